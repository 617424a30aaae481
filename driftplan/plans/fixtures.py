"""Inventories derived from the documents table, as FIXTURES.md defines them, and real trees of their files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff
from ..storage import home, scoped

DERIVED = """
SELECT doc_id, coalesce(text, '') AS text, lang, source, doc_id % 10 AS k, 1700000000 + doc_id * 60 AS t,
  concat(source, '/', lang, '/doc_', doc_id, '.', CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE lang END) AS p
FROM {documents}"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DERIVED.format(documents="{documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _files(df: DataFrame) -> DataFrame:
    content = F.col("text").cast("binary")
    return df.select("path", F.length(content).cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime"), content.alias("content"))


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_base(spark, sf_dir).where("k <= 8").selectExpr("p AS path", "t AS mtime", "text"))


def destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(
        _base(spark, sf_dir).where("k <> 7").selectExpr(
            "CASE k WHEN 4 THEN concat('old/', lang, '/doc_', doc_id, '.', lang) WHEN 5 THEN concat(CASE WHEN doc_id % 20 = 5 THEN 'zz' ELSE source END, '/renamed_', doc_id, '.', lang) ELSE p END AS path",
            "CASE WHEN k IN (5, 6) THEN t + 3600 ELSE t END AS mtime",
            "CASE k WHEN 8 THEN concat(text, 'x') ELSE text END AS text",
        )
    )


#: Directories that the destination has beside those above its files, most of them empty there.
EMPTY = "SELECT DISTINCT concat(source, '/', lang) AS path FROM {base} WHERE doc_id % 3 = 0 UNION SELECT concat('hollow/', lang) FROM {base}"


def empty_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EMPTY.format(base="{base}"), base=_base(spark, sf_dir))


#: Two archives: the second holds all that the first does, under names that come before, and as much again.
ARCHIVED = """
SELECT 0 AS archive_ord, concat('/archive/', lang, '/', {name}) AS path, t AS mtime, text FROM {base} WHERE k = 7 AND doc_id % 20 = 7
UNION ALL SELECT 1, concat('/also/', lang, '/', {name}), t, text FROM {base} WHERE k = 7"""


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(ARCHIVED.format(name="substring_index(p, '/', -1)", base="{base}"), base=_base(spark, sf_dir))
    return rows.select("archive_ord", "path", F.length(F.col("text").cast("binary")).cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime"), F.col("text").cast("binary").alias("content"))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which must be one that tasks and driver see as files."""
    root = home(spark).removeprefix("file:")
    if "://" in root.lstrip("/"):
        raise ValueError(f"{root} isn't a folder of files")
    path = scoped(spark, f"{root}/{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def tree(files: DataFrame, name: str) -> str:
    """Writes files (path, mtime, content) below a new folder in the shared one, by tasks, and gives its path.

    Directories get the latest mtime below them, as ``diff.directories`` says. Beside every seventh file by size is a link
    to it, which scans leave out. Most of the time is the file system's, so a task asks it for as little as it can: a
    directory is made once, a file is opened once, and a link names its neighbour, which needs no block of its own.
    """
    root = folder(files.sparkSession, name)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for path, mtime, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                full = os.path.join(root, path)
                above, name = os.path.split(full)
                if above not in made:
                    os.makedirs(above, exist_ok=True)
                    made.add(above)
                if len(content) % 7 == 0:
                    with suppress(FileExistsError):  # of a task that was tried before
                        os.symlink(name, f"{full}.link")
                with open(full, "wb") as f:
                    f.write(content)
                    f.flush()
                    os.utime(f.fileno(), (mtime, mtime))
            yield batch.select([0])

    def date(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, mtime in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                os.utime(os.path.join(root, path), (mtime, mtime))
            yield batch.select([0])

    files.select("path", "mtime", "content").mapInArrow(put, "path string").count()
    diff.directories(files).select("path", "mtime").mapInArrow(date, "path string").count()
    return root
