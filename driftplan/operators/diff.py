"""Differences of two inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def orphans(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Source files without an entry of equal path, size and mtime at the destination."""
    return source.join(destination.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def candidates(destination: DataFrame, orphaned: DataFrame) -> DataFrame:
    """Destination files that share extension and size with an orphan; those in sync stay eligible."""
    keys = orphaned.select(paths.extension(F.col("path")).alias("ext"), "size").distinct()
    return destination.withColumn("ext", paths.extension(F.col("path"))).join(keys, ["ext", "size"], "left_semi").select(*destination.columns)


def directories(files: DataFrame) -> DataFrame:
    """Directories above the files, each with the latest mtime below it."""
    return files.select(F.explode(paths.ancestors(F.col("path"))).alias("path"), "mtime").where("path is not null").groupBy("path").agg(F.max("mtime").alias("mtime"))


def directory_touches(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Directories of both sides whose mtimes differ, with the source's; (path, mtime) in, (path, mtime) out."""
    other = destination.select("path", F.col("mtime").alias("old"))
    return source.join(other, "path").where("mtime <> old").select("path", "mtime")


def excluded(inventory: DataFrame, names: list[str]) -> DataFrame:
    """The inventory without entries of these names and all that is below directories of these names."""
    return inventory.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(n) for n in names]).cast("array<string>")))


def without_apple_doubles(inventory: DataFrame) -> DataFrame:
    """Entries whose own name starts with ._ go; what is below such a directory stays."""
    return inventory.where(~F.startswith(paths.basename(F.col("path")), F.lit("._")))


def one_file_system(inventory: DataFrame, root_dev: int) -> DataFrame:
    """Rows (path, dev, is_dir, ...) without directories on another device and all that is below them; an unknown device stays."""
    away = inventory.where(F.col("is_dir") & F.col("dev").isNotNull() & (F.col("dev") != root_dev)).select(F.col("path").alias("away"))
    above = inventory.select("path", F.explode(F.concat(F.filter(paths.ancestors(F.col("path")), lambda p: p.isNotNull()), F.array("path"))).alias("away"))
    return inventory.join(above.join(away, "away", "left_semi").select("path"), "path", "left_anti")


def summary(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("side").agg(F.count("*").alias("files"), F.sum("size").alias("total_size"))
