"""Content digests: CRC-32 of small contents, of three samples of larger ones."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Contents up to LIMIT bytes count whole; of larger ones the first HEAD, MIDDLE from the middle and the last TAIL bytes.
LIMIT, HEAD, MIDDLE, TAIL = 16_384, 8_192, 4_096, 4_096
#: Fixed value: files that may fail to be read before an index is given up.
TOLERATED = 20


def crucial_bytes(content: Column) -> Column:
    size = F.length(content)
    half = F.floor(size / 2).cast("int")
    return F.when(size <= LIMIT, content).otherwise(F.concat(F.substring(content, F.lit(1), F.lit(HEAD)), F.substring(content, half + 1, F.lit(MIDDLE)), F.substring(content, size - TAIL + 1, F.lit(TAIL))))


def fuzzy_hash(content: Column) -> Column:
    """f (full) or s (sampled) and eight hex digits. JVM only."""
    return F.concat(F.when(F.length(content) <= LIMIT, F.lit("f")).otherwise(F.lit("s")), F.lpad(F.lower(F.hex(F.crc32(crucial_bytes(content)))), 8, "0"))


def digest_files(files: DataFrame, root: str) -> DataFrame:
    """(path, size, fuzzy_hash, error) of files under ``root``, read where the task runs: at most LIMIT bytes of each.

    Files that can't be read have a null hash and an error; they match nothing. Files are dealt to tasks by path: as few
    as a join leaves in one part, they may be hours of reading.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest_path(os.path.join(root, p)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["path", "size", "fuzzy_hash", "error"])

    parts = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(parts, "path").mapInArrow(run, "path string, size long, fuzzy_hash string, error string")


def tolerated(digests: DataFrame, most: int = TOLERATED) -> DataFrame:
    """``digests`` (of ``digest_files``, written or kept, as they are read here) unchanged; an error if more than ``most`` files of the whole index couldn't be read."""
    failed = digests.where("error is not null").agg(F.count("*").alias("n"), F.min(F.concat_ws(": ", "path", "error")).alias("first")).first()
    if failed["n"] > most:
        raise OSError(f"{failed['n']} files can't be read, {most} are tolerated; first: {failed['first']}")
    return digests


def digest_path(path: str) -> tuple[int | None, str | None, str | None]:
    """(size, hash, error) of a file on this machine."""
    try:
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            if size <= LIMIT:
                return size, f"f{zlib.crc32(f.read()):08x}", None
            found = 0
            for at, n in ((0, HEAD), (size // 2, MIDDLE), (size - TAIL, TAIL)):
                f.seek(at)
                data = f.read(n)
                if len(data) < n:
                    return size, None, "short read"
                found = zlib.crc32(data, found)
            return size, f"s{found:08x}", None
    except OSError as e:
        return None, None, str(e)
