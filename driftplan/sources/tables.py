"""Small text sources: exclusion lists and mount tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Names that scans leave out unless a list replaces them.
DEFAULT_EXCLUSIONS = (
    "$RECYCLE.BIN",
    "desktop.ini",
    "Thumbs.db",
    ".picasaoriginals",
    ".picasa.ini",
    ".Trashes",
    ".TemporaryItems",
    ".Spotlight-V100",
    ".DS_Store",
    ".fseventsd",
    "_PAlbTN",
    "System Volume Information",
)


def exclusions(lists: DataFrame, column: str = "value") -> DataFrame:
    """Distinct names of line-separated lists: trimmed, empty lines dropped, any line ends."""
    return lists.select(F.explode(F.split(F.col(column), "\r\n|\n|\r")).alias("name")).select(F.regexp_replace("name", r"^\s+|\s+$", "").alias("name")).where("name <> ''").distinct()


def mounts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(mountpoint, fstype) of mount table lines: fields between blanks or tabs, octal escapes undone."""
    fields = F.split(F.trim(F.col(column)), "[ \t]+")
    return lines.where(F.size(fields) >= 3).select(text.octal_unescaped(F.get(fields, F.lit(1))).alias("mountpoint"), F.get(fields, F.lit(2)).alias("fstype"))


def mount_of(paths: DataFrame, table: DataFrame, path: str = "path") -> DataFrame:
    """Each path with the longest mount point above it. Joined on the path's own ancestors, so no path meets the whole table."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    hits = paths.select(path, F.explode(above).alias("mountpoint")).join(table, "mountpoint")
    return hits.groupBy(path).agg(F.max_by(F.struct("mountpoint", "fstype"), F.length("mountpoint")).alias("m")).select(path, "m.*")


def first_few(names: DataFrame, column: str = "name", n: int = 3) -> DataFrame:
    return names.orderBy(column).limit(n)
