"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """Lower-cased suffix from the last dot of the last segment, dot included; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def parent(path: Column) -> Column:
    """Everything before the last slash; a dot if there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def joined(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def relative(root: Column, path: Column) -> Column:
    """``path`` without the prefix ``root`` and the slash behind it; null if it doesn't start so. The root itself is a dot."""
    rest = F.substring(path, F.length(root) + 1, F.length(path))
    rest = F.when(F.startswith(rest, F.lit("/")), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
    return F.when(path == root, F.lit(".")).when(F.startswith(path, root), rest)


def ancestors(path: Column) -> Column:
    """All directories above a path, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), n), "/")))
