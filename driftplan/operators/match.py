"""Matching orphans with candidates by digest, and what each match leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

LOCAL, AGENT = "local", "agent"


def digested(files: DataFrame, hashes: Column) -> DataFrame:
    return files.withColumn("ext", paths.extension(F.col("path"))).withColumn("hash", hashes)


def pairs(orphaned: DataFrame, candidate: DataFrame, source: DataFrame) -> DataFrame:
    """Orphans with all candidates of equal digest (path, size, mtime, ext, hash on both sides)."""
    return _joined(orphaned, _known(candidate, source))


def pick_best(orphaned: DataFrame, candidate: DataFrame, source: DataFrame) -> DataFrame:
    """One candidate per orphan: first with the orphan's name and not at the source (0), then not at the source (1), then any (2); ties by path.

    Only minima are joined: the first candidate not at the source per digest and name, and per digest the first such and
    the first of all. So equal files cost a row each, whatever their number, and no group of them is one task's work. first
    tells whether the orphan is the smallest that picked the candidate.
    """
    digest, held = ["ext", "size", "hash"], F.struct("candidate", "in_src", "synced", "cand_mtime")
    free = F.min(F.when(~F.col("in_src"), held))
    held_by = _known(candidate, source).withColumn("name", paths.basename(F.col("candidate"))).where("ext is not null and size is not null and name is not null")
    named = held_by.groupBy(*digest, "name").agg(free.alias("free"), F.min(held).alias("any"))
    some = named.groupBy(*digest).agg(F.min("free").alias("free"), F.min("any").alias("any"))
    # equal columns, and the filters that either join would add, on both sides: so they share one exchange
    same = named.select(*digest, "name", F.col("free").alias("same_name"), F.col("any").alias("same_any"))
    own = orphaned.where("hash is not null").select(F.col("path").alias("orphan"), *digest, "mtime", paths.basename(F.col("path")).alias("name"))
    met = own.join(some, digest).join(same, [*digest, "name"], "left")
    cls = F.when(F.col("same_name").isNotNull(), 0).when(F.col("free").isNotNull(), 1).otherwise(2)
    best = met.select("orphan", F.coalesce("same_name", "free", "any", "same_any").alias("p"), cls.alias("cls"), "size", "mtime").select("orphan", "p.candidate", "p.in_src", "p.synced", "cls", "size", "mtime", "p.cand_mtime")
    first = best.groupBy("candidate").agg(F.min("orphan").alias("first_orphan"))
    return best.join(first, "candidate").withColumn("first", F.col("orphan") == F.col("first_orphan")).drop("first_orphan")


def _known(candidate: DataFrame, source: DataFrame) -> DataFrame:
    at_source = source.select(F.col("path").alias("candidate"), F.col("size").alias("src_size"), F.col("mtime").alias("src_mtime"))
    there = candidate.select(F.col("path").alias("candidate"), "ext", "size", "hash", F.col("mtime").alias("cand_mtime")).where("hash is not null")
    return there.join(at_source, "candidate", "left").select("candidate", "ext", "size", "hash", "cand_mtime", F.col("src_size").isNotNull().alias("in_src"), F.coalesce((F.col("src_size") == F.col("size")) & (F.col("src_mtime") == F.col("cand_mtime")), F.lit(False)).alias("synced"))


def _joined(orphaned: DataFrame, known: DataFrame) -> DataFrame:
    own = orphaned.where("hash is not null").select(F.col("path").alias("orphan"), "ext", "size", "hash", "mtime")
    same = paths.basename(F.col("orphan")) == paths.basename(F.col("candidate"))
    return own.join(known, ["ext", "size", "hash"]).withColumn("cls", F.when(~F.col("in_src") & same, 0).when(~F.col("in_src"), 1).otherwise(2)).drop("ext", "hash")


def moves(picked: DataFrame) -> DataFrame:
    """The first orphan that picked a candidate which isn't at the source moves it."""
    return picked.where(~F.col("in_src") & F.col("first"))


def copies(picked: DataFrame, mode: str = LOCAL) -> DataFrame:
    """Copies from candidates that stay at the source or, in local mode, that another orphan has moved."""
    usable = F.col("in_src") if mode == AGENT else F.col("in_src") | ~F.col("first")
    return picked.where((F.col("candidate") != F.col("orphan")) & usable)


def touches(picked: DataFrame, mode: str = LOCAL) -> DataFrame:
    """Candidates whose mtime must change: each once, for its smallest eligible orphan. One already in sync isn't touched."""
    needed = (F.col("cand_mtime") != F.col("mtime")) & ~F.col("synced")
    if mode == LOCAL:
        needed &= F.col("in_src") | F.col("first")
    return picked.where(needed).groupBy("candidate").agg(F.min_by(F.struct("orphan", "size", "mtime"), "orphan").alias("p")).select("candidate", "p.*")


def new_directories(targets: DataFrame, existing: DataFrame | None) -> DataFrame:
    """(path, orphan): parents of ``targets`` (orphan) that don't exist yet, each with its first target. No ``existing`` directories: no check, root included."""
    made = targets.groupBy(paths.parent(F.col("orphan")).alias("path")).agg(F.min("orphan").alias("orphan"))
    return made if existing is None else made.where("path <> '.'").join(existing.select("path"), "path", "left_anti")


def archive_matches(unmatched: DataFrame, archives: DataFrame) -> DataFrame:
    """The first file, by archive order and path, with an unmatched orphan's digest. archives: archive_ord, path, ext, size, hash."""
    there = archives.where("hash is not null").groupBy("ext", "size", "hash").agg(F.min(F.struct("archive_ord", "path")).alias("hit"))
    own = unmatched.where("hash is not null").select(F.col("path").alias("orphan"), "ext", "size", "hash", "mtime")
    return own.join(there, ["ext", "size", "hash"]).select("orphan", "size", "mtime", F.col("hit.archive_ord").alias("archive_ord"), F.col("hit.path").alias("archive_path"))
