"""Applying a plan: one pass, no retries, nothing deleted, nothing at the source changed."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..progress import Progress
from ..storage import cut
from .files import Files, LocalFiles

RESULT = "exec_seq long, success boolean, error string"


def apply(plan, destination_root: str, dry_run: bool = True, reflink: bool = False, files: Files | None = None) -> Iterator[tuple[int, bool, str | None]]:
    """Performs a plan's actions in execution order, touches before the moves of the same file, and tells (exec_seq, success, error) for each.

    It goes on after failures. Copies whose source was moved in this pass read the new place; if that move failed, as it does
    where something is at its target, they read the old one. A dry run does nothing and
    counts every action as a success. ``files``: where the destination is; this machine's files by default.
    """
    rows = _passes(plan.executed())
    if dry_run:
        yield from ((row["exec_seq"], True, None) for row in rows)
    else:
        yield from _one_by_one(rows, destination_root, reflink, files or LocalFiles())


def results(plan, destination_root: str, dry_run: bool = False, reflink: bool = False, files: Files | None = None, batch: int = 10_000, progress: Progress | None = None, executed: DataFrame | None = None) -> DataFrame:
    """Performs a plan's actions and tells of them as a table (exec_seq, success, error), written once.

    Tasks perform them, where ``files`` can be used in tasks: first touches, directories and copies from where files are,
    then moves, then copies from where moves have put files, at last directories' times. So no action waits for another of
    its kind. Actions that meet another's path (``entangled``) are performed one by one in execution order, by the driver,
    after the moves; of their results no more than ``batch`` are held at a time. Files that tasks can't use are the driver's
    work throughout. ``progress`` counts what tasks have done. ``executed``: the plan's own, where it is written already;
    ordering a plan costs two sorts of it.
    """
    files, spark = files or LocalFiles(), plan.actions.sparkSession
    if not dry_run and not getattr(files, "anywhere", False):
        return _told(spark, apply(plan, destination_root, dry_run, reflink, files), batch)
    executed = cut(plan.executed(), "executed") if executed is None else executed
    if dry_run:
        return dry_results(executed)
    tied = cut(entangled(executed, destination_root), "entangled")
    free = executed.join(tied, "exec_seq", "left_anti")
    here = free.where("kind = 'mkdir' OR kind = 'touch' AND phase = 'match' OR kind = 'copy' AND from_path = planned_from")
    told = [_by_tasks(here, destination_root, reflink, files, progress, "first"), _by_tasks(free.where("kind = 'move'"), destination_root, reflink, files, progress, "moves")]
    moved = free.where("kind = 'move'").join(told[1].where("success"), "exec_seq").select(F.col("from_path").alias("planned_from"), F.col("to_path").alias("found_at"))
    late = free.where("kind = 'copy' AND from_path <> planned_from").join(moved, "planned_from", "left").withColumn("planned_from", F.coalesce("found_at", "planned_from"))
    told.append(_by_tasks(late, destination_root, reflink, files, progress, "copies"))
    rows = executed.join(tied, "exec_seq").join(moved, "planned_from", "left").withColumn("planned_from", F.coalesce("found_at", "planned_from"))
    told.append(_told(spark, _one_by_one(rows.select(*NEEDED).orderBy("exec_seq").toLocalIterator(), destination_root, reflink, files), batch))
    told.append(_by_tasks(free.where("phase = 'dirs'"), destination_root, reflink, files, progress, "times"))
    return _all(told)


#: What performing an action needs to know of it.
NEEDED = ("exec_seq", "kind", "from_path", "planned_from", "to_path", "mtime")


def entangled(executed: DataFrame, root: str) -> DataFrame:
    """Actions (exec_seq) other than touches whose outcome may depend on when another is performed.

    Their target is another's target or source, or a file that one makes or takes away is above another's path, as where a
    directory takes a file's place. Copies of a file that is moved aren't such: they find it in either place.
    """
    rows = executed.where("kind <> 'touch'")
    below = F.when(F.startswith("planned_from", F.lit(f"{root}/")), F.expr(f"substring(planned_from, {len(root) + 2})")).otherwise(F.col("planned_from"))
    targets = rows.select("exec_seq", F.col("to_path").alias("path"), F.when(F.col("kind") == "mkdir", "dir").otherwise("file").alias("role"))
    uses = targets.unionByName(rows.where("kind <> 'mkdir'").select("exec_seq", below.alias("path"), F.when(F.col("kind") == "move", "gone").otherwise("read").alias("role")))
    n = {role: F.count_if(F.col("role") == role) for role in ("file", "dir", "gone")}
    met = uses.groupBy("path").agg(F.count("*").alias("n"), *[c.alias(role) for role, c in n.items()]).where("file > 0 AND n > 1 OR gone > 1 OR gone > 0 AND dir > 0").select("path")
    change = uses.where("role IN ('file', 'gone')").select(F.col("path").alias("above"))
    above = uses.where("role <> 'read'").select("exec_seq", "path", F.explode(paths.ancestors(F.col("path"))).alias("above")).where("above IS NOT NULL")
    nested = cut(above.join(change.distinct(), "above"), "nested")
    places = met.unionByName(nested.select(F.col("above").alias("path"))).distinct()
    return uses.join(places, "path").select("exec_seq").unionByName(nested.select("exec_seq")).distinct()


def _by_tasks(rows: DataFrame, root: str, reflink: bool, files: Files, progress: Progress | None, name: str) -> DataFrame:
    """Actions that don't depend on each other, performed by tasks; a task that is tried again finds its moves done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = TaskContext.get().attemptNumber() > 0
        for batch in batches:
            done = [(row["exec_seq"], _tried(row, root, {}, reflink, files, again)) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([e is None for _, e in done], pa.bool_()), pa.array([e for _, e in done], pa.string())], names=["exec_seq", "success", "error"])

    parts = rows.sparkSession.sparkContext.defaultParallelism
    # written first, so that tasks fetch nothing: whatever ends one that has begun counts as an attempt of it
    told = cut(rows.select(*NEEDED).repartition(parts, "exec_seq"), "to-do").mapInArrow(run, RESULT)
    return cut(told if progress is None else progress.counted(told, name), "results")


def _one_by_one(rows: Iterable, root: str, reflink: bool, files: Files) -> Iterator[tuple[int, bool, str | None]]:
    moved: dict[str, str] = {}
    for row in rows:
        error = _tried(row, root, moved, reflink, files)
        yield row["exec_seq"], error is None, error


def _tried(row, root: str, moved: dict[str, str], reflink: bool, files: Files, again: bool = False) -> str | None:
    """Performs an action and gives the error, if any."""
    try:
        _perform(row, root, moved, reflink, files)
    except (OSError, ValueError) as e:
        if again and row["kind"] == "move" and os.path.lexists(os.path.join(root, row["to_path"])) and not os.path.lexists(os.path.join(root, row["from_path"])):
            return None
        return str(e)
    return None


def _told(spark: SparkSession, rows: Iterable[tuple], batch: int) -> DataFrame:
    """(exec_seq, success, error) as a table; no more than ``batch`` are held at a time."""
    return _all([cut(spark.createDataFrame(held, RESULT), "results") for held in batched(rows, batch)] or [spark.createDataFrame([], RESULT)])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def performed(executed: DataFrame, told: DataFrame) -> DataFrame:
    """The actions of a plan (its ``executed``) with how each ended, success and error; null for what wasn't tried."""
    return executed.join(told, "exec_seq", "left")


def savings(done: DataFrame) -> DataFrame:
    """By kind: actions, how many succeeded, and the bytes that these spare a transfer."""
    fine = F.col("success")
    return done.groupBy("kind").agg(F.count("*").alias("actions"), F.count_if(fine).alias("successes"), F.sum(F.when(fine, F.col("bytes_saved")).otherwise(F.lit(0))).alias("bytes_saved"))


def _passes(executed: DataFrame) -> Iterator:
    executed = cut(executed.select("phase", *NEEDED), "executed")
    for some in ("kind = 'touch' AND phase = 'match'", "kind <> 'touch'", "phase = 'dirs'"):
        yield from executed.where(some).orderBy("exec_seq").toLocalIterator()


def _perform(row, root: str, moved: dict[str, str], reflink: bool, files: Files) -> None:
    target = os.path.join(root, row["to_path"])
    if row["kind"] == "touch":
        files.touch(target, row["mtime"])
    elif row["kind"] == "mkdir":
        files.mkdir(target)
    elif row["kind"] == "move":
        files.move(os.path.join(root, row["from_path"]), target)
        moved[row["from_path"]] = row["to_path"]
    else:
        source = row["planned_from"]
        files.copy(os.path.join(root, moved.get(source, source)), target, row["mtime"], reflink)


def dry_results(executed: DataFrame) -> DataFrame:
    """What a dry run tells of each action (exec_seq, success, error), without the driver."""
    return executed.select("exec_seq", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))


def write_lines(rows: DataFrame, path: str, column: str = "path") -> None:
    """A column's values in byte order, one per line, without a line end behind the last: lists of orphans or candidates for people."""
    with open(path, "w", encoding="utf-8") as f:
        for i, row in enumerate(rows.select(column).orderBy(column).toLocalIterator()):
            f.write(("\n" if i else "") + row[0])


def write_script(lines: DataFrame, path: str) -> None:
    """Commands (seq, command) in order as an executable script."""
    with open(path, "w", encoding="utf-8") as f:
        for row in lines.orderBy("seq").toLocalIterator():
            f.write(row["command"] + "\n")
    os.chmod(path, 0o700)


def csv_lines(files: DataFrame) -> DataFrame:
    """path,size,mtime (column line), quoted as RFC 4180 has it: where a path holds a quote, a comma or a line end, begins with white space, or is \\. alone."""
    quoted = F.when(F.col("path").rlike(r'[",\r\n]|^\p{IsWhite_Space}|^\\\.$'), F.concat(F.lit('"'), F.replace("path", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("path"))
    return files.select(F.concat_ws(",", quoted, "size", "mtime").alias("line"))


def list_csv(files: DataFrame, path: str) -> None:
    """``csv_lines`` as text files."""
    csv_lines(files).write.text(path)
