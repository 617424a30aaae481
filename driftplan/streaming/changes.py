"""Continuous reconciliation from a change log. An extension: plans themselves are batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import diff


def latest(changes: DataFrame) -> DataFrame:
    """The last state per side and path of a change log (seq, side, path, size, mtime, deleted), deletions dropped."""
    return _last(changes).where("NOT deleted").drop("deleted", "seq")


#: State is kept per key where Spark keeps it for such operators. One value a path for both sides: each access is a message.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = ", ".join(f"{side}_seq long, {side}_size long, {side}_mtime long, {side}_deleted boolean" for side in ("source", "destination"))
SIDES = {"source": 0, "destination": 4}


class _Sides(StatefulProcessor):
    """What either side last said of a path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sides", STATE)

    @staticmethod
    def _orphan(held: list) -> tuple | None:
        """Size and mtime of the source's file where the destination has none like it."""
        own, other = (tuple(held[at + 1 : at + 3]) if held[at] is not None and not held[at + 3] else None for at in SIDES.values())
        return None if own is None or own == other else own

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, found = list(self.state.get() or [None] * 8), False
        before = self._orphan(held)
        for row in rows:
            at = SIDES.get(row.side)
            if at is not None and (held[at] is None or held[at] < row.seq):
                held[at : at + 4] = row.seq, row.size, row.mtime, bool(row.deleted)
                found = True
        if found:
            self.state.update(tuple(held))
        after = self._orphan(held)
        if after != before:
            size, mtime = after or before
            yield Row(path=key[0], size=size, mtime=mtime, orphan=after is not None)

    def close(self) -> None:
        pass


def orphan_changes(changes: DataFrame) -> DataFrame:
    """A stream of (path, size, mtime, orphan) from a stream of changes: what has become an orphan, or changed as one, and what is one no longer.

    A path's last states are kept under the path. So an epoch reads and writes the state of the paths that changed, however
    large the inventories are; deleted entries keep a number, by which late changes are told. Several changes of a path
    within an epoch count as the last of them. The session's state store becomes RocksDB, which such state needs.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    used = changes.select("path", "side", "seq", "size", "mtime", "deleted")
    return used.groupBy("path").transformWithState(_Sides(), "path string, size long, mtime long, orphan boolean", "Update", "None")


def current(changed: DataFrame) -> DataFrame:
    """The orphans (path, size, mtime) after all of ``orphan_changes``' rows, each with the number of its epoch."""
    last = changed.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "orphan"), "epoch").alias("last"))
    return last.where("last.orphan").select("path", "last.size", "last.mtime")


#: Epochs after which the changes since are folded into one inventory again.
COMPACT = 20


def watch(changes: DataFrame, on_orphans: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Folds each micro-batch of ``changes`` into the inventories and hands over the orphans as they then are.

    The inventories are beside the stream's own checkpoint, a folder per epoch: an epoch adds its last changes alone, and
    every twentieth holds the whole state, and what is older than the last but one of these is deleted. A stream that starts again reads what the epochs before its own have left; an
    epoch that is done again writes the same folder. So ``on_orphans`` may see an epoch twice, but never a wrong state.
    All orphans are worked out in each epoch; ``orphan_changes`` gives what changed instead, at the cost of the changes.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark, home = batch.sparkSession, f"{checkpoint.rstrip('/')}/inventory"
        done = [(n, whole) for n, whole in _epochs(spark, home) if n < epoch]
        since = max((n for n, whole in done if whole), default=-1)
        rows = _last(batch)
        whole = epoch % COMPACT == COMPACT - 1
        state = rows
        for n, kind in done:
            if n >= since:
                state = state.unionByName(spark.read.schema(rows.schema).parquet(f"{home}/{_folder(n, kind)}"))
        (_last(state) if whole else rows).write.mode("overwrite").parquet(f"{home}/{_folder(epoch, whole)}")
        now = _last(state).where("NOT deleted")
        for n, kind in done:
            if n < since:  # an epoch that is done again is this one or a later one
                _remove(spark, f"{home}/{_folder(n, kind)}")
        on_orphans(diff.orphans(now.where("side = 'source'"), now.where("side = 'destination'")), epoch)

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).start()


def _last(rows: DataFrame) -> DataFrame:
    """The last state per side and path; aggregated before it is exchanged."""
    other = [c for c in rows.columns if c not in ("side", "path")]
    last = rows.groupBy("side", "path").agg(F.max_by(F.struct(*other), "seq").alias("last"))
    return last.select("side", "path", "last.*").select(*rows.columns)


def _folder(epoch: int, whole: bool) -> str:
    return f"{'state' if whole else 'changes'}-{epoch:012d}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _epochs(spark: SparkSession, home: str) -> list[tuple[int, bool]]:
    """(epoch, whether it holds the whole state) of the folders that are complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    full = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{n}/_SUCCESS"))]
    return sorted((int(n.split("-")[1]), n.startswith("state")) for n in full)
