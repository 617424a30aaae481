"""The cluster's shared folder, and lineage cuts through it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one in local mode; an error on a cluster."""
    path = spark.conf.get(SETTING, None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="driftplan-")
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def home(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/driftplan/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; DataFrames that read it are of no use afterwards."""
    _delete(spark, home(spark))


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


_swept: set[str] = set()
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was written within it: for work whose result is read, or written elsewhere, before that.

    What is written with ``keep`` within a scope belongs to the scope around it, if there is one. Threads share scopes.
    """
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        del _scopes[next(i for i, s in enumerate(_scopes) if s is own)]
        for path in own:
            _delete(spark, path)


def scoped(spark: SparkSession, path: str, keep: bool = False) -> str:
    """Notes a path in the shared folder for deletion: at the end of the present scope, and of the application at the latest."""
    own = home(spark)
    if own not in _swept:
        _swept.add(own)
        atexit.register(_sweep_at_exit, spark)
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    return path


def cut(df: DataFrame, name: str = "cut", keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a DataFrame that reads it: lineage ends there and lost executors lose nothing.

    The files are deleted at the end of the scope around, by ``sweep``, or when the driver's Python ends.
    """
    path = scoped(df.sparkSession, f"{home(df.sparkSession)}/{name}-{uuid.uuid4().hex}", keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sweep_at_exit(spark: SparkSession) -> None:
    try:
        sweep(spark)
    except Exception:  # the session may be gone: then the files stay until the folder is cleared
        pass


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place (from 1) in a total ``order``, without a window over all rows: range-partitioned, sorted, and counted part by part."""
    low = (1 << 33) - 1
    placed = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    # one row per partition: as small as the number of tasks
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    kept = [c for c in df.columns if c != name]
    return placed.withColumn("_part", part).join(F.broadcast(ahead), "_part").select(*kept, (F.col("_ahead") + F.col("_id").bitwiseAND(low) + 1).cast("long").alias(name))
