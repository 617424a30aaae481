"""How far scans and digests are: counts while tasks run, totals when they are done."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from types import SimpleNamespace

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Progress:
    """Counts rows of several tables as tasks end, for people. A task that is tried again counts again; totals come from ``observed``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.counts: dict[str, Accumulator | SimpleNamespace] = {}
        self.finished: set[str] = set()

    def counted(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` unchanged, counted under ``name`` as they pass."""
        count = self.counts[name] = self.spark.sparkContext.accumulator(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                count.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    def counter(self, name: str) -> Callable[[int], None]:
        """For what isn't a table: a function that takes the count under ``name`` so far."""
        count = self.counts[name] = SimpleNamespace(value=0)
        return lambda n: setattr(count, "value", n)

    def now(self) -> dict[str, int]:
        return {name: count.value for name, count in self.counts.items()}

    @contextmanager
    def told(self, seconds: float, say: Callable[[dict[str, int], set[str]], None]) -> Iterator[None]:
        """Calls ``say`` with the counts, and the names that are finished, each time ``seconds`` have passed within. 0: never."""
        over = threading.Event()

        def tell() -> None:
            while not over.wait(seconds):
                say(self.now(), set(self.finished))

        teller = threading.Thread(target=tell, daemon=True)
        if seconds > 0:
            teller.start()
        try:
            yield
        finally:
            over.set()
            if seconds > 0:
                teller.join()


def observed(files: DataFrame) -> tuple[DataFrame, Observation]:
    """``files`` (size, is_dir) unchanged, and what their first action finds on its way: ``files`` and ``total_size``, without a job of their own."""
    seen, file = Observation(), ~F.col("is_dir")
    size = F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0))
    return files.observe(seen, F.count_if(file).alias("files"), size.alias("total_size")), seen
