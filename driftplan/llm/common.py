"""Shared plumbing: lineage cuts, running sums, small Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, shared_dir

__all__ = ["cut", "no_surrogates", "partitions", "pieces", "running", "safe_parts", "shared_dir", "spread", "text_or_empty", "through_tree"]

#: Blocks whose messages one task of a bucket takes, about; beyond, messages are combined in a tree.
FAN = 1_000
MESSAGE = "block long, bucket int, body binary"

def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], group: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """``df`` with running sums, the row's own value included, in a total ``order`` (that starts with ``group``, not null, if given).

    Rows are dealt to ``parts`` ranges of ``order``, which Spark measures; each range sums up its rows, and what lies before
    it is added: no window holds more than a range's rows, or a row per range.
    """
    named = df.select("*", *[v.alias(f"_of_{k}") for k, v in sums.items()])
    placed = cut(named.repartitionByRange(parts or partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    held = placed.groupBy(*group, "_part").agg(*[F.sum(f"_of_{k}").alias(f"_of_{k}") for k in sums])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut(held.select(*group, "_part", *[F.coalesce(F.sum(f"_of_{k}").over(before), F.lit(0)).alias(f"_ahead_{k}") for k in sums]), "range-sums")
    own = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(ahead, [*group, "_part"]).select(*df.columns, *[(F.col(f"_ahead_{k}") + F.sum(f"_of_{k}").over(own)).alias(k) for k in sums])


def spread(text: Column, chars: int, n: int) -> Column:
    """A text of up to ``chars`` characters whole; of a longer one ``n`` pieces, ``chars`` together, from its beginning to its end."""
    size = chars // n
    step = (F.length(text) - size) / (n - 1)
    parts = F.transform(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(parts, " "))


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of record batches whose texts (null: empty) hold about ``limit`` characters, so that working memory doesn't follow Spark's batches. A longer text comes alone."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= limit):
                held += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def no_surrogates(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def safe_parts(text: str, limit: int = 1_000_000) -> list[str]:
    """A long text in parts of about ``limit`` characters, cut before blanks that stand between two letters: no word or token spans such a cut."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        i = at + limit
        while (i := text.find(" ", i)) > 0 and not (text[i - 1].isalpha() and text[i + 1 : i + 2].isalpha()):
            i += 1
        if i < 0:
            break
        out.append(text[at:i])
        at = i
    return [*out, text[at:]]


def through_tree(messages: DataFrame, senders: int, answer: Callable, combine: Callable, deal: Callable) -> DataFrame:
    """Answers to messages (block, bucket, body), as messages: ``answer`` takes a table with all that a bucket got.

    With more than ``FAN`` senders, groups of about so many are combined first, bucket by bucket, and answered as one sender;
    the groups then deal the answers out. So what every block asks for is one task's work nowhere. ``combine`` makes one body
    of several, ``deal`` takes the same bodies and the answer to the combined one and gives an answer to each.
    """
    if senders <= FAN:
        return messages.groupBy("bucket").applyInArrow(answer, MESSAGE)
    groups = -(-senders // FAN)

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        return pa.table({"block": table["group"][:1], "bucket": table["bucket"][:1], "body": pa.array([combine(table["body"].to_pylist())], pa.binary())})

    def down(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        return pa.table({"block": table["block"], "bucket": table["bucket"], "body": pa.array(deal(table["body"].to_pylist(), answers["body"][0].as_py()), pa.binary())})

    grouped = messages.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    combined = cut(grouped.groupBy("group", "bucket").applyInArrow(up, MESSAGE), "combined")
    answers = through_tree(combined, groups, answer, combine, deal).toDF("to", "of", "body")
    return grouped.groupBy("group", "bucket").cogroup(answers.groupBy("to", "of")).applyInArrow(down, MESSAGE)
