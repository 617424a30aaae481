"""Connected components of a link table, by contraction and alternating stars, and how large groups are dealt to tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions


#: Members of a large group that all its pieces hold, about.
SHOWN = 8
#: Links that one task contracts at a time.
FEW = 250_000
#: Neighbours of a hub that one task takes, at least; more with more links than so many a partition.
HUB = 1_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): root is the smallest node reachable.

    Up to FEW links are one task's work. More are contracted in as many tasks as that takes; then large stars and small
    stars alternate until nothing changes: every node hooks its larger, then its smaller neighbours to the smallest one
    around. Each round is aggregates and joins on nodes; a hub's neighbours are dealt to several tasks. No links or roots
    reach the driver, only their number and checksum.
    """
    spark = links.sparkSession
    edges = cut(links.select("a", "b").where("a <> b"), "links")
    parts = -(-edges.count() // FEW)
    if parts:
        edges = edges.repartition(parts).mapInArrow(_contract, "a long, b long")
    if parts > 1:
        edges = cut(_clean(edges), "links")
        state = _state(edges)
        while True:
            most = max(HUB, -(-state[0] // partitions(spark)))
            edges = cut(_small_star(_large_star(edges, most), most), "links")
            now = _state(edges)
            if now == state:
                break
            state = now
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.col("b").alias("root")) for c in ("a", "b")])
    return edges.select(F.explode(ends).alias("x")).select("x.*").distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task, as few as connect the same: each node with the smallest one that these links reach."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate((table["a"].to_numpy(), table["b"].to_numpy())), return_inverse=True)
        root = merge_roots(np.arange(len(nodes)), at[: table.num_rows], at[table.num_rows :])
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def _clean(pairs: DataFrame) -> DataFrame:
    """Distinct links, each from the larger to the smaller node."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, most: int) -> DataFrame:
    """Links (a, b) with m, the smallest b of their a. Hubs with over ``most`` links are dealt by a salt."""
    least = edges.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / F.lit(most)))
    # each of these has over ``most`` links, at least as many as a partition's share: at most two rows a partition
    hot = F.broadcast(least.where(F.col("salts") > 1).select(F.col("hub").alias("a"), "salts"))
    dealt = edges.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"))
    there = least.select("hub", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("of"))
    return dealt.join(there, (F.col("a") == F.col("hub")) & (F.col("salt") == F.col("of"))).select("a", "b", "m")


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _clean(_with_least(both, most).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("b"))
    return _clean(_with_least(edges, most).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least))


def merge_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after links a-b: each root hooks to the smallest that it meets, until all agree."""
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        up = np.arange(len(root))
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def sizes(rows: DataFrame, group: str, side: int, weight: str, heavy: int) -> DataFrame:
    """(group, members, chunks) of the groups of two or more: chunks of about ``side`` members and ``heavy`` of ``weight``."""
    held = rows.groupBy(group).agg(F.count("*").alias("members"), F.sum(weight).alias("heft")).where("members > 1")
    return cut(held.select(group, "members", F.greatest(F.ceil(F.col("members") / F.lit(side)), F.ceil(F.col("heft") / F.lit(heavy))).cast("long").alias("chunks")), "group-sizes")


def deal(rows: DataFrame, group: str, node: str, sized: DataFrame) -> DataFrame:
    """Members of each group in its pieces (column piece): each in one, but a few, drawn evenly, in all, so that pieces meet."""
    both = rows.join(sized, group)
    everywhere = F.pmod(F.xxhash64(F.lit(3), node, group), F.col("members")) < SHOWN
    own = F.pmod(F.xxhash64(F.lit(5), node, group), F.col("chunks"))
    pieces = F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own))
    return both.withColumn("piece", F.explode(pieces)).drop("members", "chunks")


def deal_rest(rows: DataFrame, group: str, node: str, sized: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """What ``deal`` leaves: pieces in which every two members of a group whose ``key`` has different roots meet.

    Groups that are connected are done. In the others, the members with the most frequent root needn't meet each other:
    chunks of the other ones meet each other and the chunks of these.
    """
    large = cut(rows.join(sized.where("chunks > 1"), group).join(roots.select(F.col("node").alias(key), "root"), key, "left").withColumn("root", F.coalesce("root", key)), "large-groups")
    by_root = large.groupBy(group, "root").agg(F.count("*").alias("n"))
    split = by_root.groupBy(group).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), (F.sum("n") - F.max("n")).alias("rest")).where("roots > 1")
    side = F.ceil(F.col("members") / F.col("chunks"))
    held = large.join(split, group).withColumn("others", F.greatest(F.ceil(F.col("rest") / side), F.lit(1)).cast("long"))
    at_main, others = F.col("root") == F.col("main"), F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    held = held.withColumn("own", F.pmod(F.xxhash64(F.lit(7), node, group), F.when(at_main, F.col("chunks")).otherwise(F.col("others"))))
    # a piece is chunk i of the others with chunk j of them (j >= i) or, counted on, with chunk j of the main ones
    crossed = F.transform(others, lambda i: i * F.lit(1 << 30) + F.col("others") + F.col("own"))
    among = F.transform(others, lambda i: F.least(i, F.col("own")) * F.lit(1 << 30) + F.greatest(i, F.col("own")))
    beside = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.col("own") * F.lit(1 << 30) + F.col("others") + j)
    pieces = F.when(at_main, crossed).otherwise(F.concat(among, beside))
    return held.withColumn("piece", F.explode(pieces)).drop("members", "chunks", "main", "roots", "rest", "others", "own")


def by_group(rows: DataFrame, keys: tuple[str, ...], work: Callable[[pa.Table], Iterator[tuple[np.ndarray, ...]]], schema: str, names: tuple[str, ...]) -> DataFrame:
    """Sorts rows by long ``keys`` and hands ``work`` runs of whole groups as tables, with the places where groups begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
            found = list(work(table, bounds)) or [tuple(np.zeros(0, np.int64) for _ in names)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            of = [table[k].to_numpy() for k in keys]
            starts = np.concatenate(([0], np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in of])) + 1))
            if starts[-1]:
                yield done(table.slice(0, int(starts[-1])).combine_chunks(), starts)
            held = table.slice(int(starts[-1])).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield done(table, np.array([0, table.num_rows]))

    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
