"""A Merkle manifest of a dataset: a hash tree per group, a tree over the groups, and every row's authentication path."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Nodes that become one, and how many levels a block has: a task holds ARITY ** BLOCK_LEVELS nodes at a time.
ARITY, BLOCK_LEVELS = 3, 6
STEPS = "array<struct<at:int,others:array<string>>>"
NODE, PATH = "tree long, pos long, n long, node string", f"tree long, pos long, path {STEPS}, subroot string, root string"


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row: each value as UTF-8 byte count, colon and value, integers decimal; null is a hyphen."""
    values = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def siblings(path: Column) -> Column:
    """The digests of a path, level by level, left to right, as one string."""
    return F.array_join(F.flatten(F.transform(path, lambda s: s["others"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    others = lambda s, a, n: F.array_join(F.slice(s["others"], a, n), "")
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(others(s, F.lit(1), s["at"]), acc, others(s, s["at"] + 1, F.lit(ARITY))), 256))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", carried: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """A leaf per row over ``columns``, a subroot per value of ``group_col``, one root, and a path from each leaf to the root.

    In a group leaves ascend by id (null first, equal ids by leaf); while several nodes remain, every three in a row (the
    last run may be shorter) become the digest of their digests. Subroots by group (null first, byte by byte) give the root
    likewise. A row's path holds, per level, its place in its run and the run's other digests: what ``folded`` takes.

    Rows are numbered by a range sort, and dealt in aligned blocks of 3 ** ``levels`` nodes. Going up, a treehash stack per
    block gives the block's root; these are the next level's nodes, so a level is hundreds of times smaller than the one
    below. Going down, a block gets its own root's path once, and a traversal advances the paths within the block leaf by
    leaf: each level keeps its present run and a treehash stack that builds the next run one leaf at a time, so that beside
    the block's leaves a few nodes per level are held. The shared upper path is appended. A group of any size is many
    blocks, and no block's work depends on how large its group is.

    Null texts and other nulls are hyphens, empty texts ``0:``; very long texts are hashed whole, in the JVM. Repeated rows
    are a leaf each. An empty table has no leaves and no root. Columns beside those named are ignored, whatever their names.
    ``carried`` adds expressions over a row's columns. Returns ``id_col``, leaf, subroot, root, path, and what is carried.
    """
    carried = carried or {}
    own = docs.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_group"), leaf({c: F.col(c) for c in columns}).alias("node"), *[v.alias(f"_own_{k}") for k, v in carried.items()])
    rows, groups, longest = _placed(own)
    trees = [rows.select("tree", "pos", "n", "node")]
    trees += _upwards(trees[0], longest, levels)
    subroots = trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(groups).cast("long").alias("n"), "node")
    above = [subroots, *_upwards(subroots, groups, levels)]
    # the root's own path is empty; what comes down says which tree's root it is
    down = above[-1].select("tree", "pos", F.array().cast(STEPS).alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for k in range(len(above) - 2, -1, -1):
        down = cut(_downwards(above[k], down, k, levels), "merkle-paths")
    named = down.join(subroots.select("pos", F.col("node").alias("own")), "pos")
    down = named.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("own").alias("subroot"), "root")
    for k in range(len(trees) - 2, 0, -1):
        down = cut(_downwards(trees[k], down, k, levels), "merkle-paths")
    if len(trees) == 1:  # every group is a single leaf
        found = rows.join(down, ["tree", "pos"])
    else:
        found = _downwards(rows, down, 0, levels)
    return found.select(F.col("_id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", *[F.col(f"_own_{k}").alias(k) for k in carried])


def _placed(own: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows with the number of their group (tree), their place in it (pos) and the group's size (n); how many groups there are, and the largest size.

    No join is by group alone: a group's rows meet what is known of it part by part of the range sort.
    """
    placed = cut(own.orderBy(F.col("_group").asc_nulls_first(), F.col("_id").asc_nulls_first(), "node").withColumn("_at", F.monotonically_increasing_id()), "merkle-leaves")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    held = placed.groupBy("_group", part.alias("_part")).agg(F.count("*").alias("_n"), F.min(within).alias("_low"))
    whole = Window.partitionBy("_group")
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = held.select("_group", "_part", "_low", F.sum("_n").over(whole).alias("n"), F.min("_part").over(whole).alias("_first"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    # groups that start in one part are numbered there, behind those of the parts before it
    starts = cut(known.withColumn("_new", F.col("_part") == F.col("_first")), "merkle-groups")
    sizes = starts.where("_new").groupBy("_part").agg(F.count("*").alias("_groups"), F.max("n").alias("_longest"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offset = sizes.select(F.col("_part").alias("_first"), F.coalesce(F.sum("_groups").over(before), F.lit(0)).alias("_offset"))
    total = sizes.agg(F.sum("_groups").alias("groups"), F.max("_longest").alias("longest")).first()
    place = F.row_number().over(Window.partitionBy("_first").orderBy(F.col("_group").asc_nulls_first())) - 1
    tree = starts.where("_new").join(offset, "_first").select(F.col("_group").alias("_name"), (F.col("_offset") + place).alias("tree"))
    known = starts.join(tree, F.col("_group").eqNullSafe(F.col("_name"))).select(F.col("_group").alias("_name"), F.col("_part").alias("_where"), "_low", "n", "_ahead", "tree")
    met = placed.withColumn("_part", part).join(known, (F.col("_part") == F.col("_where")) & F.col("_group").eqNullSafe(F.col("_name")))
    rows = met.withColumn("pos", within - F.col("_low") + F.col("_ahead")).drop("_part", "_where", "_name", "_low", "_ahead", "_at", "_group")
    return rows, total["groups"] or 0, total["longest"] or 0


def _size(k: int, levels: int) -> Column:
    """How many nodes a tree has after ``k`` blocks' levels."""
    return F.ceil(F.col("n") / F.lit(ARITY ** (levels * k))).cast("long")


def _upwards(nodes: DataFrame, longest: int, levels: int) -> list[DataFrame]:
    """The tables of block roots above ``nodes``, until no tree has more than one node."""
    out, block = [], ARITY**levels
    while longest > 1:
        k = len(out)
        grouped = nodes.withColumn("_size", _size(k, levels)).withColumn("block", F.floor(F.col("pos") / block).cast("long")).groupBy("tree", "block")
        nodes = cut(grouped.applyInArrow(_root_of(levels), NODE), "merkle-nodes")
        out.append(nodes)
        longest = -(-longest // block)
    return out


def _downwards(nodes: DataFrame, upper: DataFrame, k: int, levels: int) -> DataFrame:
    """Paths of ``nodes``, given the paths of the nodes above them. At the leaves (k 0, further columns) the rows keep their columns."""
    block = ARITY**levels
    grouped = nodes.withColumn("_size", _size(k, levels)).withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    kept = nodes.schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"path {STEPS}", "subroot string", "root string"])
    return grouped.groupBy("tree", "block").cogroup(upper.groupBy("tree", "pos")).applyInArrow(_paths_of(kept.names, levels), schema)


class _Treehash:
    """A stack that takes digests from the left and completes nodes of ``level``; it holds fewer than ARITY of each level below."""

    def __init__(self, level: int):
        self.stack: list[list[bytes]] = [[] for _ in range(level + 1)]

    def take(self, digest: bytes, level: int = 0) -> None:
        stack = self.stack
        stack[level].append(digest)
        while level < len(stack) - 1 and len(stack[level]) == ARITY:
            digest, stack[level], level = _hashed(stack[level]), [], level + 1
            stack[level].append(digest)

    def flush(self) -> list[bytes]:
        """The nodes of the top level; what is left below, at the end of the leaves, becomes shorter runs."""
        for level, held in enumerate(self.stack[:-1]):
            if held:
                self.stack[level] = []
                self.stack[level + 1].append(_hashed(held))
        out, self.stack[-1] = self.stack[-1], []
        return out


def _hashed(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def _height(size: int, levels: int) -> int:
    """Levels within a block of a tree with ``size`` nodes: a tree of one block stops at its root, in others every block has all levels."""
    height = 0
    while height < levels and size > 1:
        size, height = -(-size // ARITY), height + 1
    return height


def paths(leaves: list[bytes], height: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Each leaf's path to the block's root in turn, as (place in the run, other digests) per level."""
    spans = [ARITY ** (level + 1) for level in range(height)]
    now, ahead = [], []
    for level, span in enumerate(spans):  # the first runs, as the tree's setup leaves them
        first = _Treehash(level)
        for x in leaves[:span]:
            first.take(x)
        now.append(first.flush())
        ahead.append(_Treehash(level))
    for i in range(len(leaves)):
        path = []
        for level, span in enumerate(spans):
            if i and i % span == 0:
                now[level] = ahead[level].flush()
            if i + span < len(leaves):
                ahead[level].take(leaves[i + span])
            at = i * ARITY // span % ARITY
            path.append((at, now[level][:at] + now[level][at + 1 :]))
        yield path


def _in_order(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    table = table.sort_by("pos")
    return table, [x.encode() for x in table["node"].to_pylist()]


def _root_of(levels: int):
    def run(table: pa.Table) -> pa.Table:
        table, leaves = _in_order(table)
        height = _height(table["_size"][0].as_py(), levels)
        tree = _Treehash(height)
        for x in leaves:
            tree.take(x)
        return pa.table({"tree": table["tree"][:1], "pos": table["block"][:1], "n": table["n"][:1], "node": pa.array([tree.flush()[0].decode()])})

    return run


def _paths_of(names: list[str], levels: int):
    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, leaves = _in_order(table)
        shared = upper["path"][0].as_py()
        found = [
            [{"at": at, "others": [x.decode() for x in others]} for at, others in path] + shared for path in paths(leaves, _height(table["_size"][0].as_py(), levels))
        ]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
        every = pa.table({"path": pa.array(found, kind)})
        for name in ("subroot", "root"):
            every = every.append_column(name, pa.array(upper[name].to_pylist() * len(leaves), pa.string()))
        for i, name in enumerate(names):
            every = every.add_column(i, name, table[name])
        return every

    return run
