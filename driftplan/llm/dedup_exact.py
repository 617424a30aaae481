"""Exact deduplication by deterministic block naming. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """Groups rows whose texts are byte for byte equal; of each group the row with the largest id stays.

    Texts are cut into blocks of ``block_bytes`` bytes. The distinct blocks, sorted, get integer names; then adjacent
    pairs of names are sorted and named in turn, level after level, until every document has a single name. A document's
    identity (level, name) is equal to another's exactly if the texts are equal.

    While blocks travel they are keyed by 128 bits of fingerprint; every run proves on its own data that no two
    different blocks share a key, and starts over with another seed if any do, so that names never collide. The text
    crosses the network once, pre-aggregated, and never as a group: later steps move integers.

    Returns one row per input row: ``id_col``, keep_id, group_size, kept, text_sha256, n_bytes. A null text counts as
    empty; very long texts are more blocks and more levels. Rows that repeat an id and a text are one group of which a single row is kept; a null id sorts below all
    others. An empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("bytes"))
    seed = 0
    while True:
        keyed = [F.xxhash64(F.lit(seed), "block").alias("h1"), F.xxhash64(F.lit(seed + 1), "block", F.lit(seed)).alias("h2")]
        blocks = _blocks(source, block_bytes)
        named = cut(_block_names(blocks.select(*keyed, "block")), "block-names")
        if named.where("texts > 1").isEmpty():
            break
        seed += 2
    spans = cut(blocks.select("row", "id", "sha", "n_bytes", "n", "pos", *keyed), "blocks")
    level, longest = 0, spans.agg(F.max("n")).first()[0] or 0
    rows = spans.join(named, ["h1", "h2"]).select("row", "id", "sha", "n_bytes", "n", "pos", "name")
    whole = None
    while True:
        done = rows.where("n = 1").select("row", "id", "sha", "n_bytes", F.lit(level).alias("level"), "name")
        whole = done if whole is None else whole.unionByName(done)
        if longest <= 1:
            break
        rows = _name_pairs(rows.where("n > 1"))
        level, longest = level + 1, (longest + 1) // 2
    return _groups(cut(whole, "names"), id_col)


def _blocks(source: DataFrame, size: int) -> DataFrame:
    n = F.greatest(F.ceil(F.length("bytes") / F.lit(size)), F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))
    return (
        source.select("id", "bytes", F.sha2("bytes", 256).alias("sha"), F.length("bytes").cast("long").alias("n_bytes"), n.alias("n"), F.monotonically_increasing_id().alias("row"))
        .select("row", "id", "sha", "n_bytes", "n", F.posexplode(each).alias("pos", "block"))
    )


def _block_names(blocks: DataFrame) -> DataFrame:
    """The distinct blocks in sorted order (first bytes, then key), with their ranks as names; texts: how many blocks share a key."""
    return (
        blocks.distinct()
        .groupBy("h1", "h2")
        .agg(F.min(F.hex(F.substring("block", 1, 8))).alias("head"), F.count("*").alias("texts"))
        .orderBy("head", "h1", "h2")
        .select("h1", "h2", "texts", F.monotonically_increasing_id().alias("name"))
    )


def _name_pairs(rows: DataFrame) -> DataFrame:
    """One level up: each document's adjacent names, two by two, become one name."""
    first, even = F.pmod("pos", F.lit(2)) == 0, F.col("pos").bitwiseAND(-2)
    once = lambda c: F.max(F.when(F.col("pos") == 0, F.col(c))).alias(c)  # noqa: E731  carried by the first pair alone
    pairs = cut(
        rows.groupBy("row", F.shiftright(even, 1).alias("pos"))
        .agg(F.max("n").alias("n"), F.max(F.when(first, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~first, F.col("name"))), F.lit(-1)).alias("b"), once("id"), once("sha"), once("n_bytes")),
        "pairs",
    )
    names = cut(pairs.select("a", "b").distinct().orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")), "pair-names")
    return pairs.join(names, ["a", "b"]).select("row", "id", "sha", "n_bytes", F.shiftright(F.col("n") + 1, 1).alias("n"), "pos", "name")


def _groups(whole: DataFrame, id_col: str) -> DataFrame:
    groups = cut(whole.groupBy("level", "name").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size")), "groups")
    return whole.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col),
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_bytes",
    )
