"""Mixing sources to target weights. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that one task puts in order, about.
SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_quality(text: Column) -> Column:
    """1 for prose, less the more ASCII signs and digits a text holds; 0.05 at least. Null and empty texts: 1."""
    signs = F.length(text) - F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * signs / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def uniform(name: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(name.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, mark: Column | None = None) -> DataFrame:
    """How many words of each document a mix takes, so that sources come to their targets.

    Sources, by code point with null last, get ``weights`` in turn. They share ``share`` of all words by weight; no target
    exceeds ``max_epochs`` times the source's size, and what that leaves goes to the others by weight. A source first gives
    as many complete epochs as its target holds. For the rest, documents get Efraimidis-Spirakis keys -ln(u)/quality and are
    taken whole in the order of keys, by prefix sums, as long as that brings the sum nearer to the target.

    Rows are dealt to ranges of source and key, as measured, whose sums are added up first: neither a source that holds
    most rows nor keys that crowd are one task's work. Null and empty texts have size 0 and are never taken; a source of
    size 0 has target 0. Very long texts count whole. Ties in the key go by id and size; rows that repeat an id count each.
    u depends on id and seed alone: reruns agree. An empty table gives an empty result. Other columns are ignored, whatever
    their names. Returns ``id_col``, source, size, source_size, target, taken, copies (taken / size), and ``mark``, a column
    of ``docs`` to carry along, if given.
    """
    value = symbol_quality(F.col(text_col)) if quality is None else quality
    sized = cut(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), value.alias("quality"), *([] if mark is None else [mark.alias("mark")]))
        .withColumn("key", -F.log(uniform(F.col("id"), seed)) / F.col("quality")),
        "mix-sizes",
    )
    targets = cut(_targets(sized, weights, max_epochs, share), "mix-targets")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["of"]))
    carried = [] if mark is None else ["mark"]
    placed = rows.select("id", "source", "size", "key", "source_size", "target", "place", *carried)
    order = [F.col(c) for c in ("place", "key", "id", "size")]
    summed = running(placed, order, {"upto": F.col("size")}, ("place",))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    return (
        summed.withColumn("before", F.col("upto") - F.col("size"))
        .withColumn("epochs", epochs)
        .withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + (2 * (left - F.col("before")) > F.col("size")).cast("long")).otherwise(F.lit(0)).cast("long"))
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *carried)
    )


def _targets(sized: DataFrame, weights: tuple[float, ...], max_epochs: int, share: float) -> DataFrame:
    """One row per source."""
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    parts = max(1, -(-n // SOURCES))

    def summed(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
        if parts > 1:
            return running(rows, order, sums, parts=parts)
        upto = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per source, at most SOURCES
        return rows.select("*", *[F.sum(v).over(upto).alias(k) for k, v in sums.items()])

    turn = summed(sources, [F.col("source").asc_nulls_last()], {"turn": F.lit(1)})
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = turn.withColumn("place", F.col("turn") - 1).withColumn("weight", F.get(table, F.col("place") % len(weights))).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    # sources that reach their caps first, in order of cap per weight: what is left for the others is shared by weight
    full = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = summed(full, [F.col("ratio"), F.col("place")], {"caps": F.col("cap"), "weighed": F.col("weight")})
    every = upto.agg(F.sum("weight")).first()[0]
    left = F.lit(share * float(total or 0)) - (F.col("caps") - F.col("cap"))
    others = F.lit(float(every or 0)) - (F.col("weighed") - F.col("weight"))
    level = cut(upto.withColumn("level", left / others).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight")), "mix-levels")
    final = level.where("NOT full").agg(F.min(F.struct("ratio", "place", "level"))).first()[0]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.lit(float(final["level"]) if final else 0.0) * F.col("weight"))
    return level.select(F.col("source").alias("of"), "place", "source_size", F.round(target, 6).alias("target"))
