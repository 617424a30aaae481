"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents that stay, with the columns of documents.

Empty tables pass through every stage as empty tables. Very long texts are taken whole. Further columns are carried along,
whatever their names; packing returns its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixing, packing
from .common import cut, text_or_empty
from .dedup_exact import exact_dedup
from .near_text import near_dedup
from .queries import tokenizer


def written(df: DataFrame, name: str) -> DataFrame:
    """A stage's result, which outlives the scope that the stage's own intermediate tables belong to."""
    return cut(df, f"stage-{name}", keep=True)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language shows stay: those without letters (null and empty texts too), and those that two languages fit alike, go. Repeated rows fare alike; rows without id are judged by their text."""
    own = docs.toDF(*[f"own_{c}" for c in docs.columns])
    found = language.identify(own, language.fit_dictionaries(docs), "own_doc_id", "own_text", keep=tuple(own.columns))
    return found.where(~F.col("rejected")).select(*own.columns).toDF(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays. Of rows that repeat its id too, the one whose other columns are last as JSON."""
    kept = exact_dedup(docs).where("kept").select(_key("text_sha256").alias("key"))
    other = [c for c in docs.columns if c != "text"]
    rows = docs.select(_key(F.sha2(text_or_empty("text"), 256)).alias("key"), F.struct(*docs.columns).alias("row"), F.to_json(F.struct(*other)).alias("other"))
    return rows.join(kept, "key", "left_semi").groupBy("key").agg(F.max_by("row", "other").alias("row")).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; rows that repeat an id are one document. Rows without id stay, as do null and empty texts."""
    ids = near_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it. Rows that repeat id, text and source appear equally often, as the mix takes them on average."""
    mark = F.xxhash64("text", "source")
    taken = mixing.mix(docs, mark=mark).groupBy(_key("mark").alias("key")).agg(F.round(F.avg("copies")).cast("int").alias("copies")).where("copies > 0")
    rows = docs.select(_key(mark).alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(taken, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents; null and empty texts are an end token, rows that repeat an id are packed each."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


def _key(content: Column | str) -> Column:
    """Tells rows apart by id, null included, and a fingerprint of their content."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), (F.col(content) if isinstance(content, str) else content).cast("string"))
