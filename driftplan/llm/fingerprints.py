"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segment
from .common import cut, no_surrogates, partitions, pieces

#: Bins of a fingerprint, low-order bits kept of each, and words of a shingle.
BINS, BITS, WIDTH = 256, 4, 5
#: Characters of text hashed at a time, and of the whole table in one sorted range, about.
CHUNK_CHARS, RANGE_CHARS = 500_000, 64_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
WHITE = re.compile(r"[\x20\x09-\x0D]")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """A fingerprint per document: ``id_col``, n_chars (code points), fingerprint (hex of bins * bits / 8 bytes).

    Every distinct ``width``-word shingle is hashed once; the hash says which of ``bins`` bins it falls into and its value
    there, and a bin keeps its smallest. An empty bin takes the value of the first filled bin in a random order of its own,
    the same for all documents (optimal densification), so that two documents agree in a bin with a probability that
    equals the Jaccard similarity of their shingle sets, filled or not. Of the value, mixed with the bin's number, the
    lowest ``bits`` bits are stored. ``likeness`` undoes the agreement by chance, 2 ** -bits.

    A text with fewer words is one shingle. Null texts, and texts without words, have no shingles and an empty fingerprint.
    Very long texts are taken whole, some words at a time. Repeated rows get a row each, equal texts equal fingerprints; a
    null id is carried. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    used = docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            found = [*packed(codes(texts, bins, bits, width), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.string())], names=[id_col, "n_chars", "fingerprint"])

    return used.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string")


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_chars: int = RANGE_CHARS, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """How stable fingerprints are under edits: each document beside its edited text and beside the next document.

    The next document is the next lower id (null last; rows that repeat an id in the order of a hash of their text); the
    first one follows the last. In the edited text the last third is replaced by as much of the next document's beginning.
    Rows are dealt to ranges of ids, sorted, and met with their neighbours as they pass; only a range's first and last row
    cross to the range beside it. So a text travels once, and a task holds a chunk of its range.

    Nulls, empty and very long texts, repeated rows and other columns are as ``fingerprint`` has them; a document alone in
    its table is its own next one. Returns ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    chars = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    tie = [F.col("id").desc_nulls_last(), F.xxhash64("text"), "at"]
    used = docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text").withColumn("at", F.monotonically_increasing_id())
    # texts aren't among the keys: Spark samples keys on the driver to find the ranges
    placed = used.repartitionByRange(max(partitions(spark), -(-chars // part_chars)), *tie).sortWithinPartitions(*tie).select("id", "text")
    result = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    of = (bins, bits, width)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, kind_ = TaskContext.get().partitionId(), None, None
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            kind_, ids, own = batch.schema.field(0).type, batch.column(0).to_pylist(), codes(texts, *of)
            if last is None:
                yield _edge(part, "first", ids[0], texts[0], packed(own[:1], bits)[0], kind_, names)
            else:
                ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate((last[2], own))
            if len(ids) > 1:
                done = _beside(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:], kind_, names, of)
                yield pa.RecordBatch.from_arrays([pa.array([part] * done.num_rows, pa.int64()), pa.nulls(done.num_rows, pa.string()), pa.nulls(done.num_rows, pa.string()), *done.columns], names=["part", "edge", "text", *names])
            last = ids[-1], texts[-1], own[-1:]
        if last is not None:
            yield _edge(part, "last", last[0], last[1], packed(last[2], bits)[0], kind_, names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                id_, text, own, next_text, other = (batch.column(c)[i : i + 1].to_pylist() for c in range(5))
                yield _beside(id_, text, unpacked(own, bins, bits), next_text, unpacked(other, bins, bits), batch.schema.field(0).type, names, of)

    passed = cut(placed.mapInArrow(along, f"part long, edge string, text string, {result}"), "fingerprints")
    firsts = passed.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    every = Window.partitionBy(F.lit(0)).orderBy("following")  # a number per range
    order = firsts.select(F.col("following").alias("to"), F.lag("following").over(every).alias("before"), F.max("following").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("highest"))
    order = order.select("to", F.coalesce("before", "highest").alias("part"))
    lasts = passed.where("edge = 'last'").join(order, "part").join(firsts.withColumnRenamed("following", "to"), "to")
    met = lasts.select("id", "text", "fingerprint", "next_text", "next_print").mapInArrow(across, result)
    return passed.where("edge is null").select(*names).unionByName(met).withColumnRenamed("id", id_col)


def likeness(one: Column, other: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The similarity that two columns of fingerprints tell of, 0 to 1. Two empty fingerprints are alike, an empty one and another aren't."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(alike(unpacked(a.tolist(), bins, bits), unpacked(b.tolist(), bins, bits), bits))

    return run(one, other)


def _edge(part: int, edge: str, id_, text: str, print_: str, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    none = lambda t: pa.nulls(1, t)
    columns = [pa.array([id_], kind), none(pa.int64()), none(pa.string()), pa.array([print_]), none(pa.string()), none(pa.float64()), none(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([edge]), pa.array([text]), *columns], names=["part", "edge", "text", *names])


def _beside(ids: list, texts: list[str], own: np.ndarray, next_texts: list[str], following: np.ndarray, kind: pa.DataType, names: list[str], of: tuple[int, int, int]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, next_texts, strict=True)]
    other = codes(edited, *of)
    shas = [hashlib.sha256(no_surrogates(t)).hexdigest() for t in edited]
    bits = of[1]
    columns = [pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()), pa.array(shas), pa.array(packed(own, bits)), pa.array(packed(other, bits)), pa.array(alike(own, other, bits)), pa.array(alike(own, following, bits))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def codes(texts: list[str], bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> np.ndarray:
    """A row of ``bins`` small numbers per text: the low-order bits of its densified minima. A text without words has a row of 255."""
    least = np.full((len(texts), bins), EMPTY, np.uint64)
    short = [i for i, t in enumerate(texts) if len(t) <= CHUNK_CHARS]
    if short:
        hashes, bounds = segment.words([texts[i] for i in short])
        _lower(least, np.array(short), hashes, bounds, width)
    for i, text in enumerate(texts):
        if len(text) > CHUNK_CHARS:
            held, words = np.zeros(0, np.uint64), 0
            for part in _parts(text, CHUNK_CHARS):
                hashes = segment.words([part])[0]
                words += len(hashes)
                held = np.concatenate((held, hashes))
                _lower(least, np.array([i]), held, np.array([0, len(held)]), width, whole=False)
                held = held[len(held) - min(len(held), width - 1) :]
            if 0 < words < width:
                _lower(least, np.array([i]), held, np.array([0, len(held)]), width)
    filled = densified(least)
    mixed = segment.mix(filled ^ segment.mix(np.arange(1, bins + 1, dtype=np.uint64)))
    out = (mixed & np.uint64((1 << bits) - 1)).astype(np.uint8)
    out[(least == EMPTY).all(1)] = 255
    return out


def _parts(text: str, limit: int) -> Iterator[str]:
    """A long text in parts of about ``limit`` characters, cut at white space: no word spans a cut."""
    at = 0
    while at < len(text):
        white = WHITE.search(text, at + limit)
        end = white.start() if white else len(text)
        yield text[at:end]
        at = end


def _lower(least: np.ndarray, rows: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, width: int, whole: bool = True) -> None:
    """Lowers the minima of ``rows`` by the shingles of their words (hashes, and where each text's begin); ``whole``: a text of fewer words is one shingle."""
    n, bins = len(hashes) - width + 1, np.uint64(least.shape[1])
    salts = segment.mix(np.arange(1, width + 1, dtype=np.uint64))
    found, of = hashes[:0], rows[:0]
    if n > 0:
        total = hashes[:n] * (salts[0] | np.uint64(1))
        for k in range(1, width):
            total = segment.mix(total + salts[k]) + hashes[k : k + n]
        place = np.searchsorted(bounds, np.arange(n), "right") - 1
        within = np.arange(n) + width <= bounds[place + 1]
        found, of = segment.mix(total[within]), rows[place[within]]
    if whole:
        size = np.diff(bounds)
        few = np.flatnonzero((size > 0) & (size < width))
        if len(few):
            own = [int.from_bytes(hashlib.blake2b(hashes[bounds[i] : bounds[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in few]
            found, of = np.concatenate((found, np.array(own, np.uint64))), np.concatenate((of, rows[few]))
    bin_ = ((found >> np.uint64(32)) * bins) >> np.uint64(32)
    np.minimum.at(least.reshape(-1), of * int(bins) + bin_.astype(np.int64), segment.mix(found ^ np.uint64(segment.ROOT)))


@lru_cache(4)
def donors(bins: int) -> np.ndarray:
    """For every bin, all bins in a random order of its own."""
    keys = segment.mix(np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(segment.ROOT)).reshape(bins, bins)
    return np.argsort(keys, axis=1, kind="stable")


def densified(least: np.ndarray) -> np.ndarray:
    """``least`` with each empty bin filled from its first donor that isn't empty. Rows without any value stay."""
    empty, order, out = least == EMPTY, donors(least.shape[1]), least.copy()
    row, bin_ = np.nonzero(empty & ~empty.all(1)[:, None])
    step = 0
    while len(row):
        donor = order[bin_, step]
        hit = ~empty[row, donor]
        out[row[hit], bin_[hit]] = least[row[hit], donor[hit]]
        row, bin_, step = row[~hit], bin_[~hit], step + 1
    return out


def packed(found: np.ndarray, bits: int = BITS) -> list[str]:
    """Rows of codes as hex strings, ``bits`` bits a bin; rows of 255 as empty ones. ``bits``: 1, 2, 4 or 8."""
    if not len(found):
        return []
    each = np.unpackbits(found[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(found), -1)
    none = (found == 255).all(1)
    return ["" if no else x.tobytes().hex() for no, x in zip(none.tolist(), np.packbits(each, axis=1), strict=True)]


def unpacked(prints: list[str], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    out = np.full((len(prints), bins), 255, np.uint8)
    for i, p in enumerate(prints):
        if p:
            each = np.unpackbits(np.frombuffer(bytes.fromhex(p), np.uint8)).reshape(bins, bits)
            out[i] = np.packbits(np.pad(each, ((0, 0), (8 - bits, 0))), axis=1)[:, 0]
    return out


def alike(one: np.ndarray, other: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarities of rows of codes: the share of equal bins less what chance makes equal, 0 to 1."""
    chance = 0.5**bits
    near = np.clip(((one == other).mean(axis=1) - chance) / (1 - chance), 0, 1)
    none, no_other = (one == 255).all(1), (other == 255).all(1)
    return np.where(none | no_other, (none & no_other).astype(float), near)
