"""Document quality: random-indexing word vectors, pooled, under a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import segment
from .common import cut, pieces, safe_parts

#: Labelled rows that the model is fitted on, at most, with their whole texts; tasks that sum up what stands beside words.
SAMPLE, FIT_TASKS = 6_000, 8
#: Words are told apart by hash up to WORDS; SHAPES are kinds of tokens, and TOTAL what has a vector.
WORDS, SHAPES, DIM, NONZERO, REACH = 1 << 15, 1 << 9, 32, 4, 2
TOTAL = WORDS + SHAPES
HIDDEN, EPOCHS, BATCH = 32, 60, 64
#: Characters in one array, and tokens whose vectors are in memory at once.
CHUNK_CHARS, STEP = 500_000, 100_000


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each word and shape."""
    rng = np.random.default_rng(2024)
    out = np.zeros((TOTAL, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(TOTAL), rng.integers(0, DIM, TOTAL)] += rng.choice(np.array([-1, 1], np.float32), TOTAL)
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shape of every token, and how many tokens lie before each text (with the total)."""
    points, offsets = segment.code_points(texts)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    # beyond the class table every sign is a token: what it is counts, its bounds are those of digits
    symbols, points = points, np.where(points < segment.TABLE, points, ord("0"))
    starts, ends = segment.word_bpe_spans(points, offsets)
    hashes = segment.span_hashes(symbols, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    size = np.minimum(ends - starts, 15)
    kind = segment.classes()[points[starts]].astype(np.int64)
    upper = _upper()
    first, second = upper[points[starts]], upper[points[np.minimum(starts + 1, ends - 1)]]
    same = np.zeros(len(starts), np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    glued = np.zeros(len(starts), np.int64)
    glued[1:] = starts[1:] == ends[:-1]
    # a text's first token knows nothing of the text before it
    first_ones = bounds[:-1][bounds[:-1] < len(starts)]
    same[first_ones] = glued[first_ones] = 0
    shape = (((same * 2 + glued) * 2 + first) * 2 + second) * 32 + (kind == segment.LETTER) * 16 + size
    return (hashes % np.uint64(WORDS)).astype(np.int64), WORDS + shape % SHAPES, bounds


def _upper() -> np.ndarray:
    return np.array([chr(c).isupper() for c in range(segment.TABLE)], np.int64)


def beside(texts: list[str], index: np.ndarray) -> np.ndarray:
    """For each word the sum of the index vectors of those that stand within REACH of it: whole numbers, so that sums agree in any order."""
    words, shapes, bounds = tokens(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # of an index vector only the few places count that aren't zero
    places = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :NONZERO]
    signs = np.take_along_axis(index, places, axis=1).astype(np.float64)
    total = np.zeros(TOTAL * DIM)
    for at in range(0, len(words), STEP):
        ends = min(at + STEP, len(words))
        for step in range(1, REACH + 1):
            here = np.arange(at, min(ends, len(words) - step))
            here = here[of[here] == of[here + step]]
            for ids in (words, shapes):
                to, other = np.concatenate((ids[here + step], ids[here])), np.concatenate((words[here], words[here + step]))
                for k in range(NONZERO):
                    total += np.bincount(to * DIM + places[other, k], signs[other, k], TOTAL * DIM)
    return total.astype(np.int64).reshape(TOTAL, DIM)


def word_vectors(total: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Each word's own index vector plus the direction of what stands beside it."""
    norm = np.linalg.norm(total.astype(np.float64), axis=1, keepdims=True)
    return (index / np.sqrt(NONZERO) + total / np.maximum(norm, 1e-6)).astype(np.float32)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sums over a task's whole texts, a long one in parts."""
    import zstandard

    index, total = index_vectors(), np.zeros((TOTAL, DIM), np.int64)
    for _, some in pieces(batches, "text", CHUNK_CHARS):
        for part in [some] if len(some) > 1 else [[p] for p in safe_parts(some[0], CHUNK_CHARS)]:
            total += beside(part, index)
    yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())], names=["total"])


def _opened(body: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.int64).reshape(TOTAL, DIM)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector and their lengths, one row per text; a text without tokens has zeros."""
    words, shapes, bounds = tokens(texts)
    out = np.zeros((len(texts), 2 * DIM + 3), np.float32)
    n = np.diff(bounds)
    for at in range(0, len(words), STEP):
        doc = np.searchsorted(bounds, np.arange(at, min(at + STEP, len(words))), "right") - 1
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for k, ids in enumerate((words, shapes)):
            out[doc[first], k * DIM : (k + 1) * DIM] += np.add.reduceat(vectors[ids[at : at + STEP]], first)
    full = n > 0
    for k in range(2):
        out[full, k * DIM : (k + 1) * DIM] /= n[full, None]
        out[full, 2 * DIM + k] = np.linalg.norm(out[full, k * DIM : (k + 1) * DIM], axis=1)
    out[full, -1] = np.log1p(n[full]) / 10
    return out


class Network:
    """Two layers: tanh, then a logistic output whose temperature is fitted on rows that training left out."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(5)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        x = self._scaled(x)
        check = rng.random(len(x)) < 0.2
        tx, ty = x[~check], y[~check].astype(np.float32)
        size = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.w = [s.astype(np.float32) for s in size]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS if len(tx) else 0):
            for rows in np.array_split(rng.permutation(len(tx)), max(1, len(tx) // BATCH)):
                h = np.tanh(tx[rows] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - ty[rows]) / len(rows)
                dh = d[:, None] * self.w[2] * (1 - h * h)
                grads = [tx[rows].T @ dh + 1e-4 * self.w[0], dh.sum(0), h.T @ d + 1e-4 * self.w[2], d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - (0.004 if epoch < EPOCHS * 2 // 3 else 0.001) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.temperature = 1.0
        if check.any() and len(tx):
            z = self._logits(x[check])
            loss = lambda c: np.logaddexp(0, -np.where(y[check] == 1, 1, -1) * z / c).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8).astype(np.float32)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(self._scaled(x)).astype(np.float64) / self.temperature, -60, 60)))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE):
    """Word vectors and network from at most ``sample`` labelled rows, drawn evenly by a hash of the id. Without labels of both kinds: None.

    Word vectors are sums over the drawn texts, whole, made by ``FIT_TASKS`` tasks; then tasks pool these texts, as ``score``
    does, and the network is fitted on what they found. So the driver holds numbers alone, as many as there are words and
    rows, however long texts are. Null texts count as empty, rows without label don't count; ties in the order are broken by text and label.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"), F.col(label_col).cast("int").alias("label"))
    share = min(1.0, 1.1 * sample / max(rows.count(), 1))
    at = F.abs(F.xxhash64(F.col("id").cast("string"), F.lit("quality")))
    drawn = cut(rows.withColumn("at", at).where(F.col("at") < share * float(1 << 63)).withColumn("mark", F.xxhash64("text")).orderBy("at", "mark", "label").limit(sample).repartition(FIT_TASKS, "at"), "labelled")
    if not 0 < drawn.where("label = 1").count() < drawn.count():
        return None
    total = sum(_opened(r["total"]) for r in drawn.select("text").mapInArrow(_summed, "total binary").collect())  # a row per task
    vectors = word_vectors(total, index_vectors())

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in pieces(batches, "text", CHUNK_CHARS):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(pooled(some, vectors)), pa.list_(pa.float32()))], names=["at", "mark", "label", "x"])

    found = drawn.select("at", "mark", "label", "text").mapInArrow(pool, "at long, mark long, label int, x array<float>").toPandas().sort_values(["at", "mark", "label"], kind="stable")
    return vectors, Network(np.stack(found["x"].to_list()).astype(np.float32), found["label"].to_numpy(np.int64))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Probability that a whole text is of quality 1.

    Null and empty texts get the score of a text without words. Without a model (no labels of both kinds) every score is
    0.5. Very long texts are read whole. A score equal to the threshold is predicted as 1. Rows are scored one by one,
    repeated ones too; a null id is carried. An empty table gives an empty result. Other columns are ignored, whatever
    their names. Returns ``id_col``, score, predicted (1 if score >= ``threshold``).
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    of = None if model is None else partial(pooled, vectors=model[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            p = np.full(len(texts), 0.5) if model is None else model[1](of(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.fieldNames())

    return docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text").mapInArrow(run, schema)
