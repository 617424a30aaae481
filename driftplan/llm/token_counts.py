"""Token counts from pre-token frequencies, without token ids."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import segment
from .common import MESSAGE, cut, partitions, pieces, safe_parts, through_tree

#: Characters of text in a block, and in one array while a block is built.
BLOCK_CHARS, CHUNK_CHARS = 6_000_000, 500_000
#: Strings that the library's file lists as special tokens: each counts as one token wherever it stands.
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
#: Characters of the whole table for each bucket of its dictionary, at most about: more buckets than shuffle partitions where that takes more.
BUCKET_CHARS = 32_000_000
#: Pre-tokens whose pieces the library counts at a time.
BATCH = 2_000


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """How many tokens each whole text has under the lower-case word BPE in ``tokenizer_path``.

    Documents are taken in blocks. A block keeps its documents' pre-token frequencies and sends its distinct pre-tokens,
    by hash, to the buckets of a dictionary. A bucket counts the pieces of every distinct pre-token once, by the library
    itself, and answers each block; the block then sums frequency times pieces per document. No ids are made, and no
    frequency list crosses the network by word, so frequent words weigh no more than rare ones: one a block.

    There are as many buckets as the table's size takes for each to fit a worker. A block sends at most one message per
    distinct pre-token, however many buckets there are; with thousands of blocks, groups of them are answered as one, in a
    tree, so that a word of every block reaches its bucket once a group. Hashes deal pre-tokens to buckets; what tells them apart is their
    content. Null and empty texts have 0 tokens. Very long texts are taken whole, in parts that no pre-token spans. Repeated
    rows are counted each; a null id is carried. An empty table gives an empty result. Other columns of ``docs`` are
    ignored, whatever their names. Returns ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).
    """
    kind = docs.schema[id_col].dataType
    chars = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-chars // BUCKET_CHARS))

    def block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, _Block(tokenizer_path)
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            held.kind = batch.schema.field(0).type
            held.add(batch.column(0).to_pylist(), texts)
            if held.chars >= BLOCK_CHARS:
                yield held.rows(block, buckets)
                block, held = block + 1, _Block(tokenizer_path)
        if held.ids:
            yield held.rows(block, buckets)

    def answer(table: pa.Table) -> pa.Table:
        words, found = _places(table["body"].to_pylist())
        tokenizer, n = _library(tokenizer_path), np.zeros(len(words), np.uint32)
        for i in range(0, len(words), BATCH):
            n[i : i + BATCH] = [len(e.ids) for e in tokenizer.encode_batch_fast(words[i : i + BATCH], add_special_tokens=False)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "body": pa.array([_pack(n[x].tobytes()) for x in found], pa.binary())})

    def combine(bodies: list[bytes]) -> bytes:
        return _pack("\n".join(_places(bodies)[0]).encode("utf-8"))

    def deal(bodies: list[bytes], said: bytes) -> list[bytes]:
        n = np.frombuffer(_unpack(said)[0], np.uint32)
        return [_pack(n[x].tobytes()) for x in _places(bodies)[1]]

    result = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def total(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["bucket"].to_pylist(), table["body"].to_pylist(), strict=True))
        own = _unpack(rows[0][1])
        n = np.concatenate([np.frombuffer(_unpack(b)[0], np.uint32) for _, b in rows[1:]] or [np.zeros(0, np.uint32)])
        sizes, base, per, steps, often = (np.frombuffer(x, kind) for x, kind in zip(own[1:], (np.int64, np.int64, np.int64, np.int32, np.uint32), strict=True))
        doc = np.repeat(np.arange(len(per)), per)
        at = np.cumsum(steps)
        at -= np.repeat(np.concatenate(([0], at))[np.cumsum(per) - per], per) if len(at) else 0
        tokens = base + np.bincount(doc, n[at].astype(np.float64) * often, len(per)).astype(np.int64) if len(at) else base
        return pa.table({id_col: pa.ipc.open_stream(own[0]).read_all().column(0), "n_bytes": sizes, "n_tokens": tokens})

    blocks = cut(docs.select(F.col(id_col), F.col(text_col).alias("text") if text_col != id_col else F.col(text_col)).toDF("id", "text").mapInArrow(block_up, MESSAGE), "token-blocks")
    answers = through_tree(blocks.where("bucket >= 0"), blocks.where("bucket < 0").count(), answer, combine, deal)
    counted = blocks.where("bucket < 0").unionByName(answers).groupBy("block").applyInArrow(total, result)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _places(bodies: list[bytes]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of several messages, and where each message's words are among them."""
    places: dict[str, int] = {}
    found = [np.array([places.setdefault(w, len(places)) for w in _unpack(b)[0].decode("utf-8").split("\n")], np.int64) for b in bodies]
    return list(places), found


@lru_cache(1)
def _library(path: str):
    """The tokenizer, once per worker and on the task's own thread: a pool of threads per worker would hold memory and CPUs that the task wasn't given."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _pack(*parts: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts))


def _unpack(body: bytes) -> list[bytes]:
    import zstandard

    data, out, at = zstandard.ZstdDecompressor().decompress(body), [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


class _Block:
    """Documents with their pre-token frequencies."""

    def __init__(self, tokenizer_path: str):
        self.kind: pa.DataType | None = None
        self.path, self.library, self.chars, self.ids, self.sizes, self.base = tokenizer_path, None, 0, [], [], []
        self.places: dict[str, int] = {}
        self.docs, self.at, self.often = [], [], []

    def add(self, ids: list, texts: list[str]) -> None:
        fast, odd = [], []
        special = re.compile("|".join(map(re.escape, SPECIALS)))
        for id_, text in zip(ids, texts, strict=True):
            doc, n = len(self.ids), 0
            for span in special.split(text) if "<|" in text else [text]:
                for part in safe_parts(span):
                    plain = unicodedata.normalize("NFC", part)
                    low = plain.replace("Σ", "σ").lower()  # may leave the table where the text doesn't, as Cherokee does
                    if segment.simple(plain or " ") and segment.simple(low or " "):
                        fast.append((doc, low))
                    else:
                        odd.append((doc, plain))
                n += 1
            self.ids.append(id_)
            self.sizes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
            self.base.append(n - 1)
            self.chars += len(text)
        lower = [t for _, t in fast]
        points, offsets = segment.code_points(lower)
        if len(points):
            starts, ends = segment.word_bpe_spans(points, offsets)
            of = np.array([d for d, _ in fast])[np.searchsorted(offsets, starts, "right") - 1] if len(starts) else starts
            self._count(of, points, starts, ends, "".join(lower))
        if odd and self.library is None:
            self.library = _library(self.path)
        for doc, text in odd:
            text = self.library.normalizer.normalize_str(text)
            spans = np.array([s for _, s in self.library.pre_tokenizer.pre_tokenize_str(text)], np.int64).reshape(-1, 2)
            if len(spans):
                self._count(np.full(len(spans), doc), segment.code_points([text])[0], spans[:, 0], spans[:, 1], text)

    def _count(self, of: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> None:
        first, inverse = segment.distinct_spans(points, starts, ends)
        places = self.places
        place = np.array([places.setdefault(text[a:b], len(places)) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)
        low, n = int(of[0]), len(first)
        pair, often = np.unique((of - low) * n + inverse, return_counts=True)
        self.docs.append(pair // n + low)
        self.at.append(place[pair % n].astype(np.int32))
        self.often.append(often.astype(np.uint32))

    def rows(self, block: int, buckets: int) -> pa.RecordBatch:
        """A row with the documents' ids, sizes, tokens so far and frequencies (bucket -1), and the distinct pre-tokens of each bucket."""
        words = list(self.places)
        points, edges = segment.code_points(words)
        hashes = segment.span_hashes(points, edges[:-1], edges[1:])
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((hashes, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, at, often = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.docs, self.at, self.often))
        at = place[at] if len(at) else at
        # the same pre-token of one document may have come from several parts: equal places stay apart, and add up later
        by_doc = np.lexsort((at, doc))
        doc, at, often = doc[by_doc], at[by_doc], often[by_doc].astype(np.uint32)
        steps = np.diff(at, prepend=0)
        fresh = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        steps[fresh] = at[fresh]
        sink = pa.BufferOutputStream()
        ids = pa.table({"id": pa.array(self.ids, self.kind)})
        with pa.ipc.new_stream(sink, ids.schema) as writer:
            writer.write_table(ids)
        own = _pack(sink.getvalue().to_pybytes(), np.array(self.sizes, np.int64).tobytes(), np.array(self.base, np.int64).tobytes(), np.bincount(doc.astype(np.int64), minlength=len(self.ids)).astype(np.int64).tobytes(), steps.astype(np.int32).tobytes(), often.tobytes())
        out, bucket = [(block, -1, own)], bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else bucket
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False):
            out.append((block, int(bucket[a]), _pack("\n".join([words[i] for i in order[a:b].tolist()]).encode("utf-8"))))
        blocks, of, bodies = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(of, pa.int32()), pa.array(bodies, pa.binary())], names=["block", "bucket", "body"])
