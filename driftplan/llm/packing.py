"""Harmonic packing of token sequences."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import segment
from .common import pieces, safe_parts

#: Characters in one array, and pre-tokens whose ids a worker remembers.
CHUNK_CHARS, REMEMBERED = 1_000_000, 200_000
#: What is left of a document under so many tokens isn't cut further.
SHORTEST_CUT = 64
WORKER_BITS = 40


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the token ids of all documents, each followed by ``end_id``, into sequences of at most ``capacity`` ids.

    A length l is in reciprocal-capacity class k = capacity // l, and a bin of class k is closed when it holds k pieces.
    Documents are cut so that classes are tight: whole capacities first (class 1), then powers of two, which fill their
    bins to the last id, then a tail under 64 ids. Every worker fills the bins of its own rows, with no exchange at all.
    What a worker's open bins hold in the end is laid end to end and cut at the capacity; the very last rest is cut into
    sequences whose lengths are powers of two, which need no padding.

    Null and empty texts have ``end_id`` alone. Very long texts are taken whole, in parts that no token spans. Repeated rows
    are packed each. A null id is carried. An empty table has no pieces. Other columns of ``docs`` are ignored, whatever
    their names. Returns a row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in names])
    used = docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _Ids(tokenizer_path)
        bins = _Bins(TaskContext.get().partitionId() << WORKER_BITS, capacity)
        kind = None
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            kind = batch.schema.field(0).type
            flat, ends = ids_of(texts, end_id)
            start = 0
            for name, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                bins.add(name, flat[start:end])
                start = end
            yield bins.batch(kind, schema.fieldNames())
        bins.finish()
        if bins.out:
            yield bins.batch(kind, schema.fieldNames())

    return used.mapInArrow(run, schema)


class _Bins:
    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.out, self.open = first, capacity, [], {}

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, sequence: int, offset: int, name, start: int, ids: np.ndarray, total: int) -> None:
        self.out.append((name, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))

    def add(self, name, ids: np.ndarray) -> None:
        total, at, size = len(ids), 0, self.capacity
        while total - at >= self.capacity:
            self.put(self.sequence(), 0, name, at, ids[at : at + self.capacity], total)
            at += self.capacity
        while at < total:
            while size > total - at:
                size //= 2
            n = size if size >= SHORTEST_CUT else total - at
            self.place(self.capacity // n, (name, at, ids[at : at + n].copy(), total))
            at += n

    def place(self, k: int, piece: tuple) -> None:
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            sequence, offset = self.sequence(), 0
            for name, start, ids, total in held:
                self.put(sequence, offset, name, start, ids, total)
                offset += len(ids)
            del self.open[k]

    def finish(self) -> None:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        left, room, sequence, offset = sum(len(p[2]) for p in rest), 0, 0, 0
        for name, start, ids, total in rest:
            while len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left, sequence, offset = left - room, self.sequence(), 0
                n = min(room, len(ids))
                self.put(sequence, offset, name, start, ids[:n], total)
                ids, start, offset, room = ids[n:], start + n, offset + n, room - n
        self.open = {}

    def batch(self, kind, names: list[str]) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [[]] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)


class _Ids:
    """Ids of whole texts. Each distinct pre-token is encoded once and remembered; texts beyond the class table, and those that hold a special token's string, go to the library whole."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.specials = [x["content"] for x in held["added_tokens"]]
        back = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in self.specials}
        self.encode = tiktoken.Encoding("bytes", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, list[int]] = {}

    def __call__(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, each with ``end_id`` behind it; where each ends."""
        parts, of, odd = [], [], {}
        for i, text in enumerate(texts):
            if (text and not segment.simple(text)) or any(s in text for s in self.specials):
                odd[i] = self.library.encode(text, add_special_tokens=False).ids
            else:
                more = safe_parts(text)
                parts += more
                of += [i] * len(more)
        points, offsets = segment.code_points(parts)
        flat, sizes = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(points):
            flat, per = self._ids(points, segment.byte_bpe_spans(points, offsets), offsets, "".join(parts))
            np.add.at(sizes, np.array(of), per)
        for i, x in odd.items():
            sizes[i] = len(x)
        ends = np.cumsum(sizes + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u4")
        within = np.ones(len(out), bool)
        within[ends - 1] = False
        for i, x in odd.items():
            out[ends[i] - 1 - len(x) : ends[i] - 1] = x
            within[ends[i] - 1 - len(x) : ends[i] - 1] = False
        out[within] = flat
        return out, ends

    def _ids(self, points, starts, offsets, text) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(starts[1:], len(points))
        first, inverse = segment.distinct_spans(points, starts, ends)
        found = self._found([text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        n = np.fromiter(map(len, found), np.int64, len(found))
        store = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
        size = n[inverse]
        behind = np.cumsum(size)
        at = np.arange(int(behind[-1])) + np.repeat((np.cumsum(n) - n)[inverse] - (behind - size), size)
        total = np.concatenate(([0], behind))[np.searchsorted(starts, offsets)]
        return store[at], np.diff(total)

    def _found(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct pre-tokens."""
        known, found = self.known, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self.encode(word.encode("utf-8", "surrogatepass"))
            found.append(ids)
        if len(known) > REMEMBERED:
            known.clear()
        return found


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others, in order, for U+0100 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
