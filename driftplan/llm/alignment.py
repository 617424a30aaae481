"""Alignment of two tokenizers' tokens: common cuts, links of overlapping tokens, and how many documents hold each linked pair of ids."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import segment
from .common import cut, no_surrogates, pieces, safe_parts
from .packing import REMEMBERED, _byte_letters, _Ids
from .token_counts import _pack, _unpack

#: Characters of text in a block, and tokenised at a time.
BLOCK_CHARS, CHUNK_CHARS = 6_000_000, 1_000_000
#: A pair of ids is first id * 2 ** PAIR_BITS + second id.
PAIR_BITS = 16
TABLE = "block long, pair long, n long, body binary"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Aligns the tokens of a byte-level vocabulary (A, over a blank and the text) with those of a piece vocabulary (B, over the text).

    Where a token of either kind ends at the same byte, both sequences are cut: the tokens between two cuts are a group. Two
    tokens whose bytes overlap are linked. The count of a pair of ids is how many documents of the table hold it linked.

    Tokens' ends are running sums, common cuts their intersection, groups and links come from searches in sorted ends,
    chunk by chunk. Documents are taken in blocks of about ``BLOCK_CHARS`` characters, and a block keeps its documents'
    pairs and how often each occurs. What travels is a row per block and distinct pair: counted by pair and salt first, by
    pair then, and answered the same way back. There are as many salts as the square root of the number of blocks, so a pair
    that every document has is no more than that many rows in one group, on the way up and down.

    Texts that are null or empty, or that either kind doesn't give back byte for byte (say, with U+2581), have no tokens:
    zeros, and an empty groups_sha256. Very long texts are taken whole, in parts that no token spans. Repeated rows are a
    document each, also in counts; a null id is carried. An empty table gives an empty result. Other columns are ignored,
    whatever their names. Returns ``id_col``, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their
    A id), count_sum, groups_sha256, and with ``groups`` the groups themselves (a1,a2|b1;a3|b2).
    """
    blocks = aligned_blocks(docs, byte_path, piece_path, id_col, text_col, groups)
    pairs, held = blocks.where("pair >= 0").drop("body"), blocks.where("pair < 0").select("block", "body")
    salts = max(1, math.isqrt(held.count()))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    partial = cut(salted.groupBy("pair", "salt").agg(F.sum("n").alias("n")), "pair-parts")
    known = partial.select("pair", "salt").join(pair_counts(partial), "pair").select("pair", "salt", "docs", "best")
    answers = salted.join(known, ["pair", "salt"]).select(F.col("block").alias("to"), "pair", "docs", "best")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())]
    schema = T.StructType(fields + ([T.StructField("groups", T.StringType())] if groups else []))
    return held.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(_totals(id_col), schema)


def pair_counts(partial: DataFrame) -> DataFrame:
    """(pair, docs, best) from partial counts (pair, n): how many documents hold a pair, and whether no pair with its A id is in more."""
    counts = cut(partial.groupBy("pair").agg(F.sum("n").alias("docs")), "pair-counts").withColumn("a", F.shiftright("pair", PAIR_BITS))
    # a row per id of A: no more than its vocabulary
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best"))


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Blocks of documents, written: a row per block and distinct pair with its number of documents there, and a row (pair -1) with the documents."""
    used = docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _Bytes(byte_path), _Pieces(piece_path)
        number, block = TaskContext.get().partitionId() << 32, _Block(*kinds, groups)
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            block.kind = batch.schema.field(0).type
            block.add(batch.column(0).to_pylist(), texts)
            if block.chars >= BLOCK_CHARS:
                yield from block.rows(number)
                number, block = number + 1, _Block(*kinds, groups)
        if block.ids:
            yield from block.rows(number)

    return cut(used.mapInArrow(run, TABLE), "aligned")


class _Bytes(_Ids):
    """Ids of the byte-level vocabulary; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.specials = []
        self.library.encode_special_tokens = True
        back = {c: b for b, c in _byte_letters().items()}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        table = {i: bytes(back[c] for c in token) if all(c in back for c in token) else b"" for token, i in vocabulary.items()}
        self.table = _Table([table.get(i, b"") for i in range(max(table) + 1)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        flat, ends = super().__call__(texts, 0)
        return np.delete(flat, ends - 1).astype(np.int64), np.diff(ends, prepend=0) - 1


class _Pieces(_Ids):
    """Ids of the piece vocabulary. No piece holds a blank behind anything but blanks, so what begins with blanks is encoded apart, once for each distinct content."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        blank = "▁"
        names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.apart = not any(blank in p.lstrip(blank) for p in names)
        self.table = _Table([bytes([int(p[3:-1], 16)]) if library.is_byte(i) else p.replace(blank, " ").encode() for i, p in enumerate(names)])
        self.encode, self.blank = library.encode, [library.piece_to_id(blank)]
        self.known: dict[str, list[int]] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that all begin with a blank, which the library adds itself, and how many each has."""
        points, offsets = segment.code_points(texts)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        start = np.zeros(len(points), bool)
        start[offsets[:-1]] = True
        if self.apart:
            blank = points == 0x20
            start |= blank & ~np.concatenate(([False], blank[:-1]))
        flat, per = self._ids(points, np.flatnonzero(start), offsets, "".join(texts))
        return flat.astype(np.int64), per


    def _found(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, those that aren't remembered encoded together. The library adds a blank to what isn't empty."""
        known = self.known
        new = [w for w in words if w not in known]
        known |= zip(new, self.encode([w[1:] for w in new], num_threads=1), strict=True)
        if " " in known:
            known[" "] = self.blank
        found = [known[w] for w in words]
        if len(known) > REMEMBERED:
            known.clear()
        return found


class _Table:
    """The bytes of every id."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        ids = [str(i).encode() for i in range(len(tokens))]
        #: Ids in digits with what may follow: another of the group, the other kind, the next group.
        self.shown = [i + sign for sign in (b",", b"|", b";") for i in ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        return self.data[np.arange(int(n.sum())) + np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)]


def given_back(table: _Table, ids: np.ndarray, per: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which texts their tokens' bytes, joined, are equal to."""
    doc = np.repeat(np.arange(len(per)), per)
    size = np.array([len(t) for t in texts], np.int64)
    fine = np.bincount(doc, table.sizes[ids], len(per)).astype(np.int64) == size
    found, wanted = table.joined(ids[fine[doc]]), np.frombuffer(b"".join([t for t, f in zip(texts, fine.tolist(), strict=True) if f]), np.uint8)
    wrong = np.flatnonzero(found != wanted)
    if len(wrong):
        which = np.flatnonzero(fine)
        fine[which[np.searchsorted(np.cumsum(size[which]), wrong, "right")]] = False
    return fine


def linked(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group of each A token, group of each B token, and places (in a, in b) of all linked tokens, for sequences over the same bytes."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    # B tokens from the first that ends behind a token's start to the last that starts before its end
    low = np.searchsorted(end_b, end_a - size_a, "right")
    n = np.searchsorted(end_b - size_b, end_a, "left") - low
    of_a = np.repeat(np.arange(len(a)), n)
    of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(n) - n - low, n)
    return np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), of_a, of_b


class _Block:
    """Documents with their linked pairs."""

    def __init__(self, one: _Bytes, other: _Pieces, groups: bool):
        self.one, self.other, self.groups = one, other, groups
        self.shown_ids = one.table.shown + other.table.shown
        self.kind: pa.DataType | None = None
        self.ids, self.shas, self.shown, self.counts, self.chars = [], [], [], [], 0
        self.docs, self.pairs, self.times = [], [], []

    def add(self, ids: list, texts: list[str]) -> None:
        parts, of = [], []
        for i, text in enumerate(texts):
            if text:
                more = safe_parts(" " + text)
                parts += more
                of += [i] * len(more)
            self.chars += len(text)
        n = len(texts)
        counts, sha, fine = np.zeros((n, 4), np.int64), [hashlib.sha256() for _ in texts], np.ones(n, bool)
        shown: list[list[bytes]] = [[] for _ in texts]
        keys, times = [], []
        at = 0
        while at < len(parts):
            end, held = at, 0
            while end < len(parts) and (end == at or held + len(parts[end]) <= CHUNK_CHARS):
                held += len(parts[end])
                end += 1
            key, often = self._part(parts[at:end], np.array(of[at:end]), counts, fine, shown)
            keys.append(key)
            times.append(often)
            for i in set(of[at:end]) - {of[end] if end < len(parts) else -1}:
                sha[i].update(self._said(shown[i], last=True))
            if end < len(parts) and not self.groups:  # a long text goes on: what is said of it so far is hashed away
                i = of[end]
                sha[i].update(self._said(shown[i], last=False))
                shown[i] = []
            at = end
        if keys:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            often = np.bincount(inverse, np.concatenate(times), len(key)).astype(np.int64)
            doc = key >> 2 * PAIR_BITS
            sound = fine[doc]
            self.docs.append(doc[sound] + len(self.ids))
            self.pairs.append(key[sound] & (1 << 2 * PAIR_BITS) - 1)
            self.times.append(often[sound])
        counts[~fine] = 0
        self.counts.append(counts)
        good = [bool(text) and ok for text, ok in zip(texts, fine.tolist(), strict=True)]
        self.shas += [s.hexdigest() if ok else "" for s, ok in zip(sha, good, strict=True)]
        if self.groups:
            self.shown += [b"".join(x)[:-1].decode() if ok else "" for x, ok in zip(shown, good, strict=True)]
        self.ids += ids

    def _said(self, shown: list[bytes], last: bool) -> bytes:
        """Groups as text; behind the last one of a document nothing follows."""
        said = b"".join(shown)
        return said[:-1] if last else said

    def _part(self, parts: list[str], of: np.ndarray, counts: np.ndarray, fine: np.ndarray, shown: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Tokenises parts of documents, adds to ``counts`` and ``shown``; (document and pair, occurrences) of the parts' links."""
        raw = [no_surrogates(p) for p in parts]
        a, per_a = self.one(parts)
        b, per_b = self.other(parts)
        good = given_back(self.one.table, a, per_a, raw) & given_back(self.other.table, b, per_b, raw)
        fine[of[~good]] = False
        if not good.all():
            a, b = a[np.repeat(good, per_a)], b[np.repeat(good, per_b)]
            per_a, per_b, of = per_a[good], per_b[good], of[good]
        doc_a, doc_b = np.repeat(of, per_a), np.repeat(of, per_b)
        group_a, group_b, of_a, of_b = linked(a, b, self.one.table.sizes[a], self.other.table.sizes[b])
        n = len(fine)
        counts[:, 0] += np.bincount(doc_a, minlength=n)
        counts[:, 1] += np.bincount(doc_b, minlength=n)
        new = np.flatnonzero(np.diff(group_a, prepend=-1))
        counts[:, 2] += np.bincount(doc_a[new], minlength=n)
        counts[:, 3] += np.bincount(doc_a[of_a], minlength=n)
        self._show(a, b, group_a, group_b, np.cumsum(per_a + per_b), of, shown)
        return np.unique((doc_a[of_a] << 2 * PAIR_BITS) | (a[of_a] << PAIR_BITS) | b[of_b], return_counts=True)

    def _show(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ends: np.ndarray, of: np.ndarray, shown: list[list[bytes]]) -> None:
        """All ids in order of groups, A before B, with their signs, dealt to their documents."""
        n = len(a) + len(b)
        per_a, per_b = np.bincount(group_a), np.bincount(group_b)
        before = np.cumsum(per_a + per_b) - per_a - per_b
        place_a = np.arange(len(a)) + (before - (np.cumsum(per_a) - per_a))[group_a]
        place_b = np.arange(len(b)) + (before + per_a - (np.cumsum(per_b) - per_b))[group_b]
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        size_a, size_b = len(self.one.table.sizes), len(self.other.table.sizes)
        said = np.empty(n, np.int64)
        said[place_a] = a + last_a * size_a
        said[place_b] = 3 * size_a + b + last_b * 2 * size_b
        start, of_id = 0, self.shown_ids.__getitem__
        for i, end in zip(of.tolist(), ends.tolist(), strict=True):
            shown[i].append(b"".join(map(of_id, said[start:end].tolist())))
            start = end

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        doc, pair, often = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.docs, self.pairs, self.times))
        distinct, place, n = np.unique(pair, return_inverse=True, return_counts=True)
        per = np.bincount(doc, minlength=len(self.ids)).astype(np.int64)
        steps = np.diff(place, prepend=0)
        table = pa.table({"id": pa.array(self.ids, self.kind), "groups_sha256": pa.array(self.shas, pa.string())})
        for name, own in zip(COUNTS, np.concatenate(self.counts).T, strict=True):
            table = table.append_column(name, pa.array(own))
        if self.groups:
            table = table.append_column("groups", pa.array(self.shown, pa.large_string()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        body = _pack(sink.getvalue().to_pybytes(), per.tobytes(), steps.astype(np.int32).tobytes(), often.astype(np.uint32).tobytes())
        names = ["block", "pair", "n", "body"]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([body], pa.binary())], names=names)
        for at in range(0, len(distinct), 50_000):
            own = distinct[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(own), pa.array(n[at : at + 50_000].astype(np.int64)), pa.nulls(len(own), pa.binary())], names=names)


def _totals(id_col: str):
    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        ipc, per, steps, often = _unpack(held["body"][0].as_py())
        table = pa.ipc.open_stream(ipc).read_all()
        per, steps, often = np.frombuffer(per, np.int64), np.frombuffer(steps, np.int32), np.frombuffer(often, np.uint32).astype(np.int64)
        place = np.cumsum(steps.astype(np.int64))
        order = np.argsort(answers["pair"].to_numpy())
        docs, best = (answers[c].to_numpy()[order].astype(np.int64) for c in ("docs", "best"))
        ends = np.concatenate(([0], np.cumsum(per)))

        def total(value: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(value[place] * often)))
            return sums[ends[1:]] - sums[ends[:-1]]

        columns = {id_col: table["id"]} | {c: table[c] for c in COUNTS} | {"n_best": pa.array(total(best)), "count_sum": pa.array(total(docs)), "groups_sha256": table["groups_sha256"]}
        if "groups" in table.column_names:
            columns["groups"] = table["groups"].cast(pa.string())
        return pa.table(columns)

    return run
