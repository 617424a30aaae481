"""Removal of byte strings that stand elsewhere before: a sparse suffix array, sorted by a common-prefix-aware distributed merge."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, segment
from .common import MESSAGE, cut, partitions, through_tree
from .token_counts import _pack, _unpack

#: Bytes of text for each bucket, at most about: more buckets than shuffle partitions where that takes more.
BUCKET_BYTES = 64_000_000
#: Length of grams whose minimum anchors a window; bytes in a block, and positions in one array.
GRAM, BLOCK_BYTES, CHUNK = 32, 8_000_000, 1_000_000
#: Copies to leave out are broadcast up to so many rows (16 bytes and a hash each), joined by exchange beyond.
FEW = 200_000
#: Suffixes times lengths of left contexts whose windows are compared at a time.
COMPARED = 700_000
EMPTY = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts earlier: in a row with a smaller id, or earlier in the same text.

    Every window of ``length`` bytes is anchored at the gram with the smallest hash in it, so equal windows have equal
    anchors. Only suffixes at anchors whose gram occurs twice or more are sorted, a sparse suffix array: blocks of
    documents sort theirs into runs, which travel front-coded, by gram; at the other end a loser tree merges the runs and
    knows each suffix's common prefix with the last winner, so that no byte known to be equal is compared again. The
    merged common prefixes tell which right contexts agree, for every length; together with the bytes to the left of the
    anchor that decides each window. Removed spans return to the blocks, which cut them out of the texts.

    Windows are equal if their bytes are: grams pick what is compared by hash, then contexts to the right and to the left
    are both sorted and get classes by their bytes. Of windows that a block holds twice it removes the later ones itself,
    and suffixes all of whose windows are such don't travel: a passage in most documents is sent once a block, and with
    thousands of blocks goes on once a group of them, in a tree.

    A text that is a copy of one with a smaller id goes as a whole (if it has ``length`` bytes at all) and isn't sorted.
    Null texts count as empty. A null id comes before all others; rows that repeat an id are ordered by their place in
    the table, and in no certain order where more than ``FEW`` rows are copies, as these are left out by an exchange. Very long texts are blocks of their own. An empty table gives an empty result. Other columns of ``docs`` are
    ignored, whatever their names. Returns one row per input row: ``id_col``, n_bytes, n_removed, n_spans (maximal removed
    runs), kept (remaining bytes), kept_sha256.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("bytes")).withColumn("sha", F.sha2("bytes", 256))
    order = F.coalesce("id", F.lit(-(1 << 63)))
    texts = source.select("id", "sha", F.length("bytes").cast("long").alias("n"))
    firsts = texts.where(F.col("n") >= length).groupBy("sha").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last").select("sha", "first")
    copies = cut(texts.join(firsts, "sha").where(order > F.col("first")).select("id", "sha", "n"), "copies")
    skip = copies.select("id", "sha").distinct()
    few = skip.count() <= FEW
    blocks = cut(source.join(F.broadcast(skip) if few else skip, ["id", "sha"], "left_anti").select("id", "bytes").mapInArrow(_block_up, MESSAGE), "blocks")
    senders = blocks.count()
    buckets = max(partitions(docs.sparkSession), -(-senders * BLOCK_BYTES // BUCKET_BYTES))
    answers = through_tree(blocks.mapInArrow(_grams(length, buckets), MESSAGE), senders, _repeated, _all_grams, _deal_masks)
    runs = blocks.unionByName(answers).groupBy("block").applyInArrow(_runs(length, buckets), MESSAGE)
    covers = _covers(runs, senders, length)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    found = blocks.unionByName(covers).groupBy("block").applyInArrow(_cut_out, schema)
    gone = copies.select("id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"), F.lit(EMPTY).alias("kept_sha256"))
    kind: T.DataType = docs.schema[id_col].dataType
    return found.unionByName(gone).select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def _covers(runs: DataFrame, senders: int, length: int) -> DataFrame:
    """Removed spans by block. With many blocks, runs are merged in a tree, a group of blocks at a time: a group keeps the first of its equal windows only, so a passage of every block goes on as one suffix a group."""
    if senders <= common.FAN:
        return runs.groupBy("bucket").applyInArrow(_merge(length), MESSAGE)
    groups = -(-senders // common.FAN)
    grouped = runs.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    merged = cut(grouped.groupBy("group", "bucket").applyInArrow(_merge(length, whole=False), f"{MESSAGE}, run boolean"), "merged-runs")
    return merged.where("NOT run").drop("run").unionByName(_covers(merged.where("run").drop("run"), groups, length))


def _row(block: int, bucket: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], names=["block", "bucket", "body"])


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    blocks, of, bodies = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array(of, pa.int32()), "body": pa.array(bodies, pa.binary())})


def _block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids (and which are null), lengths, bytes."""
    block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

    def body() -> bytes:
        null = np.array([i is None for i in ids], np.uint8)
        return _pack(np.array([0 if i is None else i for i in ids], np.int64).tobytes(), null.tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(texts))

    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(id_)
            texts.append(text.as_buffer().to_pybytes())
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                yield _row(block, -1, body())
                block, ids, texts, held = block + 1, [], [], 0
    if ids:
        yield _row(block, -1, body())


def _opened(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, nulls, where each text ends and starts (ends with a leading 0), bytes."""
    ids, null, sizes, data = _unpack(body)
    return np.frombuffer(ids, np.int64), np.frombuffer(null, np.uint8), np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64)))), np.frombuffer(data, np.uint8)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first window, last window) of each run of windows with one anchor. No window leaves its text."""
    out = []
    width = length - GRAM + 1
    for at in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        n, grams = len(part) - length + 1, len(part) - GRAM + 1
        starts = np.arange(grams)
        hashes = segment.span_hashes(part, starts, starts + GRAM)
        key = (hashes & ~np.uint64((1 << 24) - 1)) | starts.astype(np.uint64)
        step, low = 1, key
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[:n], low[width - step : width - step + n])
        chosen = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        text = np.searchsorted(bounds, at + np.arange(n), "right")
        inside = at + np.arange(n) + length <= bounds[np.minimum(text, len(bounds) - 1)]
        edge = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1]))))
        last = np.append(edge[1:], n) - 1
        good = inside[edge]
        edge, last = edge[good], last[good]
        out.append((hashes[chosen[edge]], at + chosen[edge], at + edge, at + last))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))


def _distinct(data: np.ndarray, bounds: np.ndarray, length: int, buckets: int):
    """Anchors of a block; its distinct grams ordered by bucket and hash, with counts; and where buckets begin among them."""
    found = anchors(data, bounds, length)
    grams, inverse, n = np.unique(found[0], return_inverse=True, return_counts=True)
    bucket = (grams % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found, grams[order], n[order], place[inverse], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _grams(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                _, _, bounds, data = _opened(body.as_py())
                _, grams, n, _, edges = _distinct(data, bounds, length, buckets)
                rows = [(block, int(b), _pack(grams[edges[b] : edges[b + 1]].tobytes(), (n[edges[b] : edges[b + 1]] > 1).tobytes())) for b in np.flatnonzero(np.diff(edges))]
                yield from _table(rows).to_batches()

    return run


def _counted(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct grams of several messages, which of them occur twice or more, and where each message's are among them."""
    opened = [_unpack(b) for b in bodies]
    grams = [np.frombuffer(b[0], np.uint64) for b in opened]
    distinct, inverse, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    twice = n > 1
    twice[inverse[np.concatenate([np.frombuffer(b[1], bool) for b in opened])]] = True
    return distinct, twice, np.split(inverse, np.cumsum([len(g) for g in grams])[:-1])


def _repeated(table: pa.Table) -> pa.Table:
    """For each block's grams of this bucket: does the gram occur twice or more?"""
    _, twice, places = _counted(table["body"].to_pylist())
    return _table([(block, bucket, _pack(twice[x].tobytes())) for block, bucket, x in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), places, strict=True)])


def _all_grams(bodies: list[bytes]) -> bytes:
    distinct, twice, _ = _counted(bodies)
    return _pack(distinct.tobytes(), twice.tobytes())


def _deal_masks(bodies: list[bytes], said: bytes) -> list[bytes]:
    mask = np.frombuffer(_unpack(said)[0], bool)
    return [_pack(mask[x].tobytes()) for x in _counted(bodies)[2]]


def _runs(length: int, buckets: int):
    """Sorted, front-coded runs of the suffixes at a block's repeated anchors, one per bucket."""

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["bucket"].to_pylist(), table["body"].to_pylist(), strict=True))
        block = table["block"][0].as_py()
        ids, null, bounds, data = _opened(rows[0][1])
        (gram, anchor, low, high), grams, _, place, _ = _distinct(data, bounds, length, buckets)
        mask = np.concatenate([np.frombuffer(_unpack(b)[0], bool) for _, b in rows[1:]] or [np.zeros(0, bool)])
        keep = np.flatnonzero(mask[place]) if len(place) else place
        padded = np.concatenate((np.zeros(length, np.uint8), data, np.zeros(length, np.uint8)))
        out = []
        bucket = (gram[keep] % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        for part in np.split(keep[by_bucket], np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if len(keep) else []:
            a, right, left = anchor[part], high[part] + length - anchor[part], anchor[part] - low[part]
            suffix = padded[length + a[:, None] + np.arange(length)]
            suffix[np.arange(length) >= right[:, None]] = 0
            order = np.lexsort((right, np.ascontiguousarray(suffix).view(f"S{length}").ravel()))
            part, a, right, left, suffix = part[order], a[order], right[order], left[order], suffix[order]
            differ = suffix[1:] != suffix[:-1]
            same = np.where(differ.any(1), differ.argmax(1), length)
            lcp = np.concatenate(([0], np.minimum(same, np.minimum(right[1:], right[:-1]))))
            reach = padded[length + a[:, None] - 1 - np.arange(length - GRAM)]
            reach[np.arange(length - GRAM) >= left[:, None]] = 0
            text = np.searchsorted(bounds, a, "right") - 1
            # the place in the order of documents: null ids first
            known, low_, here = (1 - null[text]).astype(np.uint8), a - high[part], np.full(len(a), block)
            spans, first = _windows(np.arange(len(a)), lcp, left, low_, reach, known, ids[text], here, text, a - bounds[text], length)
            # common prefixes with the last suffix that stays
            stay = np.flatnonzero(first)
            lcp = np.minimum.reduceat(lcp[: stay[-1] + 1], np.append(0, stay[:-1] + 1))
            lcp[0] = 0
            right, left, suffix, text, a = right[stay], left[stay], suffix[stay], text[stay], a[stay]
            at = np.arange(length)
            tails = suffix[(at >= lcp[:, None]) & (at < right[:, None])]
            before = reach[stay][np.arange(length - GRAM) < left[:, None]]
            columns = (lcp.astype(np.uint8), right.astype(np.uint8), left.astype(np.uint8), low_[stay].astype(np.uint8), tails, before, known[stay], ids[text], text.astype(np.int32), a - bounds[text], here[stay], spans[1].astype(np.int32), spans[2], spans[3])
            out.append((block, int(gram[part[0]] % np.uint64(buckets)), _pack(*(c.tobytes() for c in columns))))
        return _table(out)

    return work


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs (strings, each one's common prefix with the one before) by a loser tree.

    Every loser keeps its common prefix with the last winner. A longer one wins without a look at the bytes; equal ones
    are compared from there on. Returns (run, place) in order, and common prefixes with the entry before.
    """
    k = 1
    while k < len(runs):
        k *= 2
    ends = [len(r[0]) for r in runs] + [0] * (k - len(runs))
    at = [0] * k
    shared = [0] * k  # of each run's head with the last winner
    tree = [0] * k

    def beats(x: int, y: int) -> bool:
        """Whether x's head comes first; the loser's common prefix is brought up to date."""
        if at[x] >= ends[x]:
            return False
        if at[y] >= ends[y]:
            return True
        p, q = shared[x], shared[y]
        if p != q:
            return p > q
        a, b = runs[x][0][at[x]], runs[y][0][at[y]]
        n = min(len(a), len(b))
        if a[p:n] == b[p:n]:
            h, first = n, (len(a), x) < (len(b), y)
        else:
            h = p
            while a[h] == b[h]:
                h += 1
            first = a[h] < b[h]
        shared[y if first else x] = h
        return first

    def build(node: int) -> int:
        if node >= k:
            return node - k
        x, y = build(2 * node), build(2 * node + 1)
        if beats(x, y):
            tree[node] = y
            return x
        tree[node] = x
        return y

    order, prefixes = [], []
    winner = build(1) if k > 1 else 0
    for _ in range(sum(ends)):
        order.append((winner, at[winner]))
        prefixes.append(shared[winner] if len(order) > 1 else 0)
        at[winner] += 1
        if at[winner] < ends[winner]:
            shared[winner] = runs[winner][1][at[winner]]
        node = (winner + k) // 2
        while node:
            other = tree[node]
            if not beats(winner, other):
                tree[node], winner = winner, other
            node //= 2
    return order, prefixes


def _merge(length: int, whole: bool = True):
    """Removed spans of the windows that a bucket's merged suffixes show to be repeats, by block.

    Unless these are the ``whole`` table's runs, also a run (marked so) of the suffixes that have a first window among these.
    """

    def work(table: pa.Table) -> pa.Table:
        runs, heads, spans = [], [], []
        for block, body in zip(table["block"].to_pylist(), table["body"].to_pylist(), strict=True):
            c = _unpack(body)
            lcp, right, left, low = (np.frombuffer(x, np.uint8) for x in c[:4])
            strings, tails, before, at = [], c[4], b"", 0
            for p, n in zip(lcp.tolist(), right.tolist(), strict=True):
                before = before[:p] + tails[at : at + n - p]
                at += n - p
                strings.append(before)
            runs.append((strings, lcp.tolist()))
            n = len(lcp)
            reach = np.zeros((n, length - GRAM), np.uint8)
            reach[np.arange(length - GRAM) < left[:, None].astype(np.int64)] = np.frombuffer(c[5], np.uint8)
            heads.append((left.astype(np.int64), low.astype(np.int64), reach, np.frombuffer(c[6], np.uint8), *(np.frombuffer(x, k) for x, k in zip(c[7:11], (np.int64, np.int32, np.int64, np.int64), strict=True))))
            own = [np.frombuffer(x, k) for x, k in zip(c[11:], (np.int32, np.int64, np.int64), strict=True)]
            spans.append((np.full(len(own[0]), block, np.int64), *own))
        order, prefixes = merge_runs(runs)
        first = np.concatenate(([0], np.cumsum([len(r[0]) for r in runs])))
        place = np.array([first[r] + i for r, i in order], np.int64)
        left, low, reach, known, ids, text, anchor, block = (np.concatenate(c)[place] for c in zip(*heads, strict=True))
        lcp = np.array(prefixes, np.int64)
        # groups of equal grams, in batches
        edges = np.flatnonzero(np.concatenate(([True], lcp[1:] < GRAM, [True])))
        many = np.diff(edges) > 1
        start, bounds, stay = 0, edges[1:], np.ones(len(lcp), bool)
        while start < len(lcp):
            end = int(bounds[min(np.searchsorted(bounds, start + 20_000), len(bounds) - 1)])
            rows = np.arange(start, end)
            rows = rows[many[np.searchsorted(edges, rows, "right") - 1]]
            if len(rows):
                found, stay[rows] = _windows(rows, lcp, left, low, reach, known, ids, block, text, anchor, length)
                spans.append(found)
            start = end
        bucket = table["bucket"][0].as_py()
        out = _by_block(spans, bucket)
        if whole:
            return _table(out)
        kept = np.flatnonzero(stay)
        lcp = np.minimum.reduceat(lcp[: kept[-1] + 1], np.append(0, kept[:-1] + 1))
        lcp[0] = 0
        strings = [runs[r][0][i] for r, i in (order[k] for k in kept.tolist())]
        tails = b"".join([s[p:] for s, p in zip(strings, lcp.tolist(), strict=True)])
        right, none = np.array([len(s) for s in strings], np.uint8), np.zeros(0, np.int64)
        before = reach[kept][np.arange(length - GRAM) < left[kept, None]]
        columns = (lcp.astype(np.uint8), right, left[kept].astype(np.uint8), low[kept].astype(np.uint8), np.frombuffer(tails, np.uint8), before, known[kept], ids[kept], text[kept], anchor[kept], block[kept], none, none, none)
        out.append((table["group"][0].as_py(), bucket, _pack(*(c.tobytes() for c in columns))))
        return _table(out).append_column("run", pa.array([False] * (len(out) - 1) + [True]))

    return work


def _by_block(spans: list[tuple[np.ndarray, ...]], bucket: int) -> list[tuple[int, int, bytes]]:
    """A message per block with its spans."""
    block, text, begin, end = (np.concatenate(c) for c in zip(*spans, strict=True))
    order, out = np.argsort(block, kind="stable"), []
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        if len(part):
            out.append((int(block[part[0]]), bucket, _pack(text[part].astype(np.int32).tobytes(), begin[part].tobytes(), end[part].tobytes())))
    return out


def _prefix_classes(lcp: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[row, i]: rows in order agree in their first lengths[i] bytes exactly if their classes are equal; lcp: common prefix with the row before."""
    return np.cumsum(lcp[:, None] < lengths, axis=0, dtype=np.int64)


def _windows(rows, lcp, left, low, reach, known, ids, block, text, anchor, length) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Spans covered by windows that stand earlier as well, among suffixes ``rows`` of whole gram groups; which suffixes have a first window.

    A window of a suffix reaches o bytes to the left of the anchor and length - o to the right; two are equal if both agree.
    """
    context = np.ascontiguousarray(reach[rows])
    by_left = np.argsort(context.view(f"V{length - GRAM}").ravel().view(f"S{length - GRAM}"), kind="stable")
    differ = context[by_left[1:]] != context[by_left[:-1]]
    agree = np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), length - GRAM)))
    del context, differ
    order = np.lexsort((anchor[rows], text[rows], block[rows], ids[rows], known[rows]))
    new, found = np.zeros(len(rows), bool), []
    # windows that reach differently far to the left are different: some lengths at a time, fewer for large groups
    step = max(1, COMPARED // len(rows))
    for least in range(0, length - GRAM + 1, step):
        offsets = np.arange(least, min(least + step, length - GRAM + 1))
        right, before = _prefix_classes(lcp[rows], length - offsets), np.empty((len(rows), len(offsets)), np.int64)
        before[by_left] = _prefix_classes(agree, offsets)
        from_ = np.maximum(low[rows][order], least)
        n = np.maximum(np.minimum(left[rows][order], offsets[-1]) - from_ + 1, 0)
        own = np.repeat(order, n)
        o = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(from_, n)
        # classes and offsets are under the number of rows and 128: numbers up to 2**63 tell all apart for 2**28 suffixes
        key = (right[own, o - least] * (len(rows) + 1) + before[own, o - least]) * 128 + o
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        fresh = first[inverse] == np.arange(len(key))
        new[own[fresh]] = True
        own, start = own[~fresh], (anchor[rows][own] - o)[~fresh]
        of, at = block[rows][own], text[rows][own]
        by_start = np.lexsort((start, at, of))
        of, at, start = of[by_start], at[by_start], start[by_start]
        edge = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1]) | (start[1:] > start[:-1] + length)))) if len(of) else np.zeros(0, np.int64)
        last = np.append(edge[1:], len(of)) - 1 if len(of) else edge
        found.append((of[edge], at[edge], start[edge], start[last] + length))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)), new


def _cut_out(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["bucket"].to_pylist(), table["body"].to_pylist(), strict=True))
    ids, null, bounds, data = _opened(rows[0][1])
    parts = [_unpack(b) for _, b in rows[1:]]
    text, begin, end = (np.concatenate([np.frombuffer(p[i], k) for p in parts] or [np.zeros(0, k)]) for i, k in enumerate((np.int32, np.int64, np.int64)))
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    edges = np.searchsorted(text, np.arange(len(ids) + 1))
    removed, spans, kept, said = [], [], [], []
    for i in range(len(ids)):
        own = data[bounds[i] : bounds[i + 1]]
        n_spans = gone = 0
        if edges[i] < edges[i + 1]:
            ends = np.maximum.accumulate(end[edges[i] : edges[i + 1]])
            starts = begin[edges[i] : edges[i + 1]]
            fresh = np.concatenate(([True], starts[1:] > ends[:-1]))
            a, b = starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:], len(ends)) - 1]
            change = np.zeros(len(own) + 1, np.int8)
            change[a], change[b] = 1, -1
            covered = np.cumsum(change[:-1]).astype(bool)
            own, n_spans, gone = own[~covered], len(a), int(covered.sum())
        body = own.tobytes()
        removed.append(gone)
        spans.append(n_spans)
        kept.append(body)
        said.append(hashlib.sha256(body).hexdigest())
    return pa.table({"id": pa.array(ids, mask=null.astype(bool)), "n_bytes": np.diff(bounds), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array(said, pa.string())})
