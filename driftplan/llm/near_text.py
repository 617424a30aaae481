"""Near-duplicate texts: an inverted join over MinHash coordinates, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segment
from .common import cut, pieces
from .components import by_group, components, deal, deal_rest, merge_roots, sizes

#: Coordinates of a signature, and how many two documents must share to be compared on full sets. At a similarity of
#: exactly 0.75 a pair shares 24 of 32 on average and fewer than 13 with a chance of 8 in a million.
COORDINATES, SHARED = 32, 13
#: Documents of a list or family in one piece, about.
LIST_SIDE, FAMILY_SIDE = 512, 256
#: Shingles of a document up to which a piece is dealt by number; pieces of longer ones have fewer documents.
HEAVY = 4_000
CHUNK_CHARS = 500_000
#: Pairs that are left to confirm, beyond which common shingles are counted along postings instead of pair by pair.
MANY = 256


def shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct ``width``-word shingles of each text as sorted 64-bit hashes; a shorter text is one shingle, one without words none."""
    hashes, bounds = segment.words(texts)
    out = []
    salts = segment.mix(np.arange(1, width + 1, dtype=np.uint64))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own, n = hashes[a:b], b - a - width + 1
        if n >= 1:
            total = own[:n] * (salts[0] | np.uint64(1))
            for k in range(1, width):
                total = segment.mix(total + salts[k]) + own[k : k + n]
            out.append(np.unique(segment.mix(total)))
        elif b > a:
            out.append(np.array([int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little")], np.uint64))
        else:
            out.append(own[:0])
    return out


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """MinHash signatures, a row of 31-bit values per set; empty sets get zeros."""
    out = np.zeros((len(sets), coordinates), np.int32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat, starts = np.concatenate([sets[i] for i in full]), np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])))[:-1]
        factors = segment.mix(np.arange(1000, 1000 + coordinates, dtype=np.uint64)) | np.uint64(1)
        adds = segment.mix(np.arange(5000, 5000 + coordinates, dtype=np.uint64))
        for j in range(coordinates):
            x = (flat ^ adds[j]) * factors[j]
            x ^= x >> np.uint64(32)
            x *= factors[(j + 1) % coordinates]
            out[full, j] = (segment.mix(np.minimum.reduceat(x, starts)) >> np.uint64(33)).astype(np.int32)
    return out


def near_dedup(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose shingle sets have 100 * intersection >= ``percent`` * union, and finds what is connected.

    A document posts its signature under (coordinate, value); values that nobody else has can't collide and are not
    posted. A document's postings are ordered from rare to common; as a pair must share at least 13 of its values, only the
    first ones, all but 12, need lists (prefix). Along each list collisions are counted over whole signatures, for a few
    documents with all others at a time; pairs that are in one family already are skipped, as are documents that are done.
    Documents with 13 collisions or more are one family. Within families, pairs with as many collisions are compared on
    full sets, those with most collisions first, and only while they aren't connected yet.

    Documents with equal sets form one class from the start (by 128 bits of hash over the set). Classes have numbers, as
    an id that is repeated with other texts is in several; only links are by id. Long lists and large families are dealt
    in pieces: each member goes to one of them, a few to all, and pieces are connected apart. Then members that this leaves
    in different components meet, the largest component with the others only. So what is sent is linear in a group of near
    copies, and neither copies nor large families are expanded into pairs. Signatures are fitted to ``percent`` 75: below,
    pairs near the threshold are lost more often.

    Null or wordless texts have no shingles and no links. Very long texts are taken whole; pieces of them hold fewer. Rows
    that repeat an id are one document that has all of their links. A row without id has no links and a null component. An
    empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names. Returns one row per
    input row: ``id_col``, n_shingles, component_id, kept (id = component_id; a row without id: true).
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = cut(source.mapInArrow(_sign(width), "id long, mark long, n long, f1 long, f2 long, signature array<int>"), "signatures")
    sound = signed.where("n > 0 and id is not null")
    first = sound.groupBy("f1", "f2").agg(F.min(F.struct("id", "mark")).alias("first"), F.max_by("signature", "id").alias("signature"), F.max("n").alias("n"))
    classes = cut(first.select("f1", "f2", F.monotonically_increasing_id().alias("node"), "first.id", "first.mark", "signature", "n"), "classes")
    same = sound.select("f1", "f2", F.col("id").alias("a")).join(classes.select("f1", "f2", F.col("id").alias("b")), ["f1", "f2"]).select("a", "b").where("a <> b")
    links = _links(_families(_postings(classes), percent), classes, source, width, percent)
    roots = cut(components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(same)), "components")
    root = F.coalesce("root", "id")
    return signed.join(roots, signed["id"] == roots["node"], "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept")
    )


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            sets = shingles(texts, width)
            prints = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _lists(signatures(sets))], names=["id", "mark", "n", "f1", "f2", "signature"])

    return run


def _lists(found: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, COORDINATES), pa.int32()), pa.array(found.ravel(), pa.int32()))


def _postings(classes: DataFrame) -> DataFrame:
    """(list, node, n, signature): the prefix of every class's shared values, rarest first."""
    token = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long"))
    tokens = classes.select("node", F.posexplode("signature").alias("pos", "value")).select("node", token.alias("list"))
    common = cut(tokens.groupBy("list").agg(F.count("*").alias("often")).where("often > 1"), "lists")
    own = tokens.join(common, "list").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "list"))).alias("own")).where(F.size("own") >= SHARED)
    prefix = own.select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - F.lit(SHARED - 1))).alias("x")).select("node", "x.list")
    return cut(prefix.join(classes.select("node", "n", "signature"), "node").select("list", "node", "n", "signature"), "postings")


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(rows, -1)


def _linked(rows: DataFrame, group: str, key: str, side: int, heavy: int, columns: tuple[str, ...], find) -> DataFrame:
    """(node, root) of what ``find`` connects within groups: in pieces first, then what large groups have left apart."""
    sized = sizes(rows, group, side, "n", heavy)

    def work(table: pa.Table, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        own, label = table[key].to_numpy(), table["root"].to_numpy()
        edges = np.append(bounds, table.num_rows) if bounds[-1] != table.num_rows else bounds
        yield from find(table, own, label, edges)

    first = cut(by_group(deal(rows, group, "node", sized).withColumn("root", F.col(key)).select(group, "piece", key, "root", *columns), (group, "piece"), work, "a long, b long", ("a", "b")), "pairs")
    roots = components(first)
    if sized.where("chunks > 1").isEmpty():
        return roots
    roots = cut(roots, "roots")
    rest = deal_rest(rows, group, "node", sized, roots, key).select(group, "piece", key, "root", *columns)
    more = cut(by_group(rest, (group, "piece"), work, "a long, b long", ("a", "b")), "pairs")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _connect(signature: np.ndarray, n: np.ndarray, root: np.ndarray, percent: int, hashes: list[np.ndarray] | None = None) -> np.ndarray:
    """Roots after linking rows with collisions enough and sizes that allow the similarity; with ``hashes``, if the sets confirm it.

    Collisions of a few rows, members of the smallest components, are counted with all others at a time. Pairs that are
    connected already are skipped, and it ends when all that is left is connected: a group of near copies takes one step.
    Where that takes more, collisions are counted along the lists of rows with a value in common.
    """
    active, step, common = np.arange(len(root)), 1, None if hashes is None else _Postings(lambda: np.concatenate(hashes), n)
    values = _Postings(lambda: (signature + (np.arange(signature.shape[1]) << 32)).ravel(), np.full(len(root), signature.shape[1]))
    while len(active) and (root[active] != root[active[0]]).any():
        own = root[active]
        order = np.lexsort((own, np.bincount(own, minlength=len(root))[own]))
        pivots, active = active[order[:step]], active[np.sort(order[step:])]
        every = np.concatenate((pivots, active))
        if step > 4 and len(every) > 64:
            hits = np.stack([values.with_every(p)[every] for p in pivots.tolist()])
        else:
            hits = np.count_nonzero(signature[pivots][:, None, :] == signature[every][None, :, :], axis=2)
        a, b = np.nonzero(hits >= SHARED)
        x, y, hits = pivots[a], every[b], hits[a, b]
        fit = (root[x] != root[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        x, y, hits = x[fit], y[fit], hits[fit]
        root = merge_roots(root, x, y) if common is None else _confirm(x, y, hits, root, hashes, common, percent)
        step = min(64, 4 * step)
    return root


def _families(postings: DataFrame, percent: int) -> DataFrame:
    """(node, root): classes that may be linked, directly or through others."""

    def find(table: pa.Table, node: np.ndarray, label: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        signature, n, size = _matrix(table["signature"], table.num_rows), table["n"].to_numpy(), np.diff(edges)
        two = edges[:-1][size == 2]
        fit = ((signature[two] == signature[two + 1]).sum(1) >= SHARED) & (np.minimum(n[two], n[two + 1]) * 100 >= np.maximum(n[two], n[two + 1]) * percent)
        yield node[two[fit]], node[two[fit] + 1]
        for k in np.flatnonzero(size > 2):
            at = slice(edges[k], edges[k + 1])
            yield _joins(node[at], label[at], lambda start, at=at: _connect(signature[at], n[at], start, percent))

    return cut(_linked(postings, "list", "node", LIST_SIDE, LIST_SIDE * HEAVY, ("n", "signature"), find), "families")


def _joins(key: np.ndarray, label: np.ndarray, connect) -> tuple[np.ndarray, np.ndarray]:
    """The links that ``connect`` adds to rows of equal labels, as few as connect them."""
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    root = connect(first[inverse])
    moved = first[root[first] != first]
    return key[moved], key[root[moved]]


def _links(families: DataFrame, classes: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of ids that links within families connect."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            sets = shingles(texts, width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), _lists(signatures(sets))], names=["family", "node", "id", "n", "hashes", "signature"])

    def find(table: pa.Table, id_: np.ndarray, label: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        signature, n = _matrix(table["signature"], table.num_rows), table["n"].to_numpy()
        bodies = table["hashes"].combine_chunks()
        bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in bodies.slice(a, b - a)]
            yield _joins(id_[a:b], label[a:b], lambda start, a=a, b=b, hashes=hashes: _connect(signature[a:b], n[a:b], start, percent, hashes))

    named = cut(families.join(classes.select("node", "id", "mark"), "node").select(F.col("root").alias("family"), "node", "id", "mark"), "members")
    # texts meet their members by exchange at every size: members grow with the input
    members = source.join(named.hint("merge"), ["id", "mark"]).select("family", "node", "id", "text")
    sets = cut(members.mapInArrow(gather, "family long, node long, id long, n long, hashes binary, signature array<int>"), "sets")
    return _linked(sets, "family", "id", FAMILY_SIDE, FAMILY_SIDE * HEAVY, ("n", "hashes", "signature"), find)


class _Postings:
    """Lists of the rows that hold an element, to count what rows have in common. Made when they are first needed."""

    def __init__(self, elements: Callable[[], np.ndarray], sizes: np.ndarray):
        self.elements, self.sizes, self.rows = elements, sizes, None

    def with_every(self, one: int) -> np.ndarray:
        """How many elements of one row each row holds, counted along their lists."""
        if self.rows is None:
            self.ends = np.concatenate(([0], np.cumsum(self.sizes)))
            self.place = np.unique(self.elements(), return_inverse=True)[1].astype(np.int32)
            order = np.argsort(self.place, kind="stable")
            self.rows = (np.searchsorted(self.ends, order, "right") - 1).astype(np.int32)
            self.lists = np.concatenate(([0], np.cumsum(np.bincount(self.place))))
        own = self.place[self.ends[one] : self.ends[one + 1]]
        start, n = self.lists[own], self.lists[own + 1] - self.lists[own]
        start, n = start[n > 1], n[n > 1]  # lists with this row alone are skipped
        at = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
        return np.bincount(self.rows[at], minlength=len(self.sizes))


def _confirm(x: np.ndarray, y: np.ndarray, hits: np.ndarray, root: np.ndarray, hashes: list[np.ndarray], common: _Postings, percent: int) -> np.ndarray:
    """Roots after comparing full sets of the pairs x-y, best first, as long as they aren't connected.

    Where the best ones leave many pairs apart, as among documents that share much and aren't alike, the common shingles of
    each x with all others are counted at once.
    """
    turn = 1
    order = np.lexsort((y, x, -hits))
    x, y = x[order], y[order]
    while len(x):
        if turn > 2 and len(x) > MANY:
            hit = np.zeros(len(x), bool)
            for one in np.unique(x).tolist():
                at = np.flatnonzero(x == one)
                n = common.with_every(one)[y[at]]
                hit[at] = 100 * n >= percent * (common.sizes[one] + common.sizes[y[at]] - n)
            return merge_roots(root, x[hit], y[hit])
        # the best pairs of every document that are left: one each, then twice as many each time
        now = (_places(x) < turn) | (_places(y) < turn)
        hit = np.array([_similar(hashes[p], hashes[q], percent) for p, q in zip(x[now].tolist(), y[now].tolist(), strict=True)], bool)
        root = merge_roots(root, x[now][hit], y[now][hit])
        rest = ~now
        rest[rest] = root[x[rest]] != root[y[rest]]
        x, y, turn = x[rest], y[rest], 2 * turn
    return root


def _places(of: np.ndarray) -> np.ndarray:
    """How many earlier entries are equal to each entry."""
    order = np.argsort(of, kind="stable")
    held = of[order]
    first = np.concatenate(([True], held[1:] != held[:-1]))
    out = np.empty(len(of), np.int64)
    out[order] = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    return out


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
