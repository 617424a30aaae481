"""Near-duplicate vectors through an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components, merge_roots

#: Vectors that codebooks and the reach of visits are fitted on, at most, queries among them, and made-up neighbours of each.
SAMPLE, QUERIES, MADE = 20_000, 1_000, 4
#: Vectors of a cell, about; members of a cell that one task takes on each side.
PER_CELL, SIDE = 24, 4_096
TARGET_RECALL = 0.9995
TINY = 1e-12
#: Vectors of a label and length up to which they are one cell, without a model; centres of a codebook, at most: beyond
#: about PER_CELL * CENTRES ** 2, a hundred million vectors of one label, cells grow in proportion to the label.
PLAIN, CENTRES = 512, 2_048
#: Parts that a label is counted in, and entries of a matrix of rows and centres at a time.
SALTS, MATRIX = 64, 2_000_000
#: Rows, entries of a grid and postings that are in memory at once.
BLOCK, GRID, POSTS = 250, 4_000_000, 20_000
#: Members whose cosines with a chunk are in memory at once, and pairs that are verified at once.
SLAB, PAIRS = 64, 20_000


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = x.shape[1] // 2
    return x[:, :h], x[:, h:]


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres, at most k and all different at first; deterministic. Empty clusters keep their centres."""
    centres = np.unique(x, axis=0) if x.shape[1] else x[:1]
    centres = centres[np.random.default_rng(7).permutation(len(centres))[:k]]
    for _ in range(rounds if x.shape[1] else 0):
        own = distances(x, centres).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


_apart: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def apart(centres: np.ndarray) -> np.ndarray:
    """Twice the distances between centres, remembered for those in use."""
    held = _apart.get(id(centres))
    if held is None or held[0] is not centres:
        if len(_apart) >= 16:
            _apart.clear()
        held = _apart[id(centres)] = centres, 2 * np.sqrt(distances(centres, centres))
    return held[1]


def margins(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre, and the squared distance from the plane between it and each centre: 0 at the nearest one."""
    d = distances(x, centres)
    own = d.argmin(1)
    return own, (np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / np.maximum(apart(centres)[own], TINY)) ** 2


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cells, and (row, cell), in order, of all cells whose squared margins add up to ``reach`` at most, home among them."""
    (own_a, a), (own_b, b) = (margins(h, c) for h, c in zip(halves(x), books, strict=True))
    of, i = np.nonzero(a <= reach)
    step, rows, cells = max(1, GRID // b.shape[1]), [of[:0]], [of[:0]]
    for at in range(0, len(of), step):
        near, side = of[at : at + step], i[at : at + step]
        e, j = np.nonzero(a[near, side][:, None] + b[near] <= reach)
        rows.append(near[e])
        cells.append(side[e] * b.shape[1] + j)
    return own_a * b.shape[1] + own_b, np.concatenate(rows), np.concatenate(cells)


def needed(x: np.ndarray, y: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least ``reach`` with which each pair x-y meets."""
    there, back = np.zeros(len(x)), np.zeros(len(x))
    for h, other, c in zip(halves(x), halves(y), books, strict=True):
        (own_x, to_x), (own_y, to_y) = margins(h, c), margins(other, c)
        there += to_x[np.arange(len(x)), own_y]
        back += to_y[np.arange(len(x)), own_x]
    return np.minimum(there, back)


def leads(x: np.ndarray, labels: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of which none links with another: each other row links with an earlier one, so a hot group has a lead or few."""
    order = np.random.default_rng(13).permutation(len(x))
    order = order[np.argsort(labels[order], kind="stable")]
    out = []
    for own in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        held = own[:0]
        for at in np.array_split(own, -(-len(own) // BLOCK)):
            at = at[~(x[at] @ x[held].T >= threshold).any(1)]
            held = np.append(held, at[~np.tril(x[at] @ x[at].T >= threshold, -1).any(1)])
        out.append(held)
    return np.concatenate(out)


def partners(x: np.ndarray, labels: np.ndarray, chosen: np.ndarray, threshold: float, weight) -> tuple[np.ndarray, np.ndarray]:
    """For each chosen row that has links, the one of least weight: one partner per query, however large its group."""
    of, to = [], []
    for at in np.array_split(chosen, -(-len(chosen) // BLOCK)):
        cos = x[at] @ x.T
        hit = (cos >= threshold) & (labels[at][:, None] == labels)
        hit[np.arange(len(at)), at] = False
        some = hit.any(1)
        of.append(at[some])
        to.append(np.where(hit, weight(cos), np.inf)[some].argmin(1))
    return np.concatenate(of), np.concatenate(to)


def made_up(q: np.ndarray, cos: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A neighbour of each query at the given cosine, in a random direction."""
    noise = rng.normal(size=q.shape)
    noise -= (noise * q).sum(1, keepdims=True) * q
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), TINY)
    return cos[:, None] * q + np.sqrt(1 - cos[:, None] ** 2) * noise


def fit(x: np.ndarray, labels: np.ndarray, k: int, threshold: float, target: float = TARGET_RECALL) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """Codebooks of the two halves, and how far vectors visit: each of four kinds of pairs has ``target`` recall by itself.

    These are the leads' farthest links and made-up neighbours of theirs, at the threshold and from there to 1, in which a
    hot group counts no more than any lead; and links of rows drawn evenly, for the hot groups themselves.
    """
    labels = np.unique(labels.astype(str), return_inverse=True)[1]
    lead, rng = leads(x, labels, threshold), np.random.default_rng(11)
    books = tuple(codebook(h, k) for h in halves(x[lead]))
    q = x[np.resize(rng.permutation(lead)[:QUERIES], MADE * QUERIES)]
    pairs = [(q, made_up(q, cos, rng)) for cos in (np.full(len(q), threshold), rng.uniform(threshold, 1, len(q)))]
    for chosen, weight in ((rng.permutation(lead)[:QUERIES], lambda cos: cos), (rng.permutation(len(x))[:QUERIES], lambda cos: rng.random(cos.shape))):
        of, to = partners(x, labels, chosen, threshold, weight)
        pairs.append((x[of], x[to]))
    reach = 0.0
    for a, b in pairs:
        need = np.sort(needed(a, b, books))
        if len(need):
            reach = max(reach, float(need[int(np.ceil(target * len(need))) - 1]))
    return books, reach * (1 + 1e-9)


def near_vectors(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal, non-null label whose cosine, in double precision, is at least ``threshold``.

    Independent codebooks on the halves of unit vectors, fitted on a bounded sample, form a product grid of cells. Every
    vector is in its home cell and visits the cells whose borders are near, as far as the target recall takes; it meets
    those at home there. Each meeting is verified. A pair that meets in both homes counts in the lower one; who visits whose
    home is worked out from the codebooks, so a visit carries no list. Labels of about the same size share codebooks, with
    as many centres as their size takes; labels of up to ``PLAIN`` vectors are a cell.

    Equal vectors of a label are one class with a count from the start, known by 128 bits of hash beyond that step. Vectors
    travel as they are given and are normalised where they meet. Cells with many members are dealt as pairs of chunks, so
    that no task holds more than two chunks; tasks return link counts and a spanning forest, never pairs.

    Vectors that are null, zero, of length 0 or hold null or non-finite components link with nothing, as do those without
    label or id; vectors of different lengths aren't compared. Rows that repeat an id count each. An empty table gives an
    empty result. Other columns are ignored, whatever their names. Returns one row per input row: ``id_col``, n_links (other
    rows linked directly), component_id (smallest id reachable), kept.
    """
    kind = table.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda c: c + F.lit(0.0).cast(kind))))
    rows = rows.select("id", "label", "v", *[F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v")).alias(h) for seed, h in ((1, "h1"), (2, "h2"))])
    grouped = rows.where("v is not null").groupBy("label", "h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    classes = _tiered(cut(grouped.withColumn("class", F.monotonically_increasing_id()), "vector-classes"))
    stats = classes.where("tier > 0").groupBy("dim", "tier").agg(F.count("*").alias("n"), F.sum("share").alias("labels")).orderBy("dim", "tier").collect()
    models = {(s["dim"], s["tier"]): _model(classes, s, threshold) for s in stats}
    posts = cut(classes.mapInArrow(_post(models), f"label string, dim int, tier int, cell long, home long, class long, node long, copies long, v array<{kind}>"), "posts")
    sizes = cut(posts.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).where(F.col("n") > SIDE).select("label", "dim", "cell", F.ceil(F.col("n") / F.lit(SIDE)).cast("int").alias("chunks")), "large-cells")
    dealt = posts.join(sizes, ["label", "dim", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("chunks", "other")
    met = cut(dealt.groupBy("label", "dim", "cell", "i", "j").applyInArrow(_meet(models, threshold), "class long, links long, node long, root long"), "met")
    counts = met.groupBy("class").agg(F.sum("links").alias("links"))
    named = cut(rows.drop("v").join(classes.drop("v"), ["label", "h1", "h2"], "left").select("id", "class", "node", "copies"), "vector-names")
    same = named.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    roots = cut(components(met.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(same)), "vector-components").withColumnRenamed("node", "of")
    found = named.join(counts, "class", "left").join(roots, F.col("id") == F.col("of"), "left")
    links = F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long")
    root = F.coalesce("root", "id")
    return found.select(F.col("id").cast(table.schema[id_col].dataType).alias(id_col), links.alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def _unit(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    x = np.asarray(batch.flatten() if isinstance(batch, pa.ListArray) else batch).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _tiered(classes: DataFrame) -> DataFrame:
    """``classes`` with dim, and their label's tier: 0 for few vectors, else labels within a factor of four; share: a label's shares are 1 together.

    A label is counted in parts, and told its tier in parts: no task has all rows of a hot one.
    """
    parts = classes.withColumn("dim", F.size("v")).withColumn("salt", F.pmod(F.col("class"), F.lit(SALTS)).cast("int"))
    counted = cut(parts.groupBy("label", "dim", "salt").agg(F.count("*").alias("n")), "label-parts")
    whole = counted.groupBy("label", "dim").agg(F.sum("n").alias("whole"))
    tier = F.when(F.col("whole") > PLAIN, F.floor(F.log2("whole") / 2).cast("int")).otherwise(F.lit(0))
    known = counted.select("label", "dim", "salt").join(whole, ["label", "dim"]).select("label", "dim", "salt", tier.alias("tier"), (1 / F.col("whole")).alias("share"))
    return cut(parts.join(known, ["label", "dim", "salt"]).drop("salt"), "tiered-classes")


def _model(classes: DataFrame, s, threshold: float):
    """Codebooks and reach for the labels of a tier, as many centres as a label of their mean size takes."""
    classes = classes.where((F.col("dim") == s["dim"]) & (F.col("tier") == s["tier"]))
    share = min(1.0, SAMPLE / s["n"])
    drawn = classes.where((F.abs(F.xxhash64("node", F.lit("sample"))) < share * float(1 << 63))).select("label", "v", "node").orderBy("node", "label", "v").limit(2 * SAMPLE).toArrow()
    if not drawn.num_rows:
        drawn = classes.orderBy("node", "label", "v").limit(1).select("label", "v", "node").toArrow()
    x = _unit(drawn["v"].combine_chunks(), s["dim"])
    k = int(np.clip(np.sqrt(s["n"] / s["labels"] / PER_CELL), 1, min(CENTRES, len(x))))
    return fit(x, np.array(drawn["label"].to_pylist(), object), k, threshold)


def _of(models, dim: int, tier: int):
    """The model for a length and tier; few vectors are one cell with its centre at zero."""
    return models.get((dim, tier)) or ((np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))), 0.0)


def _post(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "class", "node", "copies", "v", "dim", "tier"]
        for batch in batches:
            label, class_, node, copies, v, dims, tiers = (batch.column(batch.schema.get_field_index(n)) for n in names)
            kinds = np.stack((dims.to_numpy(), tiers.to_numpy()), axis=1)
            for dim, tier in np.unique(kinds, axis=0).tolist():
                model, own = _of(models, dim, tier), np.flatnonzero((kinds == (dim, tier)).all(1))
                for at in np.array_split(own, -(-len(own) // max(1, min(2_000, MATRIX // len(model[0][0]))))):
                    home, rows, cells = visits(_unit(v.take(pa.array(at)), dim), *model)
                    for i in range(0, len(rows), POSTS):
                        of, cell = rows[i : i + POSTS], cells[i : i + POSTS]
                        take, same = pa.array(at[of]), np.ones(len(of), np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [label.take(take), pa.array(dim * same), pa.array(tier * same), pa.array(cell), pa.array(home[of]), class_.take(take), node.take(take), copies.take(take), v.take(take)],
                            names=["label", "dim", "tier", "cell", "home", "class", "node", "copies", "v"],
                        )

    return run


def _visits(x: np.ndarray, rows: np.ndarray, cells: np.ndarray, books: tuple[np.ndarray, np.ndarray], reach: float) -> np.ndarray:
    """Whether each of ``rows`` visits the cell beside it."""
    own, at = np.unique(rows, return_inverse=True)
    out = np.zeros(len(rows), bool)
    for i in range(0, len(own), BLOCK):
        (_, a), (_, b) = (margins(h, c) for h, c in zip(halves(x[own[i : i + BLOCK]]), books, strict=True))
        here = np.flatnonzero((at >= i) & (at < i + BLOCK))
        out[here] = a[at[here] - i, cells[here] // len(books[1])] + b[at[here] - i, cells[here] % len(books[1])] <= reach
    return out


def _meet(models, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j, cell, dim, tier = (table[c][0].as_py() for c in ("i", "j", "cell", "dim", "tier"))
        if table.num_rows < 2:
            return pa.table({c: pa.array([], pa.int64()) for c in ("class", "links", "node", "root")})
        model = _of(models, dim, tier)
        v = table["v"].combine_chunks()
        x = _unit(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v, dim)
        class_, node, copies, home, own = (table[c].to_numpy() for c in ("class", "node", "copies", "home", "own"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for at in range(0, len(left), SLAB):
            rows = left[at : at + SLAB]
            a, b = np.nonzero(x[rows] @ x[right].T >= threshold - 1e-9)
            a, b = rows[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            at_home = (home[a] == cell).astype(np.int8) + (home[b] == cell)
            sure = at_home == 2
            # one of the two is at home here: the other's home counts if it is lower and visited by the first
            one = np.flatnonzero(at_home == 1)
            here = home[a[one]] == cell
            host, guest = np.where(here, a[one], b[one]), np.where(here, b[one], a[one])
            sure[one] = (cell < home[guest]) | ~_visits(x, host, home[guest], *model)
            a, b = a[sure], b[sure]
            exact = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + PAIRS]], x[b[k : k + PAIRS]]) >= threshold for k in range(0, len(a), PAIRS)] or [np.zeros(0, bool)])
            a, b = a[exact], b[exact]
            links += np.bincount(a, copies[b], len(x)).astype(np.int64) + np.bincount(b, copies[a], len(x)).astype(np.int64)
            root = merge_roots(root, a, b)
        keep = (links > 0) | (root != np.arange(len(x)))
        return pa.table({"class": class_[keep], "links": links[keep], "node": node[keep], "root": node[root[keep]]})

    return run
