"""Hot labels, words, passages and ids; letters; cases that earlier tests left out."""

import random
import sys
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, TOKENS, frame, roots

from driftplan.llm import common, language, mixing, near_text, near_vectors, packing, private, quality, repeats, token_counts


def test_letters():
    wrong = [hex(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and language.lettered(chr(c)) != unicodedata.category(chr(c)).startswith("L")]
    assert wrong == []


def test_texts_without_letters_have_no_language(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ ①", None), (2, "plain words here", "en"), (3, "palabras sin más", "es"), (4, "½ x", None), (5, "_ 12 ٣", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language.identify(docs, language.fit_dictionaries(docs)).collect()}
    assert found[1] == found[5] == ("und", 0.0, True) and found[4][0] != "und"


def test_languages_that_fit_alike(spark):
    """Equal dictionaries: the language with more training documents wins, and the text is rejected."""
    docs = spark.createDataFrame([(i, "the very same words", "bb" if i < 3 else "aa") for i in range(5)], "doc_id long, text string, lang string")
    body = language.folded("the very same words ") * 50
    learned = language.fit_dictionaries(docs)
    assert list(learned) == ["bb", "aa"]
    found = language.identify(docs, dict.fromkeys(learned, body)).collect()
    assert all((r.lang_pred, r.margin, r.rejected) == ("bb", 0.0, True) for r in found)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors_of_a_hot_label(spark):
    """90 % of the rows in one of 5,000 labels: its cells stay small, and its links are found."""
    rng, dim, hot, planted = np.random.default_rng(12), 24, 45_000, 3_000
    x = unit(rng.normal(size=(hot, dim)))
    own = x[:planted]
    away = rng.normal(size=own.shape)
    away = unit(away - (away * own).sum(1, keepdims=True) * own)
    cos = rng.uniform(0.9301, 1, (planted, 1))
    x[planted : 2 * planted] = cos * own + np.sqrt(1 - cos**2) * away
    rest = unit(rng.normal(size=(5_000, dim)))
    rest[1] = rest[0]
    labels = [0] * hot + [1, 1, *range(2, 5_000)]
    rows = [(i, v, label) for i, (v, label) in enumerate(zip([*x.tolist(), *rest.tolist()], labels, strict=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(16)
    classes = table.selectExpr("vec_id AS node", "vec_id AS class", "cast(label AS string) AS label", "embedding AS v")
    tiered = near_vectors._tiered(classes)
    assert {r.tier: r.n for r in tiered.groupBy("tier").agg(F.count_distinct("label").alias("n")).collect()} == {0: 4_999, int(np.log2(hot) / 2): 1}
    stats = tiered.where("tier > 0").groupBy("dim", "tier").agg(F.count("*").alias("n"), F.sum("share").alias("labels")).first()
    books, reach = near_vectors._model(tiered, stats, 0.93)
    home = np.concatenate([near_vectors.visits(part, books, reach)[0] for part in np.array_split(x, 30)])
    assert np.bincount(home).max() < 10 * near_vectors.PER_CELL
    found = {r.vec_id: r.n_links for r in near_vectors.near_vectors(table).collect()}
    near = sum(found[i] > 0 and found[planted + i] > 0 for i in range(planted))
    assert near >= 0.99 * planted and found[hot] == found[hot + 1] == 1 and sum(found[hot + 2 + i] for i in range(4_998)) == 0
    exact = sum(int((x[a : a + 500] @ x.T >= 0.93).sum()) for a in range(0, hot, 500)) - hot
    assert 0.99 * exact <= sum(found[i] for i in range(hot)) <= exact


def test_vectors_with_clashing_columns(spark):
    names = ["node", "class", "v", "dim", "tier", "share", "cell", "home", "h1", "copies", "salt", "chunks"]
    rows = [(1, [1.0, 0.0], "a", *["x"] * 12), (2, [1.0, 0.01], "a", *["x"] * 12), (3, [1.0, 0.0], "b", *["x"] * 12), (3, [0.0, 1.0], "a", *["x"] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, " + ", ".join(f"{n} string" for n in names))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(table).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True)]


def test_tokens_through_a_tree(spark, small, monkeypatch):
    """Many blocks, answered group by group and group of groups by group of groups."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").repartition(8)
    wanted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, TOKENS["op9"]).collect()}
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 20_000)
    monkeypatch.setattr(common, "FAN", 3)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, TOKENS["op9"]).collect()} == wanted


@pytest.mark.parametrize("seed", range(3))
def test_repeats_through_a_tree(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    texts = [" ".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(passages) if rng.random() < 0.2 else "é"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts = [f"{rng.choice(words)} {passages[0]} {t}" if rng.random() < 0.5 else t for t in texts] + ["z" * 500, "z" * 350, "y" * 99, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    said = lambda d: {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in d.collect()}
    wanted = said(repeats.remove_repeats(docs))
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 900)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 9_000)
    monkeypatch.setattr(common, "FAN", 4)
    assert said(repeats.remove_repeats(docs)) == wanted
    monkeypatch.setattr(repeats, "COMPARED", 50)  # a length of context at a time
    assert said(repeats.remove_repeats(docs)) == wanted


def _megabytes(work):
    tracemalloc.start()
    out = work()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_a_passage_of_a_hundred_thousand_blocks_takes_little_memory():
    """Messages of 100,000 blocks with one passage, behind words of their own in some: each task of the tree stays small."""
    length, passage = 100, (b"so it was said of this passage, which stands in every block, word by word: " * 3)[:160]
    runs = []
    for lead in (b"", b"one ", b"another lead "):
        text = lead + passage + b" and an end"
        body = repeats._pack(np.array([0], np.int64).tobytes(), np.zeros(1, np.uint8).tobytes(), np.array([len(text)], np.int64).tobytes(), text)
        grams = np.unique(repeats.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), length)[0])
        asked = pa.table({"block": [0, 0], "bucket": pa.array([-1, 0], pa.int32()), "body": [body, repeats._pack(np.ones(len(grams), bool).tobytes())]})
        runs.append(repeats._unpack(repeats._runs(length, 1)(asked)["body"][0].as_py()))

    def message(block: int) -> bytes:
        parts = list(runs[block % 3])
        n = len(parts[0])
        parts[7], parts[10] = np.full(n, block, np.int64).tobytes(), np.full(n, block, np.int64).tobytes()
        return repeats._pack(*parts)

    def table(blocks: list[int], bodies: list[bytes]) -> pa.Table:
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([0] * len(blocks), pa.int32()), "body": pa.array(bodies, pa.binary()), "group": pa.array([blocks[0]] * len(blocks), pa.int64())})

    # a group of blocks as large as they get, and all groups' runs
    first = table(list(range(common.FAN)), [message(i) for i in range(common.FAN)])
    found, most = _megabytes(lambda: repeats._merge(length, whole=False)(first))
    assert most < 300 and sum(found["run"].to_pylist()) == 1 and found.num_rows - 1 >= common.FAN - 3
    groups = 100_000 // common.FAN
    heads = [repeats._merge(length, whole=False)(table([g * common.FAN + i for i in range(3)], [message(g * common.FAN + i) for i in range(3)])) for g in range(groups)]
    last = table(list(range(groups)), [h["body"][h.num_rows - 1].as_py() for h in heads])
    found, most = _megabytes(lambda: repeats._merge(length)(last))
    assert most < 300 and found.num_rows >= groups - 1


def test_many_suffixes_of_one_gram_take_little_memory():
    n, length, rng = 80_000, 100, np.random.default_rng(2)
    left, low = np.full(n, length - repeats.GRAM), np.zeros(n, np.int64)
    reach = rng.integers(97, 123, (n, length - repeats.GRAM)).astype(np.uint8)
    zero = np.zeros(n, np.int64)
    (spans, fresh), most = _megabytes(lambda: repeats._windows(np.arange(n), np.full(n, length), left, low, reach, zero, np.arange(n), zero, np.arange(n), np.full(n, 70), length))
    assert most < 160 and fresh.all() and len(spans[0]) > 0


def test_a_word_of_every_block_takes_little_memory():
    bodies = [token_counts._pack("the\nof\nand".encode()) for _ in range(common.FAN)]
    (words, places), most = _megabytes(lambda: token_counts._places(bodies))
    assert words == ["the", "of", "and"] and len(places) == common.FAN and most < 20


def test_equal_keys_of_different_ids(spark, monkeypatch):
    """Ties in the key go by id: the same documents are taken whatever the rows' order."""
    monkeypatch.setattr(mixing, "uniform", lambda name, seed: F.lit(0.5))
    rows = [(i, "a b c", "s" if i < 40 else "t") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = ({r.doc_id: r.taken for r in mixing.mix(d, weights=(1, 3)).collect()} for d in (docs.repartition(5), docs.orderBy(F.desc("doc_id"))))
    assert one == other and len({*one.values()}) > 1
    taken = [one[i] for i in range(40)]
    assert taken == sorted(taken, reverse=True)


def test_a_source_more_than_one_task_orders(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), f"s{i % 23}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said = lambda: sorted((r.doc_id, r.target, r.taken) for r in mixing.mix(docs).collect())
    wanted = said()
    monkeypatch.setattr(mixing, "SOURCES", 5)
    assert said() == wanted


def test_a_pattern_as_frequent_with_two_kinds(spark):
    rows = [(i, f"please reach us at person{i}@example.com") for i in range(6)] + [(10 + i, f"please reach us at 10.0.0.{i}") for i in range(6)] + [(20, "please reach us at someone@intranet")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    graph = private.find_private(docs, confidence=0.4)
    found = {r.doc_id: r.spans for r in private.digest(graph).collect()}
    assert found[20] == "" or found[20].startswith("email:19")
    learned = private._patterns(spark.createDataFrame([("us at", f"e{i}", 0) for i in range(6)] + [("us at", f"1.{i}", 1) for i in range(6)], "pattern string, instance string, kind int"), 2, 0.4, 2).collect()
    assert [(r.pattern, r.kind) for r in learned] == [("us at", 0)]


def test_a_score_at_the_threshold(spark):
    docs = frame(spark, ODD)
    assert {(r.score, r.predicted) for r in quality.score(docs, None, threshold=0.5).collect()} == {(0.5, 1)}
    model = np.zeros((quality.TOTAL, quality.DIM), np.float32), lambda x: np.full(len(x), 0.3)
    assert {(r.score, r.predicted) for r in quality.score(docs, model).collect()} == {(0.3, 1)}
    below = model[0], lambda x: np.full(len(x), np.nextafter(0.3, 0))
    assert {r.predicted for r in quality.score(docs, below).collect()} == {0}


def test_word_vectors_from_whole_texts(spark):
    """Sums by tasks over whole texts, a long one among them, equal those over all texts at once."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA", "12", "!!", "é", "日本"]) for _ in range(n)) for n in (3, 50, 4_000, 700, 1)]
    index = quality.index_vectors()
    whole = quality.beside(texts, index)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = [quality._opened(r.total) for r in docs.mapInArrow(quality._summed, "total binary").collect()]
    assert (sum(found) == whole).all()
    plain = np.zeros_like(whole)
    words, shapes, bounds = quality.tokens(texts[:2])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for ids in (words, shapes):
            for i in range(a, b):
                for j in range(max(a, i - quality.REACH), min(b, i + quality.REACH + 1)):
                    if i != j:
                        plain[ids[i]] += index[words[j]].astype(np.int64)
    assert (plain == quality.beside(texts[:2], index)).all()


@pytest.mark.parametrize("capacity", [512, 1024])
def test_padding_of_packed_sequences(spark, small, capacity):
    """Sequences are full, or of a length that is a power of two; those that need padding are few."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = packing.pack(docs, TOKENS["op3"], capacity=capacity).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    odd = found[(found != capacity) & (found & (found - 1) != 0)]
    assert (found <= capacity).all() and (capacity - odd).sum() <= 0.001 * found.sum()


@pytest.mark.parametrize("many", [4, 10**9])
def test_documents_that_share_much(monkeypatch, many):
    """Families in which most pairs are near the threshold, some above: what is linked, pair by pair and along postings."""
    monkeypatch.setattr(near_text, "MANY", many)
    rng = np.random.default_rng(9)
    sets = [np.unique(np.concatenate((rng.choice(100, rng.integers(75, 100), replace=False), rng.integers(1000, 10**9, rng.integers(0, 14))))).astype(np.uint64) for _ in range(220)]
    signature, n = near_text.signatures(sets), np.array([len(s) for s in sets])
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    near = 100 * common >= 75 * (n[:, None] + n - common)
    assert 0.02 < near.mean() < 0.9
    wanted = roots(len(sets), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i != j])
    assert near_text._connect(signature, n, np.arange(len(sets)), 75, sets).tolist() == wanted
    hits = (signature[:, None, :] == signature[None]).sum(2)
    values = near_text._Postings(lambda: (signature + (np.arange(32) << 32)).ravel(), np.full(len(sets), 32))
    assert all((values.with_every(i) == np.where(np.arange(len(sets)) == i, values.with_every(i), hits[i])).all() for i in range(len(sets)))
