import hashlib
import math
import os
import random
import re
import sys
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same

from driftplan.llm import components, dedup_exact, language, mixing, near_text, near_vectors, packing, private, quality, queries, repeats, segment, token_counts
from driftplan.llm.common import running, safe_parts

TOKENS = {"op3": queries.tokenizer("byte_bpe_50k.json"), "op9": queries.tokenizer("word_bpe_49k.json")}
#: Columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, id string, row string, n string, bytes string, block string, name string, size string, node string, bucket string"
LONG = ("lorem ipsum dolor sit amet " * 60_000) + "end"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA)


ODD = [
    (1, "one two three four five six seven", "en", "b"),
    (2, "one two three four five six seven", "en", "b"),
    (2, "one two three four five six seven", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (None, "uno dos tres cuatro cinco seis", None, "a"),
    (5, "...   \n\t 12", "es", None),
    (6, LONG, "es", "a"),
    (7, "日本語 text <|endoftext|> Σας x́ don't", "es", "a"),
    (8, "nul \x00 in \x00 it " * 20, "en", "a"),
]
OPERATORS = {
    "mix": lambda d: mixing.mix(d),
    "exact": lambda d: dedup_exact.exact_dedup(d, block_bytes=16 if d.where("doc_id = 6").isEmpty() else 4096),
    "pack": lambda d: packing.pack(d, TOKENS["op3"]),
    "repeats": lambda d: repeats.remove_repeats(d),
    "quality": lambda d: quality.score(d, quality.fit(d.limit(0).selectExpr("*", "1 quality"))),
    "language": lambda d: language.identify(d, language.fit_dictionaries(d)),
    "near": lambda d: near_text.near_dedup(d),
    "tokens": lambda d: token_counts.count_tokens(d, TOKENS["op9"]),
    "private": lambda d: private.digest(private.find_private(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    found = OPERATORS[name](frame(spark, ODD).repartition(2)).toPandas()
    if name == "pack":
        assert found.groupby("doc_id", dropna=False).ngroups == 9
    else:
        assert len(found) == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](frame(spark, []).where("false")).count() == 0


def test_exact_names(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    found = dedup_exact.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=3).toPandas()
    for r in found.itertuples():
        group = [i for i, t in enumerate(texts) if t == texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small).toPandas(), queries.ORACLES[name], small)


def test_mix_targets(spark, small):
    found = queries.op1_mixing(spark, small).toPandas()
    assert math.isclose(found.groupby(["source_size", "target"]).first().reset_index().target.sum(), found["size"].sum(), rel_tol=1e-6)
    assert (found.taken <= 3 * found["size"]).all()


def test_tokens_and_packing_against_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [r[1] or "" for r in ODD] + ["".join(rng.choice("ab 'sl\n9.éΣ") for _ in range(200)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(TOKENS["op9"])
    for r in token_counts.count_tokens(docs, TOKENS["op9"]).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(library.encode(texts[r.doc_id], add_special_tokens=False).ids))
    library, found = Tokenizer.from_file(TOKENS["op3"]), packing.pack(docs, TOKENS["op3"]).toPandas()
    for doc, own in found.groupby("doc_id"):
        ids, at = np.array([*library.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4"), 0
        for r in own.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024


def test_tokens_in_many_buckets(spark, small, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "BUCKET_CHARS", 5_000)
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 50_000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    library, texts = Tokenizer.from_file(TOKENS["op9"]), {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_counts.count_tokens(docs, TOKENS["op9"]).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_tokens_whose_lower_case_leaves_the_table(spark):
    from tokenizers import Tokenizer

    texts = ["plain text", "\u13a0\u13ef and \u13f0 isn't 12", "a" * 30 + " \u13a3\u13b3 <|endoftext|> \u13a9"]
    library = Tokenizer.from_file(TOKENS["op9"])
    found = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENS["op9"]).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", range(6))
def test_repeats_by_brute_force(spark, monkeypatch, seed):
    if seed % 2:
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 1_000_000)
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    texts = [" ".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(passages) if rng.random() < 0.2 else "é"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [texts[3], texts[7] + "!", "z" * 500, "z" * 350]
    if seed > 3:  # one passage in most documents, behind different words
        texts = [f"{rng.choice(words)} {passages[0]} {t}" if rng.random() < 0.7 else t for t in texts] + ["\0" * 300, "a" + "\0" * 250]
    found = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    seen = set()
    for i, text in enumerate(texts):
        data = text.encode()
        covered = [False] * len(data)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                covered[k : k + 100] = [True] * 100
            seen.add(data[k : k + 100])
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        assert (found[i].n_removed, found[i].n_spans, bytes(found[i].kept)) == (sum(covered), spans, kept)


@pytest.mark.parametrize("seed", range(20))
def test_loser_tree(seed):
    rng = random.Random(seed)
    runs = []
    for _ in range(rng.randint(1, 6)):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 9)))
        runs.append((strings, [0] + [len(os.path.commonprefix(x)) for x in zip(strings, strings[1:])]))
    order, prefixes = repeats.merge_runs(runs)
    merged = [runs[r][0][i] for r, i in order]
    assert merged == sorted(x for r in runs for x in r[0])
    assert prefixes == [0] + [len(os.path.commonprefix(x)) for x in zip(merged, merged[1:])]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(n, linked):
    root = list(range(n))
    for _ in range(n):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("shown", [0, 1, 8])
def test_near_text_by_brute_force(spark, monkeypatch, shown):
    monkeypatch.setattr(near_text, "LIST_SIDE", 8)
    monkeypatch.setattr(near_text, "FAMILY_SIDE", 5)
    monkeypatch.setattr(components, "SHOWN", shown)
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 999)}"
            texts.append(" ".join(own))
    texts += ["a b", "a b", "A B", "", "b a", texts[0]]
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    wanted = roots(len(texts), linked)
    for r in near_text.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), wanted[r.doc_id], wanted[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("confirmed", [False, True])
def test_a_large_family_takes_little_memory(confirmed):
    rng = np.random.default_rng(6)
    sets = [np.unique(np.concatenate((np.arange(100), rng.integers(1000, 100_000, 8)))).astype(np.uint64) for _ in range(4096)]
    signature, n = near_text.signatures(sets), np.array([len(s) for s in sets])
    tracemalloc.start()
    root = near_text._connect(signature, n, np.arange(len(sets)), 75, sets if confirmed else None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (root == 0).all() and peak < 32e6


def test_near_text_of_an_id_with_two_texts(spark):
    one, two = ([f"{c}{i}" for i in range(n)] for c, n in (("u", 60), ("v", 150)))
    rows = [(5, one), (5, two), (5, two), (1, [*one, "end"]), (9, [*two, "end"]), (7, ["w", *one[:20]])]
    found = near_text.near_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(1, 57, 1), (5, 56, 1), (5, 146, 1), (5, 146, 1), (7, 17, 7), (9, 147, 1)]


def test_near_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "SIDE", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.1 * rng.normal(size=16)).tolist(), i % 3) for i in range(400)]
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[5][1], None), (504, [None, 1.0], 1), (505, [], 1), (506, [1e300] * 16, 1), (507, [2e300] * 16, 1), (508, [1.0, 2.0], 1), (None, rows[5][1], rows[5][2])]
    found = {r.vec_id: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(found) == len(rows)
    ids = [i for i, v, l in rows if i is not None and v and l is not None and len(v) == 16 and all(math.isfinite(x) for x in v) and any(v)]
    by = {r[0]: r for r in rows}
    unit = {i: np.array(by[i][1]) / max(map(abs, by[i][1])) for i in ids}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    n = dict.fromkeys(ids, 0)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if by[i][2] == by[j][2] and float(unit[i] @ unit[j]) >= 0.93:
                n[i] += 1
                n[j] += 1
    got = sum(found[i].n_links for i in ids)
    assert 0.9 * sum(n.values()) <= got <= sum(n.values())
    assert all(found[i].n_links <= n[i] for i in ids)
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (500, 501, 502, 503, 504, 505, 508))
    assert found[506].component_id == found[507].component_id


def test_near_vectors_beside_a_hot_group(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    hot = unit(unit(rng.normal(size=(1, 64))) + 0.09 * unit(rng.normal(size=(1000, 64))))
    cold = unit(rng.normal(size=(1000, 64)))
    away = rng.normal(size=cold.shape)
    away = unit(away - (away * cold).sum(1, keepdims=True) * cold)
    cos = rng.uniform(0.931, 1, (len(cold), 1))
    x = np.concatenate([hot, cold, cos * cold + np.sqrt(1 - cos**2) * away])
    found = {r.vec_id: r.n_links for r in near_vectors.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(found[i] for i in range(1000, 3000)) >= 0.998 * 2000
    assert sum(found[i] for i in range(1000)) >= 0.998 * 1000 * 999


def test_vectors_without_rows(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("few", [20, 100_000])
def test_components(spark, monkeypatch, few):
    rng = random.Random(5)
    linked = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(80, 120)]
    wanted = roots(121, linked)
    monkeypatch.setattr(components, "HUB", 2)
    monkeypatch.setattr(components, "FEW", few)
    linked += [(200, i) for i in range(201, 260)]
    wanted += [*range(121, 200), *[200] * 60]
    found = components.components(spark.createDataFrame(linked, "a long, b long")).collect()
    assert all(r.root == wanted[r.node] for r in found) and len(found) == len({x for p in linked for x in p if p[0] != p[1]})


def test_private_contexts(spark):
    rows = [(i, f"please write to person{i}@example.com soon") for i in range(12)] + [(20, "please write to some12345person now"), (21, "number 12345678 alone")]
    rows += [(22, "card 4111 1111 1111 1111, ip 1.2.3.4 and 999.1.1.1, call +1 (386) 555-3733. a@b @c.d x@y.z")]
    found = {r.doc_id: r for r in private.digest(private.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[20].spans == "email:16:31" and found[20].n_email == 0
    assert found[21].spans == ""
    assert (found[22].n_email, found[22].n_ip, found[22].n_card, found[22].n_phone) == (1, 1, 1, 1)
    assert found[22].base_sha256 == hashlib.sha256(found[22].spans.encode()).hexdigest()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_pattern(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and doubled % 10 == 0 or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_private_base_by_brute_force(spark, small):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["1", "2", "25", "0", ".", ".", " ", "-", "+", "+1", "@", "a", "b.c", "(", ")", "é", "4111 1111 1111 1111"]) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    assert all(private.base_spans(t) == base_by_pattern(t) for t in texts)
    found = queries.op10_private(spark, small).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        spans = base_by_pattern(r.text or "")
        said = [f"{list(BASE)[k]}:{a}:{b}" for a, k, b in spans]
        assert found.loc[r.doc_id].base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [found.loc[r.doc_id][f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in said) for k in BASE]
        assert set(said) <= set(found.loc[r.doc_id].spans.split(",")) or not said


def test_private_takes_linear_time():
    began = time.process_time()
    for text in ("\u4e00" * 1_000_000 + " 12345", "1" * 1_000_000 + "...1", "1.2.3.4@" * 100_000, "a@" * 300_000, "+1" + " " * 1_000_000, "a1b@c.d," * 100_000):
        list(private.slots(text, private.base_spans(text)))
    assert time.process_time() - began < 20


def test_private_patterns_with_many_unseen(spark):
    rows = [(i, f"please write to person{i}@example.com soon") for i in range(20)] + [(100 + i, f"please write to person{i}@intranet now") for i in range(10)]
    rows += [(200 + i, f"the order number {i}{i}{i}12345 came") for i in range(30)]
    found = {r.doc_id: r.spans for r in private.digest(private.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(found[100 + i] == "email:16:32" for i in range(10)) and not any(found[200 + i] for i in range(30))


def test_quality_and_language_on_held_out_rows(spark, small):
    big = small.replace("0.001", "0.01")
    found = queries.op6_language(spark, big).where("held_out and not rejected").join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95
    found = queries.op5_quality(spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    assert (found.predicted == found.quality).mean() > 0.9


def test_safe_parts():
    assert "".join(safe_parts(LONG, 1000)) == LONG and max(map(len, safe_parts(LONG, 1000))) < 1100
    assert safe_parts("x" * 5000, 1000) == ["x" * 5000]


def test_words():
    texts = ["", "One two\tTHREE", "é", " \x0b "]
    hashes, bounds = segment.words(texts)
    assert np.diff(bounds).tolist() == [0, 3, 1, 0]
    assert hashes[0] == segment.words(["a ONE"])[0][1]


def test_distinct_spans(monkeypatch):
    rng = np.random.default_rng(9)
    points = rng.integers(97, 99, 4000).astype(np.uint32)
    edges = np.unique(np.concatenate(([0, 4000], rng.integers(0, 4000, 1500))))
    starts, ends = edges[:-1], edges[1:]
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(segment, "span_hashes", lambda symbols, a, b: (b - a).astype(np.uint64) // np.uint64(2))
        first, inverse = segment.distinct_spans(points, starts, ends)
        own = [points[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        assert len(first) == len(set(own)) and all(own[first[i]] == x for i, x in zip(inverse, own, strict=True))


def test_running_sums(spark):
    rng = random.Random(3)
    rows = sorted((rng.choice("abc"), rng.randint(0, 50), i) for i in range(500))
    frame = spark.createDataFrame(rows, "g string, k int, v long")
    for group in ((), ("g",)):
        wanted, sums = {}, {}
        for g, _, v in rows:
            key = g if group else ""
            sums[key] = wanted[v] = sums.get(key, 0) + v
        found = running(frame.repartition(5), [F.col(c) for c in ("g", "k", "v")], {"s": F.col("v")}, group, parts=7)
        assert {r.v: r.s for r in found.collect()} == wanted


def test_mix_deals_crowded_keys_evenly(spark, monkeypatch):
    """A source whose documents are all of quality 0.05 is spread over ranges like any other."""
    from driftplan.llm import common

    seen = []
    monkeypatch.setattr(common, "cut", lambda df, name="cut": seen.append((name, df)) or df)
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '{}();[]' ELSE 'plain words here' END AS text", "CASE WHEN id % 3 = 0 THEN 'code' ELSE 'web' END AS source")
    mixing.mix(docs)
    ranges = [df for name, df in seen if name == "ranges"][-1]
    held = [r["count"] for r in ranges.groupBy("_part").count().collect()]
    assert len(held) >= 3 and max(held) <= 3 * sorted(held)[len(held) // 2]


SQL_OF = {"mix": "op1_mixing", "exact": "op2_exact_dedup", "repeats": "op4_repeats", "near": "op7_near_text"}


@pytest.mark.parametrize("name", SQL_OF)
def test_odd_rows_as_sql_has_them(spark, name):
    """Null, empty, very long, equal and odd texts, null sources, and columns with clashing names: values, not numbers of rows."""
    import duckdb
    from oracle import rows

    odd = [(i, (r[1] or "")[:30_000] if r[1] else r[1], *r[2:]) for i, r in enumerate(ODD)] + [(20, LONG[:5000], "es", "a"), (21, LONG[:30_000], None, None), (22, ODD[8][1] + " and more of it", "es", "c")]
    found = OPERATORS[name](frame(spark, odd).repartition(3)).toPandas()
    con = duckdb.connect()
    documents = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").toPandas()
    con.register("documents", documents)
    wanted = con.sql(queries.ORACLES[SQL_OF[name]]).df()
    assert rows(found, sorted(wanted.columns)) == rows(wanted, sorted(wanted.columns))


def test_rows_that_repeat_an_id_or_have_none(spark):
    docs = frame(spark, ODD).repartition(2)
    found = mixing.mix(docs).toPandas()
    assert sorted(found[found.doc_id == 2]["size"]) == [7, 7] and found[found.doc_id.isna()]["size"].tolist() == [6] and found[found.doc_id == 3].taken.tolist() == [0]
    found = dedup_exact.exact_dedup(docs).toPandas()
    assert found[found.doc_id == 2].kept.sum() == 1 and not found[found.doc_id == 1].kept.any() and (found[found.doc_id.isin([1, 2])].group_size == 3).all() and found[found.doc_id.isna()].kept.all()
    found = near_text.near_dedup(docs).toPandas()
    assert (found[found.doc_id.isin([1, 2])].component_id == 1).all() and found[found.doc_id == 2].kept.sum() == 0
    alone = found[found.doc_id.isna()]
    assert alone.kept.all() and alone.component_id.isna().all() and alone.n_shingles.tolist() == [2]
    text = "z" * 130 + "".join(map(chr, range(48, 100)))
    found = repeats.remove_repeats(spark.createDataFrame([(5, text), (5, text), (None, text + "!"), (7, None)], "doc_id long, text string")).toPandas()
    assert sorted(found[found.doc_id == 5].n_removed) == [182, 182] and found[found.doc_id.isna()].n_removed.tolist() == [129]
    found = token_counts.count_tokens(docs, TOKENS["op9"]).toPandas()
    assert found[found.doc_id == 2].n_tokens.nunique() == 1 and len(found[found.doc_id.isna()]) == 1 and found[found.doc_id.isin([3, 4])].n_tokens.tolist() == [0, 0]
    found = packing.pack(docs, TOKENS["op3"]).toPandas()
    assert found[found.doc_id.isin([3, 4])].doc_tokens.tolist() == [1, 1] and found[found.doc_id == 2].length.sum() == 2 * found[found.doc_id == 2].doc_tokens.max()
    found = private.digest(private.find_private(docs)).toPandas()
    assert found[["n_email", "n_ip", "n_card", "n_phone"]].sum().sum() == 0 and (found.spans == "").all()


def test_language_and_quality_of_odd_rows(spark):
    found = language.identify(frame(spark, ODD), language.fit_dictionaries(frame(spark, ODD))).toPandas()
    by = lambda i: found[found.doc_id == i]
    assert (by(3).lang_pred == "und").all() and (by(4).lang_pred == "und").all() and (by(5).lang_pred == "und").all() and by(5).score.tolist() == [0.0]
    assert by(2).score.nunique() == 1 and by(1).score.tolist() == by(2).score.unique().tolist() and found[found.doc_id.isna()].score.between(0, 1).all()
    labelled = frame(spark, ODD).selectExpr("*", "CASE WHEN length(text) > 30 THEN 1 ELSE 0 END AS quality")
    model = quality.fit(labelled)
    found = quality.score(frame(spark, ODD), model).toPandas()
    assert by(3).score.tolist() == by(4).score.tolist() and by(2).score.nunique() == 1 and (found.predicted == (found.score >= 0.3)).all()
    again = quality.score(frame(spark, ODD).repartition(5), quality.fit(labelled.repartition(4))).toPandas()
    assert np.allclose(sorted(found.score), sorted(again.score))


def test_language_by_brute_force(spark, small):
    import zstandard

    docs = spark.read.parquet(f"{small}/documents.parquet")
    books = language.fit_dictionaries(docs)
    found = {r.doc_id: r for r in language.identify(docs, books).collect()}
    for r in docs.collect():
        if r.text and re.search(r"[^\W\d_]", r.text):
            data, sizes = language.folded(r.text), {}
            for k, body in books.items():
                packer = zstandard.ZstdCompressor(level=language.ZSTD_LEVEL, dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
                sizes[k] = sum(len(packer.compress(data[i : i + language.PIECE_BYTES])) for i in range(0, len(data), language.PIECE_BYTES))
            first, second = sorted(sizes.values())[:2]
            assert sizes[found[r.doc_id].lang_pred] == first and math.isclose(found[r.doc_id].margin, (second - first) / second)
            assert found[r.doc_id].rejected == ((second - first) / second < 0.001)


def test_quality_pools_by_brute_force():
    rng = random.Random(8)
    texts = ["", "one", "日本 語x", *(" ".join(rng.choice(["alpha", "beta", "GAMMA", "12", "!!", "é"]) for _ in range(rng.randint(1, 300))) for _ in range(20))]
    vectors = quality.word_vectors(quality.beside(texts, quality.index_vectors()), quality.index_vectors())
    words, shapes, bounds = quality.tokens(texts)
    for step in (7, 100_000):
        quality.STEP, held = step, quality.STEP
        found = quality.pooled(texts, vectors)
        quality.STEP = held
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            mean = lambda ids: vectors[ids[a:b]].mean(0) if b > a else np.zeros(quality.DIM)  # noqa: B023, E731
            w, s = mean(words), mean(shapes)
            assert np.allclose(found[i], np.concatenate((w, s, [np.linalg.norm(w), np.linalg.norm(s), np.log1p(b - a) / 10])), atol=1e-4)
    # texts beyond the class table differ by their content
    assert len({tuple(x) for x in quality.pooled(["日本語", "中国話", "日日日"], quality.index_vectors())}) == 3


@pytest.mark.parametrize("name", [n for n in OPERATORS])
def test_long_texts_without_blanks(spark, name):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    docs = frame(spark, [(1, text, "en", "a"), (2, text, "en", "b"), (3, text[::-1], "es", "a"), (4, "a few words", "es", None)])
    began = time.time()
    found = OPERATORS[name](docs).toPandas()
    assert found.doc_id.nunique() == 4 and time.time() - began < 60
