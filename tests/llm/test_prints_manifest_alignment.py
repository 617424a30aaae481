"""Fingerprints, manifest and alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import LONG, ODD, frame
from tokenizers import Tokenizer

from driftplan.llm import alignment, fingerprints, merkle, near_text, queries
from driftplan.llm.common import safe_parts

A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fingerprints


def test_fingerprints_tell_similarities():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(4_000)]
    errors = []
    for share in (0.0, 0.1, 0.3, 0.5, 0.75, 0.9, 1.0) * 6:
        one = [rng.choice(words) for _ in range(900)]
        at = int(len(one) * share)
        texts = [" ".join(one), " ".join(one[:at] + [rng.choice(words) for _ in range(len(one) - at)])]
        sets = [set(s.tolist()) for s in near_text.shingles(texts, 5)]
        codes = fingerprints.codes(texts)
        errors.append(fingerprints.alike(codes[:1], codes[1:], 4)[0] - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(errors)) < 0.015 and np.abs(errors).max() < 0.13


def test_densification_is_unbiased_for_small_sets():
    """Sets much smaller than the number of bins: filled bins agree as often as the sets are similar."""
    found, bins = [], 256
    for seed in range(300):
        rng = np.random.default_rng(seed)
        values = rng.integers(0, 2**63, 30, np.uint64)
        least = np.full((2, bins), fingerprints.EMPTY, np.uint64)
        for row, own in enumerate((values[:20], values[10:])):
            np.minimum.at(least[row], (own % np.uint64(bins)).astype(int), own)
        full = fingerprints.densified(least)
        assert (full != fingerprints.EMPTY).all() and (full[least != fingerprints.EMPTY] == least[least != fingerprints.EMPTY]).all()
        found.append((full[0] == full[1]).mean())
    assert abs(np.mean(found) - 10 / 30) < 0.02


def test_shingles_are_the_same_in_parts_and_at_once(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(3_000))
    whole = fingerprints.codes([text, "a b", "", "   ", "a  b"])
    monkeypatch.setattr(fingerprints, "CHUNK_CHARS", 700)
    assert (fingerprints.codes([text, "a b", "", "   ", "a  b"]) == whole).all()
    assert (whole[1] == whole[4]).all() and (whole[2:4] == 255).all() and (whole[:2] != 255).any(1).all()
    least = np.full((1, 256), fingerprints.EMPTY, np.uint64)  # plainly: the smallest value in each bin
    for h in near_text.shingles([text], 5)[0].tolist():
        bin_, value = ((h >> 32) * 256) >> 32, int(fingerprints.segment.mix(np.array([h ^ fingerprints.segment.ROOT], np.uint64))[0])
        least[0, bin_] = min(int(least[0, bin_]), value)
    filled = fingerprints.segment.mix(fingerprints.densified(least) ^ fingerprints.segment.mix(np.arange(1, 257, dtype=np.uint64)))
    assert ((filled & np.uint64(15)).astype(np.uint8) == whole[:1]).all()


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_packed_codes_come_back(bits):
    codes = fingerprints.codes(["a b c d e f g", "", "one two three four five"], 64, bits)
    said = fingerprints.packed(codes, bits)
    assert [len(s) for s in said] == [64 * bits // 4, 0, 64 * bits // 4]
    assert (fingerprints.unpacked(said, 64, bits) == codes).all()
    assert fingerprints.alike(codes, codes[[0, 1, 1]], bits).tolist() == [1.0, 1.0, 0.0]


def beside(docs):
    """(id, n_chars, edited_sha256, edited text, next text) by the definition, for distinct ids."""
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for (id_, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        yield id_, len(text), sha(edited), edited, after


def test_next_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for part_chars in (50_000, 10**9):  # many ranges, and few
        found = {r.doc_id: r for r in fingerprints.beside_next(docs, part_chars=part_chars).collect()}
        assert len(found) == len(texts)
        for id_, n, edited_sha, edited, after in beside(texts.items()):
            codes, r = fingerprints.codes([texts[id_] or "", edited, after]), found[id_]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, edited_sha, *fingerprints.packed(codes[:2]))
            assert [r.near_edited, r.near_next] == fingerprints.alike(codes[[0, 0]], codes[1:], 4).tolist()
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert plain == {i: r.fingerprint for i, r in found.items()}
    near = spark.createDataFrame([(found[i].fingerprint, found[i].edited_fingerprint, found[i].near_edited) for i in found], "a string, b string, near double")
    assert near.where(fingerprints.likeness(F.col("a"), F.col("b")) != F.col("near")).count() == 0


def test_prints_of_odd_rows(spark):
    docs = frame(spark, ODD).repartition(3)
    found = fingerprints.beside_next(docs, part_chars=1_000).toPandas()
    assert len(found) == len(ODD)
    same = found[found.doc_id.isin([1, 2])]
    assert same.fingerprint.nunique() == 1
    row = found.set_index("doc_id").loc
    assert row[3].n_chars == 0 and row[3].fingerprint == "" and row[3].edited_sha256 == sha("")
    assert row[4].near_edited == 1 and row[6].n_chars == len(LONG) and row[8].near_next < 0.2
    assert fingerprints.beside_next(docs.where("false")).count() == 0 and fingerprints.fingerprint(docs.where("false")).count() == 0
    alone = fingerprints.beside_next(docs.where("doc_id = 8")).collect()
    text = ODD[-1][1]
    assert len(alone) == 1 and alone[0].near_next == 1 and alone[0].edited_sha256 == sha(text[: len(text) - len(text) // 3] + text[: len(text) // 3])


# manifest


def plain_tree(leaves):
    """Root, and per leaf the other digests of its runs with its place in each."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            paths[i].append((p % 3, run[: p % 3] + run[p % 3 + 1 :]))
            at[i] = p // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 243])
def test_traversal_gives_every_path(n):
    leaves = [sha(str(i)) for i in range(n)]
    root, wanted = plain_tree(leaves)
    height = merkle._height(n, 6)
    found = [[(at, [x.decode() for x in others]) for at, others in p] for p in merkle.paths([x.encode() for x in leaves], height)]
    assert found == wanted
    tree = merkle._Treehash(height)
    for x in leaves:
        tree.take(x.encode())
        assert max(map(len, tree.stack)) <= 3
    assert tree.flush() == [root.encode()]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["a", "é", "b\n", None] + ["hot"] * 5), rng.choice(["en", None]), i % 7, rng.choice([None, "", "x\ny", "日本"])) for i in range(130)]
    rows += [(5, "hot", "en", 1, "again"), (5, "hot", "en", 1, "again"), (None, "hot", None, None, None), (999, "alone", "en", 1, LONG)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "lang node", "lang tree", "lang path", "lang pos", "lang n").repartition(4)
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(value, r)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[s])]) for s in names]
    root, above = plain_tree([t[0] for t in trees])
    wanted = []
    for name, (subroot, paths), upper in zip(names, trees, above, strict=True):
        for (_, _, leaf), path in zip(sorted(groups[name]), paths, strict=True):
            wanted.append((leaf, subroot, root, [(at, others) for at, others in path + upper]))
    found = merkle.manifest(docs, carried={"twice": F.col("doc_id") * 2}, levels=levels).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted((r.leaf, r.subroot, r.root, [(s["at"], s["others"]) for s in r.path]) for r in found) == sorted(wanted)
    assert all(r.folded == r.root and r.twice == (None if r.doc_id is None else 2 * r.doc_id) for r in found)


def test_manifest_of_few_rows(spark):
    docs = frame(spark, ODD).withColumn("n_chars", F.length("text"))
    assert merkle.manifest(docs.where("false")).count() == 0
    lone = merkle.manifest(docs.where("doc_id = 1")).collect()[0]
    assert lone.leaf == lone.subroot == lone.root and lone.path == []
    apart = merkle.manifest(docs.where("doc_id in (1, 6)")).collect()
    assert all(r.leaf == r.subroot != r.root and len(r.path) == 1 for r in apart)


def test_tampering_shows(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op12_manifest(spark, small).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified == (not changed) == (r.folded_root == r.root)


# alignment


def plainly_aligned(docs):
    """Per id: n_a, n_b, n_groups, n_links, n_best, count_sum, groups, by the definition, token by token."""
    a_library, b_library = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_library.encode_special_tokens = True
    letters = {c: b for b, c in alignment._byte_letters().items()}
    tokens, links, count = {}, {}, Counter()
    for id_, text in docs.items():
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in a_library.id_to_token(i))) for i in a_library.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(b_library.id_to_piece(i)[3:5], 16)]) if b_library.is_byte(i) else b_library.id_to_piece(i).replace("▁", " ").encode()) for i in b_library.encode(text or "")]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        spans = []
        for own in (a, b):
            at, held = 0, []
            for i, raw in own:
                held.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(held)
        tokens[id_] = spans
        links[id_] = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]] if len(spans[0]) < 3000 else None
        if links[id_] is None:
            raise ValueError("too long for a plain version")
        count.update(set(links[id_]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = {}
    for id_, (a, b) in tokens.items():
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        said, start = [], 0
        for end in cuts:
            said.append("|".join(",".join(str(i) for i, s, e in own if start <= s and e <= end) for own in (a, b)))
            start = end
        out[id_] = (len(a), len(b), len(cuts), len(links[id_]), sum(count[p] == best[p[0]] for p in links[id_]), sum(count[p] for p in links[id_]), ";".join(said))
    return out


def test_alignment(spark, monkeypatch):
    rng = random.Random(4)
    docs = {i: r[1] for i, r in enumerate(ODD) if r[1] is not LONG} | {100: "has ▁ in it", 101: "<s> <0x41> </s>", 102: "  two  blanks \n\n line\tend  ", 103: " ", 104: "🙂é́ x"}
    docs |= {200 + i: "".join(rng.choice(["the ", "The", " of", "\n", "x1", "é", "  ", "日", "don't ", "naïve"]) for _ in range(rng.randint(1, 80))) for i in range(60)}
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, pair string").repartition(4)
    wanted = plainly_aligned(docs)
    assert wanted[100][0] == 0 and wanted[101][0] > 0
    for block in (300, 6_000_000):
        monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
        monkeypatch.setattr(alignment, "CHUNK_CHARS", block)
        found = {r.doc_id: r for r in alignment.align(rows, A, B, groups=True).collect()}
        assert len(found) == len(docs)
        for i, r in found.items():
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == wanted[i]
            assert r.groups_sha256 == (sha(r.groups) if r.n_a else "") and r.n_links == r.n_a + r.n_b - r.n_groups
    plain = {r.doc_id: r.groups_sha256 for r in alignment.align(rows, A, B).collect()}
    assert plain == {i: r.groups_sha256 for i, r in found.items()}


def test_alignment_of_whole_texts(spark, small):
    """The query's ids and counts from libraries over whole texts, links from the number of cuts."""
    a_library, b_library = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_library.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op13_alignment(spark, small).collect():
        a, b = a_library.encode(" " + texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [], b_library.encode(texts[r.doc_id] or "")
        assert (r.n_a, r.n_b) == (len(a), len(b)) and r.n_links == r.n_a + r.n_b - r.n_groups


def test_alignment_of_long_texts_and_odd_rows(spark, monkeypatch):
    rows = frame(spark, ODD).repartition(2)
    found = alignment.align(rows, A, B, groups=True).toPandas()
    assert len(found) == len(ODD) and found.doc_id.isna().sum() == 1
    monkeypatch.setattr(alignment, "safe_parts", lambda t: safe_parts(t, 2_000))
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 3_000)
    again = alignment.align(rows, A, B).toPandas()
    order = lambda d: sorted(map(repr, d[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]].itertuples(index=False)))
    assert order(found) == order(again)
    assert alignment.align(rows.where("false"), A, B).count() == 0
