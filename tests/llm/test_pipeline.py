import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from test_operators import ODD, frame, roots, shingle_set

from driftplan import storage
from driftplan.llm import stages


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stages.written(stage(spark, kept[-1], small), name))
        assert kept[-1].columns == docs.columns
    language, exact, near, mixed = (d.toPandas() for d in kept[1:])
    assert 0.9 * docs.count() < len(language) <= docs.count()
    assert sorted(exact.doc_id) == sorted(language.groupby("text").doc_id.max())
    rows = exact.sort_values("doc_id").reset_index(drop=True)
    sets = [shingle_set(t) for t in rows.text]
    linked = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert sorted(near.doc_id) == sorted(rows.doc_id[i] for i in set(roots(len(sets), linked)))
    assert set(mixed.doc_id) <= set(near.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], small).toPandas()
    assert packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()
    assert len(packed[packed.start == 0]) == len(mixed)
    assert corpus_pipeline.run(spark, small).count() > 0


def test_stages_with_odd_rows(spark):
    docs = frame(spark, ODD).selectExpr("*", "id score", "id rejected", "id key", "id row_", "id mark", "map(id, id) other")
    rows = lambda d: sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r.source or "") for r in d.collect())
    every, stage = rows(docs), dict(corpus_pipeline.STAGES)
    spoken = stage["language"](spark, docs, "")
    assert spoken.columns == docs.columns and set(rows(spoken)) <= set(every) and all(any(c.isalpha() for c in r[2]) for r in rows(spoken))
    once = stage["exact_dedup"](spark, docs, "")
    assert once.columns == docs.columns
    assert rows(once) == sorted(max(r for r in every if r[2] == text) for text in {r[2] for r in every})
    near = stage["near_dedup"](spark, docs, "")
    assert near.columns == docs.columns and [r[1] for r in rows(near)] == [0, 1, 3, 4, 5, 6, 7, 8]
    mixed = stage["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and set(rows(mixed)) <= set(every)
    assert all(rows(mixed).count(r) <= 3 * every.count(r) and rows(mixed).count(r) % every.count(r) == 0 for r in every)
    for name in stage:
        assert stage[name](spark, docs.where("false"), "").count() == 0


def test_intermediate_tables_go(spark, small):
    """What stages write on their way is deleted; their results stay until the application ends."""
    folder = storage.home(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    packed = corpus_pipeline.run(spark, small)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert left == {f"stage-{name}" for name, _ in corpus_pipeline.STAGES[:-1]} and packed.count() > 0
