import pytest
from oracle import TABLES, same

from driftplan.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    found = QUERIES[name](spark, small).toPandas()
    if name in ORACLES:
        same(found, ORACLES[name], small)
    else:
        assert len(found)


def test_tables_in_parts(spark, small, tmp_path):
    """Tables that are folders of parts are entries like those that are one file, below a link as well; a folder without files isn't a table."""
    tables, link = tmp_path / "tables", tmp_path / "link"
    tables.mkdir()
    link.symlink_to(tables)
    for i, name in enumerate(TABLES):
        at = tables / f"{name}.parquet"
        if i % 2:
            (at / "day=1").mkdir(parents=True)
        for part in (at / "part-0.parquet", at / "day=1/part-1.parquet") if i % 2 else (at,):
            part.write_bytes(b"")
    found = QUERIES["scan_inventory"](spark, str(link)).toPandas()
    assert sorted(found.itertuples(index=False, name=None)) == sorted((f"{t}.parquet", False) for t in TABLES)
    (tables / "hollow.parquet").mkdir()
    assert [r.path for r in QUERIES["scan_inventory"](spark, str(tables)).where("is_dir").collect()] == ["hollow.parquet"]


def test_digest_stands_behind_the_semi_joins(spark, small):
    from pyspark.sql import functions as F

    from driftplan.functions import digest
    from driftplan.operators import diff, match
    from driftplan.plans import fixtures

    src, dst = fixtures.source(spark, small), fixtures.destination(spark, small)
    plan = match.digested(diff.orphans(src, dst), digest.fuzzy_hash(F.col("content")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("crc32") < plan.index("LeftAnti")


def test_a_stream_of_changes_is_no_single_task(spark, small, tmp_path):
    """The tables' rows are read by as many tasks as there are parts, and what a stream reads is in as many files."""
    spark.read.parquet(f"{small}/documents.parquet").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    log, stream = [], spark.readStream.__class__.parquet

    def noted(self, path, *more):
        log.append(path)
        return stream(self, path, *more)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(spark.readStream.__class__, "parquet", noted)
        found = QUERIES["orphan_stream"](spark, str(tmp_path)).toPandas()
    same(found, ORACLES["orphan_stream"], small)
    assert all(spark.read.parquet(log[0]).where(f"seq = {seq}").select("_metadata.file_path").distinct().count() > 1 for seq in (1, 2, 3))
