import os
import random

import pytest
from pyspark.sql import functions as F

from driftplan.functions import digest, paths
from driftplan.operators import apply, diff, match
from driftplan.plans import fixtures
from driftplan.plans.reconcile import reconcile
from driftplan.sources.filetree import FileTree
from driftplan.streaming.changes import latest, watch


@pytest.fixture
def trees(tmp_path):
    for side in ("src", "dst"):
        (tmp_path / side).mkdir()

    def put(side, path, content, mtime):
        full = tmp_path / side / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(content)
        os.utime(full, (mtime, mtime))

    return tmp_path, put


def scan(spark, root, **options):
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("root", str(root)).options(**options).load()


def planned(spark, tmp, copy=False):
    src, dst = (scan(spark, tmp / side).where("not is_dir") for side in ("src", "dst"))

    def hashed(files, side):
        found = digest.digest_files(files, str(tmp / ("src" if side == "source" else "dst")))
        return files.join(found.select("path", F.col("fuzzy_hash").alias("hash")), "path").withColumn("ext", paths.extension(F.col("path")))

    return reconcile(src, dst, digest=hashed, copy_duplicates=copy)


def kinds(plan):
    return {r["kind"]: r["count"] for r in plan.actions.groupBy("kind").count().collect()}


@pytest.mark.parametrize(
    ("old", "new", "old_time", "new_time", "wanted"),
    [
        ("a.txt", "b.txt", 100, 100, {"move": 1}),
        ("a.txt", "a.txt", 100, 200, {"touch": 1}),
        ("a.txt", "new/a.txt", 100, 100, {"move": 1, "mkdir": 1}),
        ("a.txt", "new/b.txt", 100, 200, {"move": 1, "mkdir": 1, "touch": 1}),
    ],
)
def test_scenarios(spark, trees, old, new, old_time, new_time, wanted):
    tmp, put = trees
    put("dst", old, b"content", old_time)
    put("src", new, b"content", new_time)
    plan = planned(spark, tmp)
    assert kinds(plan) == wanted
    assert all(ok for _, ok, _ in apply.apply(plan, str(tmp / "dst"), dry_run=False))
    assert kinds(planned(spark, tmp)) == {}
    assert (tmp / "dst" / new).stat().st_mtime == new_time


def test_changed_content_is_left_alone(spark, trees):
    tmp, put = trees
    put("dst", "a.txt", b"one", 100)
    put("src", "b.txt", b"two", 100)
    assert kinds(planned(spark, tmp)) == {}


def test_synced_twin(spark, trees):
    tmp, put = trees
    put("src", "file-1", b"same", 100)
    put("dst", "file-1", b"same", 100)
    put("src", "file-2", b"same", 300)
    put("dst", "file-2", b"other", 300)
    assert kinds(planned(spark, tmp)) == {}


@pytest.mark.parametrize(("copy", "wanted"), [(True, {"move": 1, "copy": 2, "mkdir": 3}), (False, {"move": 1, "mkdir": 1})])
def test_one_candidate_for_three(spark, trees, copy, wanted):
    tmp, put = trees
    for d in "ABC":
        put("src", f"{d}/x", b"thing", 100)
    put("dst", "wrong/x", b"thing", 100)
    plan = planned(spark, tmp, copy)
    assert kinds(plan) == wanted
    assert all(ok for _, ok, _ in apply.apply(plan, str(tmp / "dst"), dry_run=False))
    assert (tmp / "dst/A/x").exists() and (tmp / "dst/C/x").exists() == copy
    assert kinds(planned(spark, tmp, copy)) == {}


def test_scan(spark, tmp_path):
    for name in (".hidden", "_under", "empty", "Ünï", "._double", "Thumbs.db"):
        (tmp_path / name).write_bytes(b"" if name == "empty" else b"x")
    (tmp_path / ".Trashes").mkdir()
    (tmp_path / ".Trashes/inside").write_bytes(b"x")
    (tmp_path / "._dir").mkdir()
    (tmp_path / "._dir/child").write_bytes(b"x")
    os.symlink(tmp_path / "empty", tmp_path / "link")
    assert sorted(r.path for r in scan(spark, tmp_path).collect()) == ["._dir/child", ".hidden", "_under", "empty", "Ünï"]
    assert scan(spark, tmp_path / ".Trashes").count() == 0
    (tmp_path / "hollow").mkdir()
    assert scan(spark, tmp_path / "hollow").count() == 0
    with pytest.raises(Exception, match="transport"):
        scan(spark, tmp_path, scheme="sftp").count()


def test_sampled_digest_agrees(spark, tmp_path):
    data = random.Random(1).randbytes(40_001)
    (tmp_path / "big").write_bytes(data)
    found = digest.digest_files(spark.createDataFrame([("big",), ("missing",)], "path string"), str(tmp_path)).collect()
    column = spark.createDataFrame([(bytearray(data),)], "b binary").select(digest.fuzzy_hash(F.col("b"))).first()[0]
    assert {r.path: r.fuzzy_hash for r in found} == {"big": column, "missing": None}


def test_unreadable_files_are_tolerated_up_to_a_number(spark, tmp_path):
    found = digest.digest_files(spark.createDataFrame([(f"missing{i}",) for i in range(21)], "path string"), str(tmp_path))
    assert digest.tolerated(found, 21).count() == 21
    with pytest.raises(OSError, match="21 files can't be read, 20 are tolerated"):
        digest.tolerated(found)


def test_files_to_digest_are_dealt_evenly(spark, tmp_path):
    """A join may leave all files in one part, as small tables are; reading them is the work of all tasks."""
    one = spark.range(4000).select(F.concat(F.lit("gone/"), F.col("id").cast("string")).alias("path")).coalesce(1)
    shares = [r["count"] for r in digest.digest_files(one, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 4000 and len(shares) == spark.sparkContext.defaultParallelism and max(shares) < 2 * min(shares)


def test_trees_of_fixtures(spark):
    """Contents, times, and links that name their neighbours: a path that is too long for an inode would cost each link a block."""
    rows = [(f"d{i % 3}/e/f{i}", 1_000 + i, b"x" * i) for i in range(30)]
    files = spark.createDataFrame(rows, "path string, mtime long, content binary")
    for root in (fixtures.tree(files, "some-tree"), fixtures.tree(files.repartition(5), "some-tree")):
        for path, mtime, content in rows:
            full = os.path.join(root, path)
            with open(full, "rb") as f:
                assert f.read() == content and os.fstat(f.fileno()).st_mtime == mtime
            assert os.path.lexists(f"{full}.link") == (len(content) % 7 == 0)
            if len(content) % 7 == 0:
                assert os.readlink(f"{full}.link") == os.path.basename(path) and os.path.samefile(full, f"{full}.link")
        assert [os.stat(os.path.join(root, d)).st_mtime for d in ("d0", "d1/e", "d2")] == [1_027, 1_028, 1_029]


@pytest.mark.parametrize(("resolve", "copies"), [(False, 1), (True, 0)])
def test_touched_files_and_archives(spark, resolve, copies):
    schema = "path string, size long, mtime long, content string"
    src, dst = (spark.createDataFrame([("a.txt", 1, t, "x")], schema) for t in (200, 100))
    stored = spark.createDataFrame([(0, "/old/b.txt", 1, "x")], "archive_ord int, path string, size long, content string")
    plan = reconcile(src, dst, F.col("content"), archives=stored, resolve_touches=resolve)
    assert kinds(plan) == {"touch": 1} | ({"copy": copies} if copies else {})


def sequential(src, dst, copy, mode):
    """The greedy matcher as a loop, in order of orphans and candidates."""
    lost = sorted(p for p in src if dst.get(p, ())[:2] != src[p][:2])
    out, moved, touched = set(), set(), set()
    for o in lost:
        found = sorted(c for c in dst if (dst[c][0], dst[c][2]) == (src[o][0], src[o][2]))
        if not found:
            continue
        base = o.rsplit("/", 1)[-1]
        free = [c for c in found if c not in src]
        c = next((x for x in free if x.rsplit("/", 1)[-1] == base), free[0] if free else found[0])
        synced = c in src and src[c][:2] == dst[c][:2]
        if (mode == "agent" or c not in moved) and dst[c][1] != src[o][1] and not synced and c not in touched:
            touched.add(c)
            out.add(("touch", o, c))
        if c not in src and c not in moved:
            moved.add(c)
            out.add(("move", c, o))
        elif copy and c != o and (mode == "local" or c in src):
            out.add(("copy", c, o))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("mode", [match.LOCAL, match.AGENT])
def test_windows_equal_the_loop(spark, seed, mode):
    rng = random.Random(seed)

    def tree():
        return {f"{rng.choice('abc')}/{rng.choice('xyz')}{rng.randint(0, 2)}": (1, rng.randint(1, 2), rng.choice("PQR")) for _ in range(12)}

    src, dst = tree(), tree()
    frame = lambda t: spark.createDataFrame([(p, s, m, c) for p, (s, m, c) in t.items()], "path string, size long, mtime long, content string")
    plan = reconcile(frame(src), frame(dst), F.col("content"), mode=mode, copy_duplicates=True)
    found = {(r.kind, r.from_path, r.to_path) for r in plan.actions.where("kind <> 'mkdir'").collect()}
    assert found == sequential(src, dst, True, mode)


def test_changes(spark, tmp_path):
    rows = [(1, "source", "a", 1, 1, False), (2, "destination", "a", 1, 1, False), (3, "source", "a", 1, 2, False), (4, "source", "b", 1, 1, False), (5, "source", "b", 1, 1, True)]
    schema = "seq long, side string, path string, size long, mtime long, deleted boolean"
    log = spark.createDataFrame(rows, schema)
    assert diff.orphans(latest(log).where("side='source'"), latest(log).where("side='destination'")).count() == 1
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    seen = []
    query = watch(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), lambda df, _: seen.append([r.path for r in df.collect()]), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert seen[-1] == ["a"]


def test_scan_deals_large_directories_and_tells_of_errors(spark, tmp_path, monkeypatch):
    from driftplan.sources import filetree

    deep = tmp_path
    for i in range(60):
        (deep / f"f{i}").write_bytes(b"x")
        deep = deep / "d"
        deep.mkdir()
    for i in range(250):
        (tmp_path / f"many{i:03d}").write_bytes(b"xy")
    wanted = {os.path.relpath(os.path.join(d, n), tmp_path) for d, dirs, files in os.walk(tmp_path) for n in (*dirs, *files)}
    for opened, names in ((512, 10_000), (3, 20), (1, 7)):
        monkeypatch.setattr(filetree, "OPENED", opened)
        monkeypatch.setattr(filetree, "NAMES", names)
        reader = filetree._Reader({"root": str(tmp_path)})
        parts = reader.partitions()
        found = [r[0] for p in parts for r in reader.read(p)]
        assert sorted(found) == sorted(wanted) and (names > 20 or len(parts) > 10)
    monkeypatch.setattr(filetree.os, "listdir", lambda p, real=os.listdir: (_ for _ in ()).throw(PermissionError(13, "no", p)) if str(p).endswith("/d") else real(p))
    rows = list(filetree.walk(str(tmp_path), frozenset()))
    assert ("d", True, None) in {(r[0], r[3], r[4]) for r in rows} and sum(r[4] is not None for r in rows) == 1
    assert "error" in scan(spark, tmp_path, errors="true").columns


def test_scan_sends_no_names_of_files(tmp_path, monkeypatch):
    """The driver doesn't open directories without directories, and what it gives tasks doesn't grow with the files; each task finds its share."""
    import pickle

    from driftplan.sources import filetree

    for i in range(300):
        for d in ("a/b", "a/c"):
            (tmp_path / d).mkdir(parents=True, exist_ok=True)
            (tmp_path / d / f"{'long' * 9}{i}").write_bytes(b"x")
    (tmp_path / "a/c/d").mkdir()
    wanted = sorted(os.path.relpath(os.path.join(d, n), tmp_path) for d, dirs, files in os.walk(tmp_path) for n in (*dirs, *files))
    reader, opened = filetree._Reader({"root": str(tmp_path)}), []
    monkeypatch.setattr(filetree, "NAMES", 50)
    with monkeypatch.context() as patch:
        patch.setattr(filetree.os, "scandir", lambda p, real=os.scandir: opened.append(os.path.relpath(p, tmp_path)) or real(p))
        parts = reader.partitions()
    assert len(pickle.dumps(parts)) < 100 * len(parts) + 1000 and 10 < len(parts) < 60
    if os.lstat(tmp_path).st_nlink == 3:  # not all file systems count so
        assert sorted(opened) == [".", "a", "a/c"]
    assert sorted(r[0] for p in parts for r in reader.read(p)) == wanted
    (tmp_path / "a/b/new").mkdir()
    (tmp_path / "a/b/new/f").write_bytes(b"x")
    assert {"a/b/new", "a/b/new/f"} <= {r[0] for p in parts for r in reader.read(p)}


def test_equal_files_stay_linear(spark):
    n = 10_000
    src = spark.range(n).selectExpr("concat('src/a', id) AS path", "0L AS size", "1L AS mtime", "'' AS hash", "'' AS ext")
    dst = spark.range(n).selectExpr("concat('dst/b', id) AS path", "0L AS size", "1L AS mtime", "'' AS hash", "'' AS ext")
    best = match.pick_best(src, dst, src.select("path", "size", "mtime"))
    assert best.agg(F.count("*"), F.count_distinct("candidate"), F.sum(F.col("first").cast("int"))).first() == (n, 1, 1)
    assert "Window" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_sizes_as_printf(spark):
    from driftplan.functions import text

    rng = random.Random(7)
    sizes = [rng.randint(0, 10 ** rng.randint(1, 18)) for _ in range(3000)] + [1024**k * m // 1000 for k in range(1, 6) for m in range(1000, 1100)] + [1000**k * m // 1000 for k in range(1, 6) for m in range(1000, 1100, 5)]
    sizes += [1024 + 128 * i // 25 for i in range(200)] + [-1, 0, 1023, 1024, 2140, 2828382, 2341234123412341234, (1 << 63) - 1]

    def said(n, base, units):
        if n < base:
            return f"{n} B" if n >= 0 else ""
        k = next((k for k in range(1, 6) if n < base ** (k + 1)), 6)
        return f"{float(n) / float(base**k):.2f} {units[k]}"

    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.binary_size(F.col("n")).alias("b"), text.decimal_size(F.col("n")).alias("d")).collect()
    assert all(r.b == said(r.n, 1024, text.BINARY_UNITS) and r.d == said(r.n, 1000, text.DECIMAL_UNITS) for r in rows)


def test_changes_survive_a_restart(spark, tmp_path, monkeypatch):
    from driftplan.streaming import changes

    monkeypatch.setattr(changes, "COMPACT", 2)
    schema = "seq long, side string, path string, size long, mtime long, deleted boolean"
    steps = [[(1, "source", "a", 1, 1, False), (2, "source", "b", 1, 1, False)], [(3, "destination", "a", 1, 1, False)], [(4, "destination", "b", 1, 1, False)], [(5, "source", "c", 1, 1, False)], [(6, "destination", "a", 1, 1, True)]]
    wanted = [["a", "b"], ["b"], [], ["c"], ["a", "c"]]
    for rows, found in zip(steps, wanted, strict=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        seen = []
        query = watch(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), lambda df, _, seen=seen: seen.append(sorted(r.path for r in df.collect())), str(tmp_path / "state"))
        query.processAllAvailable()
        query.stop()
        assert seen[-1] == found


def test_sweep(spark, tmp_path):
    from driftplan import storage

    rows = storage.cut(spark.range(3))
    assert rows.count() == 3 and os.path.isdir(storage.home(spark).removeprefix("file:"))
    storage.sweep(spark)
    assert not os.path.exists(storage.home(spark).removeprefix("file:"))
