"""Executors, the agent's side of the protocol, progress, and what is deleted when."""

import base64
import json
import os
import random
import sys
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_trees import planned, scan, trees  # noqa: F401

from driftplan import __main__ as cli
from driftplan import progress, storage
from driftplan.operators import agent, apply, files
from driftplan.plans import reconcile
from driftplan.sources import wire
from driftplan.streaming import changes

ODD = ("0", "false", 'a"b', "new/0", "dir/fälse ", "null")


def opened(lines):
    return [files.opened(x) for x in lines]


def agent_command():
    return files.Command([sys.executable, "-m", "driftplan", "--agent"])


@pytest.mark.parametrize("kind", ["local", "agent", "command"])
def test_one_protocol(trees, kind):  # noqa: F811
    tmp, put = trees
    root = str(tmp / "dst")
    for name in ODD:
        put("dst", name, name.encode(), 100)

    def run(there):
        for name in ODD:
            there.touch(f"{root}/{name}", 200)
            there.copy(f"{root}/{name}", f"{root}/copies/{name}", 300)
            there.mkdir(f"{root}/moved/{os.path.dirname(name)}")
            there.move(f"{root}/{name}", f"{root}/moved/{name}")
        there.copy(f"{root}/moved/0", f"{root}/shared", 400, reflink=True)
        for refused in (lambda: there.move(f"{root}/moved/0", f"{root}/moved/false"), lambda: there.move(f"{root}/gone", f"{root}/there"), lambda: there.touch(f"{root}/gone", 1), lambda: there.copy(f"{root}/gone", f"{root}/x", 1)):
            with pytest.raises(OSError):
                refused()

    if kind == "command":
        with agent_command() as command:
            run(files.AgentFiles(command))
        assert command.process.returncode == 0
    else:
        run(files.AgentFiles(agent.serve) if kind == "agent" else files.LocalFiles())
    found = {os.path.relpath(os.path.join(d, n), root): (open(os.path.join(d, n)).read(), int(os.stat(os.path.join(d, n)).st_mtime)) for d, _, names in os.walk(root) for n in names}
    assert found == {f"moved/{n}": (n, 200) for n in ODD} | {f"copies/{n}": (n, 300) for n in ODD} | {"shared": ("0", 400)}


def test_an_agent_that_ended():
    with files.Command([sys.executable, "-c", "pass"]) as command:
        command.process.wait()
        with pytest.raises(OSError):
            files.AgentFiles(command).mkdir("/nowhere")


def test_specs_keep_names_that_read_like_nothing(spark, trees):  # noqa: F811
    """A plan's requests, for such names, do what the plan says."""
    tmp, put = trees
    root = str(tmp / "dst")
    for name in ODD:
        put("dst", name, name.encode(), 100)
    rows = [(i, "move", n, f"to/{n}", None) for i, n in enumerate(ODD, 10)] + [(i, "touch", f"to/{n}", f"to/{n}", 0 if n == "0" else 300) for i, n in enumerate(ODD, 20)] + [(i, "mkdir", None, f"to/{os.path.dirname(n) or '.'}", None) for i, n in enumerate(ODD)]
    plan = spark.createDataFrame(rows, "emit_seq long, kind string, from_path string, to_path string, mtime long")
    specs = [json.loads(r.spec) for r in wire.action_specs(plan, root).collect()]
    assert {s["from_rel_path"] for s in specs if s["type"] == "move"} == set(ODD)
    assert sorted(s.get("mod_timestamp", 0) for s in specs if s["type"] == "timestamp") == [0] + [300] * (len(ODD) - 1)
    sent = [r.value for r in wire.perform_requests(wire.action_specs(plan, root), False).collect()]
    answers = spark.createDataFrame([(x,) for x in agent.serve(sent)], "value string")
    assert wire.perform_rows(answers).where("NOT success").count() == 0
    assert {os.path.relpath(os.path.join(d, n), root): int(os.stat(os.path.join(d, n)).st_mtime) for d, _, names in os.walk(root) for n in names} == {f"to/{n}": 0 if n == "0" else 300 for n in ODD}
    assert int(os.stat(root).st_mtime) > 1_000_000


BAD = [
    "{", "[]", "7", '"text"', "null", '{"payload":""}', '{"type":"walk_request","payload":7}', '{"type":"walk_request","payload":"!"}', '{"type":"walk_request","payload":"' + base64.b64encode(b"\xff").decode() + '"}',
    ("walk_request", []), ("walk_request", {"dir_path": None}), ("walk_request", {"dir_path": 7}), ("walk_request", {"dir_path": "/\0"}), ("walk_request", {"dir_path": "/tmp", "excluded_names": "x"}), ("walk_request", {"dir_path": "/tmp", "excluded_names": [1]}),
    ("walk_request", {"dir_path": "/tmp", "progress_interval_ms": "1"}), ("walk_request", {"dir_path": "/tmp", "one_file_system": 1}), ("walk_request", {}), ("digest_request", {"files": [None]}), ("digest_request", {"files": {}}), ("perform_request", {"actions": {}}),
    ("perform_request", {"actions": [], "dry_run": "no"}), ("perform_request", 3), ("unheard", {}), ("walk_request", {"dir_path": "/nowhere/at/all"}),
]


@pytest.mark.parametrize("bad", BAD, ids=range(len(BAD)))
def test_bad_requests_are_answered(tmp_path, bad):
    (tmp_path / "a").write_bytes(b"x")
    line = bad if isinstance(bad, str) else files.line(*bad)
    answers = opened(agent.serve(["", line, files.line("digest_request", {"base_path": str(tmp_path), "files": ["a", "gone", "a\0"]}), files.line("quit"), line]))
    assert answers[0][0] == "error" and answers[0][1]["message"]
    assert [k for k, _ in answers[1:]] == ["digest_progress"] * 3 + ["digest_response"] and list(answers[-1][1]["digests"]) == ["a"]


def test_bad_actions_fail_alone(tmp_path):
    base, late = str(tmp_path), {"type": "mkdir", "dir_path": str(tmp_path / "made")}
    os.utime(base, (50, 50))
    wrong = [7, None, [], "x", {}, {"type": "unheard"}, {"type": "move", "base_path": base}, {"type": "timestamp", "dest_base_path": base, "mod_timestamp": 9}, {"type": "timestamp", "dest_rel_path": 3}, {"type": "mkdir"}, {"type": "mkdir", "dir_path": "/\0"}, {"type": "copy", "from_abs_path": f"{base}/gone"}, {"type": "timestamp", "dest_base_path": base, "dest_rel_path": "x", "mod_timestamp": True}]
    (kind, found), = opened(agent.serve([files.line("perform_request", {"actions": [*wrong, late]})]))
    assert kind == "perform_response" and [r["index"] for r in found["results"]] == list(range(len(wrong) + 1))
    assert [r["success"] for r in found["results"]] == [False] * len(wrong) + [True] and all(r.get("error") for r in found["results"][:-1])
    assert (tmp_path / "made").is_dir() and not (tmp_path / "x").exists()
    (_, dry), = opened(agent.serve([files.line("perform_request", {"actions": [7, late], "dry_run": True})]))
    assert all(r["success"] for r in dry["results"])


@pytest.mark.parametrize(("interval", "least"), [(50, 3), (0, 0)])
def test_a_walk_tells_of_progress(tmp_path, monkeypatch, interval, least):
    def slow(root, *_):
        for i in range(10):
            time.sleep(0.04)
            yield f"f{i}", 1, 1, False, None

    monkeypatch.setattr(agent, "walk", slow)
    times, answers = [], []
    for x in agent.serve([files.line("walk_request", {"dir_path": str(tmp_path), "progress_interval_ms": interval})]):
        times.append(time.monotonic())
        answers.append(files.opened(x))
    told = [p["files_found"] for k, p in answers if k == "walk_progress"]
    assert told == sorted(told) and told[-1] == 10 and len(told) - 1 >= least and (not least or (told[0] < 10 and times[-1] - times[0] > 0.1))
    assert answers[-1][0] == "walk_response" and len(answers[-1][1]["files"]) == 10


def test_a_walk_that_fails_late(tmp_path, monkeypatch):
    def broken(root, *_):
        yield "f", 1, 1, False, None
        time.sleep(0.1)
        raise OSError("gone")

    monkeypatch.setattr(agent, "walk", broken)
    answers = opened(agent.serve([files.line("walk_request", {"dir_path": str(tmp_path), "progress_interval_ms": 20}), files.line("digest_request", {})]))
    assert [k for k, _ in answers if k != "walk_progress"] == ["error", "digest_response"]


def test_progress_while_tasks_run(spark):
    def slow(batches):
        for batch in batches:
            time.sleep(0.3)
            yield batch

    seen, watched = [], progress.Progress(spark)
    rows = spark.range(0, 60, 1, 24).mapInArrow(slow, "id long")
    with watched.told(0.2, lambda counts, done: seen.append(counts["slow"])):
        assert watched.counted(rows, "slow").count() == 60
    assert watched.now() == {"slow": 60} and seen == sorted(seen) and len({n for n in seen if 0 < n < 60}) >= 1
    with watched.told(0, lambda *_: seen.append(None)):
        time.sleep(0.05)
    assert None not in seen


def test_totals_on_the_way(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a").write_bytes(b"xyz")
    rows, seen = progress.observed(scan(spark, tmp_path))
    assert rows.count() == 2 and seen.get == {"files": 1, "total_size": 3}
    rows, seen = progress.observed(scan(spark, tmp_path).where("false"))
    assert rows.count() == 0 and seen.get == {"files": 0, "total_size": 0}


def test_the_command_line_tells_of_scans(spark, trees, monkeypatch):  # noqa: F811
    """Counts of both scans are told while a slow one goes on; totals come from the scans themselves."""
    tmp, put = trees
    put("src", "a", b"x", 100)
    put("src", "hollow/b", b"y", 100)
    put("dst", "b", b"y", 100)
    (tmp / "dst/hollow").mkdir()
    real = progress.Progress.counted

    def slow(batches):
        for batch in batches:
            time.sleep(0.5)
            yield batch

    monkeypatch.setattr(progress.Progress, "counted", lambda self, rows, name: real(self, rows.mapInArrow(slow, rows.schema), name))
    said = []
    assert cli.run(cli.parser().parse_args(["-f", "100ms", str(tmp / "src"), str(tmp / "dst")]), said.append) == cli.SUCCESS
    assert any(s.startswith("entries found so far") for s in said) and any(s.startswith("digests of the") for s in said)
    assert "source: 2 files, 2 B together" in said and "destination: 1 files, 1 B together" in said
    assert said[-1] == "1 of 1 actions succeeded"  # no mkdir: the empty directory is there
    assert (tmp / "dst/hollow/b").exists()


def test_results_as_a_table(spark, trees):  # noqa: F811
    tmp, put = trees
    for n in "ab":
        put("src", f"new/{n}", n.encode(), 100)
        put("dst", n, n.encode(), 50)
    plan = planned(spark, tmp)
    plan.actions = storage.cut(plan.actions)
    os.remove(tmp / "dst/b")  # gone since the scan
    told = apply.results(plan, str(tmp / "dst"), batch=2)
    done = apply.performed(plan.executed(), told)
    assert {(r.kind, r.to_path, r.success) for r in done.collect()} == {("mkdir", "new", True), ("touch", "a", True), ("touch", "b", False), ("move", "new/a", True), ("move", "new/b", False)}
    assert {r.kind: (r.actions, r.successes, r.bytes_saved) for r in apply.savings(done).collect()} == {"mkdir": (1, 1, 0), "touch": (2, 1, 1), "move": (2, 1, 1)}


def test_copies_beside_a_move_that_fails(spark, trees):  # noqa: F811
    """Something else is at the target of a move: copies of the file that should have moved read it where it is."""
    tmp, put = trees
    for d in "ABC":
        put("src", f"{d}/x", b"thing", 100)
    put("dst", "wrong/x", b"thing", 100)
    put("dst", "A/x", b"other", 50)
    plan = planned(spark, tmp, True)
    plan.actions = storage.cut(plan.actions)
    told = {(r.kind, r.to_path): r.success for r in apply.performed(plan.executed(), apply.results(plan, str(tmp / "dst"))).collect()}
    assert told == {("move", "A/x"): False, ("copy", "B/x"): True, ("copy", "C/x"): True, ("mkdir", "B"): True, ("mkdir", "C"): True}
    assert {p: (tmp / "dst" / p).read_bytes() for p in ("A/x", "B/x", "C/x", "wrong/x")} == {"A/x": b"other", "B/x": b"thing", "C/x": b"thing", "wrong/x": b"thing"}


def test_scopes(spark):
    there = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file://"))
    before = storage.cut(spark.range(3))
    with storage.scope(spark):
        outer = storage.cut(spark.range(3))
        with storage.scope(spark):
            inner, kept = storage.cut(spark.range(3)), storage.cut(spark.range(3), keep=True)
            assert inner.count() == 3
            names = [x.inputFiles()[0].removeprefix("file://") for x in (inner, kept, outer)]
        assert [os.path.exists(n) for n in names] == [False, True, True]
        assert kept.count() == 3 and there(outer)
    assert not any(map(os.path.exists, names)) and before.count() == 3
    with pytest.raises(ValueError), storage.scope(spark):
        name = storage.cut(spark.range(3)).inputFiles()[0].removeprefix("file://")
        raise ValueError
    assert not os.path.exists(name)


SCHEMA = "seq long, side string, path string, size long, mtime long, deleted boolean"


def test_orphans_by_change(spark, tmp_path):
    """Random changes, some of them late, in epochs with a restart between: after each, the orphans are those of the whole log."""
    rng, log, wanted, previous = random.Random(5), [], [], {}
    steps = [[(rng.randint(1, 400), rng.choice(["source", "destination"]), f"p{rng.randint(0, 25)}", rng.randint(1, 2), rng.randint(1, 2), rng.random() < 0.2) for _ in range(60)] for _ in range(4)]
    out = str(tmp_path / "out")

    def keep(rows, epoch):
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    for n, step in enumerate(steps):
        step = [(s * 5 + n, *rest) for s, *rest in {r[0]: r for r in step}.values()]  # numbers differ
        log += step
        last = {}
        for seq, side, path, *state in sorted(log):
            last[side, path] = state
        state = {p: tuple(s[:2]) for (side, p), s in last.items() if side == "source" and not s[2]}
        other = {p: tuple(s[:2]) for (side, p), s in last.items() if side == "destination" and not s[2]}
        now = {p: s for p, s in state.items() if other.get(p) != s}
        spark.createDataFrame(step, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = changes.orphan_changes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log")))
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        changed = spark.read.parquet(out).where(F.col("epoch") == n).collect()
        assert {r.path: (r.size, r.mtime) for r in changes.current(spark.read.parquet(out)).collect()} == now
        # no more is told than what changed
        assert {r.path for r in changed} == {p for p in {*now, *previous} if now.get(p) != previous.get(p)}
        previous = now


def test_old_epochs_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "COMPACT", 2)
    for n in range(7):
        spark.createDataFrame([(n, "source", f"p{n}", 1, 1, False)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        seen = []
        query = changes.watch(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log")), lambda df, _, seen=seen: seen.append(df.count()), str(tmp_path / "state"))
        query.processAllAvailable()
        query.stop()
        assert seen == [n + 1]
    assert len(os.listdir(tmp_path / "state/inventory")) <= 4


@pytest.mark.parametrize(("master", "fine"), [("local", True), ("local[4]", True), ("local[*, 2]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_folder_of_this_machine_in_local_mode_alone(master, fine):
    held = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=held.get, set=held.__setitem__), sparkContext=SimpleNamespace(master=master))
    if fine:
        assert os.path.isdir(storage.shared_dir(session)) and storage.shared_dir(session) == held[storage.SETTING]
    else:
        with pytest.raises(RuntimeError, match=storage.SETTING):
            storage.shared_dir(session)


def test_csv_quotes(spark):
    names = ["plain", 'a"b', "a,b", " lead", "\tlead", " lead", " lead", "\\.", "\\.x", "trail ", "new\nline"]
    lines = [r.line for r in apply.csv_lines(spark.createDataFrame([(n, 1, 2) for n in names], "path string, size long, mtime long")).collect()]
    assert [x.startswith('"') for x in lines] == [False, True, True, True, True, True, True, True, False, False, True]


@pytest.fixture
def ssh(tmp_path, monkeypatch):
    """An ssh that notes its arguments and runs the last one here."""
    (tmp_path / "bin").mkdir()
    script = tmp_path / "bin/ssh"
    script.write_text(f"""#!/bin/sh
echo "$@" >> {tmp_path}/asked
for last; do :; done
cd {os.getcwd()} && exec sh -c "$last"
""")
    script.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}/bin", prepend=os.pathsep)
    return tmp_path / "asked"


REMOTE = f"{sys.executable} -m driftplan"


@pytest.mark.parametrize("side", ["source", "destination"])
def test_remote_places(spark, trees, ssh, monkeypatch, capsys, side):  # noqa: F811
    tmp, put = trees
    put("src", "new/a.txt", b"one", 200)
    put("dst", "a.txt", b"one", 100)
    put("src", "0", b"two", 100)
    put("dst", "false", b"two", 100)
    put("src", "archived", b"three", 100)
    put("old", "x", b"three", 50)
    put("src", "other", b"not there", 100)
    put("src", "Thumbs.db", b"left out", 100)
    places = [str(tmp / "src"), str(tmp / "dst")]
    at = 0 if side == "source" else 1
    places[at] = f"me@host:2222:{places[at]}"
    options = ["--sidekick-path", REMOTE, "-i", "/key", "-a", str(tmp / "old"), "-f", "100ms"]
    if side == "source":
        assert cli.main(["--list", *options, *places]) == cli.SUCCESS
        assert [x for x in capsys.readouterr().out.splitlines() if "," in x and " " not in x][-1:] and (tmp / "dst/a.txt").exists()
    assert cli.main(["-p", str(tmp / "do.sh"), *options, *places]) == cli.SUCCESS
    commands = (tmp / "do.sh").read_text().splitlines()
    assert all(c.startswith("ssh me@host '") == (side == "destination") for c in commands) and any("mv -v -n" in c for c in commands)
    assert cli.main(["-n", *options, *places]) == cli.SUCCESS and "actions would be performed" in capsys.readouterr().out
    assert cli.main([*options, *places]) == cli.SUCCESS
    said = capsys.readouterr().out
    assert "source: 4 files" in said and "failed" not in said
    found = {os.path.relpath(os.path.join(d, n), tmp / "dst"): int(os.stat(os.path.join(d, n)).st_mtime) for d, _, names in os.walk(tmp / "dst") for n in names}
    assert found == {"new/a.txt": 200, "0": 100, "archived": 100}
    asked = ssh.read_text().splitlines()
    assert set(asked) == {f"-l me -p 2222 -i /key -T host {REMOTE} --{x}" for x in ("version", "agent")}


def test_remote_places_without_a_fit_agent(spark, trees, ssh):  # noqa: F811
    tmp, _ = trees
    places = [str(tmp / "src"), f"host:{tmp}/dst"]
    for command in ("false", "echo v1.10.5 #", "echo nonsense #", "sh -c 'exit 3' #"):
        assert cli.main(["--sidekick-path", command, *places]) == cli.CONNECTION
    assert cli.main(["--sftp", "--sidekick-path", REMOTE, *places]) == cli.CONNECTION
    # an agent that can't read the directory
    assert cli.main(["--sidekick-path", REMOTE, places[0], "host:/nowhere/at/all"]) == cli.SYNC


def test_digests_and_actions_of_an_agent_in_batches(spark, trees, monkeypatch):  # noqa: F811
    from driftplan.operators import remote

    tmp, put = trees
    for i in range(7):
        put("dst", f"f{i}", b"x" * i, 100)
    monkeypatch.setattr(remote, "BATCH", 3)
    tree, told = remote.AgentTree(spark, agent.serve), []
    rows = tree.scan(str(tmp / "dst"), [], tell=told.append)
    assert sorted((r.path, r.size) for r in rows.collect()) == [(f"f{i}", i) for i in range(7)] and told == [7]
    asked = rows.select("path").unionByName(spark.createDataFrame([("gone",)], "path string"))
    found = {r.path: (r.size, r.error is None) for r in tree.digests(asked, str(tmp / "dst"), told.append).collect()}
    assert found == {f"f{i}": (i, True) for i in range(7)} | {"gone": (None, False)} and told[-1] == 8
    ordered = spark.createDataFrame([(i + 1, "touch", f"f{i}", f"f{i}", 300 + i) for i in range(7)] + [(8, "move", "gone", "there", None)], "emit_seq long, kind string, from_path string, to_path string, mtime long")
    assert [(n, fine) for n, fine, _ in tree.perform(ordered, str(tmp / "dst"))] == [(i + 1, i < 7) for i in range(8)]
    assert [int(os.stat(tmp / f"dst/f{i}").st_mtime) for i in range(7)] == [300 + i for i in range(7)]
    assert tree.digests(rows.where("false"), str(tmp / "dst")).count() == 0
    with pytest.raises(OSError):
        tree.scan(str(tmp / "gone"), [])


def action_rows(*rows):
    """A plan of (kind, from, to) without reconciliation, executed in this order."""
    columns = "phase string, kind string, orphan string, from_path string, planned_from string, to_path string, mtime long, bytes_saved long, exec_seq long"
    return lambda spark: SimpleNamespace(actions=(df := spark.createDataFrame([("match", kind, to, old, old, to, 100, 0, n) for n, (kind, old, to) in enumerate(rows, 1)], columns)), executed=lambda: reconcile.redirected(df.drop("planned_from")))


def snapshot(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, names in os.walk(root) for n in names}


@pytest.mark.parametrize("through_agent", [False, True])
def test_actions_are_performed_by_tasks(spark, trees, through_agent, monkeypatch):  # noqa: F811
    """The driver gets no rows of a plan whose actions don't meet; those that do end as they do one by one."""
    tmp, put = trees
    there = files.AgentFiles(agent.serve, anywhere=True) if through_agent else files.LocalFiles()
    loose = action_rows(("mkdir", None, "new"), *[("move", f"m{i}", f"new/m{i}") for i in range(40)], *[("copy", f"m{i}", f"copies/c{i}") for i in range(40)], ("touch", "t", "t"))(spark)
    for name in (*[f"m{i}" for i in range(40)], "t"):
        put("dst", name, name.encode(), 50)
    with monkeypatch.context() as patch:
        patch.setattr(type(loose.actions), "toLocalIterator", lambda self, *_: pytest.fail("rows of the driver") if not self.isEmpty() else iter(()))
        told = apply.results(loose, str(tmp / "dst"), files=there).collect()
    assert {r.exec_seq for r in told} == set(range(1, 83)) and len(told) == 82 and all(r.success for r in told)
    assert snapshot(tmp / "dst") == {f"new/m{i}": f"m{i}" for i in range(40)} | {f"copies/c{i}": f"m{i}" for i in range(40)} | {"t": "t"}
    assert int(os.stat(tmp / "dst/t").st_mtime) == 100


@pytest.mark.parametrize("seed", range(4))
def test_tasks_do_what_the_driver_does(spark, trees, seed):  # noqa: F811
    """Chains, swaps, targets that are others' sources, directories where files were: results and files of a plan in any order of its actions."""
    tmp, put = trees
    rng = random.Random(seed)
    rows = [("move", "a", "b"), ("move", "c", "a"), ("move", "d", "e"), ("copy", "e", "f"), ("copy", "g", "e"), ("move", "h", "i"), ("copy", "h", "h1"), ("copy", "h", "h2"), ("move", "j", "j2/j"), ("mkdir", None, "j"), ("move", "k", "j/k"), ("move", "l", "l2"), ("copy", "l", "l2/x"), ("mkdir", None, "n"), ("move", "m", "n/m"), ("copy", "o", "p"), ("move", "o", "q")]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[:1] != ("mkdir",) or r[2] != "n")  # as in plans, a directory comes before what is put there
    plan = action_rows(*rows)(spark)
    for side in ("one", "two"):
        for name in "abcdeghijklmo":
            if name != "b":
                put(side, name, name.encode(), 50)
    (tmp / "one/j2").mkdir()
    (tmp / "two/j2").mkdir()
    wanted = {n: fine for n, fine, _ in apply.apply(plan, str(tmp / "one"), dry_run=False)}
    told = apply.results(plan, str(tmp / "two"))
    assert {r.exec_seq: r.success for r in told.collect()} == wanted
    assert snapshot(tmp / "two") == snapshot(tmp / "one")


def test_a_task_that_is_tried_again_finds_its_moves_done(trees):  # noqa: F811
    tmp, put = trees
    put("dst", "a", b"a", 50)
    row = {"kind": "move", "from_path": "a", "to_path": "b"}
    assert [apply._tried(row, str(tmp / "dst"), {}, False, files.LocalFiles(), again) is None for again in (False, True, False)] == [True, True, False]


def test_a_plan_is_ordered_once(spark, small, monkeypatch):
    """Ordering is two sorts of all actions: what is performed and what is told of it share them."""
    from driftplan import queries

    orders = []
    monkeypatch.setattr(reconcile, "numbered", lambda df, order, name: orders.append(name) or storage.numbered(df, order, name))
    assert queries.QUERIES["performed_by_agent"](spark, small).count() == 4
    assert orders == ["emit_seq", "exec_seq"]
