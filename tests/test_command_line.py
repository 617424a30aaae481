import base64
import json
import os

import pytest
from pyspark.sql import functions as F
from test_trees import scan, trees  # noqa: F401

from driftplan import __main__ as cli
from driftplan.operators import agent, apply
from driftplan.sources import wire


def files_of(root):
    return {os.path.relpath(os.path.join(d, n), root): int(os.stat(os.path.join(d, n)).st_mtime) for d, _, names in os.walk(root) for n in names}


@pytest.mark.parametrize(
    ("arguments", "code"),
    [
        ([], cli.ARGUMENTS), (["one"], cli.ARGUMENTS), (["--nonsense"], cli.ARGUMENTS), (["--version"], cli.SUCCESS), (["missing", "{dst}"], cli.SOURCE), (["{src}", "missing"], cli.DESTINATION),
        (["{src}", ":/x"], cli.DESTINATION), (["a:/x", "b:/y"], cli.ARGUMENTS), (["{src}", "host:/y"], cli.CONNECTION), (["-s", "-p", "x.sh", "{src}", "{dst}"], cli.SCRIPT), (["-x", "missing", "{src}", "{dst}"], cli.EXCLUSIONS),
        (["-f", "soon", "{src}", "{dst}"], cli.ARGUMENTS),
    ],
)
def test_options(trees, arguments, code):  # noqa: F811
    tmp, _ = trees
    assert cli.main([a.format(src=tmp / "src", dst=tmp / "dst") for a in arguments]) == code


def test_a_link_is_no_place(trees):  # noqa: F811
    tmp, _ = trees
    os.symlink(tmp / "src", tmp / "link")
    assert cli.main([str(tmp / "link"), str(tmp / "dst")]) == cli.SOURCE and cli.main([str(tmp / "src"), str(tmp / "link")]) == cli.DESTINATION


def test_run(spark, trees, monkeypatch, capsys):  # noqa: F811
    tmp, put = trees
    monkeypatch.chdir(tmp)
    put("src", "new/a.txt", b"one", 200)
    put("dst", "a.txt", b"one", 100)
    put("src", "b.txt", b"two", 100)
    put("one", "b.txt", b"two", 50)
    put("two", "a-first.txt", b"two", 50)
    places = [str(tmp / "src"), str(tmp / "dst")]
    assert cli.main(["--list", *places]) == cli.SUCCESS and sorted(capsys.readouterr().out.split()) == ["b.txt,3,100", "new/a.txt,3,200"]
    assert cli.main(["-n", "-v", *places]) == cli.SUCCESS and "3 actions would be performed" in capsys.readouterr().out
    dump = next(n for n in os.listdir(tmp) if n.endswith("orphans_at_source.txt"))
    assert (tmp / dump).read_text() == "b.txt\nnew/a.txt" and files_of(tmp / "dst") == {"a.txt": 100}
    assert cli.main(["-p", "do.sh", "-a", str(tmp / "one"), *places]) == cli.SUCCESS
    assert os.access(tmp / "do.sh", os.X_OK) and len((tmp / "do.sh").read_text().splitlines()) == 4
    assert f'"{tmp}/one/b.txt"' in (tmp / "do.sh").read_text()
    assert cli.main(["--reflink", "-a", str(tmp / "one"), "-a", str(tmp / "two"), *places]) == cli.SUCCESS
    assert files_of(tmp / "dst") == files_of(tmp / "src")


def lines(*messages):
    return [json.dumps({"type": kind, "payload": base64.b64encode(json.dumps(p).encode()).decode()}) for kind, p in messages]


def test_agent(spark, trees):  # noqa: F811
    tmp, put = trees
    for name in ("old.txt", "twin.txt", "touch.txt", "sub/x.TXT"):
        put("dst", name, name.encode(), 100)
    root = str(tmp / "dst")
    rows = [(1, "touch", "touch.txt", "touch.txt", 300), (2, "mkdir", None, "sub/deep", None), (3, "move", "old.txt", "sub/deep/new.txt", None), (4, "copy", "twin.txt", "other/copy.txt", 400), (5, "move", "missing", "there", None), (6, "copy", "twin.txt", "third.txt", 500)]
    plan = spark.createDataFrame(rows, "emit_seq long, kind string, from_path string, to_path string, mtime long")
    for dry in (True, False):
        sent = [r.value for r in wire.perform_requests(wire.action_specs(plan, root, reflink=not dry), dry, 4).orderBy("part").collect()]
        answers = spark.createDataFrame([(x,) for x in agent.serve(sent)], "value string")
        found = [(r["index"], r["success"]) for r in wire.perform_rows(answers).collect()]
        assert sorted(found) == sorted((i, dry or part * 4 + i != 4) for part, n in ((0, 4), (1, 2)) for i in range(n))
    assert files_of(root) == {"touch.txt": 300, "sub/deep/new.txt": 100, "other/copy.txt": 400, "third.txt": 500, "twin.txt": 100, "sub/x.TXT": 100}
    asked = spark.range(1).select(wire.walk_request(F.lit(root), F.array(F.lit("deep"))).alias("a"), wire.digest_request(F.lit(root), F.array(F.lit("sub/x.TXT"), F.lit("gone"))).alias("b"), wire.request("quit").alias("c")).first()
    answers = spark.createDataFrame([(x,) for x in agent.serve([asked.a, asked.b, "{", *lines(("what", {})), asked.c, asked.a])], "value string")
    assert {(r.path, r.is_dir) for r in wire.walk_rows(answers).collect()} == {("touch.txt", False), ("other/copy.txt", False), ("third.txt", False), ("twin.txt", False), ("sub/x.TXT", False), ("sub", True), ("other", True)}
    assert [(r.path, r.ext, r.size) for r in wire.digest_rows(answers).collect()] == [("sub/x.TXT", ".txt", 9)]
    assert wire.error_rows(answers).count() == 2 and wire.progress_rows(answers).count() == 3


def test_lines_of_paths(spark, tmp_path):
    apply.write_lines(spark.createDataFrame([("b",), ("B",), ("é",)], "path string"), str(tmp_path / "x"))
    assert (tmp_path / "x").read_text() == "B\nb\né"
