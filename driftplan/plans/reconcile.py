"""The plan that brings a destination's names and times in line with a source."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import diff, match
from ..storage import cut, numbered

#: Shell commands by kind. {at_source}, {old} and {new} are quoted paths, {stamp} a quoted time.
COMMANDS = {
    "touch": "touch -r {at_source} {new}",
    "mkdir": "mkdir -p -v {new}",
    "move": "mv -v -n {old} {new}",
    "copy": "cp -pv {old} {new} && touch -m -a -t {stamp} {new}",
    "reflink": 'if [ "$(uname)" = "Darwin" ]; then cp -pv -c {old} {new}; else cp -pv --reflink=auto {old} {new}; fi && touch -m -a -t {stamp} {new}',
}
#: Actions in words, and what a dry run says of them.
WORDS = {
    "touch": "propagate timestamp of {old} to {new}",
    "mkdir": "create directory {new}",
    "move": "rename/move file from {old} to {new}",
    "copy": "copy file {old} to {new}",
}
DRY_RUN = "skipping (dry run)"

#: Order of kinds within one orphan, and of phases by mode.
KIND_RANK = {"touch": 0, "mkdir": 1, "move": 2, "copy": 2}
PHASES = {match.LOCAL: {"match": 1, "archive": 2, "dirs": 3}, match.AGENT: {"match": 1, "dirs": 2, "archive": 3}}
ACTION = ("phase", "kind", "orphan", "from_path", "to_path", "mtime", "bytes_saved")


@dataclass
class Plan:
    """Relations of a plan; ``actions`` has phase, kind, orphan, from_path, to_path, mtime, bytes_saved."""

    orphans: DataFrame
    candidates: DataFrame
    picked: DataFrame
    unmatched: DataFrame
    actions: DataFrame
    mode: str

    def ordered(self) -> DataFrame:
        """Actions with emit_seq, the order in which they are emitted."""
        phase = F.create_map(*[F.lit(x) for kv in PHASES[self.mode].items() for x in kv])[F.col("phase")]
        rank = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])[F.col("kind")]
        return numbered(self.actions, [phase, "orphan", rank, "kind", "to_path"], "emit_seq")

    def executed(self) -> DataFrame:
        """Actions in order of their targets' directories (exec_seq), emission order within one, and copies redirected to where an earlier move took their source."""
        ordered = self.ordered()
        rows = numbered(ordered.withColumn("dest_dir", paths.parent(F.col("to_path"))), ["dest_dir", "emit_seq"], "exec_seq")
        return redirected(rows)


def redirected(rows: DataFrame) -> DataFrame:
    """A copy whose source an earlier action (by exec_seq) moves reads from the move's target, if that succeeds; planned_from is where it reads otherwise."""
    moved = rows.where("kind = 'move'").select(F.col("from_path").alias("moved"), F.col("to_path").alias("moved_to"), F.col("exec_seq").alias("moved_at"))
    held = rows.join(moved, (F.col("kind") == "copy") & (F.col("phase") == "match") & (F.col("from_path") == F.col("moved")) & (F.col("moved_at") < F.col("exec_seq")), "left")
    return held.withColumn("planned_from", F.col("from_path")).withColumn("from_path", F.coalesce("moved_to", "from_path")).drop("moved", "moved_to", "moved_at")


def reconcile(source: DataFrame, destination: DataFrame, hashes: Column | None = None, mode: str = match.LOCAL, copy_duplicates: bool = False, archives: DataFrame | None = None, directory_times: tuple[DataFrame, DataFrame] | None = None, digest=None, resolve_touches: bool = False, directories: DataFrame | None = None) -> Plan:
    """Plans touches, directories, moves and copies.

    ``source``, ``destination``: path, size, mtime, and what ``hashes`` (a column over ``content``, say) or ``digest`` (a
    function from files and side to files with a hash) needs. Only orphans and candidates are hashed: the semi-joins stand
    before the digest. ``archives`` (archive_ord, path, size, content) are further sources of copies and imply
    ``copy_duplicates``. ``directory_times``: directories of both sides with mtimes. An orphan that only
    needs a touch of its own path counts as unmatched, so archives may copy over it, unless ``resolve_touches``.
    ``directories``: paths of the destination's directories, empty ones too; without them only those above files are known.
    """
    copy_duplicates = copy_duplicates or archives is not None
    digest = digest or (lambda files, side: match.digested(files, hashes))
    columns = ["path", "size", "mtime", "ext", "hash"]
    # used several times: without the cut each use would scan the inventories and hash again
    lost = cut(digest(diff.orphans(source, destination.select("path", "size", "mtime")), "source").select(*columns), "orphans")
    known = cut(digest(diff.candidates(destination, lost), "destination").select(*columns), "candidates")
    picked = cut(match.pick_best(lost, known, source.select("path", "size", "mtime")), "picked")
    moved, touched = match.moves(picked), match.touches(picked, mode)
    copied = match.copies(picked, mode) if copy_duplicates else picked.limit(0)
    existing = _existing(destination, directories) if mode == match.LOCAL else None
    wanted = (moved if mode == match.LOCAL else picked.where(~F.col("in_src"))).select("orphan").unionByName(copied.select("orphan"))
    made = match.new_directories(wanted, existing)
    rows = [
        _rows(touched, "match", "touch", F.col("orphan"), F.col("candidate"), F.col("mtime"), F.col("size")),
        _rows(made, "match", "mkdir", F.lit(None), F.col("path")),
        _rows(moved, "match", "move", F.col("candidate"), F.col("orphan"), F.lit(None), F.col("size")),
        _rows(copied, "match", "copy", F.col("candidate"), F.col("orphan"), F.col("mtime"), F.col("size")),
    ]
    solved = [moved, copied, *([touched.where("candidate = orphan")] if resolve_touches else [])]
    unmatched = lost
    for some in solved:
        unmatched = unmatched.join(some.select(F.col("orphan").alias("path")), "path", "left_anti")
    if archives is not None:
        few = archives.withColumn("ext", paths.extension(F.col("path"))).join(unmatched.select("ext", "size").distinct(), ["ext", "size"], "left_semi")
        few = match.digested(few, hashes) if hashes is not None else digest(few.drop("ext"), "archive")
        hit = cut(match.archive_matches(unmatched, few), "archived")
        fresh = match.new_directories(hit.select("orphan"), existing).join(made.select("path"), "path", "left_anti")
        rows += [_rows(fresh, "archive", "mkdir", F.lit(None), F.col("path")), _rows(hit, "archive", "copy", F.col("archive_path"), F.col("orphan"), F.col("mtime"))]
    if directory_times is not None:
        rows.append(_rows(diff.directory_touches(*directory_times).withColumn("orphan", F.col("path")), "dirs", "touch", F.col("path"), F.col("path"), F.col("mtime")))
    actions = rows[0]
    for more in rows[1:]:
        actions = actions.unionByName(more)
    return Plan(lost, known, picked, unmatched, actions, mode)


def _existing(destination: DataFrame, directories: DataFrame | None) -> DataFrame:
    above = diff.directories(destination).select("path")
    return above if directories is None else above.unionByName(directories.select("path"))


def _rows(of: DataFrame, phase: str, kind: str, from_path: Column, to_path: Column, mtime: Column | None = None, saved: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return of.select(F.lit(phase).alias("phase"), F.lit(kind).alias("kind"), "orphan", from_path.cast("string").alias("from_path"), to_path.alias("to_path"), (none if mtime is None else mtime).cast("long").alias("mtime"), (F.lit(0) if saved is None else saved).cast("long").alias("bytes_saved"))


def plan_summary(plan: Plan) -> DataFrame:
    return plan.actions.groupBy("kind").agg(F.count("*").alias("actions"), F.sum("bytes_saved").alias("bytes_saved"))


def _filled(template: str, **values: Column) -> Column:
    """A template with columns for its {names}."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def _by_kind(templates: dict[str, str], **values: Column) -> Column:
    said = [_filled(templates[k], **values) for k in ("touch", "mkdir", "move", "copy")]
    kind = F.col("kind")
    return F.when(kind == "touch", said[0]).when(kind == "mkdir", said[1]).when(kind == "move", said[2]).otherwise(said[3])


def commands(actions: DataFrame, source_root: str, destination_root: str, reflink: bool = False) -> DataFrame:
    """A shell command per action (column command). Times are written in the session's time zone."""

    def at(root: str, path: Column) -> Column:
        full = F.when(F.startswith(path, F.lit("/")), path).when(path == ".", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), path))
        return F.concat(F.lit('"'), text.shell_escaped(full), F.lit('"'))

    old, new = F.col("from_path"), F.col("to_path")
    stamp = F.concat(F.lit('"'), F.date_format(F.timestamp_seconds(F.col("mtime")), "yyyyMMddHHmm.ss"), F.lit('"'))
    templates = COMMANDS | ({"copy": COMMANDS["reflink"]} if reflink else {})
    return actions.withColumn("command", _by_kind(templates, at_source=at(source_root, old), old=at(destination_root, old), new=at(destination_root, new), stamp=stamp))


def over_ssh(command: Column, spec: str) -> Column:
    return F.concat(F.lit(f"ssh {spec} '"), F.replace(command, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def uniqueness(actions: DataFrame) -> Column:
    """What makes an action the same as another: its kind and one path."""
    mark = F.lit(text.KEY_SEPARATOR)
    return F.concat(F.col("kind"), mark, F.when(F.col("kind") == "move", F.col("from_path")).otherwise(F.col("to_path")))


def shown(actions: DataFrame) -> Column:
    """An action in words."""
    old, new = (F.concat(F.lit('"'), text.sanitized(F.col(c)), F.lit('"')) for c in ("from_path", "to_path"))
    return _by_kind(WORDS, old=old, new=new)


def log_lines(ordered: DataFrame, total: Column, word: str = DRY_RUN) -> Column:
    return F.concat(F.format_string("%4d/%d ", F.col("exec_seq"), total), shown(ordered), F.lit(f": {word}"))
