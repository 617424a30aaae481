"""The command line: ``python -m driftplan [options] source destination``."""

from __future__ import annotations

import argparse
import os
import re
import sys
import time

#: Exit codes.
SUCCESS, ARGUMENTS, SOURCE, DESTINATION, LISTING, SYNC, EXCLUSION_FILE, EXCLUSIONS, SCRIPT, CONNECTION = range(10)
VERSION = "2.0.0"


class Refused(Exception):
    """A message and an exit code."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Refused(ARGUMENTS, message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="driftplan", description="Brings renames, moves and times of a source directory to a destination directory.")
    flag = lambda *names, **more: p.add_argument(*names, action="store_true", **more)
    p.add_argument("places", nargs="*", metavar="directory", help="source and destination: a local path or user@host:/path")
    p.add_argument("-x", "--exclusions", metavar="FILE", help="names to leave out, one per line, instead of the usual ones")
    flag("-s", "--shellscript", help="write a script instead of acting")
    p.add_argument("-p", "--shellscript-at-path", metavar="PATH", default="", help="write a script to this path")
    flag("-v", "--verbose", help="say more and write lists of orphans and candidates")
    p.add_argument("-f", "--progress-frequency", type=_seconds, default=5.0, help="how often to tell of progress, such as 5s or 1m")
    flag("--list", help="list the source's files as CSV")
    flag("--version", help="show the version")
    flag("-n", "--dry-run", help="show what would be done")
    p.add_argument("-i", "--ssh-key", default="", help="a private key for remote places")
    p.add_argument("--sidekick-path", default="driftplan", help="the command at the remote place")
    flag("--sftp", help="refused: remote places are reached through an agent")
    flag("--agent", help=argparse.SUPPRESS)
    flag("-d", "--sync-dir-timestamps", help="directories' times as well")
    flag("-c", "--copy-duplicates", help="copy files whose content is at the destination already")
    flag("--reflink", help="let copies share blocks where the file system can")
    p.add_argument("-a", "--archive-path", action="append", default=[], help="a further directory to copy from; may be repeated, implies -c")
    flag("--one-file-system", help="stay on the file systems of source and destination")
    flag("--archive-one-file-system", help="stay on the file systems of the archives")
    return p


def _seconds(text: str) -> float:
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise argparse.ArgumentTypeError(f"{text!r} isn't a time such as 5s or 1m30s")
    return sum(float(a) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[b] for a, b in parts)


def is_local(place: str) -> bool:
    return place.startswith(("/", "./", "../")) or ":" not in place


def checked(options: argparse.Namespace) -> None:
    """Raises Refused where options don't fit."""
    if len(options.places) != 2:
        raise Refused(ARGUMENTS, "give a source directory and a destination directory")
    remote = []
    for code, which, place in ((SOURCE, "source", options.places[0]), (DESTINATION, "destination", options.places[1])):
        local = is_local(place)
        host, _, path = place.partition(":")
        if not place or not local and not (host.rpartition("@")[2] and path):
            raise Refused(code, f"{place!r} can't be the {which}")
        if local and (os.path.islink(place) or not os.path.isdir(place) or not os.access(place, os.R_OK)):
            raise Refused(code, f"the {which}, {place!r}, isn't a directory that can be read")
        remote.append(not local)
    if all(remote):
        raise Refused(ARGUMENTS, "at least one place must be on this machine")
    if options.shellscript and options.shellscript_at_path:
        raise Refused(SCRIPT, "-s and -p exclude each other")
    if any(remote) and options.sftp:
        raise Refused(CONNECTION, "remote places are reached through an agent alone: leave out --sftp")


def exclusions(path: str | None) -> str | None:
    """The content of an exclusion list for the scan; None: the usual names."""
    if path is None:
        return None
    if not os.path.isfile(path):
        raise Refused(EXCLUSIONS, "there is no such list of exclusions")
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise Refused(EXCLUSION_FILE, f"the list of exclusions can't be read: {e}") from e


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[*]").appName("driftplan").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(options: argparse.Namespace, say=print) -> int:
    from contextlib import ExitStack

    from .operators import remote
    from .sources.filetree import FileTree

    checked(options)
    names, spark = exclusions(options.exclusions), session()
    spark.dataSource.register(FileTree)
    roots, trees = {}, {}
    with ExitStack() as stack:
        for side, place in zip(("source", "destination"), options.places, strict=True):
            roots[side] = os.path.abspath(place)
            if not is_local(place):
                try:
                    command, roots[side] = remote.connect(spark, place, options.ssh_key, options.sidekick_path)
                except ConnectionError as e:
                    raise Refused(CONNECTION, str(e)) from e
                trees[side] = remote.AgentTree(spark, stack.enter_context(command))
        return _run(options, spark, names, roots, trees, say)


def _run(options: argparse.Namespace, spark, names: str | None, roots: dict[str, str], trees: dict, say) -> int:
    """``roots``: a directory per side; ``trees``: the agents of sides elsewhere."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F

    from .functions import digest, paths, text
    from .operators import apply, match
    from .plans import reconcile
    from .progress import Progress, observed
    from .sources.tables import DEFAULT_EXCLUSIONS
    from .storage import cut

    frequency = options.progress_frequency
    excluded = DEFAULT_EXCLUSIONS if names is None else [x.strip() for x in names.splitlines() if x.strip()]

    def scan(side: str, root: str, one: bool, progress: Progress):
        """Entries below a directory of a side, written, with their number and size."""
        if side in trees:
            rows = trees[side].scan(root, excluded, one, int(1000 * frequency), progress.counter(side))
            files, size = rows.where("NOT is_dir").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            return rows, {"files": files, "total_size": size}
        reader = spark.read.format("filetree").option("root", root).option("one_file_system", str(one).lower())
        rows, seen = observed(progress.counted((reader if names is None else reader.option("exclusions", names)).load(), side))
        return cut(rows, side), seen.get

    if options.list:
        try:
            rows, _ = scan("source", roots["source"], options.one_file_system, Progress(spark))
            for row in apply.csv_lines(rows.where("NOT is_dir")).toLocalIterator():
                say(row["line"])
        except Exception as e:
            raise Refused(LISTING, f"the list can't be made: {e}") from e
        return SUCCESS
    progress = Progress(spark)

    def scanned(side: str):
        found = scan(side, roots[side], options.one_file_system, progress)
        progress.finished.add(side)
        return found

    def at(counts: dict, done: set) -> str:
        return ", ".join(f"{n} at the {side}{' (all)' if side in done else ''}" for side, n in counts.items())

    def hashed(rows, side: str):
        """Digests of files; archives are at the destination, and their paths are absolute already."""
        hashes, tree = Progress(spark), trees.get("destination" if side == "archive" else side)
        root, expected = roots.get(side, "/"), (rows := cut(rows, f"to-hash-{side}")).count()
        with hashes.told(frequency, lambda counts, _: say(f"digests of the {side}: {100 * sum(counts.values()) // max(expected, 1)}% of {expected}")):
            said = tree.digests(rows, root, hashes.counter(side)) if tree else hashes.counted(digest.digest_files(rows, root), side)
            found = digest.tolerated(cut(said, f"digests-{side}"))
        return rows.join(found.select("path", F.col("fuzzy_hash").alias("hash")), "path").withColumn("ext", paths.extension(F.col("path")))

    try:
        # both sides at once, as two jobs that share the session's tasks
        with progress.told(frequency, lambda counts, done: say(f"entries found so far: {at(counts, done)}")), ThreadPoolExecutor(2) as pool:
            sides = dict(zip(roots, pool.map(scanned, roots), strict=True))
        every = {side: rows for side, (rows, _) in sides.items()}
        files = {side: rows.where("NOT is_dir").drop("is_dir") for side, rows in every.items()}
        for side, (_, seen) in sides.items():
            (size,) = spark.range(1).select(text.binary_size(F.lit(seen["total_size"]))).first()
            say(f"{side}: {seen['files']} files, {size} together")
        archives = None
        for ord_, root in enumerate(options.archive_path):
            root = root if "destination" in trees else os.path.abspath(root)
            rows, _ = scan("destination", root, options.archive_one_file_system, Progress(spark))
            rows = rows.where("NOT is_dir").select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), "size", "mtime", F.lit(ord_).alias("archive_ord"))
            archives = rows if archives is None else archives.unionByName(rows)
        times = tuple(every[side].where("is_dir").select("path", "mtime") for side in roots) if options.sync_dir_timestamps else None
        mode, known = match.AGENT if trees else match.LOCAL, every["destination"].where("is_dir").select("path")
        plan = reconcile.reconcile(files["source"], files["destination"], digest=hashed, mode=mode, copy_duplicates=options.copy_duplicates, archives=archives, directory_times=times, directories=known)
        stamp = time.strftime("%y%m%d_%H%M%S")
        if options.verbose:
            apply.write_lines(plan.orphans, f"./info_{stamp}_orphans_at_source.txt")
            apply.write_lines(plan.candidates, f"./info_{stamp}_candidates_at_destination.txt")
        script = options.shellscript_at_path or (f"./sync_actions_{stamp}.sh" if options.shellscript else "")
        if script:
            lines = reconcile.commands(plan.ordered(), roots["source"], roots["destination"], options.reflink).select(F.col("emit_seq").alias("seq"), "command")
            if "destination" in trees:
                (spec,) = spark.range(1).select(text.ssh_spec(text.location(F.lit(options.places[1])))).first()
                lines = lines.withColumn("command", reconcile.over_ssh(F.col("command"), spec))
            apply.write_script(lines, script)
            say(f"the script is {script}")
            return SUCCESS
        plan.actions = cut(plan.actions, "actions")
        total, good, last = plan.actions.count(), 0, time.monotonic()
        if "destination" in trees:
            told = trees["destination"].perform(plan.ordered(), roots["destination"], options.dry_run, options.reflink)
            for n, (_, fine, error) in enumerate(told, 1):
                good += fine
                if not fine:
                    say(f"action {n} of {total} failed: {error}")
                if time.monotonic() - last >= frequency:
                    last = time.monotonic()
                    say(f"{n} of {total} actions done")
        elif options.dry_run:
            good = total
        else:
            done = Progress(spark)
            with done.told(frequency, lambda counts, _: say(f"{sum(counts.values())} of {total} actions done")):
                failed = cut(apply.results(plan, roots["destination"], reflink=options.reflink, progress=done).where("NOT success"), "failed")
            good = total - failed.count()
            for row in failed.orderBy("exec_seq").toLocalIterator():
                say(f"action {row['exec_seq']} of {total} failed: {row['error']}")
        say(f"{good} actions would be performed" if options.dry_run else f"{good} of {total} actions succeeded")
    except Exception as e:
        raise Refused(SYNC, f"the plan can't be made or carried out: {e}") from e
    return SUCCESS


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    try:
        options = parser().parse_args(arguments)
        if options.agent:
            from .operators.agent import serve

            for line in serve(sys.stdin):
                print(line, flush=True)
            return SUCCESS
        if options.version:
            print(VERSION)
            return SUCCESS
        if not arguments:
            raise Refused(ARGUMENTS, "no directories given")
        return run(options)
    except Refused as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
