"""Trees at the other end of an agent: scans, digests and actions as tables."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import wire
from ..storage import cut
from .files import Command, line, opened

#: Fixed value: the first version whose agent speaks the protocol. Seconds that it may take to tell its version.
AGENT_SINCE, PROBE_SECONDS = (1, 10, 6), 10
#: Files in a digest request, and actions in a perform request.
BATCH = 10_000


class AgentTree:
    """What an agent is asked about its files. ``exchange`` sends request lines and gives the lines that answer them.

    A scan is one message, so its size is bounded by what the driver can hold; digests and actions go in batches.
    """

    def __init__(self, spark: SparkSession, exchange: Callable[[list[str]], Iterable[str]]):
        self.spark, self.exchange = spark, exchange

    def _answers(self, request: str, tell: Callable[[dict], None] = lambda _: None) -> Iterator[str]:
        """The lines of an answer but for those of progress, which ``tell`` gets; an error is raised."""
        for answer in self.exchange([request]):
            kind, payload = opened(answer)
            if kind == "error":
                raise OSError(payload.get("message"))
            if kind.endswith("_progress"):
                tell(payload)
            else:
                yield answer

    def _lines(self, lines: Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in lines], "value string")

    def scan(self, root: str, excluded: Iterable[str], one_file_system: bool = False, progress_ms: int = 0, tell: Callable[[int], None] = lambda _: None) -> DataFrame:
        """(path, size, mtime, is_dir) below ``root``; ``tell`` gets the number of files found each ``progress_ms``."""
        asked = {"dir_path": root, "excluded_names": sorted(excluded)} | ({"progress_interval_ms": progress_ms} if progress_ms > 0 else {}) | ({"one_file_system": True} if one_file_system else {})
        answers = self._answers(line("walk_request", asked), lambda p: tell(p["files_found"]))
        return cut(wire.walk_rows(self._lines(answers)), "remote-scan")

    def digests(self, files: DataFrame, root: str, tell: Callable[[int], None] = lambda _: None) -> DataFrame:
        """(path, size, fuzzy_hash, error) of files (path): those that the agent leaves out have an error."""
        found, done = None, 0
        for rows in batched(files.select("path").distinct().toLocalIterator(), BATCH):
            paths = [r["path"] for r in rows]
            answers = self._answers(line("digest_request", {"base_path": root, "files": paths}), lambda p, done=done: tell(done + p["files_hashed"]))
            some = cut(wire.digest_rows(self._lines(answers)).select("path", "size", "fuzzy_hash"), "remote-digests")
            found, done = some if found is None else found.unionByName(some), done + len(paths)
        if found is None:
            found = self.spark.createDataFrame([], "path string, size long, fuzzy_hash string")
        unread = F.when(F.col("fuzzy_hash").isNull(), F.lit("the agent gives no digest"))
        return files.select("path").distinct().join(found, "path", "left").select("path", "size", "fuzzy_hash", unread.alias("error"))

    def perform(self, ordered: DataFrame, root: str, dry_run: bool = False, reflink: bool = False) -> Iterator[tuple[int, bool, str | None]]:
        """Has a plan's actions (its ``ordered``) performed in the order of emission, and tells (emit_seq, success, error) for each."""
        requests = cut(wire.perform_requests(wire.action_specs(ordered, root, reflink), dry_run, BATCH), "requests")
        for r in requests.orderBy("part").toLocalIterator():
            for answer in self._answers(r["value"]):
                for result in opened(answer)[1]["results"]:
                    yield int(r["part"]) * BATCH + result["index"] + 1, result["success"], result.get("error") or None


def connect(spark: SparkSession, place: str, key: str = "", command: str = "driftplan") -> tuple[Command, str]:
    """An agent at [user@]host:[port:]path that the system's ssh starts, and the path. ConnectionError where there is none of a fit version."""
    loc = text.location(F.lit(place))
    args, path, error = spark.range(1).select(text.ssh_arguments(loc, F.lit(key)), loc["path"], loc["error"]).first()
    if error:
        raise ConnectionError(f"{place}: {error}")
    ssh = ["ssh", *args]
    try:
        said = subprocess.run([*ssh, f"{command} --version"], capture_output=True, text=True, timeout=PROBE_SECONDS)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise ConnectionError(f"{place}: {e}") from e
    version = said.stdout.strip()
    (fit,) = spark.range(1).select(text.version_at_least(F.lit(version), AGENT_SINCE)).first()
    if said.returncode or not fit:
        raise ConnectionError(f"{place}: no agent of a version that is known ({version or said.stderr.strip() or 'no answer'})")
    return Command([*ssh, f"{command} --agent"]), path
