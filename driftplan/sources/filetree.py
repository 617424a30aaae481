"""A batch data source that scans a directory tree."""

from __future__ import annotations

import logging
import os
import stat
import zlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import DEFAULT_EXCLUSIONS

SCHEMA = "path string, size long, mtime long, is_dir boolean"
#: Directories that the driver looks at to find work for tasks, at most, and names that one task gets of a large directory;
#: its shares, at most, as each lists it; bytes that a name takes in a directory, about.
OPENED, NAMES, SHARES, ENTRY = 512, 10_000, 64, 32
LOG = logging.getLogger("driftplan")


def walk(root: str, excluded: frozenset[str], one: bool = False, start: tuple[str, ...] | None = None, below: bool = True) -> Iterator[tuple]:
    """(path, size, mtime, is_dir, error) of regular files and directories; entries that can't be read have an error alone.

    From the root's entries on, or from the paths ``start``; without ``below`` directories aren't entered. No recursion: a
    tree may be as deep as it likes.
    """
    root = os.path.normpath(root)
    device = os.lstat(root).st_dev if one else None
    if start is None:
        if os.path.basename(root) in excluded:
            return
        start = tuple(sorted(os.listdir(root)))
    left = deque(start)
    while left:
        rel = left.popleft()
        name = os.path.basename(rel)
        if name in excluded:
            continue
        shown, full = not name.startswith("._"), os.path.join(root, rel)
        try:
            info = os.lstat(full)
        except OSError as e:
            yield _skipped(rel, full, e)
            continue
        if stat.S_ISREG(info.st_mode):
            if shown:
                yield rel, info.st_size, int(info.st_mtime // 1), False, None
        elif stat.S_ISDIR(info.st_mode) and (not one or info.st_dev == device):
            if shown:
                yield rel, 0, int(info.st_mtime // 1), True, None
            if below:
                try:
                    left.extendleft(f"{rel}/{child}" for child in sorted(os.listdir(full), reverse=True))
                except OSError as e:
                    yield _skipped(rel, full, e)


def _skipped(rel: str, full: str, error: OSError) -> tuple:
    LOG.warning("skipped %s: %s", full, error)
    return rel, None, None, None, str(error)


class FileTree(DataSource):
    """``spark.read.format("filetree").option("root", ...)``: regular files and directories below a root.

    Options: root (needed), exclusions (names, one per line; default: the usual litter), one_file_system (true/false),
    errors (true/false). Excluded directories aren't entered. Names that start with ._ are left out, what is below them is
    not. Links and devices are left out. What can't be read is logged and skipped; with errors=true it is a row with a text
    in a further column, error. mtime is in whole seconds; directories have size 0. The driver looks at a few hundred
    directories and deals them to tasks, large ones in shares by hash of name. It holds no names but those of directories,
    and doesn't open those that have none as their link count tells; the root must be visible where tasks run.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA + (", error string" if self.options.get("errors", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Part(InputPartition):
    """A share of a directory's entries, and whether what is below them belongs to the part as well."""

    def __init__(self, rel: str, below: bool, share: int = 0, shares: int = 1):
        super().__init__((rel, below, share, shares))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if options.get("scheme", "file") != "file":
            raise ValueError(f"scheme {options['scheme']!r} needs a transport that this engine doesn't have; mount the tree instead")
        root = options.get("root")
        if not root:
            raise ValueError("option root is missing")
        names = options.get("exclusions")
        self.root = os.path.normpath(root)
        self.excluded = frozenset(DEFAULT_EXCLUSIONS if names is None else (x.strip() for x in names.splitlines() if x.strip()))
        self.one = options.get("one_file_system", "false").lower() == "true"
        self.errors = options.get("errors", "false").lower() == "true"
        if not stat.S_ISDIR(os.lstat(self.root).st_mode):
            raise NotADirectoryError(self.root)

    def partitions(self) -> list[InputPartition]:
        if os.path.basename(self.root) in self.excluded:
            return []
        device = os.lstat(self.root).st_dev
        parts, todo, looked, counts = [], deque([""]), 0, False
        while todo and looked < OPENED:
            rel, looked = todo.popleft(), looked + 1
            full = os.path.join(self.root, rel)
            try:
                info, entries = os.lstat(full), None
                if not (counts and info.st_nlink == 2 and info.st_dev == device):
                    entries, held, dirs = self._counted(rel, device)
                    if not rel:  # whether this file system's links tell of directories
                        counts = info.st_nlink == held + 2
            except OSError:
                if not rel:
                    raise
                parts.append(_Part(rel, True))  # a task of its own says why
                continue
            if entries is None:  # no directories, as far as its links tell: a task that finds one enters it
                parts += self._shares(rel, info.st_size // ENTRY, True)
            else:  # its own entries are one part or more; its directories are looked at in turn or become parts
                parts += self._shares(rel, entries, False)
                todo.extend(dirs)
        return parts + [_Part(rel, True) for rel in todo]

    def _counted(self, rel: str, device: int) -> tuple[int, int, list[str]]:
        """How many entries a directory has, how many directories, and which of these are to be entered."""
        n, held, dirs = 0, 0, []
        with os.scandir(os.path.join(self.root, rel)) as entries:
            for e in entries:
                n += 1
                if e.is_dir(follow_symlinks=False):
                    held += 1
                    if e.name not in self.excluded and not (self.one and e.stat(follow_symlinks=False).st_dev != device):
                        dirs.append(f"{rel}/{e.name}" if rel else e.name)
        return n, held, sorted(dirs)

    def _shares(self, rel: str, entries: int, below: bool) -> list[InputPartition]:
        n = min(max(-(-entries // NAMES), 1), SHARES)
        return [_Part(rel, below, i, n) for i in range(n)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        for row in self._found(*partition.value):
            if self.errors:
                yield row
            elif row[4] is None:
                yield row[:4]

    def _found(self, rel: str, below: bool, share: int, shares: int) -> Iterator[tuple]:
        """A share of what is in a directory; the directory's own row is in its parent's part."""
        full = os.path.join(self.root, rel)
        try:
            with os.scandir(full) as entries:
                names = sorted(f"{rel}/{e.name}" if rel else e.name for e in entries if shares == 1 or zlib.crc32(os.fsencode(e.name)) % shares == share)
        except OSError as e:
            if not rel:
                raise
            if share == 0:  # once for all shares
                yield _skipped(rel, full, e)
            return
        yield from walk(self.root, self.excluded, self.one, tuple(names), below)
