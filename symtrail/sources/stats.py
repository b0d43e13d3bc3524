"""A stream of the changes of a source tree, found by comparing file times and sizes.

An offset numbers a snapshot: for each top folder a file with the time and size of every source file below it.
A folder that did not change keeps its file, so only changed folders are read and compared, each by a task of
its own.  The first snapshot is the one at the start, and tells nothing: what differs then is for a reconcile.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from symtrail.sources.tree import IGNORED

ENDINGS = ("*.py", "*.pyi", "*.ts", "*.tsx", "*.mts", "*.cts")
CHANGES = "repo_id string, rel_path string, change string, mtime_ns bigint, size bigint, content binary"

Stats = dict[str, tuple[int, int]]


def stat_tree(root: str, patterns: tuple[str, ...] = ENDINGS, ignored: tuple[str, ...] = IGNORED) -> dict[str, Stats]:
    """{top folder: {path: (time in ns, size)}} of the files that fit, without following linked folders.

    A file or folder that goes while it is looked at is left out."""
    out: dict[str, Stats] = {}
    waiting = [""]
    while waiting:
        folder = waiting.pop()
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except OSError:
            continue
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            try:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in ignored:
                        waiting.append(path)
                elif any(fnmatch(entry.name, p) for p in patterns):
                    seen = entry.stat()
                    out.setdefault(path.partition("/")[0] if "/" in path else "", {})[path] = (seen.st_mtime_ns, seen.st_size)
            except OSError:
                continue
    return out


class Snapshots:
    """Numbered snapshots in a folder that driver and executors share."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def numbers(self) -> list[int]:
        if not os.path.isdir(self.folder):
            return []
        return sorted(int(n.partition(".")[0]) for n in os.listdir(self.folder) if n.endswith(".index"))

    def index(self, number: int) -> dict[str, str]:
        """{top folder: name of the file with its stats}"""
        with open(self._path(f"{number:012d}.index")) as f:
            return json.load(f)

    def stats(self, name: str | None) -> Stats:
        if name is None:
            return {}
        with open(self._path(name)) as f:
            return {p: tuple(s) for p, s in json.load(f).items()}

    def _put(self, name: str, value) -> None:
        """Whole or not at all: a reader never sees half a file."""
        part = self._path(f".{name}.{os.getpid()}")
        with open(part, "w") as f:
            json.dump(value, f)
        os.replace(part, self._path(name))

    def add(self, tree: dict[str, Stats], always: bool = False) -> int:
        """The number of the snapshot of `tree`: the last one if nothing changed, unless `always`."""
        os.makedirs(self.folder, exist_ok=True)
        known = self.numbers()
        index = {}
        for folder, stats in tree.items():
            name = sha1(json.dumps([folder, sorted(stats.items())]).encode()).hexdigest() + ".stats"
            index[folder] = name
            if not os.path.exists(self._path(name)):
                self._put(name, stats)
        if known and not always and self.index(known[-1]) == index:
            return known[-1]
        number = known[-1] + 1 if known else 0
        self._put(f"{number:012d}.index", index)
        return number

    def forget(self, before: int) -> None:
        """Remove the snapshots before a number, and the files that only they used."""
        numbers = self.numbers()
        used = {name for n in numbers if n >= before for name in self.index(n).values()}
        gone = {name for n in numbers if n < before for name in self.index(n).values()} - used
        for name in [f"{n:012d}.index" for n in numbers if n < before] + sorted(gone):
            if os.path.exists(self._path(name)):
                os.remove(self._path(name))


@dataclass
class Folder(InputPartition):
    """One top folder between two snapshots."""

    before: str | None
    after: str | None


class StatReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.repo = options["path"], options["repo_id"]
        self.patterns = tuple(options["patterns"].split(",")) if "patterns" in options else ENDINGS
        self.snapshots = Snapshots(options["snapshots"])
        self.pause = float(options.get("pause", "0"))

    def initialOffset(self) -> dict:
        return {"snapshot": self.snapshots.add(stat_tree(self.root, self.patterns), always=True)}

    def latestOffset(self) -> dict:
        time.sleep(self.pause)
        return {"snapshot": self.snapshots.add(stat_tree(self.root, self.patterns))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self.snapshots.index(start["snapshot"]), self.snapshots.index(end["snapshot"])
        return [Folder(before.get(f), after.get(f)) for f in sorted(before.keys() | after.keys()) if before.get(f) != after.get(f)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        before, after = self.snapshots.stats(partition.before), self.snapshots.stats(partition.after)
        for path in sorted(before.keys() | after.keys()):
            if path not in after:
                yield self.repo, path, "removed", None, None, None
            elif before.get(path) != after[path]:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    continue               # gone again: the next snapshot says so
                yield self.repo, path, "saved", *after[path], content

    def commit(self, end: dict) -> None:
        self.snapshots.forget(end["snapshot"])


class StatSource(DataSource):
    """`spark.readStream.format("symtrail_stats")` with options path, repo_id, snapshots, and patterns and pause if wanted."""

    @classmethod
    def name(cls) -> str:
        return "symtrail_stats"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> StatReader:
        return StatReader(dict(self.options))


def changes(spark: SparkSession, root: str, repo_id: str, snapshots: str, patterns: tuple[str, ...] = ENDINGS, pause: float = 0.0) -> DataFrame:
    """A stream of CHANGES of the tree at `root`, each once: files saved since the stream first started, with
    their content, and files removed.

    `snapshots` is a folder of the stream's own that driver and executors share, like the tree.  A change
    is told when time or size differ; a file that was changed again meanwhile has its newest content, and
    is told again.  `pause` seconds pass before each look."""
    spark.dataSource.register(StatSource)
    reader = spark.readStream.format("symtrail_stats").option("path", root).option("repo_id", repo_id).option("snapshots", snapshots)
    return reader.option("patterns", ",".join(patterns)).option("pause", str(pause)).load()
