"""A versioned key-value table with compare-and-set, for facts about a store that no snapshot holds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from symtrail import schema as SC
from symtrail.session import cut
from symtrail.sources.snapshots import folder_of

#: Versions a reader puts together at most; the next write then writes all keys.
MOST_VERSIONS = 32


class Conflict(RuntimeError):
    """A key was changed after the version that the change was based on."""


class Meta:
    """`<root>/rows/<name>` holds the keys of a version, `<root>/commits/<number>` says that it counts.

    A commit file is created only if its number is free, so of two writers one comes first; the other tries
    the next number, after a look at the keys that were changed before it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return folder_of(self.spark, f"{self.root}/{name}")

    def versions(self) -> list[int]:
        fs, path = self._path("commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _commit(self, number: int) -> dict:
        fs, path = self._path(f"commits/{number:012d}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _claim(self, number: int, content: dict) -> bool:
        fs, path = self._path(f"commits/{number:012d}")
        try:
            stream = fs.create(path, False)
        except Exception as exc:  # noqa: BLE001 - py4j wraps what the file system throws
            if fs.exists(path):
                return False
            raise exc
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return True

    def changes(self, after: int = 0, until: int | None = None) -> DataFrame:
        """`key, value, version` of the versions in (after, until]."""
        out = self.spark.createDataFrame([], f"{SC.META}, version bigint")
        for number in self.versions():
            if after < number and (until is None or number <= until):
                part = self.spark.read.schema(SC.META).parquet(f"{self.root}/rows/{self._commit(number)['rows']}")
                out = out.unionByName(part.withColumn("version", F.lit(number).cast("bigint")))
        return out

    def read(self, at: int | None = None) -> DataFrame:
        """`key, value` as of a version (the last one if none is given)."""
        numbers = [n for n in self.versions() if at is None or n <= at]
        whole = [n for n in numbers if self._commit(n)["whole"]]
        last = self.changes(max(whole, default=1) - 1, at).groupBy("key").agg(F.max_by("value", "version").alias("value"))
        return last.select("key", "value")

    def put(self, rows: DataFrame, based_on: int | None = None) -> int:
        """Set the keys of `rows` (key, value), one row each; the number of the new version.

        With `based_on`, raises Conflict if one of them was set by a later version.  All keys are set or none."""
        rows = cut(rows.select("key", "value"))
        while True:
            now = self.versions()
            last = max(now, default=0)
            if based_on is not None and last > based_on:
                later = self.changes(based_on, last).select("key").distinct()
                taken = rows.join(later, "key", "left_semi").limit(5).collect()
                if taken:
                    raise Conflict("changed since version %d: %s" % (based_on, ", ".join(sorted(r["key"] for r in taken))))
            whole = len([n for n in now if n > max((m for m in now if self._commit(m)["whole"]), default=0)]) >= MOST_VERSIONS
            kept = rows
            if whole:
                kept = rows.unionByName(self.read(last).join(rows.select("key"), "key", "left_anti"))
            name = uuid.uuid4().hex
            kept.write.parquet(f"{self.root}/rows/{name}")
            if self._claim(last + 1, {"rows": name, "whole": whole}):
                return last + 1
            fs, path = self._path(f"rows/{name}")
            fs.delete(path, True)
