"""Counters of a run that ride on its own writes: no second pass, and a task that is tried again counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Counters:
    """Named counts.  `watch` attaches counts to rows that are written next; `values` adds up what was seen.

    A watched DataFrame must be the top of what its action runs (a write or a lineage cut): there Spark
    takes the counts of each task that finished once, whatever was tried before."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []
        self._told: dict[str, int] = {}

    def watch(self, df: DataFrame, counts: dict[str, Column]) -> DataFrame:
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[c.alias(name) for name, c in counts.items()])

    def add(self, name: str, n: int = 1) -> None:
        self._told[name] = self._told.get(name, 0) + n

    def values(self) -> dict[str, int]:
        """Counters that are not zero.  Waits for the actions of all watched rows."""
        for seen in self._seen:
            for name, n in seen.get.items():
                self.add(name, int(n or 0))
        self._seen.clear()
        return {name: n for name, n in self._told.items() if n}


def rows(spark: SparkSession, values: dict[str, int]) -> DataFrame:
    """`counter, n`, as `metrics.decisions` reads them."""
    return spark.createDataFrame(list(values.items()), "counter string, n bigint")
