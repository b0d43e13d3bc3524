"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from symtrail.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the least node that can be reached.

    Each round takes the least label among a node and its neighbours, then follows that label's own label,
    so labels cover distances that double.  It ends when a round changes nothing.  Minima are combined
    before the shuffle, so a hub costs no more than its edges; lineage is cut every round.  Sides are sorted and
    merged: a broadcast would gather all labels in the driver, twice a round."""
    pairs = edges.filter("a != b").select("a", "b")
    # each edge turned round where it is made: a union would run what makes the edges twice, at the same time
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(pairs.select(F.inline(ends)).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component")).hint("merge"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        lower = labels.join(near.hint("merge"), "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = lower.select(F.col("node").alias("at"), F.col("next").alias("beyond"))
        moved = cut(
            lower.join(jump.hint("merge"), F.col("next") == F.col("at"), "left")
            .select("node", "old", F.least("next", F.coalesce("beyond", "next")).alias("component")))
        if moved.filter("component != old").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
