"""Building blocks that keep one hot key from landing in one task.

A key may hold a third of all rows, so nothing here sorts or collects a whole key in one place:
ordered work is split into buckets of a key, every bucket is folded on its own, and only the
one-row-per-bucket summaries are carried across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from symtrail.functions import paths as P
from symtrail.session import cut, small, written

#: A key with this many left rows is hot; at most rows / HOT_ROWS keys can be.
HOT_ROWS = 1_000_000

#: Keys are counted in this many buckets first: a bucket below HOT_ROWS holds no hot key.
HOT_BUCKETS = 1 << 16


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
           hot_rows: int | None = None, bound: DataFrame | None = None, settle: bool = False) -> DataFrame:
    """Join many `left` rows to `right` rows that are few per key, whatever the skew of `left`.

    A small right side (its rows counted, its bytes estimated) is broadcast.  Beyond that the left rows
    are counted by a hash of the key, which shuffles a few numbers per task.  Without a hot bucket this is
    a plain join, each side shuffled once.  Else the keys of hot buckets are counted; only rows of hot keys
    are salted, a salt for every `hot_rows` of them, and only their right rows repeated.  `bound` is a
    cheaper DataFrame known to have at least as many rows as `right`; it is counted in its place.
    `settle` writes a left side that is itself the result of shuffles, which else would run again to be counted."""
    if hot_rows is None and small(right if bound is None else bound, widest=right):
        return left.join(F.broadcast(right), keys, how)
    left = written(left) if settle else left
    size = hot_rows or HOT_ROWS
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HOT_BUCKETS)).cast("int")
    full = [r["_bucket"] for r in left.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= size).select("_bucket").collect()]
    if not full:
        return left.join(right, keys, how)
    counted = left.join(F.broadcast(_numbers(left, full)), bucket == F.col("_bucket"), "left_semi")\
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(written(counted.filter(F.col("_n") >= size).select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("_salts"))))
    # Salt from the row itself, not from rand(): a recomputed task must send its rows the same way.
    hashable = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    salts = F.coalesce("_salts", F.lit(1))
    salted = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*hashable), salts).cast("int")).drop("_salts")
    spread = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def _numbers(df: DataFrame, values: list[int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], "_bucket int")


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """`row_number()` over (keys, bucket, order) where each task sorts one bucket, not one key.

    `bucket` must not decrease along `order`."""
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    local = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    return (rows.withColumn("_rn", local).join(offsets, [*keys, "_b"])
            .withColumn(name, (F.col("_off") + F.col("_rn")).cast("bigint")).drop("_b", "_rn", "_off"))


def running_sums(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                 sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums `{output: input}` along `order`, split the same way as `numbered`."""
    rows = df.withColumn("_b", bucket)
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    ahead = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", *[
        F.coalesce(F.sum(f"_t_{o}").over(ahead), F.lit(0)).alias(f"_o_{o}") for o in sums])
    upto = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.select("*", *[F.sum(c).over(upto).alias(f"_s_{o}") for o, c in sums.items()])
    out = out.join(offsets, [*keys, "_b"])
    for o in sums:
        out = out.withColumn(o, F.col(f"_s_{o}") + F.col(f"_o_{o}")).drop(f"_s_{o}", f"_o_{o}")
    return out.drop("_b")


def range_buckets(df: DataFrame, *columns: str) -> DataFrame:
    """Adds `bucket`, a range number along `columns`.  The split is sampled, so it is written down
    before use: a recomputed bucket could differ."""
    parts = df.repartitionByRange(*[F.col(c) for c in columns])
    return cut(parts.withColumn("bucket", F.spark_partition_id()))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str,
          values: list[str], bucket, strict: bool = False, tie: str | None = None) -> DataFrame:
    """For each left row, the right `values` with the greatest `since` at or before `at`.

    `bucket(col)` maps an ordering value to a coarse, non-decreasing bucket.  Inside a bucket a
    running `last` finds the match; across buckets only each bucket's last row is carried.  With
    `strict`, equal positions do not match.  `tie` orders right rows of equal `since`."""
    payload = F.struct(F.col(since).alias("_since"), *[F.col(v) for v in values])
    tie_col = F.col(tie) if tie else F.lit(0)
    r = right.select(*keys, F.col(since).alias("_pos"), F.lit(1 if strict else 0).alias("_side"),
                     tie_col.alias("_tie"), payload.alias("_hit"))
    marked = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns]))
    side = 0 if strict else 1
    l = marked.select(*keys, F.col(at).alias("_pos"), F.lit(side).alias("_side"),
                      F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), "_row")
    both = r.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType)).unionByName(
        l.withColumn("_hit", F.lit(None).cast(r.schema["_hit"].dataType))).withColumn("_b", bucket(F.col("_pos")))
    lasts = both.filter("_hit is not null").groupBy(*keys, "_b").agg(
        F.max_by("_hit", F.struct("_pos", "_tie")).alias("_h"))
    spots = both.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c")).join(lasts, [*keys, "_b"], "left")
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = spots.select(*keys, "_b", F.last("_h", True).over(before).alias("_carry"))
    inside = W.partitionBy(*keys, "_b").orderBy("_pos", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    found = (both.withColumn("_near", F.last("_hit", True).over(inside)).filter("_row is not null")
             .join(carried, [*keys, "_b"])
             .withColumn("_best", F.coalesce("_near", "_carry")))
    picked = [F.col(f"_best.{v}").alias(v) for v in values]
    rest = [F.col(f"_row.{c}").alias(c) for c in left.columns]
    return found.select(*rest, F.col("_best._since").alias("matched_at"), *picked)


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], point: str,
              start: str, end: str, pick: list[str]) -> DataFrame:
    """The enclosing interval with the greatest start for each point (ties: least end, then `pick`).

    Intervals are cut into aligned power-of-two cells, at most two per size; a cell keeps only its best
    interval, so a point meets at most one row per size and no list of intervals is ever paired with a
    list of points.  The sizes follow from the least and the greatest position of the intervals."""
    rank = F.struct((-F.col(start)).alias("s"), F.col(end).alias("e"), *[F.col(p) for p in pick])
    spans = intervals.filter(F.col(start) <= F.col(end)).select(
        *keys, rank.alias("_iv"), F.col(start).cast("bigint").alias("_lo"),
        (F.col(end).cast("bigint") + 1).alias("_hi"))
    least, most = spans.agg(F.min("_lo"), F.max("_hi")).first()
    least, bits = least or 0, max(1, ((most or 0) - (least or 0)).bit_length())
    spans = spans.withColumn("_lo", F.col("_lo") - least).withColumn("_hi", F.col("_hi") - least)
    best = (spans.withColumn("_cell", F.explode(_aligned_cells(bits)))
            .groupBy(*keys, "_cell").agg(F.min("_iv").alias("_iv")))
    inside = points.select(*keys, (F.col(point).cast("bigint") - least).alias("_p")).distinct().filter(F.col("_p").between(0, 1 << bits))
    probes = inside.withColumn(
        "_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.struct(
            k.alias("k"), _cell_of(F.col("_p"), k).alias("n")))))
    chosen = probes.join(best, [*keys, "_cell"]).groupBy(*keys, "_p").agg(F.min("_iv").alias("_iv"))
    joined = points.withColumn("_p", F.col(point).cast("bigint") - least).join(chosen, [*keys, "_p"], "left")
    return joined.select(*points.columns, (-F.col("_iv.s")).alias(start), F.col("_iv.e").alias(end),
                         *[F.col(f"_iv.{p}").alias(p) for p in pick])


def _cell_of(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("bigint")


def _aligned_cells(bits: int) -> Column:
    """Cells inside [_lo, _hi) whose double-sized parent is not inside: at most two per size."""
    lo, hi = F.col("_lo"), F.col("_hi")

    def size_of(level):
        return F.pow(F.lit(2.0), level).cast("bigint")

    def keep(level, n):
        parent = F.floor(n / 2).cast("bigint") * size_of(level + 1)
        inside = (parent >= lo) & (parent + size_of(level + 1) <= hi)
        return F.when(~inside, n)

    def at(level):
        first = F.ceil(lo / size_of(level)).cast("bigint")
        last = F.floor(hi / size_of(level)).cast("bigint") - 1
        cells = F.when(first <= last, F.array_distinct(F.array(keep(level, first), keep(level, last))))
        return F.filter(F.coalesce(cells, F.array().cast("array<bigint>")), lambda n: n.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.transform(
        at(k), lambda n: F.struct(k.alias("k"), n.alias("n")))))


def answering_to(symbols: DataFrame, wanted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Symbols with each wanted written name they answer to (exact, leaf, or dotted suffix).

    `wanted(*keys, name)` is made distinct.  Symbols are cut to those with a wanted leaf, then their
    suffixes are matched by equality: names that share a common leaf are never paired with every
    symbol of that leaf."""
    names = wanted.select(*keys, name).distinct()
    leafs = names.select(*keys, P.leaf(F.col(name)).alias("name")).distinct()
    near = lookup(symbols, leafs, [*keys, "name"], "inner")
    rows = near.withColumn(name, F.explode(P.dotted_suffixes(F.col("qualified_name"))))
    return lookup(rows, names, [*keys, name], "inner", settle=True)

