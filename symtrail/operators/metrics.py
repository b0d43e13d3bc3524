"""Evaluation: recall, reciprocal rank, set precision, nearest-rank percentiles, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from symtrail import constants as K
from symtrail.functions.text import NUL
from symtrail.operators.keyed import range_buckets, running_sums
from symtrail.session import cut, small


def first_hits(questions: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """`question_id, class, scoreable, first_hit`: rank of the first gold row, null for a miss."""
    scoreable = gold.select("question_id").distinct().withColumn("scoreable", F.lit(True))
    hits = ranked.join(gold.select("question_id", "uid").distinct(), ["question_id", "uid"], "left_semi")\
        .groupBy("question_id").agg(F.min("rank").alias("first_hit"))
    return questions.select("question_id", "class").join(scoreable, "question_id", "left").join(hits, "question_id", "left")\
        .withColumn("scoreable", F.coalesce("scoreable", F.lit(False)))


def recall_and_mrr(hits: DataFrame, k: int = 10, by: str | None = None) -> DataFrame:
    """recall@k, MRR, resolution and misses over scoreable questions; 0.0 when there are none."""
    one = F.col("scoreable")
    found = F.coalesce(F.col("first_hit") <= k, F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return hits.groupBy(*([by] if by else [])).agg(
        F.count_if(one).alias("scoreable"), F.count_if(one & ~found).alias("misses"),
        zero(F.avg(F.when(one, found.cast("double")))).alias("recall"),
        zero(F.avg(F.when(one, F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))))).alias("mrr"),
        zero(F.try_divide(F.lit(100.0), F.count_if(one))).alias("resolution_pp"))


def set_scores(expected: DataFrame, returned: DataFrame, by: list[str]) -> DataFrame:
    """Micro precision and recall of two sets of rows keyed by `by`; null on an empty denominator."""
    both = expected.select(*by).distinct().withColumn("_e", F.lit(1)).join(
        returned.select(*by).distinct().withColumn("_r", F.lit(1)), by, "full_outer")
    hits = F.count_if(F.col("_e").isNotNull() & F.col("_r").isNotNull())
    return both.agg(hits.alias("hits"), F.count("_e").alias("expected"), F.count("_r").alias("returned"),
                    F.try_divide(hits, F.count("_r")).alias("precision"), F.try_divide(hits, F.count("_e")).alias("recall"))


def caller_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, precision over all, and recall of `(function, caller)` sets.

    A function without gold callers counts only in precision over all, as unconfirmed."""
    key = ["function", "caller"]
    both = gold.select(*key).distinct().withColumn("_g", F.lit(1)).join(
        found.select(*key).distinct().withColumn("_f", F.lit(1)), key, "full_outer")
    with_gold = gold.select("function").distinct().withColumn("_has", F.lit(True))
    rows = both.join(with_gold, "function", "left")
    hits = F.count_if(F.col("_g").isNotNull() & F.col("_f").isNotNull())
    scored_found = F.count_if(F.col("_f").isNotNull() & F.col("_has"))
    return rows.agg(hits.alias("hits"), F.count("_g").alias("gold"), scored_found.alias("found"),
                    F.count("_f").alias("found_all"), F.try_divide(hits, scored_found).alias("precision"),
                    F.try_divide(hits, F.count("_f")).alias("precision_all"), F.try_divide(hits, F.count("_g")).alias("recall"))


# -- percentiles ---------------------------------------------------------------------------------

def nearest_rank_index(fraction: Column, n: Column) -> Column:
    """0-based index; `bround` rounds half to even."""
    return F.greatest(F.lit(0), F.least(n - 1, F.bround(fraction * n + 0.5).cast("bigint") - 1))


def scaled_index(fraction: Column, n: Column) -> Column:
    return F.least(n - 1, F.bround(fraction * (n - 1)).cast("bigint"))


def percentiles(df: DataFrame, keys: list[str], value: str, fractions: list[float], index=nearest_rank_index) -> DataFrame:
    """Exact percentiles per key: `keys, fraction, value`.

    Equal values are counted first; distinct values are cut into range buckets, bucket counts are
    carried, and only the bucket that holds the wanted rank contributes a row.  No key's values ever
    meet in one task."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = range_buckets(counts, *keys, "_v")
    upto = running_sums(ranged, keys, F.col("bucket"), [F.col("_v")], {"_cum": "_c"})
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    wanted = sizes.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions]))).withColumn(
        "_k", index(F.col("fraction"), F.col("_n")) + 1)
    joined = upto.join(wanted, keys) if keys else upto.join(F.broadcast(wanted))
    return joined.filter((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))\
        .select(*keys, "fraction", F.col("_v").alias(value))


#: Bins of a histogram per doubling of the value, and per range that is looked at again.
PER_DOUBLING, BINS = 8, 256

#: A range with at most this many rows is settled by counting its values.
FEW = 65_536


def _magnitude(v: Column) -> Column:
    """A bin that grows with the value over all numbers: by sign, then by size in eighths of a doubling."""
    size = F.floor(F.greatest(F.least(F.log2(F.abs(v)) * PER_DOUBLING, F.lit(15_000.0)), F.lit(-15_000.0))).cast("int") + 20_000
    return F.when(F.isnan(v), 50_000).when(v == 0, 0).when(v > 0, size).otherwise(-size)


def rank_values(df: DataFrame, keys: list[str], value: str, fractions: list[float], index=nearest_rank_index, few: int = FEW) -> DataFrame:
    """As `percentiles`, without sorting or counting all values: `keys, fraction, value`.

    A histogram of all values, by their magnitude, is merged from those of the tasks.  Only the bin that holds
    the wanted rank is looked at again, with bins between its own least and greatest value, until it is one
    value or holds few rows, whose values are counted.  A round is one pass and sends a row per task and bin.
    Nulls are left out; NaN counts as the greatest; without values there is no row."""
    v = F.col("_v")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(v.isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("_k", index(F.col("fraction"), F.col("_n")) + 1)
    bins = rows.groupBy(*keys, _magnitude(v).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    each = [F.col(k).eqNullSafe(F.col(f"_w.{k}")) for k in keys]
    every = F.lit(True)
    for one in each:
        every = every & one

    def chosen(counted: DataFrame, sought: DataFrame, by: list[str]) -> DataFrame:
        """The bin of each wanted rank, and the rank within it."""
        upto = W.partitionBy(*(by or [F.lit(0)])).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
        cum = counted.withColumn("_cum", F.sum("_c").over(upto))
        w = sought.select(F.struct(*sought.columns).alias("_w"))
        same = every if "fraction" not in by else every & (F.col("fraction") == F.col("_w.fraction"))
        hit = cum.join(F.broadcast(w) if small(sought) else w, same & (F.col("_cum") >= F.col("_w._k")) & (F.col("_cum") - F.col("_c") < F.col("_w._k")))
        return hit.select(*[F.col(f"_w.{k}").alias(k) for k in keys], F.col("_w.fraction").alias("fraction"),
                          (F.col("_w._k") - F.col("_cum") + F.col("_c")).alias("_k"), F.col("_c").alias("_n"), "_lo", "_hi")

    state = cut(chosen(bins, cut(wanted.drop("_n")), keys))
    done = []
    while True:
        done.append(state.filter("_lo = _hi").select(*keys, "fraction", F.col("_lo").alias(value)))
        rest = state.filter("_lo <> _hi")
        if rest.isEmpty():
            break
        w = rest.select(F.struct(*rest.columns).alias("_w"))
        active = rows.join(F.broadcast(w) if small(rest) else w, every & v.between(F.col("_w._lo"), F.col("_w._hi")))
        width = F.col("_w._hi") / BINS - F.col("_w._lo") / BINS
        part = F.least(F.floor((v - F.col("_w._lo")) / width), F.lit(BINS - 1)).cast("double")
        place = F.when((F.col("_w._n") <= few) | (width <= 0), v).otherwise(part)
        again = active.select(*keys, F.col("_w.fraction").alias("fraction"), place.alias("_bin"), "_v").groupBy(*keys, "fraction", "_bin").agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        state = cut(chosen(again, rest.select(*keys, "fraction", "_k"), [*keys, "fraction"]))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn(value, F.col(value).cast(df.schema[value].dataType))


# -- samples ---------------------------------------------------------------------------------------

#: Hex digits of a hash that a histogram tells apart at once.
DIGITS = 3


def seeded_sample(df: DataFrame, n: int, key: list[Column], seed: int = 0, strata: list[str] | None = None) -> DataFrame:
    """The `n` rows with the least hash of `seed` and `key` (of each of the `strata`), all columns.

    Hashes are counted by their first digits; only the digits in which the n-th falls are looked at with more
    digits, so no task sorts the rows or takes n from every other.  Rows of equal `key` are chosen alike: with
    repeated keys a stratum may hold more than `n` rows, by the repeats of its last key.  The choice
    depends on seed and keys alone, not on order, partitions or other rows' contents."""
    by = strata or []
    digest = F.sha1(F.concat_ws(NUL, F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key]).cast("binary"))
    keyed = df.withColumn("_hash", digest)
    same = F.lit(True)
    for s in by:
        same = same & F.col(s).eqNullSafe(F.col(f"_t.{s}"))
    # Thresholds: (strata, prefix, left) - hashes below the prefix are in, `left` more come from it.
    hashes = keyed.select(*by, "_hash")
    limits = None
    for depth in range(DIGITS, 40 + DIGITS, DIGITS):
        rows = hashes
        if limits is not None:
            t = limits.filter("_open").select(F.struct(*by, "_prefix", "_left").alias("_t"))
            if t.isEmpty():
                break
            rows = hashes.join(F.broadcast(t) if small(t) else t, same & (F.substring("_hash", 1, depth - DIGITS) == F.col("_t._prefix")))
            left = F.col("_t._left")
        else:
            left = F.lit(n)
        counted = rows.groupBy(*by, F.substring("_hash", 1, depth).alias("_prefix")).agg(F.count(F.lit(1)).alias("_c"), F.first(left).alias("_want"))
        upto = W.partitionBy(*(by or [F.lit(0)])).orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0)
        cum = counted.withColumn("_cum", F.sum("_c").over(upto))
        at = cum.filter((F.col("_cum") >= F.col("_want")) & (F.col("_cum") - F.col("_c") < F.col("_want")))
        left_in = F.col("_want") - F.col("_cum") + F.col("_c")
        found = at.select(*by, "_prefix", left_in.alias("_left"), (F.col("_c") > left_in).alias("_open"))
        closed = found if limits is None else found.unionByName(limits.filter("not _open"))
        limits = cut(closed)
    t = limits.select(F.struct(*by, "_prefix").alias("_t"))
    within = F.substring("_hash", 1, F.length("_t._prefix")) <= F.col("_t._prefix")
    out = keyed.join(F.broadcast(t) if small(t) else t, same, "left").filter(F.col("_t").isNull() | within)
    return out.drop("_hash", "_t")


# -- gates -----------------------------------------------------------------------------------------

def gates(measures: DataFrame) -> DataFrame:
    """Every gate with `value` from `measures(name, value)` and its status."""
    table = measures.sparkSession.createDataFrame(
        [(i, *g) for i, g in enumerate(K.GATES, 1)], "position int, name string, threshold double, direction string")
    met = F.when(F.col("direction") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    status = F.when(F.col("value").isNull(), "NOT MEASURED").when(met, "PASS").otherwise("FAIL")
    return table.join(F.broadcast(measures), "name", "left").withColumn("status", status)


def decisions(counters: DataFrame) -> DataFrame:
    """Decision metrics as ratios of two counters; a zero denominator is unknown, not zero."""
    table = counters.sparkSession.createDataFrame(
        list(K.DECISIONS), "name string, top string, bottom string, threshold double, direction string")
    summed = counters.groupBy(F.col("counter")).agg(F.sum("n").alias("n"))
    out = table.join(F.broadcast(summed.toDF("top", "_t")), "top", "left").join(
        F.broadcast(summed.toDF("bottom", "_b")), "bottom", "left")
    value = F.try_divide(F.coalesce("_t", F.lit(0)), F.coalesce("_b", F.lit(0)))
    fires = F.when(F.col("direction") == "<", value < F.col("threshold")).otherwise(value > F.col("threshold"))
    return out.select("name", value.alias("value"), "threshold", "direction", fires.alias("fires"))


def answer_cost(tokens_in: Column, tokens_out: Column, packed: Column) -> Column:
    used = F.coalesce(tokens_in, packed)
    return (used * K.LLM_INPUT_RATE + F.coalesce(tokens_out, F.lit(0)) * K.LLM_OUTPUT_RATE) / 1e6
