"""Mixing sources to target weights with hash-threshold histograms.

Targets are a water level over one row per source.  What a source takes beyond whole repeats is the
set of its documents whose hash lies below a threshold.  The threshold is found by summing words by
(source, hash bucket), taking whole buckets while the budget lasts, and splitting only the bucket in
which it ends, level by level.  Documents are then filtered by one comparison; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from symtrail.session import cut

#: Hash digits (of four bits) of one histogram level, and the number of levels.
LEVEL_DIGITS, LEVELS = 3, 4

WHITE_SPACE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes other than space and 0x09-0x0D; null counts 0."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE[1:], " " * 5)
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def hash_digits(key: Column) -> Column:
    """The first 48 bits of a key's MD5 in hexadecimal; null counts as the empty string."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, LEVEL_DIGITS * LEVELS)


def targets(sizes: DataFrame, ratio: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, target) of `sizes` (source, source_size), one row per source.

    Sources by code point, null last, weigh `weights` in turn and share `ratio` of all sizes; no target
    exceeds `cap` times its source, and the excess goes to the others by weight.  All targets are then
    min(cap * size, level * weight) for one level, found with running sums over sources by cap / weight."""
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    at_most = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("place"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
             / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    return (
        sizes.withColumn("place", place)
        .withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("full", at_most)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(ratio)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))).over(everything))
        .select("source", "source_size", F.least(F.col("full"), F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))
    )


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, source_size, target, repeats, below, whole): take `repeats` of every document, and one
    more of those whose digits are below `below`; `whole`: also of those equal to it.

    `sized` has (source, size, digits); the boundary bucket of a level is the next level's only input."""
    state = wanted.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("repeats"),
    ).withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size")).withColumn("below", F.lit(""))
    for k in range(LEVELS):
        state = cut(state)          # a row per source, read three times by its level
        last = k == LEVELS - 1
        inside = sized.alias("d").join(
            state.select(F.col("source").alias("s"), F.col("below").alias("prefix")),
            F.col("d.source").eqNullSafe(F.col("s")) & (F.substring("d.digits", 1, k * LEVEL_DIGITS) == F.col("prefix")))
        sums = inside.groupBy(F.col("d.source").alias("source"), F.substring("d.digits", k * LEVEL_DIGITS + 1, LEVEL_DIGITS).alias("bucket")).agg(F.sum("d.size").alias("words"))
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = sums.withColumn("until", F.sum("words").over(order)).alias("b").join(
            state.select(F.col("source").alias("s"), F.col("left").alias("budget")), F.col("b.source").eqNullSafe(F.col("s")))
        ends = (
            running.filter(F.col("until") > F.col("budget"))
            .groupBy(F.col("b.source").alias("e"))
            .agg(F.min_by(F.struct("bucket", (F.col("budget") - F.col("until") + F.col("words")).alias("left"), "words"), F.col("bucket")).alias("end"))
        )
        # only a source without words has no such bucket
        state = state.alias("t").join(ends, F.col("t.source").eqNullSafe(F.col("e")), "left").select(
            "t.source", "t.source_size", "t.target", "t.repeats",
            F.coalesce(F.col("end.left"), F.col("t.left")).alias("left"),
            F.coalesce(F.concat("t.below", "end.bucket"), F.col("t.below")).alias("below"),
            *([(F.col("end.left") * 2 >= F.col("end.words")).alias("whole")] if last else []),
        )
    return state.withColumn("whole", F.coalesce("whole", F.lit(False)))


def _planned(docs: DataFrame, ratio: float, cap: float, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Sizes and hash digits of all documents, and the thresholds of all sources."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_digits(F.col("doc_id")).alias("digits")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, cut(thresholds(sized, targets(sizes, ratio, cap, weights)))


def _times(digits: Column, repeats: Column, below: Column, whole: Column) -> Column:
    more = (digits < below) | (whole & (digits == below))
    return repeats + more.cast("long")


def mix(docs: DataFrame, ratio: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of `docs` (doc_id, text, source).

    Documents are chosen by the hash of their id: equal ids are chosen alike, a null id hashes as the
    empty string, a null text has size 0 and takes 0, a null source is a source of its own.  The document
    in which a budget ends is taken when at least half of it fits, so a source misses its target by half
    of one document (or one group of equal ids) at most.  An empty table gives no rows; other columns
    are not read."""
    sized, chosen = _planned(docs, ratio, cap, weights)
    times = _times(F.col("digits"), F.col("repeats"), F.col("below"), F.col("whole"))
    return (
        sized.alias("d").join(chosen.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))
    )


def repeated(docs: DataFrame, ratio: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """The mix itself: every row of `docs`, all columns, as often as it is taken (0 to `cap` times).

    A document without words counts for no budget and stays once.  Rows are repeated where they are read;
    only the thresholds, a row per source, are joined."""
    _, chosen = _planned(docs, ratio, cap, weights)
    plan = F.col("symtrail mix")
    rows = docs.join(chosen.select(F.struct("source", "repeats", "below", "whole").alias("symtrail mix")), docs["source"].eqNullSafe(plan["source"]))
    times = F.when(word_count(docs["text"]) > 0, _times(hash_digits(docs["doc_id"]), plan["repeats"], plan["below"], plan["whole"])).otherwise(1)
    copies = F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("symtrail copy")
    return rows.select(*[docs[f"`{c}`"] for c in docs.columns], copies).drop("symtrail copy")


SQL = r"""
with sized as (
  select doc_id, source, case when text is null then 0 else
         len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) end::bigint size,
         left(md5(coalesce(doc_id::varchar, '')), 12) digits from documents),
sources as (select source, sum(size)::bigint source_size from sized group by 1),
placed as (select *, row_number() over (order by source is null, source) - 1 place from sources),
weighed as (select *, [3.0, 1.0, 2.0][(place % 3 + 1)::int]::double weight, source_size * 2.0::double as full_size from placed),
levels as (
  select *, ((sum(source_size) over () * 1.5)::double - coalesce(sum(full_size) over w, 0))
         / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as lvl
  from weighed window w as (order by full_size / weight, place rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, least(full_size, coalesce(max(case when lvl * weight <= full_size then lvl end) over () * weight, full_size)) target
  from levels),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end repeats from targets),
sums as (select source, digits, sum(size)::bigint words from sized group by all),
running as (select *, sum(words) over (partition by source order by digits) until from sums),
chosen as (
  select r.source, r.digits,
         until <= target - repeats * source_size
         or (until - words <= target - repeats * source_size and (target - repeats * source_size - until + words) * 2 >= words) as one_more
  from running r join budgets b on r.source is not distinct from b.source)
select d.doc_id, d.size, b.source_size, b.target, (d.size * (b.repeats + c.one_more::int))::bigint taken
from sized d join budgets b on d.source is not distinct from b.source
join chosen c on d.source is not distinct from c.source and d.digits = c.digits
"""
