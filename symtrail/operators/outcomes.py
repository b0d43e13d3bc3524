"""What became of each question, rolled up by class and language in one pass, and gates parted by status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from symtrail.functions.paths import is_library
from symtrail.operators import metrics as ME

#: Counts of an outcome that reports add up.
COUNTS = ("claims", "cited", "relations", "relations_verified", "conflicts", "unknown_citations", "unsupported", "frames_total", "frames_resolved")


def question_outcomes(questions: DataFrame, packed: DataFrame, gold: DataFrame | None = None, report: DataFrame | None = None,
                      frames: DataFrame | None = None, errors: DataFrame | None = None, unsupported: DataFrame | None = None,
                      costs: DataFrame | None = None) -> DataFrame:
    """One row per question (question_id, class, language): what it was given and how its answer did.

    `packed` has the blocks (question_id, uid, handle, rank, cost), those without a handle were dropped;
    `gold` (question_id, uid); `report` is `grounding.report` with question_id; `frames` (question_id,
    language, file_path, tier) of traces; `errors` and `unsupported` one row per case; `costs` (question_id,
    usd, ttft, retried).  `gold_rank` is the first packed gold block, null for a miss.  A question without
    a report was not answered and counts in no ratio.  Of its frames those in Python or in a library are
    not the repository's TypeScript frames and are not counted."""
    held = packed.filter("handle is not null")
    per = [held.groupBy("question_id").agg(F.sum("cost").cast("bigint").alias("packed_tokens"))]
    if gold is not None:
        per.append(held.join(gold.select("question_id", "uid").distinct(), ["question_id", "uid"], "left_semi").groupBy("question_id").agg(F.min("rank").cast("bigint").alias("gold_rank")))
    if report is not None:
        per.append(report.select("question_id", "claims", "cited", "relations", F.col("verified").alias("relations_verified"), "conflicts", "coverage", F.lit(True).alias("answered")))
    if frames is not None:
        own = frames.filter((F.col("language") != "python") & ~is_library(F.col("file_path")))
        per.append(own.groupBy("question_id").agg(F.count(F.lit(1)).alias("frames_total"), F.count_if(F.col("tier").isin("direct", "name")).alias("frames_resolved")))
    for df, name in ((errors, "unknown_citations"), (unsupported, "unsupported")):
        if df is not None:
            per.append(df.groupBy("question_id").agg(F.count(F.lit(1)).alias(name)))
    if costs is not None:
        per.append(costs.select("question_id", "usd", "ttft", "retried"))
    out = questions.select("question_id", "class", "language")
    for part in per:
        out = out.join(part, "question_id", "left")
    missing = {"gold_rank": "bigint", "coverage": "double", "usd": "double", "ttft": "double"}
    for name, kind in missing.items():
        out = out if name in out.columns else out.withColumn(name, F.lit(None).cast(kind))
    for name in ("packed_tokens", *COUNTS):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint") if name in out.columns else F.lit(0).cast("bigint"))
    for name in ("answered", "retried"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(False)) if name in out.columns else F.lit(False))
    from symtrail import constants as K
    return out.withColumn("needs_review", F.col("retried") & ((F.coalesce("coverage", F.lit(1.0)) < K.COVERAGE_RETRY_THRESHOLD) | (F.col("conflicts") > 0)))


def rollup(outcomes: DataFrame, k: int = 10) -> DataFrame:
    """Totals and ratios of outcomes by (class, language), by class, by language and over all.

    All levels come from one pass over the outcomes; `level` tells them apart, as a class may be null itself.
    Ratios are pooled over what was answered and null on an empty denominator."""
    answered = F.col("answered")
    total = lambda c: F.sum(F.when(answered, F.col(c)).otherwise(0))
    frames = F.col("language") == "typescript"
    sums = [F.count(F.lit(1)).alias("questions"), F.count_if(answered).alias("answered"), F.count_if(F.col("gold_rank") <= k).alias("gold_packed"),
            F.count_if("retried").alias("retried"), F.count_if("needs_review").alias("needs_review"),
            *[total(c).alias(c) for c in COUNTS if not c.startswith("frames")],
            F.sum(F.when(frames, F.col("frames_total")).otherwise(0)).alias("frames_total"), F.sum(F.when(frames, F.col("frames_resolved")).otherwise(0)).alias("frames_resolved")]
    sets = [[F.col("class"), F.col("language")], [F.col("class")], [F.col("language")], []]
    rolled = outcomes.groupingSets(sets, "class", "language").agg(F.grouping_id().alias("_set"), *sums)
    level = F.element_at(F.array(*[F.lit(x) for x in ("class, language", "class", "language", "all")]), F.col("_set").cast("int") + 1)
    return rolled.select(
        level.alias("level"), "class", "language", "questions", "answered", "gold_packed", "retried", "needs_review", *COUNTS,
        F.try_divide("gold_packed", "questions").alias("gold_rate"), F.try_divide("cited", "claims").alias("coverage"),
        F.try_divide("relations_verified", "relations").alias("relation_precision"), F.try_divide("frames_resolved", "frames_total").alias("frame_resolution"))


def measures(outcomes: DataFrame) -> DataFrame:
    """`name, value` of the gates that outcomes decide: pooled coverage, relation precision, and the percentiles
    of time to first token and cost over answered questions.  What was not measured has a null value."""
    whole = rollup(outcomes).filter("level = 'all'")
    ratios = whole.select(F.explode(F.create_map(
        F.lit("Citation Coverage"), F.col("coverage"), F.lit("Relation Precision"), F.col("relation_precision"))).alias("name", "value"))
    done = outcomes.filter("answered")
    out = ratios
    for column, title in (("ttft", "TTFT p{}"), ("usd", "$/query p{} (uncached)")):
        found = ME.rank_values(done, [], column, [0.5, 0.95])
        name = F.when(F.col("fraction") == 0.5, title.format(50)).otherwise(title.format(95))
        out = out.unionByName(found.select(name.alias("name"), F.col(column).cast("double").alias("value")))
    return out


def gate_partitions(gates: DataFrame) -> DataFrame:
    """`status, n, names` of `metrics.gates`: passing, failing and not measured, each gate in its place's order.

    A status without gates has a row too, so that none reads as unknown."""
    statuses = gates.sparkSession.createDataFrame([("PASS",), ("FAIL",), ("NOT MEASURED",)], "status string")
    listed = gates.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("position", "name"))).alias("g"))
    return statuses.join(F.broadcast(listed), "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.array_join(F.transform("g", lambda g: g["name"]), "; ").alias("names")).na.fill("", ["names"])
