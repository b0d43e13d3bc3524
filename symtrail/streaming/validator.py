"""Answers that arrive in chunks: sentences get their verdict as soon as they close.

Each micro-batch is one DataFrame job.  An answer's state is a row with its open text: the last two
sentences, as handles that still arrive can only join the sentence before them.  New chunks are put behind the
open text, which is cut with the batch pattern, and a sentence is told when its text differs from what was told
under its number.  So an amendment is a second version of a sentence, and the last versions of a finished
answer equal `operators.grounding.sentences` on the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from symtrail.functions import answers as A
from symtrail.functions.text import strip
from symtrail.operators import grounding as GR
from symtrail.sources.snapshots import folder_of

CHUNK = "chunk_no bigint, chunk string, final boolean"
STATE = f"answer_id string, before bigint, text string, told array<string>, next_chunk bigint, held array<struct<{CHUNK.replace(' bigint', ':bigint').replace(' string', ':string').replace(' boolean', ':boolean')}>>, seen timestamp"
EVENTS = "answer_id string, sentence_no bigint, version bigint, text string, amends boolean"

#: Sentences that stay open: the last, and the one before it, which late handles may amend.
OPEN_SENTENCES = 2


def advance(state: DataFrame, chunks: DataFrame, version: int, timeout: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, next state) after one batch of `answer_id, chunk_no, chunk, final`.

    Chunks may come late, in any order and twice; they are read in order of their number.  An answer that
    got no chunk for `timeout` (an interval) ends where it is."""
    arrived = chunks.groupBy("answer_id").agg(F.collect_set(F.struct("chunk_no", "chunk", "final")).alias("new"))
    none = F.array().cast(f"array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>")
    both = state.join(arrived, "answer_id", "full_outer")
    start = F.coalesce("next_chunk", F.lit(0).cast("bigint"))
    waiting = F.array_sort(F.array_distinct(F.concat(F.coalesce("held", none), F.coalesce("new", none))))
    rows = both.select(
        "answer_id", F.coalesce("before", F.lit(0).cast("bigint")).alias("before"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("told", F.array().cast("array<string>")).alias("told"), start.alias("start"),
        F.filter(waiting, lambda c: c["chunk_no"] >= start).alias("waiting"),
        F.when(F.col("new").isNull(), F.col("seen")).otherwise(F.current_timestamp()).alias("seen"), F.col("new").isNull().alias("silent"))
    ready = F.filter("waiting", lambda c, i: c["chunk_no"] == F.col("start") + i)
    late = F.col("silent") & (F.col("seen") < F.current_timestamp() - F.expr(f"interval {timeout}")) if timeout else F.lit(False)
    rows = rows.withColumn("ready", ready).select(
        "answer_id", "before", "told", "seen", "waiting", "start", F.size("ready").alias("n_ready"),
        (F.exists("ready", lambda c: c["final"]) | late).alias("ended"),
        F.concat("text", F.array_join(F.transform("ready", lambda c: c["chunk"]), "")).alias("text"))
    rows = rows.withColumn("pieces", A.pieces(F.col("text")))
    places = F.filter(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: strip(F.get("pieces", i)) != "")
    rows = rows.withColumn("places", F.when(F.size("pieces") > 0, places).otherwise(F.array().cast("array<int>")))
    n = F.size("places")
    followed = F.coalesce(F.element_at("places", -1), F.lit(-1)) < F.size("pieces") - 1
    rows = rows.withColumn("closed", F.when(F.col("ended"), n).otherwise(F.greatest(n - 1 + followed.cast("int"), F.lit(0))))
    rows = rows.withColumn("now", F.transform("places", lambda p: strip(F.get("pieces", p))))

    changed = F.transform(F.slice("now", F.lit(1), F.col("closed")), lambda s, i: F.struct(
        (F.col("before") + i).alias("sentence_no"), s.alias("text"), F.get("told", i).isNotNull().alias("amends"),
        (~F.get("told", i).eqNullSafe(s)).alias("new")))
    events = rows.select("answer_id", F.explode(changed).alias("e")).filter("e.new").select(
        "answer_id", "e.sentence_no", F.lit(version).cast("bigint").alias("version"), "e.text", "e.amends")

    done = F.greatest(n - OPEN_SENTENCES, F.lit(0))
    kept = F.when(n > 0, F.array_join(F.slice("pieces", F.get("places", done) + 1, F.size("pieces")), "")).otherwise(F.col("text"))
    told = F.transform(F.slice("now", done + 1, F.lit(OPEN_SENTENCES)), lambda s, i: F.when(done + i < F.col("closed"), s).otherwise(F.get("told", done + i)))
    following = rows.filter("not ended").select(
        "answer_id", (F.col("before") + done).alias("before"), kept.alias("text"), told.alias("told"),
        (F.col("start") + F.col("n_ready")).alias("next_chunk"), F.slice("waiting", F.col("n_ready") + 1, F.greatest(F.size("waiting"), F.lit(1))).alias("held"), "seen")
    return events, following


def start(chunks: DataFrame, folder: str, timeout: str | None = "1 hour", interval: str | None = None):
    """Run a stream of chunks; events and state go to `folder`, a shared one.

    State and events of a batch are written under its number, so a batch that is run again after a loss
    overwrites what it wrote.  Without an interval the stream ends when its input is read."""
    spark = chunks.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        path = f"{folder}/state/batch={number - 1}"
        fs, at = folder_of(spark, path)
        state = spark.read.schema(STATE).parquet(path) if fs.exists(at) else spark.createDataFrame([], STATE)
        events, following = advance(state, batch, number, timeout)
        following.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        events.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        older, gone = folder_of(spark, f"{folder}/state/batch={number - 2}")
        older.delete(gone, True)

    writer = chunks.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def told(spark: SparkSession, folder: str) -> DataFrame:
    """All events of a stream so far."""
    return spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{folder}/events")


def settled(events: DataFrame) -> DataFrame:
    """The verdicts that stand: `answer_id, sentence_no, text` and the columns of a claim verdict."""
    last = events.groupBy("answer_id", "sentence_no").agg(F.max_by("text", "version").alias("text"))
    return GR.judged(last)


def with_badges(verdicts: DataFrame, context: DataFrame) -> DataFrame:
    """Adds `badge`: a citation of a block that is not in `context` (answer_id, handle) is unknown."""
    bad = GR.handle_errors(verdicts, context).select("answer_id", "sentence_no", F.lit(True).alias("_bad")).distinct()
    rows = verdicts.join(bad, ["answer_id", "sentence_no"], "left")
    return rows.withColumn("badge", A.badge(F.col("is_claim"), F.col("_bad").isNull(), F.col("cited"))).drop("_bad")
