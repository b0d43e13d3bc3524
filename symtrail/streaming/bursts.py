"""Quiet-period batching as a structured stream: session windows with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from symtrail.session import shared_dir, table_schema


def bursts(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """One row per closed burst: key, first event, number of events, greatest event id, last event.

    Works on streaming and static inputs; state per key is one open session."""
    return (events.withWatermark(ts, late)
            .groupBy(F.session_window(ts, gap).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("writes"), F.max("event_id").alias("last_event"), F.max(ts).alias("last_ts"))
            .select(key, F.col("w.start").alias("flush_start"), "writes", "last_event", "last_ts"))


def open_bursts(events: DataFrame, key: str, ts: str, gap: str, late: str, watermark) -> DataFrame:
    """Bursts of a static input that `watermark` has not closed.

    Only keys with an event that late are grouped.  Bursts are told apart by their last event, which is an
    aggregate: a filter on the window would be pushed below its merge and cut the first events of a burst off."""
    late_enough = F.col(ts) + F.expr(f"interval {gap}") > watermark
    keys = events.filter(late_enough).select(key).distinct()
    mine = bursts(events.join(keys, key, "left_semi"), key, ts, gap, late)
    return mine.filter(F.col("last_ts") + F.expr(f"interval {gap}") > watermark)


def run_once(spark: SparkSession, path: str, key: str, ts: str, gap: str, late: str,
             max_files: int | None = None) -> DataFrame:
    """Drain a file stream with `availableNow` into a table of the shared folder and read it back.

    The stream tells the bursts that its last watermark closed; the others, of the last gap, are open
    when the input ends and are taken from the files."""
    base = f"{shared_dir(spark)}/symtrail-streams/{uuid.uuid4().hex}"
    reader = spark.readStream.schema(table_schema(spark, path))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rpartition("/")
    events = reader.option("pathGlobFilter", name).parquet(folder)
    kind = events.schema[ts].dataType           # windows need zoned time; the result gets the type back
    zoned = lambda df: df.withColumn(ts, F.col(ts).cast("timestamp"))
    out = bursts(zoned(events), key, ts, gap, late)
    stream = (out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
              .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    stream.awaitTermination()
    last = stream.lastProgress
    reached = (last["eventTime"] if last else {}).get("watermark") or "1970-01-01T00:00:00.000Z"
    still_open = open_bursts(zoned(spark.read.parquet(path)), key, ts, gap, late, F.lit(reached).cast("timestamp"))
    told = spark.read.schema(out.schema).parquet(f"{base}/out")
    return told.unionByName(still_open).drop("last_ts").withColumn("flush_start", F.col("flush_start").cast(kind))
