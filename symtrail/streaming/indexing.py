"""Keeping the graph current from a stream of saves and moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from symtrail.engine import CodeGraph
from symtrail.functions import text as X
from symtrail.operators.maintenance import collapse_chains
from symtrail.session import cut
from symtrail.sources.snapshots import folder_of
from symtrail.streaming import quiet

#: A row with `old_path` is a move of that file to `rel_path`; all others are saves.
SAVES = "repo_id string, rel_path string, content binary, ts timestamp, seq bigint, old_path string"


def last_writes(saves: DataFrame) -> DataFrame:
    """The last content of each path (greatest `ts`, then `seq`), with its kind of change.

    A save without content is a removal."""
    last = saves.groupBy("repo_id", "rel_path").agg(F.max_by("content", F.struct("ts", "seq")).alias("content"))
    return last.withColumn("removed", F.col("content").isNull())


def write_batch(engine: CodeGraph, saves: DataFrame, moves: DataFrame | None = None, tree: DataFrame | None = None):
    """One micro-batch into one snapshot; replaying it converges, because it is keyed and stamped."""
    last = cut(last_writes(saves))
    collapsed = None
    if moves is not None and not moves.isEmpty():
        collapsed = cut(collapse_chains(moves))
        gone = collapsed.select("repo_id", F.col("old_path").alias("rel_path"))
        last = cut(last.join(gone, ["repo_id", "rel_path"], "left_anti"))    # or the old path would come back
    live = last.filter("not removed").select("repo_id", "rel_path", "content")
    return engine.write(live, last.filter("removed").select("repo_id", "rel_path"), collapsed, tree=tree)


def apply(engine: CodeGraph, batch: DataFrame, tree=None) -> None:
    """The saves and moves of one batch (rows of SAVES), as one write."""
    if batch.isEmpty():
        return
    moves = batch.filter("old_path is not null").select("repo_id", "seq", "old_path", F.col("rel_path").alias("new_path"))
    written = batch.filter("old_path is null or content is not null")
    write_batch(engine, written, moves, tree=tree() if callable(tree) else tree)


def start(engine: CodeGraph, saves: DataFrame, checkpoint: str, interval: str | None = "2 seconds", tree=None):
    """Index a stream of saves.  Micro-batches are the quiet-period batches: they run one at a time,
    a failed one is retried from the checkpoint, and nothing is dropped.  Moves come in the same stream;
    what a moved file holds is saved in the batch or read from `tree`."""
    def run(batch: DataFrame, _batch_id: int) -> None:
        apply(engine, batch, tree)

    writer = saves.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def as_saves(changes: DataFrame) -> DataFrame:
    """Changes of `sources.stats.changes` as rows of SAVES: a removal has no content, later times count."""
    at = F.coalesce(F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)), F.current_timestamp())
    return changes.select("repo_id", "rel_path", "content", at.alias("ts"), F.unix_micros(at).alias("seq"), F.lit(None).cast("string").alias("old_path"))


def watch(engine: CodeGraph, changes: DataFrame, checkpoint: str, interval: str | None = "1 second", tree=None):
    """Index a stream of changes of a tree.  Files that were touched but hold what the graph holds are left alone."""
    def run(batch: DataFrame, _batch_id: int) -> None:
        held = engine.store.read().files.select("repo_id", "rel_path", F.col("content_hash").alias("hash"))
        rows = batch.withColumn("hash", X.content_hash(X.text_of(F.col("content")))).join(held, ["repo_id", "rel_path", "hash"], "left_anti")
        apply(engine, cut(as_saves(rows.drop("hash"))), tree)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


# -- quiet periods ---------------------------------------------------------------------------------------

#: Between the path and the number of a move, of which none replaces another.
_MOVE = "\u0000"


def _slot():
    return F.when(F.col("old_path").isNull(), F.col("rel_path")).otherwise(F.concat("rel_path", F.lit(_MOVE), "seq"))


@dataclass
class QuietIndexing:
    """Two streams: saves into the inbox, and flushes of quiet repositories out of it."""

    engine: CodeGraph
    root: str
    tree: object
    arrivals: StreamingQuery
    flushes: StreamingQuery

    def awaitTermination(self) -> None:
        self.arrivals.awaitTermination()
        self.flushes.awaitTermination()

    def stop(self) -> None:
        self.arrivals.stop()
        self.flushes.stop()

    def settle(self) -> None:
        """Write what is still armed, once the streams have stopped."""
        spark = self.engine.spark
        _flush(self.engine, quiet.armed(spark, f"{self.root}/quiet", ["repo_id"], "seq"), f"{self.root}/inbox", self.tree)


def _flush(engine: CodeGraph, flushed: DataFrame, inbox: str, tree) -> None:
    named = cut(flushed.select("repo_id", F.substring_index("slot", _MOVE, 1).alias("rel_path"), "seq"))
    low, high = named.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return
    near = engine.spark.read.schema(SAVES).parquet(inbox).filter(F.col("seq").between(low, high))      # numbers grow, so other files are skipped
    apply(engine, cut(near.join(named, ["repo_id", "rel_path", "seq"], "left_semi")), tree)


def start_quiet(engine: CodeGraph, saves: DataFrame, root: str, quiet_seconds: float = 2.0, late: str | None = None,
                interval: str | None = "1 second", tree=None) -> QuietIndexing:
    """Index a stream of saves, a repository when nothing was saved in it for `quiet_seconds`.

    Saves are written to an inbox first; the keyed state holds paths and numbers only, and a flush reads from
    the inbox what counts: of the saves of a path the last one, and every move.  `seq` tells the saves of a
    path apart.  With `late` time is that of `ts`, else that of arrival.  A failed flush is tried again from
    the checkpoint, and writing it twice converges.  Without `interval` the streams end when all is read."""
    spark = engine.spark
    inbox = f"{root}/inbox"
    fs, path = folder_of(spark, inbox)
    fs.mkdirs(path)

    def trigger(writer):
        return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)

    arrivals = trigger(saves.writeStream.format("parquet").option("path", inbox).option("checkpointLocation", f"{root}/arrivals")).start()
    if not interval:
        arrivals.awaitTermination()
    events = spark.readStream.schema(SAVES).parquet(inbox)
    out = quiet.flushes(events, ["repo_id"], _slot(), "ts", "seq", quiet_seconds, late)
    with quiet.rocksdb(spark):
        flushed = trigger(out.writeStream.foreachBatch(lambda batch, _id: _flush(engine, batch, inbox, tree)).option("checkpointLocation", f"{root}/quiet")).start()
    return QuietIndexing(engine, root, tree, arrivals, flushed)
