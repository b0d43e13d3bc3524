"""Session helpers: a tuned builder, lineage cuts, and the size check every broadcast goes through."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only when it was counted and has at most this many rows and (estimated) bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 128 << 20


def build(app: str = "symtrail", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """The session of `spark-submit`, as it is configured there, or else a local one.

    A plain Python process has no configuration to respect; it gets all cores of this machine."""
    builder = SparkSession.builder.appName(app)
    if "PYSPARK_GATEWAY_PORT" not in os.environ and SparkSession.getActiveSession() is None:
        builder = (
            builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "16g"))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder: spark.checkpoint.dir.

    Only a local master may do without: it gets a temporary folder that goes with the process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="symtrail-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor never replays a whole loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as packed columns in the shared folder: a lineage cut for many rows of numbers, a fraction of a checkpoint's bytes."""
    path = f"{shared_dir(df.sparkSession)}/symtrail-cuts/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: dict[tuple, object] = {}


def table_schema(spark: SparkSession, path: str):
    """The schema of a parquet table, read from its footers once per session."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _written:
        _written[key] = spark.read.parquet(path).schema
    return _written[key]


def stored(spark: SparkSession, name: str, build, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """A derived table, written once per application to the shared folder and read from there.

    Later plans scan parquet (pruned columns, partitions and filters) instead of deriving it again."""
    app = spark.sparkContext.applicationId
    digest = hashlib.sha1(name.encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/symtrail-tables/{app}/{digest}"
    key = (app, path)
    if key not in _written:
        df = build()
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        _written[key] = spark.read.parquet(path).schema
    return spark.read.schema(_written[key]).parquet(path)


def spread(df: DataFrame, *keys: str, rows_per_task: int | None = None) -> DataFrame:
    """Rows of a scan with fewer splits than cores, hashed by `keys` over all cores.

    For work that is heavy per row (parsing, tokenizing).  A scan that already has a split per core
    is left alone, so on large inputs this adds no shuffle.  With `rows_per_task`, for rows that cost far
    more than their bytes tell, the rows are counted and there are as many tasks as that takes."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        tasks = max(tasks, -(-df.count() // rows_per_task))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *keys)


def row_bytes(df: DataFrame) -> int:
    """A row's estimated bytes: 16 for a number, 200 for a string, 1,000 for a list; vectors count 8,000."""
    def width(kind: str) -> int:
        if kind.startswith("array<") and kind[6:-1] in ("float", "double"):
            return 8_000
        return 1_000 if kind.startswith(("array", "map", "struct")) else 200 if kind in ("string", "binary") else 16

    return sum(width(f.dataType.simpleString()) for f in df.schema) or 16


def small(df: DataFrame, limit: int = BROADCAST_ROWS, widest: DataFrame | None = None) -> bool:
    """Whether `df` holds at most `limit` rows, and these (as wide as those of `widest`) at most
    BROADCAST_BYTES; reads no more than `limit + 1` rows."""
    limit = min(limit, BROADCAST_BYTES // row_bytes(df if widest is None else widest))
    return df.limit(limit + 1).count() <= limit
