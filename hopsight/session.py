"""Session settings and the size checks that guard every broadcast."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000
TASK_ROWS = 100_000
MOST_TASKS = 100_000
OPEN_WRITERS = 2
#: Tables of `stored_by`: the columns of their buckets, and how many.
_buckets: WeakKeyDictionary[DataFrame, tuple[list[str], int]] = WeakKeyDictionary()


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans rely on; each can be overridden after the call.

    Joins on (key, more) may then reuse a partitioning by key, and AQE may split a skewed
    join even if that costs a later stage its partitioning.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="hopsight-checkpoint-")
        sc.setCheckpointDir(folder)
    return spark


def persist(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Persist `df`; AQE may merge its small partitions unless later joins build on them."""
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = conf.get(name)
    conf.set(name, str(not keep_partitioning).lower())
    try:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        conf.set(name, before)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of so many rows: they grow with the rows, so that a task's sort stays in memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-rows // TASK_ROWS)))


def stored(df: DataFrame) -> DataFrame:
    """`df` written compressed to the checkpoint folder and read again: a checkpoint of a fraction of the size."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """The same as a table in `tasks` buckets of `keys`: joins, windows and aggregates by them need no shuffle.

    `df` has to be partitioned so, else every task writes a file for every bucket. A task then has rows of one bucket,
    which need no sort by bucket; Spark falls back to that sort if there are more buckets than open writers.
    """
    spark = df.sparkSession
    name, writers = f"stored_{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, str(OPEN_WRITERS))
    try:
        (df.write.option("compression", "zstd").option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}")
         .bucketBy(tasks, *keys).format("parquet").saveAsTable(name))
    finally:
        spark.conf.set(writers, before)
    table = spark.table(name)
    _buckets[table] = (list(keys), tasks)
    return table


def buckets_of(df: DataFrame, keys: list[str]) -> tuple[list[str], int] | None:
    """Columns and number of the buckets of a table of `stored_by`, if they keep the rows of `keys` together."""
    columns, tasks = _buckets.get(df, (["?"], 0))
    return (columns, tasks) if set(columns) <= set(keys) else None


def is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def bounded(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it is proven small; else a plain side for a shuffle join."""
    return F.broadcast(df) if is_small(df) else df
