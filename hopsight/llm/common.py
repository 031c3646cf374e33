"""Helpers shared by the operators: written cuts of the lineage and components of links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; a temporary one on a local master where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="hopsight-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Tables that `cut` wrote and nothing has deleted, in order.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, and it survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, *figures: Column) -> tuple[DataFrame, dict]:
    """`cut`, and aggregates over its rows (at least their number `rows`), taken while they are written instead of in jobs of their own."""
    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *figures)), seen.get


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by `cut` that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/cut-" in folder:
            _delete(df.sparkSession, folder)


def result_of(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that `make` describes, written; the tables that were cut on the way are deleted."""
    before = set(_written)
    result = cut(make())
    for path in [p for p in _written[:-1] if p not in before]:
        _delete(result.sparkSession, path)
        _written.remove(path)
    return result


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of `links` (u, v) and of `known`: component is the smallest node reachable.

    `known` is an earlier result; it is joined with the links between its components only, not computed anew.
    Alternating large-star and small-star rounds: each hangs neighbours on the smallest known node,
    so a hub is aggregated by its partial minimum and never gathered. Ends when a round changes nothing.
    """
    same = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("same")
    if known is not None:
        for end in ("u", "v"):
            links = (links.join(known.select(F.col("node").alias(end), F.col("component").alias("top")), end, "left")
                     .withColumn(end, F.coalesce("top", end)).drop("top"))
    edges, state = measured(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), same)
    if known is not None and not state["rows"]:
        return known
    while state["rows"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge now points from the larger to the smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new, now = measured(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
                            .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), same)
        discard(edges)
        edges, before, state = new, state, now
        if state == before:
            break
    top = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        top.join(edges.select(F.col("u").alias("node")), "node", "left_anti"))
    if known is not None:
        found = cut(found)
        moved = found.select(F.col("node").alias("component"), F.col("component").alias("top"))
        found = (known.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
                 .unionByName(found.join(known.select("node"), "node", "left_anti")))
    return cut(found)
