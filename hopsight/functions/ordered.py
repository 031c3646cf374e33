"""Ordered per-group functions whose groups may be larger than one task can hold.

A window sends a whole group to one task. Here a group is first cut into ranges of its own
order; a window then runs per range, and one row per range carries the state across. The cut
is written to the checkpoint folder, so both branches see the same ranges even if an executor
is lost, and exact copies of a row are told apart by an id taken from checkpointed rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RANGE_ROWS = 1_000_000
HASHES = 65_536


def large_groups(df: DataFrame, group: list[str], rows: int = RANGE_ROWS) -> DataFrame | None:
    """The groups of more than `rows` rows, or None without any.

    Rows are counted by a hash of their group first; groups are only counted where a hash has that many.
    """
    place = F.pmod(F.xxhash64(*group), F.lit(HASHES))
    full = [r.place for r in df.groupBy(place.alias("place")).agg(F.count("*").alias("n")).filter(F.col("n") > rows).collect()]
    if not full:
        return None
    counts = df.filter(place.isin(full)).groupBy(*group).agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") > rows).select(*group).checkpoint()
    return None if found.isEmpty() else found


def _cut(df: DataFrame, group: list[str], order: list[str], rows: int) -> DataFrame:
    spark = df.sparkSession
    stable = df.checkpoint().withColumn("_uid", F.monotonically_increasing_id())
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stable.count() // rows))
    return (stable.repartitionByRange(ranges, *group, *order, "_uid")
            .withColumn("_range", F.spark_partition_id())
            .checkpoint())



def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str], column: str) -> DataFrame:
    renamed = carry.select(*[F.col(k).alias(f"_c_{k}") for k in keys], column)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys])
    return rows.join(renamed, cond, "left").drop(*[f"_c_{k}" for k in keys])


def previous_in_group(df: DataFrame, group: list[str], order: list[str], value: Column, name: str,
                      seq: str | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """Add `name`: `value` of the row before, within `group` by `order`; NULL on the first.

    `seq` adds a column that sorts as the rows do, so that rows equal in `order` have the places that `name` saw.
    """
    cut = _cut(df.withColumn("_value", value), group, order, rows)
    keys = [*group, "_range"]
    ordered = W.partitionBy(*keys).orderBy(*order, "_uid")
    within = cut.withColumn(name, F.lag("_value").over(ordered))
    if seq is not None:
        within = within.withColumn(seq, F.struct("_range", F.row_number().over(ordered).alias("n")))
    last = cut.groupBy(*keys).agg(F.max(F.struct(*order, "_uid", "_value")).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last._value").over(W.partitionBy(*group).orderBy("_range")))
    return (_with_carry(within, carry, keys, "_carry")
            .withColumn(name, F.coalesce(name, "_carry"))
            .drop("_value", "_uid", "_range", "_carry"))


def position_in_group(df: DataFrame, group: list[str], order: list[str], name: str,
                      rows: int = RANGE_ROWS) -> DataFrame:
    """Add `name`: the 0-based position within `group` by `order`."""
    cut = _cut(df, group, order, rows)
    keys = [*group, "_range"]
    within = cut.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order, "_uid")))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = (cut.groupBy(*keys).agg(F.count("*").alias("_n"))
             .withColumn("_carry", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    return (_with_carry(within, carry, keys, "_carry")
            .withColumn(name, (F.col(name) - 1 + F.col("_carry")).cast("int"))
            .drop("_uid", "_range", "_carry"))
