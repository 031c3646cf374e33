"""Flat trace source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopsight.sources.records import Checked, csv_records, json_records, table_records


def trace_records(spark: SparkSession, path: str, format: str = "parquet") -> Checked:
    """The records of a trace, accepted with the declared types or rejected; a column of another kind in a table raises at once."""
    if format == "csv":
        return csv_records(spark, path)
    if format == "json":
        return json_records(spark, path)
    return table_records(spark.read.format(format).load(path))


def read_trace(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A trace with its declared types; a record that does not fit raises when it is read. `trace_records` sets rejects apart instead."""
    return trace_records(spark, path, format).strict()
