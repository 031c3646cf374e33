"""Table sinks, staged publication, and the matching reader for the serving side."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from hopsight.schema import KEY

MANIFEST = "_MANIFEST.json"


def write_tables(folder: str, tables: dict[str, DataFrame], format: str = "parquet",
                 partition_by: list[str] | None = None) -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(format)
        if format == "csv":
            writer = writer.option("header", True)
        if partition_by and set(partition_by) <= set(df.columns):
            writer = writer.partitionBy(*partition_by)
        writer.save(f"{folder}/{name}")


def write_trace(trace: DataFrame, path: str, format: str = "parquet", by_scenario: bool = False) -> None:
    folder, _, name = path.rstrip("/").rpartition("/")
    write_tables(folder or ".", {name: trace}, format, ["workflow_template"] if by_scenario else None)


def read_table(spark: SparkSession, folder: str, name: str, format: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{folder}/{name}")


class Staged:
    """Tables that are written beside their folder and enter it by rename, all of them or none.

    Within `with`, `write` stages and `publish` renames: the old tables step aside, the new ones step in, and a manifest
    with their counts ends the publication. A failure of either puts the old tables back and deletes what was staged.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.run = spark, folder.rstrip("/"), uuid.uuid4().hex
        self.staging, self.aside = f"{self.folder}._staging-{self.run}", f"{self.folder}._old-{self.run}"
        self._tables: list[str] = []
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _rename(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} cannot be renamed to {target}")

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *_) -> None:
        for folder in (self.staging, self.aside):
            self._fs.delete(self._path(folder), True)

    def write(self, tables: dict[str, DataFrame], format: str = "parquet") -> dict[str, dict[str, int]]:
        """Stage `tables`; their rows, and rows without a key, are counted by the job that writes them."""
        counted = {}
        for name, df in tables.items():
            seen, keyed = Observation(), set(KEY) <= set(df.columns)
            lost = F.count_if(F.col(KEY[0]).isNull() | F.col(KEY[1]).isNull()) if keyed else F.count_if(F.lit(False))
            write_tables(self.staging, {name: df.observe(seen, F.count(F.lit(1)).alias("rows"), lost.alias("without_key"))}, format)
            counted[name] = {k: int(v) for k, v in {"rows": 0, "without_key": 0, **seen.get}.items()}
            self._tables.append(name)
        return counted

    def read(self, name: str, format: str = "parquet", schema=None) -> DataFrame:
        return read_table(self.spark, self.staging, name, format, schema)

    def publish(self, counted: dict[str, dict[str, int]]) -> None:
        out = self._fs.create(self._path(f"{self.staging}/{MANIFEST}"), True)
        out.write(bytearray(json.dumps({"run": self.run, "tables": counted}).encode()))
        out.close()
        self._fs.mkdirs(self._path(self.folder))
        self._fs.mkdirs(self._path(self.aside))
        moved: list[tuple[str, str]] = []
        try:
            for name in [*self._tables, MANIFEST]:
                here, new, old = f"{self.folder}/{name}", f"{self.staging}/{name}", f"{self.aside}/{name}"
                if self._fs.exists(self._path(here)):
                    self._rename(here, old)
                    moved.append((old, here))
                self._rename(new, here)
                moved.append((here, new))
        except BaseException:
            for now, before in reversed(moved):
                self._rename(now, before)
            raise
