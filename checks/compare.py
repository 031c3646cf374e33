"""Compare registered queries with their SQL: `python -m checks.compare SF_DIR [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    """An empty text if both sides agree in column names and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(set(names) ^ set(spark_df.columns))}"
    expected, actual = _rows(names, result.fetchall()), _rows(spark_df.columns, spark_df.collect())
    if expected == actual:
        return ""
    extra, lack = sorted(set(actual) - set(expected))[:2], sorted(set(expected) - set(actual))[:2]
    return f"rows {len(actual)} vs {len(expected)}; only Spark {extra}; only SQL {lack}"


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession
    from checks import registry
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), registry.oracle_sql(), 0
    for name, run in registry.queries().items():
        if names and name not in names:
            continue
        begun = time.time()
        try:
            df = run(spark, sf_dir)
            said = differences(df, con, sqls[name])
            said = said or f"ok {df.count()} rows"
        except Exception as e:
            said = f"{type(e).__name__} {str(e)[:600]}"
        bad += not said.startswith("ok")
        print(f"{name}: {said} [{time.time() - begun:.1f}s]", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
