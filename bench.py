"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The JVM is warmed up by one plan over the smallest tables. Every query starts cold otherwise: shared tables are
dropped and built again inside its own time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from checks import registry

HEADLINE = ["nodes", "edges", "paths", "plan", "redundant_paths", "features", "metrics_overall", "scenario_metrics",
            "boundary_matrix", "explanations", "plan_accounting", "plan_events", "session_trace"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    names = sys.argv[1:] or HEADLINE
    queries["plan"](spark, os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")).write.format("noop").mode("overwrite").save()
    for name in names:
        registry.release()
        begun = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begun, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    registry.release()
    begun = time.time()
    run = registry.analysis(spark, sf_dir, "orders")
    run.hold_checks()
    for table in (run.nodes, run.edges, run.plan, run.redundant, run.features, run.metrics, run.scenarios,
                  run.boundary_matrix, run.explanations()):
        table.write.format("noop").mode("overwrite").save()
    times["full_pipeline"] = round(time.time() - begun, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
