"""What is written and shuffled on the way grows as the input does."""

import os

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from hopsight import Analysis, session
from hopsight.functions.ordered import large_groups
from hopsight.operators import paths, plan as plan_ops
from hopsight.plans import explain

from tests import traces

SF = "/root/testdata/sf0.001"


def size(folder) -> int:
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(workflow_id")


def test_trace_is_small_and_large_orders_give_the_same_rows(spark, monkeypatch):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = size(folder)
    trace = fixtures.order_trace(spark, SF)
    assert size(folder) - before < 100 * trace.count()
    monkeypatch.setattr(fixtures, "large_groups", lambda df, group: large_groups(df, group, 5))
    again = fixtures.order_trace(spark, SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, trace.collect()))


def test_stages_by_key_shuffle_nothing(spark):
    a = Analysis(fixtures.order_trace(spark, SF))
    for table in (a.nodes, a.edges, a.paths, a.features, a.redundant, a.plan):
        assert exchanges(table) == 0
    a.release()


def test_order_trace_is_shuffled_once(spark):
    a = Analysis(fixtures.order_trace(spark, SF))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = size(folder)
    for table in (a.keyed, a.nodes, a.edges):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    assert size(folder) == before
    assert session.buckets_of(a.trace, ["workflow_id"]) is None
    a.release()


def test_stored_shapes_hold_nothing_twice(spark):
    a = Analysis(fixtures.order_trace(spark, SF))
    fields = spark.read.parquet(*a.topologies.keys.inputFiles()).schema
    assert not {"step_id", "tie"} & set(fields["hops"].dataType.elementType.names)
    assert {fields[c].dataType.simpleString() for c in ("kinds", "links")} == {"string"}
    a.release()


def test_large_keys_are_not_stored_by_key(spark):
    trace = traces.frame(spark, traces.clean())
    whole, large = Analysis(trace), Analysis(trace, heavy_rows=1)
    assert whole._tasks is not None and large._tasks is None
    assert sorted(map(str, whole.plan.collect())) == sorted(map(str, large.plan.collect()))
    whole.release(), large.release()


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_large_groups_are_counted_exactly(spark, rows):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.floor(F.sqrt("id"))).alias("g"))
    expected = {r.g for r in df.groupBy("g").count().filter(F.col("count") > rows).collect()}
    found = large_groups(df, ["g"], rows)
    assert (set() if found is None else {r.g for r in found.collect()}) == expected


def test_partitions_grow_with_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.tasks_for(spark, 10) == least
    assert session.tasks_for(spark, 1000 * session.TASK_ROWS) == 1000


def operators(df, name) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_checks_meet_their_edges_without_a_sort(spark):
    a = Analysis(fixtures.order_trace(spark, SF))
    part = a.path_checks.parts[0]
    assert operators(part.on_edges(), "ShuffledHashJoin") == 1 and operators(part.on_edges(), "Sort") == 0
    large = Analysis(fixtures.order_trace(spark, SF).select("*"), heavy_rows=1)
    assert all(operators(p.on_edges(), "ShuffledHashJoin") == 0 for p in large.path_checks.parts)
    a.release(), large.release()


def test_stored_shapes_keep_what_is_read(spark):
    a = Analysis(fixtures.order_trace(spark, SF))
    hops = spark.read.parquet(*a.topologies.keys.inputFiles()).schema["hops"].dataType.elementType
    assert len(hops.names) == len(paths.EDGE_COLUMNS) and "first" not in hops.names
    gaps = plan_ops.missing_final_rows(a.topologies.keys)
    assert operators(gaps, "Aggregate") == operators(gaps, "Join") == 0
    a.release()


def test_stored_by_loses_nothing_with_few_open_writers(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    before, seen = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"), []
    for dealt in (rows.repartition(8, "k"), rows):  # also with a bucket in every task
        found = session.stored_by(dealt, ["k"], 8)
        assert sorted(found.collect()) == sorted(rows.collect())
        seen.append(operators(found.groupBy("k").count(), "Exchange"))
    assert seen == [0, 0] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_explanations_plan_only_the_workflows_they_name(spark, monkeypatch):
    a = Analysis(fixtures.order_trace(spark, SF))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(workflow):
        seen.add(1)
        return True

    a.plan_with_paths = a.plan_with_paths.filter(counted("workflow_id"))
    told, read = [], []
    for most in (explain.NAMED_WORKFLOWS, 0):
        monkeypatch.setattr(explain, "NAMED_WORKFLOWS", most)
        before = seen.value
        told.append(a.explanations(5).collect())
        read.append(seen.value - before)
    assert told[0] == told[1]
    assert 3 * read[0] < 2 * read[1], read
    a.release()
