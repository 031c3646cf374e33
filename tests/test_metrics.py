import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import fixtures, registry
from hopsight import Analysis
from hopsight.plans import audit, metrics as m, serving
from hopsight.policy import DEFAULT_POLICY, KEEP, REUSE, SKIP, with_overrides
from hopsight.schema import ContractError
from hopsight.sources import sinks
from tests import traces
from tests.traces import row

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    """Traces that the gates accept; the registered ones hold copies and checks off any path."""
    return Analysis(traces.frame(spark, traces.clean()))


def test_saved_figures_follow_from_rounded_totals(orders):
    o = orders.metrics.first().overall
    assert o.latency_saved_ms == pytest.approx(o.original_total_latency_ms - o.optimized_total_latency_ms, abs=1e-6)
    assert o.cost_saved_usd == pytest.approx(o.original_total_cost_usd - o.optimized_total_cost_usd, abs=1e-9)
    g = orders.metrics.first().graph
    assert g.total_redundant_paths_detected == g.redundant_paths_optimized + g.redundant_paths_blocked_by_safety


def test_gates_pass_on_the_plan_and_fail_on_a_tampered_one(orders):
    m.enforce_gate(orders.metrics)
    m.enforce_matrix_gate(orders.boundary_matrix, orders.policy)
    bad = orders.plan.withColumn("recommended_decision", F.when(
        F.col("protected_boundary"), SKIP).otherwise(F.col("recommended_decision")))
    rows = m.ledger(orders.trace, bad, orders.policy)
    with pytest.raises(m.SafetyGateError):
        m.enforce_gate(m.metrics(rows, orders.features))
    with pytest.raises(m.SafetyGateError):
        m.enforce_matrix_gate(m.boundary_matrix(rows, orders.policy), orders.policy)
    risky = orders.plan.withColumn("recommended_decision", F.when(
        (F.col("risk_level") == "high") & (F.col("recommended_decision") != KEEP), REUSE)
        .otherwise(F.col("recommended_decision")))
    with pytest.raises(m.SafetyGateError, match="high_risk"):
        m.enforce_gate(m.metrics(m.ledger(orders.trace, risky, orders.policy), orders.features))


def test_uncovered_protected_edges_trip_the_gate(spark):
    with pytest.raises(m.SafetyGateError):
        m.enforce_gate(registry.analysis(spark, SF, "events").metrics)


def test_strict_mode_never_skips(spark):
    plan = registry.analysis(spark, SF, "events", strict=True).plan
    decisions = {r.recommended_decision for r in plan.select("recommended_decision").distinct().collect()}
    assert SKIP not in decisions and REUSE in decisions


def test_audits_hold(orders):
    assert {r.violations for r in audit.plan_invariants(orders.plan).collect()} == {0}
    assert all(r.agrees for r in audit.scenario_reconciliation(orders.scenarios, orders.metrics).collect())
    assert orders.accounting().isEmpty()


def test_one_scenario_and_one_workflow(spark, orders):
    one = Analysis(orders.trace, scenario="t1")
    assert one.scenarios.count() == 1
    whole = {r.scenario: r for r in orders.scenarios.collect()}["t1"]
    assert one.scenarios.first() == whole
    some = orders.plan.first().workflow_id
    rows = serving.one_workflow(orders.plan, some).collect()
    assert rows and {r.workflow_id for r in rows} == {some}


def test_custom_policy(spark):
    rows = [row(1, "User", "A"), row(2, "A", "B"), row(3, "B", "C"), row(4, "C", "FinalAnswer")]
    a = Analysis(traces.frame(spark, rows), with_overrides(
        skip_allowed_risk_levels=[], savings_model={**DEFAULT_POLICY["savings_model"], REUSE: 0.5}))
    assert {r.step_id: r.recommended_decision for r in a.plan.collect()} == {1: KEEP, 2: REUSE, 3: REUSE, 4: KEEP}
    assert a.metrics.first().overall.optimized_total_latency_ms == 300.0
    with pytest.raises(KeyError):
        with_overrides(unheard_of=1)


def test_explanation_wording_and_foreign_request(spark):
    first = [row(1, "User", "A", request_id="r1"), row(2, "A", "FinalAnswer", request_id="r1")]
    second = [row(i + 1, *hop, request_id="r2", timestamp="2024-02-01 00:00:00")
              for i, hop in enumerate([("User", "A"), ("A", "B"), ("B", "C"), ("C", "FinalAnswer")])]
    e = Analysis(traces.frame(spark, first + second)).explanations().first()
    assert e.path_summary == "" and e.recommended_action == SKIP
    assert e.duplicate_guardrail_pattern == "PII_CHECK / p1 repeated 2x"
    assert e.latency_saved_ms == 200.0 and e.boundary_checks_preserved == ["AGENT_TO_FINAL_RESPONSE", "USER_TO_AGENT"]
    alone = Analysis(traces.frame(spark, second)).explanations().first()
    assert alone.path_summary == "User -> A -> B -> C -> FinalAnswer"


def test_write_gates_first(spark, tmp_path, orders):
    folder = str(tmp_path / "out")
    orders.write(folder)
    back = sinks.read_table(spark, folder, "optimized_plan")
    assert sorted(map(str, back.collect())) == sorted(map(str, orders.plan.collect()))
    metrics = sinks.read_table(spark, folder, "metrics", "json", orders.metrics.schema)
    assert metrics.first() == orders.metrics.first()
    part = next(Path(folder, "explanations").glob("part-*"))
    assert isinstance(json.loads(part.read_text().splitlines()[0])["boundary_checks_preserved"], list)
    bad = Path(tmp_path, "bad")
    with pytest.raises(m.SafetyGateError):
        registry.analysis(spark, SF, "events").write(str(bad))
    assert not bad.exists()


def test_policies_may_be_given_in_part(spark):
    rows = [row(1, "User", "A"), row(2, "A", "B", guardrail_result="WARN"), row(3, "B", "FinalAnswer")]
    whole = Analysis(traces.frame(spark, rows)).features.first().graph_risk_score
    a = Analysis(traces.frame(spark, rows), {"risk_score_weights": {"warn_result": 10}})
    assert a.features.first().graph_risk_score == whole + 9 and a.plan.count() == 3


def _whole_result(spark, folder):
    return {t: sorted(map(str, sinks.read_table(spark, folder, t).collect())) for t in ("optimized_plan", "graph_nodes", "scenario_metrics")}


def test_a_failing_sink_or_rename_leaves_the_old_result_whole(spark, tmp_path, orders, monkeypatch):
    folder = str(tmp_path / "out")
    counted = orders.write(folder)
    old, names = _whole_result(spark, folder), sorted(p.name for p in tmp_path.iterdir())
    assert names == ["out"] and counted["optimized_plan"] == {"rows": orders.plan.count(), "without_key": 0}
    manifest = json.loads(Path(folder, sinks.MANIFEST).read_text())
    assert manifest["tables"] == counted and set(counted) == {p.name for p in Path(folder).iterdir() if p.is_dir()}
    other = Analysis(traces.frame(spark, [row(1, "User", "A"), row(2, "A", "FinalAnswer")]))
    other.__dict__["redundant"] = orders.redundant.withColumn("path_id", F.raise_error(F.concat(F.lit("no space left"), "path_id")).cast("string"))
    with pytest.raises(Exception, match="no space left"):
        other.write(folder)
    del other.__dict__["redundant"]
    real, calls = sinks.Staged._rename, []

    def failing(self, source, target):
        calls.append(source)
        if len(calls) == 6:
            raise OSError("the store is gone")
        real(self, source, target)
    monkeypatch.setattr(sinks.Staged, "_rename", failing)
    with pytest.raises(OSError, match="the store is gone"):
        other.write(folder)
    monkeypatch.undo()
    assert _whole_result(spark, folder) == old and sorted(p.name for p in tmp_path.iterdir()) == names
    assert json.loads(Path(folder, sinks.MANIFEST).read_text()) == manifest
    other.write(folder)
    assert len(_whole_result(spark, folder)["optimized_plan"]) == 2


def test_contracts_on_entry_and_while_writing(spark, tmp_path):
    df = traces.frame(spark, [row(1, "User", "A"), row(2, "A", "FinalAnswer")])
    with pytest.raises(ContractError, match="trust_boundary"):
        Analysis(df.drop("trust_boundary"))
    with pytest.raises(ContractError, match="step_id"):
        Analysis(df.withColumn("step_id", F.col("step_id").cast("string")))
    wide = df.withColumn("step_id", F.col("step_id").cast("bigint"))
    assert sorted(map(str, Analysis(wide).plan.collect())) == sorted(map(str, Analysis(df).plan.collect()))
    with pytest.raises(Exception, match="step_id is no int: 5000000001"):
        Analysis(wide.withColumn("step_id", F.col("step_id") + 5_000_000_000)).plan.collect()
    with pytest.raises(ContractError, match="trace has zero rows"):
        Analysis(df.limit(0)).write(str(tmp_path / "none"))
    assert not list(tmp_path.iterdir())


def test_metrics_scenarios_and_matrix_share_one_scan(spark, tmp_path):
    traces.frame(spark, traces.clean()).write.parquet(str(tmp_path / "trace"))
    a = Analysis(spark.read.parquet(str(tmp_path / "trace")))
    a.plan.count(), a.features.count(), a.ledger.count()
    for table in (a.metrics, a.scenarios, a.boundary_matrix):
        physical = table._jdf.queryExecution().executedPlan().toString()
        above = physical.split("InMemoryRelation")[0]
        assert "InMemoryTableScan" in above and "FileScan" not in above
    one = a._held[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("InMemoryRelation") >= 1
