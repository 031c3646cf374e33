import pytest

from hopsight import schema
from tests import traces
from tests.traces import row


def test_trace_passes_and_extra_columns_are_allowed(spark):
    df = traces.frame(spark, [row(1, "User", "A")])
    assert schema.require_trace(df.selectExpr("*", "1 AS extra")) is not None


@pytest.mark.parametrize("column", schema.TRACE_REQUIRED)
def test_missing_trace_column_is_named(spark, column):
    with pytest.raises(schema.ContractError, match=column):
        schema.require_trace(traces.frame(spark, [row(1, "User", "A")]).drop(column))


def test_wrong_type_and_zero_rows_are_refused(spark):
    df = traces.frame(spark, [row(1, "User", "A")])
    with pytest.raises(schema.ContractError, match="step_id"):
        schema.require_trace(df.selectExpr("* EXCEPT (step_id)", "CAST(step_id AS STRING) AS step_id"))
    with pytest.raises(schema.ContractError, match="zero rows"):
        schema.require_trace(df.limit(0))


def test_plan_redundant_and_metrics_contracts(spark):
    from hopsight import Analysis
    a = Analysis(traces.frame(spark, [row(1, "User", "A"), row(2, "A", "B"), row(3, "B", "FinalAnswer")]))
    schema.require_plan(a.plan), schema.require_redundant(a.redundant), schema.require_metrics(a.metrics)
    schema.require_redundant(a.redundant.limit(0))
    with pytest.raises(schema.ContractError, match="reason"):
        schema.require_plan(a.plan.drop("reason"))
    with pytest.raises(schema.ContractError, match="blocked_by"):
        schema.require_redundant(a.redundant.drop("blocked_by"))
    with pytest.raises(schema.ContractError, match="human_review_count"):
        schema.require_metrics(a.metrics.select("overall"))


def test_optional_columns_fall_back(spark):
    from hopsight import Analysis
    rows = [row(1, "User", "A", risk_level="high"), row(2, "A", "FinalAnswer")]
    bare = traces.frame(spark, rows).select(*schema.TRACE_REQUIRED)
    a = Analysis(bare)
    nodes = {r.node_name: r for r in a.nodes.collect()}
    assert nodes["A"].node_id == "r_A" and nodes["A"].node_type == "agent" and nodes["A"].input_text_hash == ""
    edges = {(r.source_node, r.target_node): r.edge_risk_level for r in a.edges.collect()}
    assert edges[("User", "A")] == "high"
    assert {r.step_id for r in a.plan.collect()} == {1, 2}
