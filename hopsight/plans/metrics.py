"""Savings and safety metrics, breakdowns and hard gates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from hopsight.operators.plan import isin
from hopsight.policy import (ADDED_CHECK_COST_USD, ADDED_CHECK_LATENCY_MS, KEEP, MOVE, REUSE, REVIEW, SKIP)

OVERALL = [
    "original_guardrail_calls", "optimized_guardrail_calls", "guardrail_call_reduction_percent",
    "original_total_latency_ms", "optimized_total_latency_ms", "latency_saved_ms", "latency_saved_percent",
    "original_total_cost_usd", "optimized_total_cost_usd", "cost_saved_usd", "cost_saved_percent",
]
GRAPH = [
    "workflows_analyzed", "average_nodes_per_workflow", "average_edges_per_workflow", "average_path_length",
    "workflows_with_redundant_paths", "total_redundant_paths_detected", "redundant_paths_optimized",
    "redundant_paths_blocked_by_safety", "graph_risk_score_average",
]
SAFETY = [
    "boundary_checks_original", "boundary_checks_preserved", "boundary_coverage_preserved_percent",
    "high_risk_checks_original", "high_risk_checks_preserved", "high_risk_preservation_percent",
    "false_skip_rate_simulated", "policy_drift_blocks", "text_mutation_blocks", "warn_block_escalations",
    "human_review_count", "audit_required_count",
]


class SafetyGateError(RuntimeError):
    """The plan would leave a protected boundary or a high-risk check uncovered."""


def with_savings(plan: DataFrame, policy: dict) -> DataFrame:
    """Add each row's latency and cost after its decision (exact decimals)."""
    left = F.lit(Decimal(1)).cast("decimal(9,6)")
    chain = None
    for decision, saved in policy["savings_model"].items():
        factor = F.lit(Decimal(1) - Decimal(str(saved))).cast("decimal(9,6)")
        hit = F.col("recommended_decision") == decision
        chain = F.when(hit, factor) if chain is None else chain.when(hit, factor)
    factor = left if chain is None else chain.otherwise(left)
    gap = (F.col("recommended_decision") == MOVE) & (F.col("step_id") == -1)

    def after(column: str, added: Decimal) -> Column:
        return F.when(gap, F.lit(added)).otherwise(F.col(column) * factor).cast("decimal(28,12)")

    return plan.withColumns({
        "optimized_latency_ms": after("original_latency_ms", ADDED_CHECK_LATENCY_MS),
        "optimized_cost_usd": after("original_cost_usd", ADDED_CHECK_COST_USD)})


def _trace_sums(policy: dict) -> list[Column]:
    risky = (F.col("risk_level").eqNullSafe("high") | F.col("edge_risk_level").eqNullSafe("high"))
    return [
        F.count("*").alias("original_guardrail_calls"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("original_latency"),
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)).alias("original_cost"),
        F.count_if(isin("trust_boundary", policy["protected_boundaries"])).alias("boundary_checks_original"),
        F.count_if(risky).alias("high_risk_checks_original")]


def _plan_sums(policy: dict) -> list[Column]:
    real = F.col("step_id") != -1
    decision, reason = F.col("recommended_decision"), F.col("reason")
    reused = F.col("reused_from_step_id").isNotNull()
    protected = isin("trust_boundary", policy["protected_boundaries"])

    def n(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return [
        n(real, "real_rows"),
        n((real & (decision != SKIP)) | ~real, "optimized_guardrail_calls"),
        F.coalesce(F.sum("optimized_latency_ms"), F.lit(0)).alias("optimized_latency"),
        F.coalesce(F.sum("optimized_cost_usd"), F.lit(0)).alias("optimized_cost"),
        n(real & reused, "total_redundant_paths_detected"),
        n(real & decision.isin(SKIP, REUSE), "redundant_paths_optimized"),
        n(real & reused & decision.isin(KEEP, REVIEW), "redundant_paths_blocked_by_safety"),
        n(real & protected & (decision == KEEP), "boundary_checks_preserved"),
        n(real & F.col("risk_level").eqNullSafe("high") & decision.isin(KEEP, REVIEW), "high_risk_checks_preserved"),
        n(real & protected & (decision == SKIP), "false_skips"),
        n(real & (reason == "policy_drift_since_previous_check"), "policy_drift_blocks"),
        n(real & (reason == "text_changed_since_previous_check"), "text_mutation_blocks"),
        n(real & reason.rlike("previous_result_(?:WARN|BLOCK)"), "warn_block_escalations"),
        n(decision == REVIEW, "human_review_count"),
        n(F.col("audit_required"), "audit_required_count"),
        n(real & ((decision == KEEP) | (protected & (decision == REVIEW))), "checks_preserved"),
        n(real & (decision == REVIEW), "checks_reviewed")]


def _percent(part: Column, whole: Column, default: float) -> Column:
    return F.coalesce(F.round(F.try_divide(100 * part.cast("double"), whole.cast("double")), 2), F.lit(default))


def _call_reduction() -> Column:
    kept = F.try_divide(F.col("optimized_guardrail_calls").cast("double"),
                        F.col("original_guardrail_calls").cast("double"))
    return F.coalesce(F.round(100 * (1 - kept), 2), F.lit(0.0))


def _derived(df: DataFrame) -> DataFrame:
    """Percentages and rounded totals from the plain sums; savings are taken from rounded totals."""
    df = df.withColumns({
        "guardrail_call_reduction_percent": _call_reduction(),
        "_latency": F.round("original_latency", 2) - F.round("optimized_latency", 2),
        "_cost": F.round("original_cost", 4) - F.round("optimized_cost", 4),
        "boundary_coverage_preserved_percent":
            _percent(F.col("boundary_checks_preserved"), F.col("boundary_checks_original"), 100.0),
        "high_risk_preservation_percent":
            _percent(F.col("high_risk_checks_preserved"), F.col("high_risk_checks_original"), 100.0)})
    return df.withColumns({
        "original_total_latency_ms": F.round("original_latency", 2).cast("double"),
        "optimized_total_latency_ms": F.round("optimized_latency", 2).cast("double"),
        "latency_saved_ms": F.round("_latency", 2).cast("double"),
        "latency_saved_percent": _percent(F.col("_latency"), F.col("original_latency"), 0.0),
        "original_total_cost_usd": F.round("original_cost", 4).cast("double"),
        "optimized_total_cost_usd": F.round("optimized_cost", 4).cast("double"),
        "cost_saved_usd": F.round("_cost", 4).cast("double"),
        "cost_saved_percent": _percent(F.col("_cost"), F.col("original_cost"), 0.0)})


def ledger(trace: DataFrame, plan: DataFrame, policy: dict, key: list[str] | None = None) -> DataFrame:
    """Sums and counts per workflow and boundary, or per `key`, from one scan of the trace and one of the plan.

    Metrics, scenarios and the boundary matrix are sums over its rows. Workflows may be nearly as many as rows,
    so only scenarios ask for them.
    """
    key = key or ["workflow_id", "trust_boundary"]
    shown = F.struct("timestamp", "request_id", "step_id", "workflow_template")
    ran = trace.groupBy(*key).agg(*_trace_sums(policy), F.min(F.when(F.col("workflow_template").isNotNull(), shown)).alias("shown"))
    return ran.unionByName(with_savings(plan, policy).groupBy(*key).agg(*_plan_sums(policy)), allowMissingColumns=True)


SCENARIO_SUMS = [
    "original_guardrail_calls", "original_latency", "original_cost", "boundary_checks_original", "high_risk_checks_original",
    "optimized_guardrail_calls", "optimized_latency", "optimized_cost", "boundary_checks_preserved", "high_risk_checks_preserved",
]


def workflow_ledger(trace: DataFrame, plan: DataFrame, policy: dict) -> DataFrame:
    """The sums that scenarios need, per workflow."""
    return ledger(trace, plan, policy, ["workflow_id"]).select("workflow_id", "shown", *SCENARIO_SUMS)


def _totals(rows: DataFrame) -> list[Column]:
    """Sums of the ledger's figures, zero without rows."""
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns if c not in ("workflow_id", "trust_boundary", "shown")]


def metrics(rows: DataFrame, features: DataFrame) -> DataFrame:
    """One row with the structs `overall`, `graph` and `safety`, from the ledger and the features."""
    def mean(column: str, name: str) -> Column:
        return F.round(F.avg(column), 2).alias(name)

    graph = features.agg(
        F.count_distinct("workflow_id").alias("workflows_analyzed"),
        mean("node_count", "average_nodes_per_workflow"), mean("edge_count", "average_edges_per_workflow"),
        mean("max_path_length", "average_path_length"),
        F.count_if(F.col("redundant_internal_checks") > 0).alias("workflows_with_redundant_paths"),
        mean("graph_risk_score", "graph_risk_score_average"))
    parts = rows.agg(*_totals(rows)).unionByName(graph, allowMissingColumns=True)
    row = _derived(parts.agg(*[F.max(c).alias(c) for c in parts.columns]))
    row = row.withColumn("false_skip_rate_simulated", F.round(
        100 * F.col("false_skips").cast("double") / F.greatest(F.lit(1), "real_rows"), 4))
    return row.select(F.struct(*OVERALL).alias("overall"), F.struct(*GRAPH).alias("graph"),
                      F.struct(*SAFETY).alias("safety"))


def enforce_gate(metrics_row: DataFrame) -> DataFrame:
    """Raise unless protected boundaries and high-risk checks are fully preserved, by their counts."""
    for gate in safety_gates(metrics_row).collect():
        if not gate["passes"]:
            raise SafetyGateError(f"{gate['gate']}: {gate['preserved']} of {gate['original']} checks are preserved")
    return metrics_row


def safety_gates(metrics_row: DataFrame) -> DataFrame:
    """(gate, preserved, original, passes) of the two gates on the metrics."""
    gates = [F.struct(F.lit(name).alias("gate"), F.col(f"safety.{name}_preserved").alias("preserved"),
                      F.col(f"safety.{name}_original").alias("original")) for name in ("boundary_checks", "high_risk_checks")]
    rows = metrics_row.select(F.explode(F.array(*gates)).alias("g")).select("g.*")
    return rows.withColumn("passes", F.col("preserved") >= F.col("original"))


def boundary_gates(matrix: DataFrame, policy: dict) -> DataFrame:
    """The same for each protected boundary of the matrix."""
    return matrix.filter(isin("trust_boundary", policy["protected_boundaries"])).select(
        F.col("trust_boundary").alias("gate"), F.col("preserved_checks").alias("preserved"),
        F.col("original_checks").cast("long").alias("original"),
        (F.col("preserved_checks") >= F.col("original_checks")).alias("passes"))


def scenario_metrics(rows: DataFrame) -> DataFrame:
    """The headline metrics per scenario, where a workflow's scenario is its first template, or null if it has none."""
    sums = _totals(rows)
    per_workflow = rows.groupBy("workflow_id").agg(F.min("shown").alias("shown"), *sums)
    found = (per_workflow.withColumn("scenario", F.col("shown.workflow_template"))
             .groupBy("scenario").agg(F.count("*").alias("workflow_count"), *sums))
    return _derived(found).select(
        "scenario", "workflow_count", "original_guardrail_calls", "optimized_guardrail_calls",
        F.col("guardrail_call_reduction_percent").alias("call_reduction_percent"), "latency_saved_percent",
        "cost_saved_percent", F.col("boundary_coverage_preserved_percent").alias("boundary_coverage_percent"),
        "high_risk_preservation_percent").orderBy("scenario")


def boundary_matrix(rows: DataFrame, policy: dict) -> DataFrame:
    """Per boundary: original, preserved, optimized and reviewed checks."""
    listed = (rows.sparkSession.range(1)
              .select(F.explode(F.array(*[F.lit(b) for b in policy["protected_boundaries"]])).alias("trust_boundary"), F.lit(True).alias("listed")))
    names = {"original_guardrail_calls": "original_checks", "checks_preserved": "preserved_checks",
             "redundant_paths_optimized": "optimized_checks", "checks_reviewed": "human_review_checks", "real_rows": "real_rows"}
    counts = rows.unionByName(listed, allowMissingColumns=True).groupBy("trust_boundary").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in names.items()], F.max("listed").alias("listed"))
    # a recommendation alone makes no row of its boundary
    counts = counts.filter("original_checks > 0 OR real_rows > 0 OR listed")
    return counts.select(
        "trust_boundary", "original_checks", "preserved_checks",
        _percent(F.col("preserved_checks"), F.col("original_checks"), 100.0).alias("coverage_percent"),
        "optimized_checks", "human_review_checks").orderBy("trust_boundary")


def enforce_matrix_gate(matrix: DataFrame, policy: dict) -> DataFrame:
    bad = boundary_gates(matrix, policy).filter("NOT passes").first()
    if bad is not None:
        raise SafetyGateError(f"protected boundary {bad.gate}: {bad.preserved} of {bad.original} checks are preserved")
    return matrix
