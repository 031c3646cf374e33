"""Audits: does the plan account for every check, and do the reports agree?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hopsight.operators.paths import Topologies
from hopsight.policy import MOVE, REUSE, SKIP
from hopsight.schema import KEY


def plan_accounting(trace: DataFrame, plan: DataFrame) -> DataFrame:
    """Steps missing from the plan, unknown to the trace, or repeated in either."""
    ledger = (trace.select(*KEY, "step_id", F.lit(1).alias("ran"), F.lit(0).alias("planned"))
              .unionByName(plan.filter("step_id <> -1").select(
                  *KEY, "step_id", F.lit(0).alias("ran"), F.lit(1).alias("planned"))))
    counts = ledger.groupBy(*KEY, "step_id").agg(F.sum("ran").alias("ran"), F.sum("planned").alias("planned"))
    problem = (F.when(F.col("planned") == 0, "missing_from_plan").when(F.col("ran") == 0, "not_in_trace")
               .when(F.col("planned") > 1, "planned_twice").when(F.col("ran") > 1, "step_id_repeated"))
    return counts.withColumn("problem", problem).filter("problem IS NOT NULL")


def uncovered_edges(topo: Topologies) -> DataFrame:
    """Edges on no path; their checks are absent from the plan."""
    parts = [topo.edges] + ([topo.wide_edges] if topo.wide_edges is not None else [])
    return reduce(DataFrame.unionByName, [
        topo.uncovered(e).select(*KEY, "source_node", "target_node", "trust_boundary",
                F.col("check_count").alias("guardrail_check_count")) for e in parts])


def plan_invariants(plan: DataFrame) -> DataFrame:
    """One row per rule the plan must keep, with its number of violations."""
    optimized = F.col("recommended_decision").isin(SKIP, REUSE)
    gap = F.col("recommended_decision") == MOVE
    rules = {
        "optimized_on_protected_boundary": optimized & F.col("protected_boundary"),
        "optimized_high_risk": optimized & F.col("risk_level").eqNullSafe("high"),
        "optimized_without_earlier_step": optimized & F.col("reused_from_step_id").isNull(),
        "optimized_without_audit": optimized & ~F.col("audit_required"),
        "optimized_on_dead_end": optimized & (F.col("path_type") == "orphan_branch"),
        "gap_row_with_step": gap & (F.col("step_id") != -1),
        "step_minus_one_without_gap": ~gap & (F.col("step_id") == -1),
    }
    counts = plan.agg(*[F.count_if(c).alias(name) for name, c in rules.items()])
    return counts.select(F.explode(F.create_map(*[
        x for name in rules for x in (F.lit(name), F.col(name))])).alias("invariant", "violations"))


def scenario_reconciliation(scenarios: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sums over scenarios against the overall totals."""
    names = ["original_guardrail_calls", "optimized_guardrail_calls"]
    sums = scenarios.agg(*[F.sum(c).alias(c) for c in names]).withColumn("side", F.lit("scenario_sum"))
    total = metrics.select("overall.*").select(*names).withColumn("side", F.lit("overall"))
    both = sums.unionByName(total).unpivot("side", names, "metric", "value")
    return both.groupBy("metric").agg(
        F.max(F.when(F.col("side") == "scenario_sum", F.col("value"))).alias("scenario_sum"),
        F.max(F.when(F.col("side") == "overall", F.col("value"))).alias("overall"),
        (F.min("value") == F.max("value")).alias("agrees"))


def optimized_without_redundancy(plan: DataFrame, features: DataFrame) -> DataFrame:
    """Workflows with an optimized check although their features show no redundant internal check."""
    optimized = plan.filter(F.col("recommended_decision").isin(SKIP, REUSE)).select("workflow_id").distinct()
    redundant = features.filter("redundant_internal_checks > 0").select("workflow_id").distinct()
    return optimized.join(redundant, "workflow_id", "left_anti")
