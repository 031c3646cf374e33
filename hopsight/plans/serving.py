"""Result queries over the finished tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hopsight.policy import PROTECTED


def overview(metrics: DataFrame) -> DataFrame:
    return metrics.select("overall.*", "graph.*", "safety.*")


def run_summary(metrics: DataFrame, nodes: DataFrame, edges: DataFrame, redundant: DataFrame) -> DataFrame:
    """The run's counts and headline figures in one row."""
    counts = (nodes.agg(F.count("*").alias("graph_nodes"))
              .unionByName(edges.agg(F.count("*").alias("graph_edges")), allowMissingColumns=True)
              .unionByName(redundant.agg(F.count("*").alias("redundant_rows")), allowMissingColumns=True)
              .unionByName(overview(metrics), allowMissingColumns=True))
    return counts.agg(*[F.max(c).alias(c) for c in counts.columns])


def _selected(column: str, values: list | None) -> Column:
    return F.lit(True) if not values else F.col(column).isin(values)


def plan_rows(plan: DataFrame, decisions=None, boundaries=None, risks=None, types=None) -> DataFrame:
    return plan.filter(_selected("recommended_decision", decisions) & _selected("trust_boundary", boundaries)
                       & _selected("risk_level", risks) & _selected("guardrail_type", types))


def redundant_rows(redundant: DataFrame, workflows=None, types=None, decisions=None, blocks=None) -> DataFrame:
    """`blocks` selects rows blocked by any of the given reasons."""
    hit = F.lit(True) if not blocks else F.arrays_overlap(
        F.split("blocked_by", ";"), F.array(*[F.lit(b) for b in blocks]))
    return redundant.filter(_selected("workflow_id", workflows) & _selected("guardrail_type", types)
                            & _selected("recommended_decision", decisions) & hit)


def block_reasons(redundant: DataFrame) -> DataFrame:
    return (redundant.select(F.explode(F.split("blocked_by", ";")).alias("blocked_by"))
            .filter("blocked_by <> ''").distinct().orderBy("blocked_by"))


def protected_fully_covered(matrix: DataFrame) -> DataFrame:
    return matrix.filter(F.col("trust_boundary").isin(PROTECTED)).agg(
        F.bool_and(F.col("coverage_percent") == 100.0).alias("all_protected_covered"))


def riskiest(features: DataFrame, n: int = 10) -> DataFrame:
    return (features.select("workflow_id", "node_count", "edge_count", "redundant_internal_checks",
                            "missing_final_boundary_check", "graph_risk_score", "request_id")
            .orderBy(F.desc("graph_risk_score"), "workflow_id", "request_id").limit(n))


def edge_classes(edges: DataFrame) -> DataFrame:
    kind = F.when(F.col("trust_boundary").isin(PROTECTED), "protected").otherwise("internal")
    return edges.select("workflow_id", "request_id", "source_node", "target_node", "trust_boundary",
                        kind.alias("edge_class"), "guardrail_check_count")


def one_workflow(table: DataFrame, workflow_id: str) -> DataFrame:
    return table.filter(F.col("workflow_id") == workflow_id)
