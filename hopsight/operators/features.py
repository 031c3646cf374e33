"""Per-workflow graph features and the rule-based risk score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hopsight.operators.graph import is_protected
from hopsight.operators import shapes
from hopsight.operators.path_checks import Part, PathChecks
from hopsight.operators.paths import node_names
from hopsight.policy import AGENT_TO_TOOL, INTERNAL, TO_FINAL, TOOL_TO_AGENT
from hopsight.schema import KEY

FEATURE_COLUMNS = [
    "workflow_id", "request_id", "node_count", "edge_count", "max_path_length", "total_guardrail_calls",
    "duplicate_guardrail_groups", "redundant_internal_checks", "protected_boundary_count",
    "boundary_guardrail_coverage", "missing_final_boundary_check", "policy_drift_count",
    "text_mutation_count", "graph_risk_score", "highest_redundancy_path", "path_count",
    "internal_handoff_count", "high_risk_node_count", "high_risk_edge_count",
    "repeated_text_hash_count", "guardrail_density", "internal_redundancy_ratio",
]


def _edge_sums(edges: DataFrame, weights: dict) -> DataFrame:
    boundary, risk = F.col("trust_boundary"), F.col("edge_risk_level")
    internal = boundary.eqNullSafe(INTERNAL)
    points = (F.when(~internal & risk.eqNullSafe("high"), weights["high_risk_boundary"]).otherwise(0)
              + F.when(boundary.isin(AGENT_TO_TOOL, TOOL_TO_AGENT), weights["tool_boundary"]).otherwise(0)
              + F.col("warn_count") * weights["warn_result"] + F.col("block_count") * weights["block_result"]
              + F.col("policy_drift").cast("int") * weights["policy_drift"]
              + F.col("changed_count") * weights["text_mutation"])
    return edges.groupBy(*KEY).agg(
        F.count("*").alias("edge_count"),
        F.count_if(is_protected("trust_boundary")).alias("protected_boundary_count"),
        F.count_if(internal).alias("internal_handoff_count"),
        F.sum("check_count").alias("total_guardrail_calls"),
        F.count_if(risk == "high").alias("high_risk_edge_count"),
        (~F.bool_or(boundary.eqNullSafe(TO_FINAL))).alias("missing_final_boundary_check"),
        F.count_if("policy_drift").alias("policy_drift_count"),
        F.sum("changed_count").alias("text_mutation_count"),
        F.sum(points).alias("points"))


def _repeats(path_checks: PathChecks) -> DataFrame:
    """Repeats over the whole workflow, whatever the path; two levels so no group is gathered."""
    def build(part: Part) -> DataFrame:
        internal = F.col("edge_boundary").eqNullSafe(INTERNAL)
        groups = part.on_edges().groupBy(
            *KEY, "guardrail_type", "policy_id", "text_hash").agg(
            F.count("*").alias("n"), F.count_if(internal).alias("internal"),
            F.min(F.struct("step_id", "edge_ord", internal.alias("internal"))).alias("f"))
        texts = groups.groupBy(*KEY, "text_hash").agg(
            F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("dup"),
            F.sum(F.col("internal") - F.col("f.internal").cast("int")).alias("again"))
        return texts.groupBy(*KEY).agg(
            F.sum("dup").alias("duplicate_guardrail_groups"), F.sum("again").alias("redundant_internal_checks"),
            (F.sum("n") - F.count("*")).alias("repeated_text_hash_count"))

    return path_checks.per_part(build)


def _extra(edges: DataFrame) -> DataFrame:
    return edges.select(*KEY, "topology_id", "edge_ord", (F.col("check_count") - 1).alias("extra"))


def _busiest_path(path_checks: PathChecks) -> DataFrame:
    topo = path_checks.topo
    paths, steps = topo.paths.select("topology_id", "path_idx", "labels"), topo.path_steps
    if topo.dense is not None:
        steps = steps.join(topo.dense.select("topology_id"), "topology_id", "left_anti")

    def build(part: Part) -> DataFrame:
        scored = (topo.place(_extra(part.edges), steps)
                  .groupBy(*KEY, "topology_id", "path_idx").agg(F.sum("extra").alias("score")))
        return (scored.groupBy(*KEY, "topology_id")
                .agg(F.max(F.struct("score", (-F.col("path_idx")).alias("rank"))).alias("best"))
                .select(*KEY, "topology_id", (-F.col("best.rank")).alias("path_idx")))

    found = topo.per_key(path_checks.per_part(build), paths, on=("topology_id", "path_idx")).select(*KEY, "labels")
    if topo.dense is not None:  # keys with few edges, all of them in one array
        extra = F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", "extra"))), lambda x: x.extra)
        weighed = topo.per_key(_extra(topo.edges), topo.dense).groupBy(*KEY).agg(
            extra.alias("extra"), F.any_value("kinds").alias("kinds"), F.any_value("links").alias("links"))
        found = found.unionByName(shapes.busiest(weighed))
    return (found.join(topo.keys.select(*KEY, "names"), KEY)
            .select(*KEY, F.array_join(node_names("labels", "names"), " -> ").alias("highest_redundancy_path")))


def workflow_features(path_checks: PathChecks, weights: dict) -> DataFrame:
    topo = path_checks.topo
    sums = path_checks.per_part(lambda part: _edge_sums(part.edges, weights))
    nodes = (topo.per_key(topo.keys, topo.routes, "left")
             .select(*KEY, "node_count", "high_risk_node_count", "path_count", "max_path_length"))
    joined = (sums.join(nodes, KEY).join(_repeats(path_checks), KEY)
              .join(_busiest_path(path_checks), KEY, "left"))

    def ratio(a, b):
        return F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 3), F.lit(0.0))

    zero = F.lit(0)
    return joined.select(
        *KEY, F.col("node_count").cast("long").alias("node_count"), "edge_count",
        F.coalesce("max_path_length", zero).cast("long").alias("max_path_length"), "total_guardrail_calls",
        "duplicate_guardrail_groups", "redundant_internal_checks", "protected_boundary_count",
        ratio("protected_boundary_count", "edge_count").alias("boundary_guardrail_coverage"),
        "missing_final_boundary_check", "policy_drift_count", "text_mutation_count",
        (F.col("points") + F.when(F.col("missing_final_boundary_check"), weights["missing_final_check"])
         .otherwise(0)).cast("long").alias("graph_risk_score"),
        F.coalesce("highest_redundancy_path", F.lit("")).alias("highest_redundancy_path"),
        F.coalesce("path_count", zero).cast("long").alias("path_count"), "internal_handoff_count",
        F.col("high_risk_node_count").cast("long").alias("high_risk_node_count"), "high_risk_edge_count",
        "repeated_text_hash_count", ratio("total_guardrail_calls", "edge_count").alias("guardrail_density"),
        ratio("redundant_internal_checks", "internal_handoff_count").alias("internal_redundancy_ratio"))
