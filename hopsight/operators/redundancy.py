"""Redundancy report: every repeated check on a path and what blocks its optimization."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hopsight.operators.path_checks import Part, PathChecks
from hopsight.operators.paths import path_id
from hopsight.operators.plan import differs, isin
from hopsight.policy import KEEP, REUSE, REVIEW, SKIP
from hopsight.schema import KEY

# The report's columns; the names of its blocks are in `redundant_checks`.
REDUNDANT_COLUMNS = [
    "workflow_id", "request_id", "path_id", "path_type", "path_nodes", "guardrail_type", "policy_id",
    "text_hash", "first_step_id", "duplicate_step_id", "duplicate_reason", "optimization_allowed",
    "blocked_by", "recommended_decision",
]


def redundant_checks(path_checks: PathChecks, paths: DataFrame, policy: dict) -> DataFrame:
    """One row per repeated check and path. `first_step_id` is the step just before, not the first.

    These rules differ from the plan's on purpose: a conflict outranks a protected boundary, the
    previous risk counts, and every risk but `low` is reusable.
    """
    high = (F.col("risk_level").eqNullSafe("high") | F.col("prev.risk_level").eqNullSafe("high")
            | F.col("edge_risk").eqNullSafe("high"))
    conflict = differs("guardrail_result", "prev.guardrail_result")
    blocks = F.array_compact(F.array(
        F.when(isin("edge_boundary", policy["protected_boundaries"]), "protected_boundary"),
        F.when(high, "high_risk"),
        F.when(F.col("text_changed") | differs("text_hash", "prev.text_hash"), "text_changed"),
        F.when(differs("policy_id", "prev.policy_id"), "policy_drift"),
        F.when(isin("prev.guardrail_result", policy["never_reuse_previous_results"]), "previous_unsafe_result"),
        F.when(F.col("path_type") == "orphan_branch", "orphan_branch"),
        F.when(conflict & ~high, "conflicting_result")))
    decision = (F.when(high | conflict, REVIEW)
                .when(F.size("blocks") > 0, KEEP)
                .when(F.col("risk_level").eqNullSafe("low"), SKIP)
                .otherwise(REUSE))

    def build(part: Part) -> DataFrame:
        repeated = (path_checks.along_paths(part, path_checks.topo.every_step).filter("prev IS NOT NULL")
                    .withColumn("blocks", blocks).withColumn("recommended_decision", decision))
        text = paths.select(*KEY, "path_idx", F.array_join("path_nodes", " -> ").alias("path_nodes"))
        return repeated.drop("seq").join(text, [*KEY, "path_idx"])

    joined = F.array_join("blocks", ";")
    return path_checks.per_part(build).select(
        *KEY, path_id().alias("path_id"), "path_type", "path_nodes", "guardrail_type", "policy_id", "text_hash",
        F.col("prev.step_id").alias("first_step_id"), F.col("step_id").alias("duplicate_step_id"),
        F.when(F.size("blocks") == 0, "same_guardrail_same_text_same_policy").otherwise(joined)
        .alias("duplicate_reason"),
        F.col("recommended_decision").isin(SKIP, REUSE).alias("optimization_allowed"),
        joined.alias("blocked_by"), "recommended_decision")
