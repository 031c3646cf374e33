"""Placement plan: one decision per executed check, plus rows for missing final checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hopsight.operators.path_checks import Part, PathChecks
from hopsight.operators.paths import path_id
from hopsight.policy import KEEP, MOVE, REUSE, REVIEW, SKIP, TO_FINAL
from hopsight.schema import KEY, MONEY

# The plan's columns; the decisions' reasons are in `decide` and below.
PLAN_COLUMNS = [
    "workflow_id", "request_id", "step_id", "node_id", "source_node", "target_node", "agent_name",
    "guardrail_type", "policy_id", "text_hash", "trust_boundary", "risk_level",
    "original_latency_ms", "original_cost_usd", "recommended_decision", "reason",
    "reused_from_step_id", "safe_to_optimize", "graph_path_id", "path_type",
    "protected_boundary", "audit_required",
]


def isin(column: str | Column, values: list[str]) -> Column:
    """Membership where NULL is simply not a member."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.isin(values), F.lit(False))


def differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def decide(policy: dict, strict: bool) -> Column:
    """The rule cascade as one CASE; the first rule that applies decides."""
    def verdict(decision, reason, reuse=False):
        reason = F.lit(reason) if isinstance(reason, str) else reason
        step = F.col("prev.step_id") if reuse else F.lit(None).cast("int")
        return F.struct(F.lit(decision).alias("decision"), reason.alias("reason"),
                        step.alias("reused_from"), F.lit(reuse).alias("audit"))

    high = F.col("risk_level").eqNullSafe("high") | F.col("edge_risk").eqNullSafe("high")
    first = F.col("prev").isNull()
    rules = [
        (isin("edge_boundary", policy["protected_boundaries"]),
         verdict(KEEP, "protected_trust_boundary_always_kept")),
        (high & ~first, verdict(REVIEW, "high_risk_duplicate_requires_human_review", True)),
        (high, verdict(KEEP, "high_risk_check_kept")),
        (first, verdict(KEEP, "first_occurrence_on_this_graph_path")),
        (isin("prev.guardrail_result", policy["never_reuse_previous_results"]),
         verdict(KEEP, F.concat(F.lit("previous_result_"), "prev.guardrail_result", F.lit("_not_reusable")))),
        (F.col("text_changed") | differs("text_hash", "prev.text_hash"),
         verdict(KEEP, "text_changed_since_previous_check")),
        (differs("policy_id", "prev.policy_id"), verdict(KEEP, "policy_drift_since_previous_check")),
        (differs("guardrail_result", "prev.guardrail_result"),
         verdict(REVIEW, "conflicting_guardrail_results", True)),
    ]
    reusable = isin("risk_level", policy["reuse_allowed_risk_levels"])
    if strict:
        rules.append((reusable, verdict(REUSE, "strict_mode_reuse_previous_decision", True)))
        otherwise = verdict(REVIEW, "strict_mode_escalates_uncertain_case", True)
    else:
        rules.append((isin("risk_level", policy["skip_allowed_risk_levels"]),
                      verdict(SKIP, "low_risk_internal_duplicate_same_text_same_policy_previous_pass", True)))
        rules.append((reusable, verdict(REUSE, "medium_risk_internal_duplicate_reuse_prior_decision", True)))
        otherwise = verdict(REVIEW, "unclassified_risk_escalated_for_safety", True)
    chain = F.when(*rules[0])
    for condition, result in rules[1:]:
        chain = chain.when(condition, result)
    return chain.otherwise(otherwise)


def executed_rows(path_checks: PathChecks, policy: dict, strict: bool = False) -> DataFrame:
    """Plan columns and `path_idx` for every check that lies on a path."""
    def build(part: Part) -> DataFrame:
        judged = path_checks.along_paths(part, steps).withColumn("v", decide(policy, strict))
        # A check on several paths ran once: the first path that holds it decides.
        judged = judged.filter("path_idx = first_path")
        place = ["path_idx", "pos", "path_tie", "seq"]
        if not part.heavy:
            rank = F.row_number().over(W.partitionBy(*KEY, "step_id").orderBy(*place))
            return judged.withColumn("rank", rank).filter("rank = 1").select(*KEY, "step_id", *columns)
        return (judged.groupBy(*KEY, "step_id").agg(F.min(F.struct(*place, *[c for c in columns if c != "path_idx"])).alias("c"))
                .select(*KEY, "step_id", *[F.col(f"c.{c}") for c in columns]))

    steps = path_checks.deciding_steps()
    columns = ["path_idx", "node_id", "source_node", "target_node", "agent_name", "guardrail_type", "policy_id",
               "text_hash", "edge_boundary", "risk_level", "latency_ms", "estimated_cost_usd", "path_type", "v"]
    rows = path_checks.per_part(build)
    held_back = (F.col("path_type") == "orphan_branch") & F.col("v.decision").isin(SKIP, REUSE)
    rows = rows.withColumn("recommended_decision", F.when(held_back, KEEP).otherwise(F.col("v.decision")))
    rows = rows.withColumn("reason", F.when(
        held_back, F.concat(F.lit("orphan_branch_dead_end_conservatively_kept;"), "v.reason"),
    ).otherwise(F.col("v.reason")))
    return rows.select(
        *KEY, "step_id", "node_id", "source_node", "target_node", "agent_name", "guardrail_type",
        "policy_id", "text_hash", F.col("edge_boundary").alias("trust_boundary"), "risk_level",
        F.col("latency_ms").cast(MONEY).alias("original_latency_ms"),
        F.col("estimated_cost_usd").cast(MONEY).alias("original_cost_usd"),
        "recommended_decision", "reason", F.col("v.reused_from").alias("reused_from_step_id"),
        F.col("recommended_decision").isin(SKIP, REUSE).alias("safe_to_optimize"),
        path_id().alias("graph_path_id"), "path_type",
        isin("edge_boundary", policy["protected_boundaries"]).alias("protected_boundary"),
        (F.col("v.audit") & ~held_back).alias("audit_required"), "path_idx")


def missing_final_rows(keys: DataFrame) -> DataFrame:
    """A recommendation per key without any check on the final-response boundary."""
    target = F.coalesce("first_final", F.lit("FinalAnswer"))
    null = F.lit(None).cast("string")
    zero = F.lit(0).cast(MONEY)
    return keys.filter("NOT has_final").withColumn("t", target).select(
        *KEY, F.lit(-1).alias("step_id"),
        F.concat("request_id", F.lit("_"), "t", F.lit("_boundary_gap")).alias("node_id"),
        F.lit("?").alias("source_node"), F.col("t").alias("target_node"), F.col("t").alias("agent_name"),
        F.col("first_type").alias("guardrail_type"), null.alias("policy_id"), null.alias("text_hash"),
        F.lit(TO_FINAL).alias("trust_boundary"), F.lit("unknown").alias("risk_level"),
        zero.alias("original_latency_ms"), zero.alias("original_cost_usd"),
        F.lit(MOVE).alias("recommended_decision"),
        F.lit("no_guardrail_check_found_on_agent_to_final_response_boundary").alias("reason"),
        F.lit(None).cast("int").alias("reused_from_step_id"), F.lit(False).alias("safe_to_optimize"),
        F.concat("request_id", F.lit("_p0")).alias("graph_path_id"),
        F.lit("boundary_gap").alias("path_type"), F.lit(True).alias("protected_boundary"),
        F.lit(True).alias("audit_required"), F.lit(None).cast("long").alias("path_idx"))


def decision_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("recommended_decision").agg(F.count("*").alias("checks"))
