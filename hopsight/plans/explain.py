"""Plain-language explanations for the workflows with the most optimized checks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from hopsight.policy import KEEP, REUSE, REVIEW, SKIP

EXPLANATION_COLUMNS = [
    "workflow_id", "path_summary", "duplicate_guardrail_pattern", "recommended_action", "safety_reasoning",
    "boundary_checks_preserved", "latency_saved_ms", "cost_saved_usd", "audit_required", "human_review_required",
]

NAMED_WORKFLOWS = 1_000


def _sentence() -> Column:
    """Fixed wording per decision of the group's last check."""
    action = F.col("recommended_action")
    why = (F.when(action == SKIP, "the duplicate checks occurred only on AGENT_TO_AGENT_INTERNAL edges, the "
                  "previous result was PASS, the text hash did not change, and risk was low")
           .when(action == REUSE, "risk was medium, so the prior decision is reused with an audit trail rather "
                 "than fully skipped")
           .when(action == REVIEW, "the duplicate involved high risk or a conflicting guardrail result, so it is "
                 "never auto-optimized")
           .otherwise("the check falls on a protected trust boundary and is always preserved"))
    n = F.col("n").cast("string")
    what = (F.when(action == SKIP, F.concat(F.lit("the optimizer recommends SKIP_REDUNDANT_WITH_AUDIT for "), n,
                                            F.lit(" downstream check(s) on internal handoffs")))
            .when(action == REUSE, F.concat(F.lit("the optimizer recommends REUSE_PREVIOUS_DECISION for "), n,
                                            F.lit(" downstream check(s)")))
            .when(action == REVIEW, "the optimizer flags this path for HUMAN_REVIEW_REQUIRED")
            .otherwise(F.concat(F.lit("the optimizer recommends "), action)))
    kept = F.when(F.size("boundary_checks_preserved") > 0, F.array_join("boundary_checks_preserved", ", ")
                  ).otherwise("no additional boundaries")
    return F.format_string(
        "Workflow %s contains a path %s. The same %s under policy %s was executed multiple times across internal "
        "agent handoffs. Because %s, %s. Checks at %s are preserved.",
        "workflow_id", "path_summary", "guardrail_type", "policy_id", why, what, kept)


def explanations(plan: DataFrame, paths: DataFrame, request_times: DataFrame, top_n: int = 25) -> DataFrame:
    """`plan` carries `path_idx`; `request_times` gives each key's first timestamp.

    Rows of a workflow are ordered by (first timestamp of the request, request, path, step).
    """
    real = plan.filter("step_id <> -1")
    impact = (real.groupBy("workflow_id").agg(F.count_if("safe_to_optimize").alias("impact"))
              .orderBy(F.desc("impact"), "workflow_id").limit(top_n).checkpoint())
    top = F.broadcast(impact)
    if top_n <= NAMED_WORKFLOWS:  # named, the filter reaches the scans; a join would plan every workflow again and drop it then
        named = F.col("workflow_id").isin([r.workflow_id for r in impact.select("workflow_id").collect()])
        real, request_times, paths = (df.filter(named) for df in (real, request_times, paths))
    rows = real.join(top, "workflow_id").join(
        request_times.join(top.select("workflow_id"), "workflow_id", "left_semi"), ["workflow_id", "request_id"])
    place = F.struct("request_time", "request_id", "path_idx", "step_id")
    keep = F.col("recommended_decision") == KEEP
    workflow = rows.groupBy("workflow_id", "impact").agg(
        F.min(place).alias("first_row"),
        F.sort_array(F.collect_set(F.when(keep, F.col("trust_boundary")))).alias("boundary_checks_preserved"),
        F.bool_or(F.col("recommended_decision") == REVIEW).alias("human_review_required"))
    saved = [F.coalesce(F.sum(F.when(~keep, F.col(c))), F.lit(Decimal(0))).alias(c)
             for c in ("original_latency_ms", "original_cost_usd")]
    groups = (rows.filter("reused_from_step_id IS NOT NULL AND policy_id IS NOT NULL AND guardrail_type IS NOT NULL")
              .groupBy("workflow_id", "guardrail_type", "policy_id", "graph_path_id")
              .agg(F.count("*").alias("n"),
                   F.max_by("recommended_decision", place).alias("recommended_action"),
                   F.bool_or("audit_required").alias("audit_required"), *saved))
    largest = (groups.groupBy("workflow_id")
               .agg(F.min(F.struct((-F.col("n")).alias("rank"), "guardrail_type", "policy_id", "graph_path_id", "n",
                                   "recommended_action", "audit_required", "original_latency_ms",
                                   "original_cost_usd")).alias("g"))
               .select("workflow_id", "g.*"))
    # At most `top_n` rows, read twice below.
    told = (workflow.join(largest, "workflow_id").withColumn("request_id", F.col("first_row.request_id"))
            .coalesce(1).checkpoint())
    wanted = told.select("workflow_id", "request_id", F.col("graph_path_id").alias("path_id"))
    texts = (paths.join(F.broadcast(wanted), ["workflow_id", "request_id", "path_id"])
             .select("workflow_id", F.array_join("path_nodes", " -> ").alias("path_text")))
    factor = F.when(F.col("recommended_action") == SKIP, F.lit(Decimal("1.0"))).otherwise(F.lit(Decimal("0.8")))
    told = (told.join(texts, "workflow_id", "left")
            .withColumn("path_summary", F.coalesce("path_text", F.lit(""))))
    return told.select(
        "workflow_id", "path_summary",
        F.format_string("%s / %s repeated %dx", "guardrail_type", "policy_id", "n")
        .alias("duplicate_guardrail_pattern"),
        "recommended_action", _sentence().alias("safety_reasoning"), "boundary_checks_preserved",
        F.round(F.col("original_latency_ms") * factor, 2).cast("double").alias("latency_saved_ms"),
        F.round(F.col("original_cost_usd") * factor, 6).cast("double").alias("cost_saved_usd"),
        "audit_required", "human_review_required", "impact",
    ).orderBy(F.desc("impact"), "workflow_id").drop("impact")
