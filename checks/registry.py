"""Every registered query with its SQL counterpart.

Queries over the same derived trace share one `Analysis`, so that its persisted tables are
built once per session; `release()` drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import fixtures, oracle as o
from hopsight import Analysis
from hopsight.operators import graph, paths, plan as plan_ops
from hopsight.plans import audit, metrics as metric_ops, serving
from hopsight.policy import REUSE, REVIEW, SKIP
from hopsight.schema import TRACE, contract_report
from hopsight.sources.records import REASON, json_texts

_TRACES = {"orders": fixtures.order_trace, "events": fixtures.event_trace, "sessions": fixtures.session_trace}
_SQL_TRACES = {"orders": o.ORDERS, "events": o.EVENTS, "sessions": o.SESSIONS}
_open: dict[tuple, Analysis] = {}


def analysis(spark: SparkSession, sf_dir: str, trace: str, strict: bool = False) -> Analysis:
    key = (spark.sparkContext.applicationId, sf_dir, trace, strict)
    if key not in _open:
        _open[key] = Analysis(_TRACES[trace](spark, sf_dir), strict=strict)
    return _open[key]


def release() -> None:
    for a in _open.values():
        a.release()
    _open.clear()


def flat(df: DataFrame) -> DataFrame:
    """Decimals as doubles and lists as text, so that any reader compares them alike."""
    def column(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name)
        return F.col(f.name)
    return df.select(*[column(f) for f in df.schema.fields])


_ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _add(name: str, trace: str, build: Callable[[Analysis], DataFrame], chain: str, select: str,
         strict: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(build(analysis(spark, sf_dir, trace, strict)))
    _ENTRIES[name] = (run, o.query(_SQL_TRACES[trace], chain, select))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ENTRIES.items()}


def _columns(names: list[str], doubles: tuple[str, ...] = ()) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) {n}" if n in doubles else f'"{n}"' for n in names)


_MONEY = ("latency_ms", "estimated_cost_usd", "original_latency_ms", "original_cost_usd")
_TRACE_SELECT = f"SELECT {_columns(TRACE.fieldNames(), _MONEY)} FROM trace"
_PLAN_SELECT = f"SELECT {_columns(plan_ops.PLAN_COLUMNS, _MONEY)} FROM plan"
_NODES = ("SELECT node_id, workflow_id, request_id, node_name, node_type, agent_name, risk_level, input_text_hash, "
          "output_text_hash, checks guardrail_check_count FROM node")
_EDGES = ("SELECT request_id || '_' || source_node || '_' || target_node edge_id, workflow_id, request_id, source_node, "
          f"target_node, trust_boundary, trust_boundary IN {o.PROT} protected_boundary, changed text_changed_on_edge, "
          "edge_risk_level, n guardrail_check_count FROM edge")
_PATHS = ("SELECT workflow_id, request_id, CAST(idx AS INTEGER) path_idx, pt path_type, pid path_id, "
          "array_to_string(names, ';') path_nodes, array_to_string(eos, ';') edge_ords FROM path")
_UNCOVERED = ("SELECT e.workflow_id, e.request_id, source_node, target_node, trust_boundary, n guardrail_check_count "
              "FROM edge e ANTI JOIN (SELECT workflow_id, request_id, unnest(eos) eo FROM path) p "
              "USING (workflow_id, request_id, eo)")
_ACCOUNTING = """SELECT * FROM (SELECT workflow_id, request_id, step_id, CAST(sum(ran) AS BIGINT) ran,
    CAST(sum(planned) AS BIGINT) planned, CASE WHEN sum(planned) = 0 THEN 'missing_from_plan'
      WHEN sum(ran) = 0 THEN 'not_in_trace' WHEN sum(planned) > 1 THEN 'planned_twice'
      WHEN sum(ran) > 1 THEN 'step_id_repeated' END problem
  FROM (SELECT workflow_id, request_id, step_id, 1 ran, 0 planned FROM trace UNION ALL
        SELECT workflow_id, request_id, step_id, 0, 1 FROM plan WHERE step_id <> -1)
  GROUP BY workflow_id, request_id, step_id) WHERE problem IS NOT NULL"""
_OVERALL = f"""SELECT tt.calls original_guardrail_calls, pt_.kept optimized_guardrail_calls,
    {o.savings_columns('tt', 'pt_', 'guardrail_call_reduction_percent')},
    CAST(round(tt.lat, 2) AS DOUBLE) original_total_latency_ms, CAST(round(pt_.lat, 2) AS DOUBLE) optimized_total_latency_ms,
    CAST(round(tt.lat, 2) - round(pt_.lat, 2) AS DOUBLE) latency_saved_ms,
    CAST(round(tt.cost, 4) AS DOUBLE) original_total_cost_usd, CAST(round(pt_.cost, 4) AS DOUBLE) optimized_total_cost_usd,
    CAST(round(tt.cost, 4) - round(pt_.cost, 4) AS DOUBLE) cost_saved_usd FROM tt, pt_"""
_GRAPH = """SELECT (SELECT count(DISTINCT workflow_id) FROM features) workflows_analyzed,
    (SELECT round(avg(node_count), 2) FROM features) average_nodes_per_workflow,
    (SELECT round(avg(edge_count), 2) FROM features) average_edges_per_workflow,
    (SELECT round(avg(max_path_length), 2) FROM features) average_path_length,
    (SELECT count(*) FROM features WHERE redundant_internal_checks > 0) workflows_with_redundant_paths,
    reused total_redundant_paths_detected, optimized redundant_paths_optimized, blocked redundant_paths_blocked_by_safety,
    (SELECT round(avg(graph_risk_score), 2) FROM features) graph_risk_score_average FROM pt_"""
_SAFETY = f"""SELECT prot boundary_checks_original, prot_kept boundary_checks_preserved,
    {o._pct('prot_kept', 'prot', '100.0')} boundary_coverage_preserved_percent,
    high high_risk_checks_original, high_kept high_risk_checks_preserved,
    {o._pct('high_kept', 'high', '100.0')} high_risk_preservation_percent,
    round(100 * CAST(false_skips AS DOUBLE) / greatest(1, real_rows), 4) false_skip_rate_simulated,
    drift policy_drift_blocks, mutated text_mutation_blocks, unsafe warn_block_escalations, review human_review_count,
    audits audit_required_count FROM tt, pt_"""
_SCENARIO_CHAIN = f""",
sw AS (SELECT workflow_id, arg_min(workflow_template, ("timestamp", request_id, step_id)) scenario, count(*) calls,
    sum(latency_ms) lat, sum(estimated_cost_usd) cost, count(*) FILTER (trust_boundary IN {o.PROT}) prot,
    count(*) FILTER (risk_level = 'high' OR edge_risk_level = 'high') high FROM trace GROUP BY ALL),
sp AS (SELECT workflow_id, count(*) FILTER (recommended_decision <> 'SKIP_REDUNDANT_WITH_AUDIT') kept, sum(opt_latency) lat,
    sum(opt_cost) cost, count(*) FILTER (step_id <> -1 AND protected_boundary AND recommended_decision = 'KEEP') prot_kept,
    count(*) FILTER (step_id <> -1 AND risk_level = 'high'
      AND recommended_decision IN ('KEEP', 'HUMAN_REVIEW_REQUIRED')) high_kept FROM saved GROUP BY ALL),
so AS (SELECT scenario, count(*) workflows, CAST(sum(calls) AS BIGINT) calls, sum(lat) lat, sum(cost) cost, sum(prot) prot,
    sum(high) high FROM sw GROUP BY ALL),
sq AS (SELECT scenario, CAST(sum(kept) AS BIGINT) kept, sum(p.lat) lat, sum(p.cost) cost, sum(prot_kept) prot_kept,
    sum(high_kept) high_kept FROM sw JOIN sp p USING (workflow_id) GROUP BY ALL)"""
_SCENARIOS = f"""SELECT so.scenario, workflows workflow_count, calls original_guardrail_calls, kept optimized_guardrail_calls,
    {o.savings_columns('so', 'sq', 'call_reduction_percent')},
    {o._pct('prot_kept', 'prot', '100.0')} boundary_coverage_percent,
    {o._pct('high_kept', 'high', '100.0')} high_risk_preservation_percent FROM so JOIN sq ON so.scenario IS NOT DISTINCT FROM sq.scenario"""
_MATRIX_CHAIN = f""",
bt AS (SELECT trust_boundary, sum(n) n FROM (SELECT trust_boundary, 1 n FROM trace UNION ALL
    SELECT unnest(['USER_TO_AGENT', 'AGENT_TO_TOOL', 'TOOL_TO_AGENT', 'AGENT_TO_FINAL_RESPONSE']), 0) GROUP BY ALL),
bp AS (SELECT trust_boundary, count(*) FILTER (recommended_decision = 'KEEP' OR
      (recommended_decision = 'HUMAN_REVIEW_REQUIRED' AND trust_boundary IN {o.PROT})) kept,
    count(*) FILTER (recommended_decision IN {o.OPT}) optimized,
    count(*) FILTER (recommended_decision = 'HUMAN_REVIEW_REQUIRED') review FROM plan WHERE step_id <> -1 GROUP BY ALL),
matrix AS (SELECT trust_boundary, CAST(n AS BIGINT) original_checks, coalesce(kept, 0) preserved_checks,
    {o._pct('coalesce(kept, 0)', 'n', '100.0')} coverage_percent, coalesce(optimized, 0) optimized_checks,
    coalesce(review, 0) human_review_checks FROM bt LEFT JOIN bp USING (trust_boundary))"""
_EXPLAIN_CHAIN = """,
rt AS (SELECT workflow_id, request_id, min("timestamp") seen FROM trace GROUP BY ALL),
pr AS (SELECT p.*, (seen, p.request_id, path_idx, step_id) place FROM plan p JOIN rt USING (workflow_id, request_id)
       WHERE step_id <> -1),
im AS (SELECT workflow_id, count(*) FILTER (safe_to_optimize) impact, arg_min(request_id, place) first_request,
    bool_or(recommended_decision = 'HUMAN_REVIEW_REQUIRED') reviewed,
    coalesce(list_sort(list(DISTINCT trust_boundary) FILTER (recommended_decision = 'KEEP')), []) kept
  FROM pr GROUP BY ALL ORDER BY impact DESC, workflow_id LIMIT 25),
gr AS (SELECT workflow_id, guardrail_type, policy_id, graph_path_id, count(*) n,
    arg_max(recommended_decision, place) dec, bool_or(audit_required) audited,
    coalesce(sum(original_latency_ms) FILTER (recommended_decision <> 'KEEP'), 0) lat,
    coalesce(sum(original_cost_usd) FILTER (recommended_decision <> 'KEEP'), 0) cost
  FROM pr SEMI JOIN im USING (workflow_id) WHERE reused_from_step_id IS NOT NULL AND policy_id IS NOT NULL
  GROUP BY workflow_id, guardrail_type, policy_id, graph_path_id
  QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY n DESC, guardrail_type, policy_id, graph_path_id) = 1),
ex AS (SELECT im.*, gr.* EXCLUDE (workflow_id), coalesce(path.txt, '') txt, CASE dec WHEN 'SKIP_REDUNDANT_WITH_AUDIT'
    THEN 'the duplicate checks occurred only on AGENT_TO_AGENT_INTERNAL edges, the previous result was PASS, the text hash did not change, and risk was low, the optimizer recommends SKIP_REDUNDANT_WITH_AUDIT for ' || n || ' downstream check(s) on internal handoffs'
    WHEN 'REUSE_PREVIOUS_DECISION' THEN 'risk was medium, so the prior decision is reused with an audit trail rather than fully skipped, the optimizer recommends REUSE_PREVIOUS_DECISION for ' || n || ' downstream check(s)'
    WHEN 'HUMAN_REVIEW_REQUIRED' THEN 'the duplicate involved high risk or a conflicting guardrail result, so it is never auto-optimized, the optimizer flags this path for HUMAN_REVIEW_REQUIRED'
    ELSE 'the check falls on a protected trust boundary and is always preserved, the optimizer recommends ' || dec END why
  FROM im JOIN gr USING (workflow_id) LEFT JOIN path ON path.workflow_id = im.workflow_id
    AND path.request_id = first_request AND path.pid = graph_path_id)"""
_EXPLAIN = """SELECT workflow_id, txt path_summary,
    guardrail_type || ' / ' || policy_id || ' repeated ' || n || 'x' duplicate_guardrail_pattern, dec recommended_action,
    'Workflow ' || workflow_id || ' contains a path ' || txt || '. The same ' || guardrail_type || ' under policy ' ||
      policy_id || ' was executed multiple times across internal agent handoffs. Because ' || why || '. Checks at ' ||
      CASE WHEN len(kept) = 0 THEN 'no additional boundaries' ELSE array_to_string(kept, ', ') END || ' are preserved.'
      safety_reasoning, array_to_string(kept, ';') boundary_checks_preserved,
    CAST(round(lat * CASE WHEN dec = 'SKIP_REDUNDANT_WITH_AUDIT' THEN 1.0 ELSE 0.8 END, 2) AS DOUBLE) latency_saved_ms,
    CAST(round(cost * CASE WHEN dec = 'SKIP_REDUNDANT_WITH_AUDIT' THEN 1.0 ELSE 0.8 END, 6) AS DOUBLE) cost_saved_usd,
    audited audit_required, reviewed human_review_required FROM ex"""
_INVARIANTS = {
    "optimized_on_protected_boundary": f"recommended_decision IN {o.OPT} AND protected_boundary",
    "optimized_high_risk": f"recommended_decision IN {o.OPT} AND risk_level = 'high'",
    "optimized_without_earlier_step": f"recommended_decision IN {o.OPT} AND reused_from_step_id IS NULL",
    "optimized_without_audit": f"recommended_decision IN {o.OPT} AND NOT audit_required",
    "optimized_on_dead_end": f"recommended_decision IN {o.OPT} AND path_type = 'orphan_branch'",
    "gap_row_with_step": "recommended_decision = 'MOVE_TO_BOUNDARY' AND step_id <> -1",
    "step_minus_one_without_gap": "recommended_decision <> 'MOVE_TO_BOUNDARY' AND step_id = -1",
}
_INVARIANT_SELECT = " UNION ALL ".join(
    f"SELECT '{n}' invariant, count(*) FILTER ({c}) violations FROM plan" for n, c in _INVARIANTS.items())

_PLAN = o.plan_sql()
_FULL = _PLAN + o.FEATURES + o.TOTALS

# Sources and the session import
_add("trace_f1", "orders", lambda a: a.trace.select(*TRACE.fieldNames()), "", _TRACE_SELECT)
_add("trace_events", "events", lambda a: a.trace, "", _TRACE_SELECT)
_add("session_trace", "sessions", lambda a: a.trace, "", _TRACE_SELECT)
_add("workflow_keys", "orders", lambda a: a.trace.select("workflow_id", "request_id").distinct(), "",
     "SELECT DISTINCT workflow_id, request_id FROM trace")

# Graph tables and paths
for _suffix, _trace in (("", "orders"), ("_events", "events"), ("_sessions", "sessions")):
    _add(f"nodes{_suffix}", _trace, lambda a: a.nodes, o.GRAPH, _NODES)
    _add(f"edges{_suffix}", _trace, lambda a: a.edges, o.GRAPH, _EDGES)
    _add(f"start_final_nodes{_suffix}", _trace, lambda a: graph.end_nodes(a.rollup).filter("kind <> 'leaf'"), o.GRAPH,
         "SELECT workflow_id, request_id, node_name, 'final' kind FROM ends WHERE kind = 0 UNION ALL "
         "SELECT workflow_id, request_id, s, 'start' FROM starts")
    _add(f"leaves{_suffix}", _trace, lambda a: graph.end_nodes(a.rollup).filter("kind = 'leaf'"), o.GRAPH,
         "SELECT workflow_id, request_id, node_name, 'leaf' kind FROM ends WHERE kind = 1")
    _add(f"paths{_suffix}", _trace, lambda a: a.paths, o.PATHS, _PATHS)
    _add(f"features{_suffix}", _trace, lambda a: a.features, o.PATHS + o.FEATURES, "SELECT * FROM features")
    _add(f"redundant_paths{_suffix}", _trace, lambda a: a.redundant, o.REDUNDANT, "SELECT * FROM redundant")
    _add(f"plan{_suffix}", _trace, lambda a: a.plan, _PLAN, _PLAN_SELECT)
    _add(f"plan_accounting{_suffix}", _trace, lambda a: a.accounting(), _PLAN, _ACCOUNTING)
    _add(f"edge_coverage{_suffix}", _trace, lambda a: audit.uncovered_edges(a.topologies), o.PATHS, _UNCOVERED)
    _add(f"metrics_overall{_suffix}", _trace, lambda a: a.metrics.select("overall.*"), _FULL, _OVERALL)
    _add(f"metrics_graph{_suffix}", _trace, lambda a: a.metrics.select("graph.*"), _FULL, _GRAPH)
    _add(f"metrics_safety{_suffix}", _trace, lambda a: a.metrics.select("safety.*"), _FULL, _SAFETY)
    _add(f"boundary_matrix{_suffix}", _trace, lambda a: a.boundary_matrix, _PLAN + _MATRIX_CHAIN, "SELECT * FROM matrix")
    _add(f"explanations{_suffix}", _trace, lambda a: a.explanations(), _PLAN + _EXPLAIN_CHAIN, _EXPLAIN)

_add("boundary_presence", "orders", lambda a: graph.boundary_presence(a.rollup), o.GRAPH,
     "SELECT workflow_id, request_id, bool_or(trust_boundary = 'AGENT_TO_FINAL_RESPONSE') has_final_boundary "
     "FROM edge GROUP BY ALL")
_add("node_order", "orders", lambda a: paths.ordered_nodes(a.topologies), o.GRAPH,
     "SELECT workflow_id, request_id, CAST(ord AS INTEGER) node_ord, node_name FROM node")
_add("edge_classes", "orders", lambda a: serving.edge_classes(a.edges), o.GRAPH,
     f"SELECT workflow_id, request_id, source_node, target_node, trust_boundary, CASE WHEN trust_boundary IN {o.PROT} "
     "THEN 'protected' ELSE 'internal' END edge_class, n guardrail_check_count FROM edge")

# Plan variants and result queries
_add("plan_strict", "orders", lambda a: a.plan, o.plan_sql(True), _PLAN_SELECT, strict=True)
_add("decision_counts", "orders", lambda a: plan_ops.decision_counts(a.plan), _PLAN,
     "SELECT recommended_decision, count(*) checks FROM plan GROUP BY ALL")
_add("plan_filtered", "orders", lambda a: serving.plan_rows(
        a.plan, [SKIP, REUSE, REVIEW], ["AGENT_TO_AGENT_INTERNAL"], ["low", "medium"], ["PII_CHECK", "TOXICITY_CHECK"]),
     _PLAN, _PLAN_SELECT + f" WHERE (recommended_decision IN {o.OPT} OR recommended_decision = 'HUMAN_REVIEW_REQUIRED') "
     "AND trust_boundary = 'AGENT_TO_AGENT_INTERNAL' AND risk_level IN ('low', 'medium') "
     "AND guardrail_type IN ('PII_CHECK', 'TOXICITY_CHECK')")
_add("row_savings", "orders", lambda a: metric_ops.with_savings(a.plan, a.policy).select(
        "workflow_id", "request_id", "step_id", "recommended_decision", "optimized_latency_ms", "optimized_cost_usd"),
     _PLAN, "SELECT workflow_id, request_id, step_id, recommended_decision, CAST(opt_latency AS DOUBLE) "
     "optimized_latency_ms, CAST(opt_cost AS DOUBLE) optimized_cost_usd FROM saved")
_add("redundant_filtered", "orders", lambda a: serving.redundant_rows(
        a.redundant, types=["PII_CHECK", "GROUNDING_CHECK"], blocks=["policy_drift", "orphan_branch"]), o.REDUNDANT,
     "SELECT * FROM redundant WHERE guardrail_type IN ('PII_CHECK', 'GROUNDING_CHECK') "
     "AND list_has_any(string_split(blocked_by, ';'), ['policy_drift', 'orphan_branch'])")
_add("blocked_by_tokens", "orders", lambda a: serving.block_reasons(a.redundant), o.REDUNDANT,
     "SELECT DISTINCT blocked_by FROM (SELECT unnest(string_split(blocked_by, ';')) blocked_by FROM redundant) "
     "WHERE blocked_by <> ''")
_add("risk_top10", "orders", lambda a: serving.riskiest(a.features), o.PATHS + o.FEATURES,
     "SELECT workflow_id, node_count, edge_count, redundant_internal_checks, missing_final_boundary_check, "
     "graph_risk_score, request_id FROM features ORDER BY graph_risk_score DESC, workflow_id, request_id LIMIT 10")
_add("scenario_metrics", "orders", lambda a: a.scenarios, _PLAN + _SCENARIO_CHAIN, _SCENARIOS)
_add("scenario_metrics_events", "events", lambda a: a.scenarios, _PLAN + _SCENARIO_CHAIN, _SCENARIOS)
_add("plan_strict_events", "events", lambda a: a.plan, o.plan_sql(True), _PLAN_SELECT, strict=True)
_add("rule_counts", "orders", lambda a: a.plan.groupBy("reason", "recommended_decision").agg(F.count("*").alias("checks")), _PLAN,
     "SELECT reason, recommended_decision, count(*) checks FROM plan GROUP BY ALL")
_add("gate_report", "orders", lambda a: metric_ops.safety_gates(a.metrics).unionByName(
        metric_ops.boundary_gates(a.boundary_matrix, a.policy)),
     _FULL + _MATRIX_CHAIN,
     "SELECT 'boundary_checks' gate, prot_kept preserved, prot original, prot_kept >= prot passes FROM tt, pt_ UNION ALL "
     "SELECT 'high_risk_checks', high_kept, high, high_kept >= high FROM tt, pt_ UNION ALL "
     f"SELECT trust_boundary, preserved_checks, original_checks, preserved_checks >= original_checks FROM matrix "
     f"WHERE trust_boundary IN {o.PROT}")
_add("overview", "orders", lambda a: a.metrics.select(
        "overall.original_guardrail_calls", "overall.optimized_guardrail_calls", "overall.guardrail_call_reduction_percent",
        "safety.boundary_coverage_preserved_percent", "safety.high_risk_preservation_percent", "safety.human_review_count"),
     _FULL, f"SELECT tt.calls original_guardrail_calls, pt_.kept optimized_guardrail_calls, "
     "coalesce(round(100 * (1 - CAST(pt_.kept AS DOUBLE) / nullif(tt.calls, 0)), 2), 0.0) guardrail_call_reduction_percent, "
     f"{o._pct('prot_kept', 'prot', '100.0')} boundary_coverage_preserved_percent, "
     f"{o._pct('high_kept', 'high', '100.0')} high_risk_preservation_percent, review human_review_count FROM tt, pt_")
_add("protected_ok", "orders", lambda a: serving.protected_fully_covered(a.boundary_matrix), _PLAN + _MATRIX_CHAIN,
     f"SELECT bool_and(coverage_percent = 100) all_protected_covered FROM matrix WHERE trust_boundary IN {o.PROT}")
_add("run_summary", "orders", lambda a: a.summary().select(
        "graph_nodes", "graph_edges", "redundant_rows", "original_guardrail_calls", "optimized_guardrail_calls",
        "workflows_analyzed", "human_review_count"),
     _FULL + ", " + o.REDUNDANT[len(o.WALKED):].lstrip(",\n "),
     "SELECT (SELECT count(*) FROM node) graph_nodes, (SELECT count(*) FROM edge) graph_edges, "
     "(SELECT count(*) FROM redundant) redundant_rows, tt.calls original_guardrail_calls, "
     "pt_.kept optimized_guardrail_calls, (SELECT count(DISTINCT workflow_id) FROM features) workflows_analyzed, "
     "pt_.review human_review_count FROM tt, pt_")

# One workflow, one scenario, the contracts
_add("workflow_detail", "orders", lambda a: serving.one_workflow(a.plan, serving.riskiest(a.features, 1).first().workflow_id),
     _PLAN + o.FEATURES, _PLAN_SELECT + " WHERE workflow_id = (SELECT workflow_id FROM features "
     "ORDER BY graph_risk_score DESC, workflow_id, request_id LIMIT 1)")
_COUNTED = ("count(*) \"rows\", count(*) FILTER (workflow_id IS NULL OR request_id IS NULL) without_key, count(*) FILTER (step_id IS NULL) "
            "without_step_id, count(*) FILTER (guardrail_type IS NULL) without_guardrail_type, count(*) FILTER (trust_boundary IS NULL) without_trust_boundary")
_add("contract_report", "orders", lambda a: contract_report({"trace": a.trace, "plan": a.plan, "redundant": a.redundant.withColumn(
        "step_id", F.col("duplicate_step_id")).select("workflow_id", "request_id", "step_id", "guardrail_type")}),
     _PLAN + ", " + o.REDUNDANT[len(o.WALKED):].lstrip(",\n "),
     f"SELECT 'trace' \"table\", {_COUNTED} FROM trace UNION ALL SELECT 'plan', {_COUNTED} FROM plan UNION ALL SELECT 'redundant', "
     + _COUNTED.replace("step_id IS NULL", "duplicate_step_id IS NULL").replace(
         "count(*) FILTER (trust_boundary IS NULL) without_trust_boundary", "CAST(NULL AS BIGINT)") + " FROM redundant")


def _scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of one scenario's workflows; a run of its own."""
    trace = analysis(spark, sf_dir, "orders").trace
    return flat(Analysis(trace, scenario="t1").plan)


_ENTRIES["scenario_run"] = (_scenario, o.query(
    o.ORDERS.replace("trace AS MATERIALIZED (", "all_trace AS MATERIALIZED (") + ", trace AS MATERIALIZED (SELECT * FROM all_trace WHERE workflow_template = 't1')",
    _PLAN, _PLAN_SELECT))


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order trace as JSON lines with cells that don't fit, by rule: how many records are accepted or rejected, and why."""
    t = analysis(spark, sf_dir, "orders").trace
    step, text = F.col("step_id"), F.to_json(F.struct(*[F.col(c) for c in TRACE.fieldNames()]))
    bad = (F.when(step % 7 == 3, F.regexp_replace(text, r'"step_id":\d+', '"step_id":"third"'))
           .when(step % 7 == 4, F.regexp_replace(F.regexp_replace(text, r'"latency_ms":[\d.]+', '"latency_ms":"slow"'),
                                                 r'"text_changed":\w+', '"text_changed":"perhaps"'))
           .when(step % 7 == 5, F.substring(text, 1, 60)).otherwise(text))
    judged = json_texts(t.select(bad.alias("line")), "line", F.lit("orders")).judged
    return judged.groupBy(F.coalesce(REASON, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("records"), F.sum("step_id").alias("steps"))


_ENTRIES["rejected_records"] = (_rejects, o.query(o.ORDERS, "", """SELECT CASE step_id % 7 WHEN 3 THEN 'step_id is no int'
    WHEN 4 THEN 'text_changed is no boolean; latency_ms is no decimal(18,6)' WHEN 5 THEN 'malformed JSON' ELSE 'accepted' END reason, count(*) records,
    CAST(CASE WHEN reason IN ('step_id is no int', 'malformed JSON') THEN NULL ELSE sum(step_id) END AS BIGINT) steps FROM trace GROUP BY reason, step_id % 7 IN (3, 4, 5)"""))

# Audits
_add("plan_invariants", "orders", lambda a: audit.plan_invariants(a.plan), _PLAN, _INVARIANT_SELECT)
_add("plan_invariants_events", "events", lambda a: audit.plan_invariants(a.plan), _PLAN, _INVARIANT_SELECT)
_add("scenario_reconcile", "orders", lambda a: audit.scenario_reconciliation(a.scenarios, a.metrics),
     _PLAN + o.TOTALS + _SCENARIO_CHAIN,
     "SELECT 'original_guardrail_calls' metric, (SELECT CAST(sum(calls) AS BIGINT) FROM so) scenario_sum, tt.calls overall, "
     "(SELECT sum(calls) FROM so) = tt.calls agrees FROM tt UNION ALL "
     "SELECT 'optimized_guardrail_calls', (SELECT CAST(sum(kept) AS BIGINT) FROM sq), pt_.kept, "
     "(SELECT sum(kept) FROM sq) = pt_.kept FROM pt_")
_add("feature_plan_agreement", "orders", lambda a: audit.optimized_without_redundancy(a.plan, a.features),
     _PLAN + o.FEATURES,
     f"SELECT DISTINCT workflow_id FROM plan WHERE recommended_decision IN {o.OPT} AND workflow_id NOT IN "
     "(SELECT workflow_id FROM features WHERE redundant_internal_checks > 0)")
