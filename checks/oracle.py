"""The same results in SQL, per workflow and without topologies, for side-by-side comparison."""

from __future__ import annotations

# Vocabulary of the trace and session formats.
CHECK_TYPES = ["PII_CHECK", "PROMPT_ATTACK_CHECK", "TOXICITY_CHECK", "SENSITIVE_INFO_CHECK", "GROUNDING_CHECK"]
EVENT_TYPES = ["ORCHESTRATION", "ACTION_GROUP_INVOCATION", "ACTION_GROUP_RESPONSE", "KNOWLEDGE_BASE_LOOKUP",
               "KNOWLEDGE_BASE_RESPONSE", "SOMETHING_ELSE"]
EVENT_BOUNDARIES = """('PRE_PROCESSING', 'USER_TO_AGENT'), ('ORCHESTRATION', 'AGENT_TO_AGENT_INTERNAL'),
  ('ACTION_GROUP_INVOCATION', 'AGENT_TO_TOOL'), ('ACTION_GROUP_RESPONSE', 'TOOL_TO_AGENT'),
  ('KNOWLEDGE_BASE_LOOKUP', 'AGENT_TO_TOOL'), ('KNOWLEDGE_BASE_RESPONSE', 'TOOL_TO_AGENT'),
  ('POST_PROCESSING', 'AGENT_TO_FINAL_RESPONSE')"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _hash(text: str) -> str:
    return f"substr(sha256({text}), 1, 12)"


ORDERS = f"""
li AS (SELECT l.*, o.*, row_number() OVER w - 1 pos, count(*) OVER (PARTITION BY l_orderkey) - 1 last
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus)),
lt AS (SELECT *, CASE WHEN pos = last AND o_orderstatus <> 'P' THEN 'FinalAnswer' WHEN l_discount >= 0.09::DOUBLE
    THEN 'Tool' || (l_suppkey % 2) ELSE 'Agent' || (l_suppkey % 5) END tgt,
  pos - CASE WHEN l_partkey % 5 = 0 AND pos >= 2 THEN 2 ELSE 1 END from_pos FROM li),
ls AS (SELECT a.*, coalesce(b.tgt, 'User') src FROM lt a LEFT JOIN lt b ON a.l_orderkey = b.l_orderkey AND a.from_pos = b.pos),
lk AS (SELECT *, CASE WHEN tgt = 'FinalAnswer' THEN 'final' WHEN tgt LIKE 'Tool%' THEN 'tool' ELSE 'agent' END kind,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '4-NOT SPECIFIED' THEN 'unknown' WHEN '5-LOW' THEN 'low'
    ELSE 'medium' END risk, l_tax >= 0.07::DOUBLE changed,
  CASE WHEN l_quantity < 3 THEN 'WARN' WHEN l_quantity < 5 THEN 'BLOCK' ELSE 'PASS' END res FROM ls),
trace AS MATERIALIZED (SELECT
  'wf_' || o_custkey workflow_id, 'req_' || l_orderkey request_id, CAST(pos + 1 AS INTEGER) step_id,
  'req_' || l_orderkey || '_' || tgt node_id, src source_node, tgt target_node, kind node_type, kind step_type, tgt agent_name,
  {_list(CHECK_TYPES)}[l_partkey % 2 * (1 + l_partkey % 3) + 1] guardrail_type,
  'policy_v' || CASE WHEN l_discount = 0.05::DOUBLE THEN '2' ELSE '1' END policy_id,
  {_hash("'text_' || (o_custkey % 10 + changed::INT)")} text_hash, {_hash("'text_' || (o_custkey % 10)")} input_text_hash,
  {_hash("'text_' || (o_custkey % 10 + changed::INT)")} output_text_hash, changed text_changed,
  CASE WHEN src = 'User' THEN 'USER_TO_AGENT' WHEN tgt = 'FinalAnswer' THEN 'AGENT_TO_FINAL_RESPONSE'
    WHEN tgt LIKE 'Tool%' THEN 'AGENT_TO_TOOL' WHEN src LIKE 'Tool%' THEN 'TOOL_TO_AGENT'
    WHEN l_tax = 0.08::DOUBLE THEN 'AGENT_TO_ARCHIVE' ELSE 'AGENT_TO_AGENT_INTERNAL' END trust_boundary,
  risk risk_level, CASE WHEN l_quantity = 50 THEN 'high' ELSE risk END edge_risk_level, res guardrail_result,
  CASE res WHEN 'BLOCK' THEN 'HIGH' WHEN 'WARN' THEN 'MEDIUM' ELSE 'NONE' END severity, CAST(0.5 AS DOUBLE) confidence,
  CAST(l_quantity * 10 + l_tax * 100 AS DECIMAL(18, 6)) latency_ms,
  CAST(CAST(floor(l_extendedprice) AS DECIMAL(18, 6)) / 1000000 AS DECIMAL(18, 6)) estimated_cost_usd,
  CAST(date_trunc('second', l_shipdate) AS VARCHAR) "timestamp",
  CASE WHEN o_custkey % 7 <> 6 THEN 't' || (o_custkey % 7) END workflow_template, 'b' || o_orderstatus behavior_pattern
  FROM lk, (VALUES (0), (1)) twice(copy) WHERE copy = 0 OR (l_tax = 0 AND l_quantity > 25))"""

EVENTS = f"""
ev AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) "day", CASE event_type WHEN 'purchase' THEN 'FinalAnswer'
         WHEN 'error' THEN 'LookupTool' ELSE event_type || 'Agent' END tgt FROM events),
ew AS (SELECT *, row_number() OVER w step_id, coalesce(lag(tgt) OVER w, 'User') src
       FROM ev WINDOW w AS (PARTITION BY user_id, "day" ORDER BY ts, event_id)),
ek AS (SELECT *, CASE WHEN tgt = 'FinalAnswer' THEN 'final' WHEN tgt = 'LookupTool' THEN 'tool' ELSE 'agent' END kind,
         CASE WHEN "value" < 20 THEN 'low' WHEN "value" < 60 THEN 'medium' WHEN "value" < 150 THEN 'high'
              ELSE 'unknown' END risk FROM ew),
trace AS MATERIALIZED (SELECT
  'wf_' || user_id workflow_id, 'req_' || user_id || '_' || "day" request_id, CAST(step_id AS INTEGER) step_id,
  'req_' || user_id || '_' || "day" || '_' || tgt node_id, src source_node, tgt target_node, kind node_type,
  kind step_type, tgt agent_name, {_list(CHECK_TYPES)}[event_id % 3 + 1] guardrail_type,
  'policy_v' || (user_id % 2) policy_id, {_hash("'text_' || (user_id % 4)")} text_hash,
  {_hash("'text_' || (user_id % 4)")} input_text_hash, {_hash("'text_' || (user_id % 4)")} output_text_hash,
  false text_changed,
  CASE WHEN src = 'User' THEN 'USER_TO_AGENT' WHEN tgt = 'FinalAnswer' THEN 'AGENT_TO_FINAL_RESPONSE'
       WHEN tgt = 'LookupTool' THEN 'AGENT_TO_TOOL' WHEN src = 'LookupTool' THEN 'TOOL_TO_AGENT'
       ELSE 'AGENT_TO_AGENT_INTERNAL' END trust_boundary,
  risk risk_level, risk edge_risk_level,
  CASE event_id % 10 WHEN 0 THEN 'WARN' WHEN 1 THEN 'BLOCK' ELSE 'PASS' END guardrail_result, 'NONE' severity,
  CAST(0.5 AS DOUBLE) confidence, CAST("value" AS DECIMAL(18, 6)) latency_ms,
  CAST(CAST(floor("value") AS DECIMAL(18, 6)) / 1000000 AS DECIMAL(18, 6)) estimated_cost_usd,
  CAST(date_trunc('second', ts) AS VARCHAR) "timestamp", 'sessions' workflow_template, 'events' behavior_pattern
  FROM ek)"""


def _session_target(at: str) -> str:
    return (f"CASE WHEN {at} = 0 THEN 'PlannerAgent' WHEN {at} = last THEN 'FinalAnswer' "
            f"WHEN {at} % 5 = 2 THEN 'PaymentAgent' WHEN {at} % 5 = 3 THEN 'ComplianceAgent' "
            f"ELSE 'Agent' || {at} END")


SESSIONS = f"""
cp AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 pos,
              count(*) OVER (PARTITION BY conv_id) - 1 last FROM conversations),
cv AS (SELECT *, (conv_id * 3 + pos) % 8 v,
         CASE WHEN pos = 0 THEN 'PRE_PROCESSING' WHEN pos = last THEN 'POST_PROCESSING'
              ELSE {_list(EVENT_TYPES)}[(conv_id + pos) % 6 + 1] END et,
         CASE WHEN pos = 0 THEN 'User' ELSE {_session_target('(pos - 1)')} END src, {_session_target('pos')} tgt,
         CASE WHEN pos % 8 = 5 THEN '' WHEN pos % 4 = 3 THEN text || ' .' ELSE text END out_text FROM cp),
eb(et, bnd) AS (VALUES {EVENT_BOUNDARIES}),
vc(v, i, ct, res, conf, sev) AS (VALUES
  (0, 0, 'PROMPT_ATTACK_CHECK', 'PASS', 0.4, 'LOW'), (0, 1, 'PII_CHECK', 'PASS', 0.05, 'NONE'),
  (1, 0, 'PII_CHECK', 'PASS', 0.05, 'NONE'), (2, 0, 'PII_CHECK', 'WARN', 0.9, 'MEDIUM'),
  (3, 0, 'PII_CHECK', 'BLOCK', 0.9, 'HIGH'), (4, 0, 'SENSITIVE_INFO_CHECK', 'BLOCK', 0.8, 'HIGH'),
  (5, 0, 'TOXICITY_CHECK', 'BLOCK', 0.92, 'HIGH'), (6, 0, 'GROUNDING_CHECK', 'PASS', 0.6, 'MEDIUM')),
cb AS (SELECT cv.*, i, ct, res, conf, sev, coalesce(bnd, 'AGENT_TO_AGENT_INTERNAL') bnd,
         row_number() OVER (PARTITION BY conv_id ORDER BY pos, i) step_id,
         CASE WHEN conv_id % 7 = 0 OR src = 'PaymentAgent' OR tgt = 'PaymentAgent' THEN 'high'
              WHEN src = 'ComplianceAgent' OR tgt = 'ComplianceAgent' THEN 'medium' ELSE 'low' END risk
       FROM cv JOIN vc USING (v) LEFT JOIN eb USING (et)),
ck AS (SELECT *, CASE bnd WHEN 'AGENT_TO_TOOL' THEN 'tool' WHEN 'AGENT_TO_FINAL_RESPONSE' THEN 'final'
                 ELSE 'agent' END kind FROM cb),
trace AS MATERIALIZED (SELECT
  'agent_bot' || (conv_id % 5) workflow_id, 'sess_' || conv_id request_id,
  CAST(step_id AS INTEGER) step_id, 'agent_bot' || (conv_id % 5) || '_' || tgt node_id, src source_node,
  tgt target_node, kind node_type, kind step_type, tgt agent_name, ct guardrail_type,
  'g' || (conv_id % 3) || ':' || CASE WHEN pos % 2 = 1 THEN '2' ELSE '1' END policy_id,
  {_hash('out_text')} text_hash, {_hash('text')} input_text_hash, {_hash('out_text')} output_text_hash,
  {_hash('out_text')} <> {_hash('text')} text_changed, bnd trust_boundary, risk risk_level, risk edge_risk_level,
  res guardrail_result, sev severity, CAST(conf AS DOUBLE) confidence, CAST(50 + pos AS DECIMAL(18, 6)) latency_ms,
  CAST(round(CASE WHEN pos % 2 = 0 THEN pos % 3 + 1 ELSE 1 END * CAST(0.000075 AS DOUBLE), 6) AS DECIMAL(18, 6))
    estimated_cost_usd,
  '2024-01-01T' || lpad(CAST(pos % 24 AS VARCHAR), 2, '0') || ':00:00Z' "timestamp",
  'session_import' workflow_template, 'session_trace' behavior_pattern FROM ck)"""

PROT = "('USER_TO_AGENT', 'AGENT_TO_TOOL', 'TOOL_TO_AGENT', 'AGENT_TO_FINAL_RESPONSE')"
OPT = "('SKIP_REDUNDANT_WITH_AUDIT', 'REUSE_PREVIOUS_DECISION')"

GRAPH = """
firsts AS (SELECT * FROM trace QUALIFY row_number() OVER (
  PARTITION BY workflow_id, request_id, source_node, target_node ORDER BY step_id) = 1),
ecount AS (SELECT workflow_id, request_id, source_node, target_node, count(*) n, bool_or(text_changed) changed,
    count(*) FILTER (text_changed) n_changed, count(DISTINCT coalesce(policy_id, '~null')) n_policies,
    count(*) FILTER (guardrail_result = 'WARN') n_warn, count(*) FILTER (guardrail_result = 'BLOCK') n_block
  FROM trace GROUP BY ALL),
edge AS MATERIALIZED (SELECT f.workflow_id, f.request_id, f.source_node, f.target_node, f.trust_boundary, f.edge_risk_level,
    f.guardrail_type, f.step_id, n, changed, n_changed, n_policies, n_warn, n_block,
    row_number() OVER (PARTITION BY f.workflow_id, f.request_id ORDER BY f.step_id) - 1 AS eo
  FROM firsts f JOIN ecount USING (workflow_id, request_id, source_node, target_node)),
roles AS (
  SELECT workflow_id, request_id, source_node node_name, step_id, 0 AS role, request_id || '_' || source_node node_id,
    CASE WHEN source_node = 'User' THEN 'user' ELSE 'agent' END node_type, source_node agent_name, risk_level,
    input_text_hash, input_text_hash output_text_hash FROM trace
  UNION ALL
  SELECT workflow_id, request_id, target_node, step_id, 1, node_id, node_type, agent_name, risk_level, input_text_hash,
    output_text_hash FROM trace),
node0 AS (SELECT * FROM roles QUALIFY row_number() OVER (
  PARTITION BY workflow_id, request_id, node_name ORDER BY step_id, role) = 1),
node AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM trace t WHERE t.workflow_id = n.workflow_id
      AND t.request_id = n.request_id AND t.target_node = n.node_name) checks,
    row_number() OVER (PARTITION BY workflow_id, request_id ORDER BY step_id, role) - 1 AS ord FROM node0 n),
starts AS (SELECT workflow_id, request_id, arg_min(node_name, ord) AS s FROM node WHERE node_type = 'user' GROUP BY ALL),
ends AS (SELECT n.workflow_id, n.request_id, n.node_name, n.ord,
    CASE WHEN n.node_type = 'final' THEN 0 ELSE 1 END kind
  FROM node n LEFT JOIN starts USING (workflow_id, request_id)
  WHERE n.node_name IS DISTINCT FROM s AND (n.node_type = 'final' OR NOT EXISTS (
    SELECT 1 FROM edge e WHERE e.workflow_id = n.workflow_id AND e.request_id = n.request_id
      AND e.source_node = n.node_name)))"""

PATHS = GRAPH + """,
walk AS (
  SELECT workflow_id, request_id, s AS at, [s] AS names, CAST([] AS BIGINT[]) AS eos FROM starts
  UNION ALL
  SELECT w.workflow_id, w.request_id, e.target_node, list_append(w.names, e.target_node), list_append(w.eos, e.eo)
  FROM walk w JOIN edge e ON e.workflow_id = w.workflow_id AND e.request_id = w.request_id AND e.source_node = w.at
  WHERE NOT list_contains(w.names, e.target_node)),
ended AS MATERIALIZED (SELECT w.*, kind, x.ord FROM walk w JOIN ends x ON x.workflow_id = w.workflow_id
    AND x.request_id = w.request_id AND x.node_name = w.at),
covered AS (SELECT DISTINCT workflow_id, request_id, unnest(eos) eo FROM ended WHERE kind = 0),
dead AS (SELECT DISTINCT u.workflow_id, u.request_id, u.eos FROM (
    SELECT workflow_id, request_id, eos, unnest(eos) eo FROM ended WHERE kind = 1) u
  ANTI JOIN covered USING (workflow_id, request_id, eo)),
path AS MATERIALIZED (SELECT workflow_id, request_id, idx, pt, names, eos,
    request_id || CASE pt WHEN 'final' THEN '_p' ELSE '_o' END || idx pid, array_to_string(names, ' -> ') txt
  FROM (SELECT e.*, CASE kind WHEN 0 THEN 'final' ELSE 'orphan_branch' END pt,
          row_number() OVER (PARTITION BY workflow_id, request_id ORDER BY kind, ord, eos) - 1 AS idx
        FROM ended e WHERE kind = 0 OR EXISTS (SELECT 1 FROM dead d WHERE d.workflow_id = e.workflow_id
          AND d.request_id = e.request_id AND d.eos = e.eos)))"""

WALKED = PATHS + """,
path_edge AS (SELECT workflow_id, request_id, idx, pt, pid, txt, unnest(eos) eo, generate_subscripts(eos, 1) pos FROM path),
on_edge AS (SELECT t.*, e.eo, e.trust_boundary eb, e.edge_risk_level er FROM trace t
  JOIN edge e USING (workflow_id, request_id, source_node, target_node)),
pc AS MATERIALIZED (SELECT c.*, idx, pt, pid, txt, pos, lag(c.step_id) OVER w p_step, lag(c.risk_level) OVER w p_risk,
    lag(c.text_hash) OVER w p_text, lag(c.policy_id) OVER w p_pol, lag(c.guardrail_result) OVER w p_res,
    row_number() OVER w seq
  FROM on_edge c JOIN path_edge p USING (workflow_id, request_id, eo)
  WINDOW w AS (PARTITION BY workflow_id, request_id, idx, guardrail_type ORDER BY step_id))"""


def plan_sql(strict: bool = False) -> str:
    if strict:
        tail = ("WHEN risk_level IN ('low', 'medium') THEN 'strict_mode_reuse_previous_decision' "
                "ELSE 'strict_mode_escalates_uncertain_case' END")
    else:
        tail = ("WHEN risk_level = 'low' THEN 'low_risk_internal_duplicate_same_text_same_policy_previous_pass' "
                "WHEN risk_level = 'medium' THEN 'medium_risk_internal_duplicate_reuse_prior_decision' "
                "ELSE 'unclassified_risk_escalated_for_safety' END")
    return WALKED + f""",
ruled AS (SELECT *, CASE
    WHEN eb IN {PROT} THEN 'protected_trust_boundary_always_kept'
    WHEN (risk_level = 'high' OR er = 'high') AND p_step IS NOT NULL THEN 'high_risk_duplicate_requires_human_review'
    WHEN risk_level = 'high' OR er = 'high' THEN 'high_risk_check_kept'
    WHEN p_step IS NULL THEN 'first_occurrence_on_this_graph_path'
    WHEN p_res IN ('WARN', 'BLOCK') THEN 'previous_result_' || p_res || '_not_reusable'
    WHEN text_changed OR text_hash IS DISTINCT FROM p_text THEN 'text_changed_since_previous_check'
    WHEN policy_id IS DISTINCT FROM p_pol THEN 'policy_drift_since_previous_check'
    WHEN guardrail_result IS DISTINCT FROM p_res THEN 'conflicting_guardrail_results'
    {tail} why FROM pc),
judged AS (SELECT *, CASE
    WHEN why IN ('high_risk_duplicate_requires_human_review', 'conflicting_guardrail_results',
      'unclassified_risk_escalated_for_safety', 'strict_mode_escalates_uncertain_case') THEN 'HUMAN_REVIEW_REQUIRED'
    WHEN why LIKE 'low_risk_internal%' THEN 'SKIP_REDUNDANT_WITH_AUDIT'
    WHEN why LIKE 'medium_risk_internal%' OR why = 'strict_mode_reuse_previous_decision' THEN 'REUSE_PREVIOUS_DECISION'
    ELSE 'KEEP' END dec FROM ruled),
chosen AS (SELECT *, pt = 'orphan_branch' AND dec IN {OPT} held FROM judged
  QUALIFY row_number() OVER (PARTITION BY workflow_id, request_id, step_id ORDER BY idx, pos, seq) = 1),
gap AS (SELECT workflow_id, request_id, arg_min(guardrail_type, step_id) gt FROM edge GROUP BY ALL
  HAVING NOT bool_or(trust_boundary = 'AGENT_TO_FINAL_RESPONSE')),
first_final AS (SELECT workflow_id, request_id, arg_min(node_name, ord) f FROM node WHERE node_type = 'final' GROUP BY ALL),
plan AS MATERIALIZED (
  SELECT workflow_id, request_id, step_id, node_id, source_node, target_node, agent_name, guardrail_type, policy_id,
    text_hash, eb trust_boundary, risk_level, latency_ms original_latency_ms, estimated_cost_usd original_cost_usd,
    CASE WHEN held THEN 'KEEP' ELSE dec END recommended_decision,
    CASE WHEN held THEN 'orphan_branch_dead_end_conservatively_kept;' || why ELSE why END reason,
    CASE WHEN dec <> 'KEEP' THEN p_step END reused_from_step_id, dec IN {OPT} AND NOT held safe_to_optimize,
    pid graph_path_id, pt path_type, eb IN {PROT} protected_boundary, dec <> 'KEEP' AND NOT held audit_required,
    idx path_idx FROM chosen
  UNION ALL
  SELECT workflow_id, request_id, -1, request_id || '_' || coalesce(f, 'FinalAnswer') || '_boundary_gap', '?',
    coalesce(f, 'FinalAnswer'), coalesce(f, 'FinalAnswer'), gt, NULL, NULL, 'AGENT_TO_FINAL_RESPONSE', 'unknown', 0, 0,
    'MOVE_TO_BOUNDARY', 'no_guardrail_check_found_on_agent_to_final_response_boundary', NULL, false,
    request_id || '_p0', 'boundary_gap', true, true, NULL
  FROM gap LEFT JOIN first_final USING (workflow_id, request_id)),
saved AS (SELECT *, CASE WHEN step_id = -1 THEN 260.0 WHEN recommended_decision = 'SKIP_REDUNDANT_WITH_AUDIT' THEN 0
      WHEN recommended_decision = 'REUSE_PREVIOUS_DECISION' THEN original_latency_ms * 0.2
      ELSE original_latency_ms END opt_latency,
    CASE WHEN step_id = -1 THEN 0.0003 WHEN recommended_decision = 'SKIP_REDUNDANT_WITH_AUDIT' THEN 0
      WHEN recommended_decision = 'REUSE_PREVIOUS_DECISION' THEN original_cost_usd * 0.2
      ELSE original_cost_usd END opt_cost FROM plan)"""


REDUNDANT = WALKED + f""",
flags AS (SELECT *, coalesce(risk_level = 'high', false) OR coalesce(p_risk = 'high', false) OR coalesce(er = 'high', false) hi,
    guardrail_result IS DISTINCT FROM p_res conflict FROM pc WHERE p_step IS NOT NULL),
blocks AS (SELECT *, concat_ws(';', CASE WHEN eb IN {PROT} THEN 'protected_boundary' END,
    CASE WHEN hi THEN 'high_risk' END,
    CASE WHEN text_changed OR text_hash IS DISTINCT FROM p_text THEN 'text_changed' END,
    CASE WHEN policy_id IS DISTINCT FROM p_pol THEN 'policy_drift' END,
    CASE WHEN p_res IN ('WARN', 'BLOCK') THEN 'previous_unsafe_result' END,
    CASE WHEN pt = 'orphan_branch' THEN 'orphan_branch' END,
    CASE WHEN conflict AND NOT hi THEN 'conflicting_result' END) bl FROM flags),
redundant AS MATERIALIZED (SELECT workflow_id, request_id, pid path_id, pt path_type, txt path_nodes, guardrail_type,
    policy_id, text_hash, p_step first_step_id, step_id duplicate_step_id,
    CASE WHEN bl = '' THEN 'same_guardrail_same_text_same_policy' ELSE bl END duplicate_reason,
    NOT hi AND NOT conflict AND bl = '' optimization_allowed, bl blocked_by,
    CASE WHEN hi OR conflict THEN 'HUMAN_REVIEW_REQUIRED' WHEN bl <> '' THEN 'KEEP'
         WHEN risk_level = 'low' THEN 'SKIP_REDUNDANT_WITH_AUDIT' ELSE 'REUSE_PREVIOUS_DECISION' END
      recommended_decision FROM blocks)"""

FEATURES = f""",
fe AS (SELECT workflow_id, request_id, count(*) edge_count,
    count(*) FILTER (trust_boundary IN {PROT}) protected_boundary_count,
    count(*) FILTER (trust_boundary = 'AGENT_TO_AGENT_INTERNAL') internal_handoff_count,
    CAST(sum(n) AS BIGINT) calls, count(*) FILTER (edge_risk_level = 'high') high_risk_edge_count,
    NOT bool_or(trust_boundary = 'AGENT_TO_FINAL_RESPONSE') missing, count(*) FILTER (n_policies > 1) drift,
    CAST(sum(n_changed) AS BIGINT) mutations,
    CAST(sum(CASE WHEN trust_boundary <> 'AGENT_TO_AGENT_INTERNAL' AND edge_risk_level = 'high' THEN 3 ELSE 0 END
      + CASE WHEN trust_boundary IN ('AGENT_TO_TOOL', 'TOOL_TO_AGENT') THEN 2 ELSE 0 END + n_warn + 2 * n_block)
      AS BIGINT) points
  FROM edge GROUP BY ALL),
fn AS (SELECT workflow_id, request_id, count(*) node_count, count(*) FILTER (risk_level = 'high') high_risk_node_count
  FROM node GROUP BY ALL),
fo AS (SELECT t.*, e.eo, e.trust_boundary eb,
    row_number() OVER (PARTITION BY workflow_id, request_id, t.guardrail_type, policy_id, text_hash
      ORDER BY t.step_id, e.eo) again FROM trace t
  JOIN edge e USING (workflow_id, request_id, source_node, target_node)),
fd AS (SELECT workflow_id, request_id, count(*) FILTER (again = 2) dups,
    count(*) FILTER (again > 1 AND eb = 'AGENT_TO_AGENT_INTERNAL') redundant,
    count(*) - count(DISTINCT coalesce(text_hash, '~null')) repeated FROM fo GROUP BY ALL),
fp AS (SELECT workflow_id, request_id, count(*) path_count, CAST(max(len(eos)) AS BIGINT) longest FROM path GROUP BY ALL),
fs AS (SELECT workflow_id, request_id, idx, sum(n - 1) score FROM (
    SELECT workflow_id, request_id, idx, unnest(eos) eo FROM path) JOIN edge USING (workflow_id, request_id, eo) GROUP BY ALL),
fb AS (SELECT workflow_id, request_id, txt FROM fs JOIN path USING (workflow_id, request_id, idx)
  QUALIFY row_number() OVER (PARTITION BY workflow_id, request_id ORDER BY score DESC, idx) = 1),
features AS MATERIALIZED (SELECT workflow_id, request_id, node_count, edge_count, coalesce(longest, 0) max_path_length,
    calls total_guardrail_calls, dups duplicate_guardrail_groups, redundant redundant_internal_checks,
    protected_boundary_count, round(protected_boundary_count / edge_count, 3) boundary_guardrail_coverage,
    missing missing_final_boundary_check, drift policy_drift_count, mutations text_mutation_count,
    points + CASE WHEN missing THEN 2 ELSE 0 END + drift + mutations graph_risk_score,
    coalesce(txt, '') highest_redundancy_path, coalesce(path_count, 0) path_count, internal_handoff_count,
    high_risk_node_count, high_risk_edge_count, repeated repeated_text_hash_count,
    round(calls / edge_count, 3) guardrail_density,
    CASE WHEN internal_handoff_count = 0 THEN 0.0 ELSE round(redundant / internal_handoff_count, 3) END
      internal_redundancy_ratio
  FROM fe JOIN fn USING (workflow_id, request_id) JOIN fd USING (workflow_id, request_id)
  LEFT JOIN fp USING (workflow_id, request_id) LEFT JOIN fb USING (workflow_id, request_id))"""

TOTALS = f""",
tt AS (SELECT count(*) calls, sum(latency_ms) lat, sum(estimated_cost_usd) cost,
    count(*) FILTER (trust_boundary IN {PROT}) prot,
    count(*) FILTER (risk_level = 'high' OR edge_risk_level = 'high') high FROM trace),
pt_ AS (SELECT count(*) FILTER (recommended_decision <> 'SKIP_REDUNDANT_WITH_AUDIT') kept, sum(opt_latency) lat,
    sum(opt_cost) cost, count(*) FILTER (step_id <> -1) real_rows,
    count(*) FILTER (step_id <> -1 AND reused_from_step_id IS NOT NULL) reused,
    count(*) FILTER (recommended_decision IN {OPT}) optimized,
    count(*) FILTER (reused_from_step_id IS NOT NULL AND recommended_decision IN ('KEEP', 'HUMAN_REVIEW_REQUIRED')) blocked,
    count(*) FILTER (step_id <> -1 AND protected_boundary AND recommended_decision = 'KEEP') prot_kept,
    count(*) FILTER (step_id <> -1 AND risk_level = 'high'
      AND recommended_decision IN ('KEEP', 'HUMAN_REVIEW_REQUIRED')) high_kept,
    count(*) FILTER (step_id <> -1 AND protected_boundary AND recommended_decision = 'SKIP_REDUNDANT_WITH_AUDIT') false_skips,
    count(*) FILTER (reason = 'policy_drift_since_previous_check') drift,
    count(*) FILTER (reason = 'text_changed_since_previous_check') mutated,
    count(*) FILTER (regexp_matches(reason, 'previous_result_(?:WARN|BLOCK)')) unsafe,
    count(*) FILTER (recommended_decision = 'HUMAN_REVIEW_REQUIRED') review, count(*) FILTER (audit_required) audits
  FROM saved)"""


def _pct(part: str, whole: str, default: str) -> str:
    return (f"coalesce(round(100 * CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), 2), {default})")


def savings_columns(o: str, p: str, call_name: str) -> str:
    return (f"coalesce(round(100 * (1 - CAST({p}.kept AS DOUBLE) / nullif({o}.calls, 0)), 2), 0.0) {call_name}, "
            + _pct(f"(round({o}.lat, 2) - round({p}.lat, 2))", f"{o}.lat", "0.0") + " latency_saved_percent, "
            + _pct(f"(round({o}.cost, 4) - round({p}.cost, 4))", f"{o}.cost", "0.0") + " cost_saved_percent")


def query(trace: str, chain: str, select: str) -> str:
    return f"WITH RECURSIVE {trace}{',' if chain else ''}{chain.lstrip(',') if chain else ''}\n{select}"
