import hashlib
import json

from hopsight import Analysis
from hopsight.schema import TRACE, require_trace
from hopsight.sources import sinks
from hopsight.sources.sessions import read_sessions, sessions_to_trace
from hopsight.sources.trace import read_trace


def event(order, source, target, assessments=None, **over):
    body = {"eventOrder": order, "eventType": "ORCHESTRATION", "sourceNode": source, "targetNode": target,
            "inputText": "secret words", "latencyMs": 50.0, "usageUnits": 2, "timestamp": "2024-05-01T00:00:00Z", **over}
    if assessments is not None:
        body["guardrailTrace"] = {"guardrailId": "g", "guardrailVersion": "7", "assessments": assessments}
    return body


SESSION = {"agentId": "A1", "sessionId": "S1", "traceEvents": [
    event(3, "Planner", "FinalAnswer", [
        {"contextualGroundingPolicy": {"filters": [
            {"type": "GROUNDING", "score": 0.41239, "threshold": 0.75, "action": "NONE"},
            {"type": "RELEVANCE", "score": 0.1, "action": "BLOCKED"},
            {"type": "GROUNDING", "score": 0.5, "action": "SOMETHING"}]}}], eventType="POST_PROCESSING"),
    event(1, "User", "Planner", [
        {"contentPolicy": {"filters": [
            {"type": "PROMPT_ATTACK", "confidence": "LOW", "filterStrength": "MEDIUM", "action": "NONE"},
            {"type": "NEW_KIND", "confidence": "HIGH", "action": "INTERVENED"}]},
         "sensitiveInformationPolicy": {"piiEntities": []}, "wordPolicy": {}},
        {"wordPolicy": {"customWords": [{"match": "x", "action": "NONE"}]}}], eventType="PRE_PROCESSING"),
    event(2, "Planner", "PaymentTool", [
        {"sensitiveInformationPolicy": {"piiEntities": [{"action": "MASKED"}, {"action": "BLOCKED"}]},
         "wordPolicy": {"managedWordLists": []}},
        {"sensitiveInformationPolicy": {"piiEntities": [{"action": "INTERVENED"}]}},
        {"sensitiveInformationPolicy": None}], eventType="ACTION_GROUP_INVOCATION", outputText="changed"),
    event(2, "PaymentTool", "Planner", None, eventType="ACTION_GROUP_RESPONSE"),
]}


def trace_of(spark, tmp_path, data, name="s.json"):
    (tmp_path / name).write_text(json.dumps(data))
    return sessions_to_trace(read_sessions(spark, str(tmp_path / name)))


def test_every_policy_block(spark, tmp_path):
    df = trace_of(spark, tmp_path, SESSION)
    assert df.columns == TRACE.fieldNames()
    assert [f.dataType for f in df.schema] == [f.dataType for f in TRACE]
    got = [(r.step_id, r.target_node, r.guardrail_type, r.guardrail_result, r.severity, r.confidence)
           for r in df.orderBy("step_id").collect()]
    assert got == [
        (1, "Planner", "PROMPT_ATTACK_CHECK", "PASS", "MEDIUM", 0.4),
        (2, "Planner", "TOXICITY_CHECK", "BLOCK", "HIGH", 0.92),
        (3, "Planner", "PII_CHECK", "PASS", "NONE", 0.05),
        (4, "Planner", "SENSITIVE_INFO_CHECK", "PASS", "NONE", 0.8),
        (5, "PaymentTool", "PII_CHECK", "BLOCK", "HIGH", 0.9),
        (6, "PaymentTool", "SENSITIVE_INFO_CHECK", "PASS", "NONE", 0.05),
        (7, "PaymentTool", "PII_CHECK", "PASS", "NONE", 0.9),
        (8, "FinalAnswer", "GROUNDING_CHECK", "PASS", "MEDIUM", 0.412),
        (9, "FinalAnswer", "GROUNDING_CHECK", "WARN", "MEDIUM", 0.5)]


def test_hop_columns(spark, tmp_path):
    rows = {r.step_id: r for r in trace_of(spark, tmp_path, SESSION).collect()}
    tool = rows[5]
    assert (tool.workflow_id, tool.request_id, tool.node_id) == ("agent_A1", "S1", "agent_A1_PaymentTool")
    assert (tool.trust_boundary, tool.node_type, tool.step_type, tool.risk_level) == (
        "AGENT_TO_TOOL", "tool", "tool", "high")
    assert tool.text_changed and tool.text_hash == hashlib.sha256(b"changed").hexdigest()[:12]
    assert tool.input_text_hash == hashlib.sha256(b"secret words").hexdigest()[:12]
    assert tool.policy_id == "g:7" and float(tool.estimated_cost_usd) == 0.00015 and float(tool.latency_ms) == 50.0
    assert rows[1].trust_boundary == "USER_TO_AGENT" and rows[8].node_type == "final"
    assert not rows[1].text_changed and rows[1].risk_level == "low"


def test_defaults_and_empty_texts(spark, tmp_path):
    check = {"guardrailTrace": {"assessments": [{"sensitiveInformationPolicy": {}}]}}
    (r,) = trace_of(spark, tmp_path, {"traceEvents": [check]}).collect()
    assert (r.workflow_id, r.request_id, r.source_node, r.target_node, r.policy_id) == (
        "agent_unknown_agent", "unknown_session", "User", "FinalAnswer", "unspecified:1")
    assert r.text_hash == hashlib.sha256(b"").hexdigest()[:12] and not r.text_changed
    assert float(r.latency_ms) == 100.0 and r.trust_boundary == "AGENT_TO_AGENT_INTERNAL" and r.timestamp == ""


def test_lists_repeated_sessions_and_no_raw_text(spark, tmp_path):
    other = {**SESSION, "traceEvents": SESSION["traceEvents"][:2]}
    df = trace_of(spark, tmp_path, [SESSION, other, {"agentId": "Z", "sessionId": "Z"}])
    rows = df.collect()
    assert len(rows) == 15 and sorted(r.step_id for r in rows).count(1) == 2
    assert not any("secret" in str(v) for r in rows for v in r)
    empty = trace_of(spark, tmp_path, {"agentId": "Z"}, "e.json")
    assert empty.columns == TRACE.fieldNames() and empty.isEmpty()


def test_imported_sessions_run_through_the_analysis(spark, tmp_path):
    trace = require_trace(trace_of(spark, tmp_path, SESSION))
    plan = Analysis(trace).plan
    assert {r.step_id for r in plan.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9} - {r.step_id for r in
            Analysis(trace).accounting().filter("problem = 'missing_from_plan'").collect()}


def test_trace_round_trips(spark, tmp_path):
    trace = trace_of(spark, tmp_path, SESSION)
    for format in ("parquet", "csv", "json"):
        sinks.write_trace(trace, f"{tmp_path}/out/trace_{format}", format)
        back = read_trace(spark, f"{tmp_path}/out/trace_{format}", format)
        assert sorted(map(str, back.collect())) == sorted(map(str, trace.collect()))
