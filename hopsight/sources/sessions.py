"""Nested session JSON to the flat trace: one narrow job, no shuffle and no Python rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hopsight.policy import AGENT_TO_TOOL, INTERNAL, TO_FINAL, TOOL_TO_AGENT, USER_TO_AGENT
from hopsight.schema import MONEY, TRACE
from hopsight.sources.records import CORRUPT, FILE, REASON, RECORD, Checked

# Events come as JSON text, so that a null text and an absent one can be told apart.
SESSION = "agentId string, sessionId string, traceEvents array<string>"
# `wordPolicy` stays raw JSON: an empty object and an absent one mean different things. Numbers may be given as text.
EVENT = """
    eventOrder int, eventType string, sourceNode string, targetNode string, inputText string,
    outputText string, riskTag string, modelId string, latencyMs string, usageUnits string, timestamp string,
    guardrailTrace struct<guardrailId: string, guardrailVersion: string, assessments: array<struct<
      contentPolicy: struct<filters: array<struct<
        type: string, confidence: string, filterStrength: string, action: string>>>,
      sensitiveInformationPolicy: struct<piiEntities: array<struct<type: string, match: string, action: string>>>,
      wordPolicy: string,
      contextualGroundingPolicy: struct<filters: array<struct<
        type: string, score: string, threshold: string, action: string>>>>>>
"""
WORDS = "struct<customWords: array<struct<match: string, action: string>>>"

# Vocabulary of the session format and what each entry means in a trace.
EVENT_BOUNDARY = {
    "PRE_PROCESSING": USER_TO_AGENT,
    "ORCHESTRATION": INTERNAL,
    "ACTION_GROUP_INVOCATION": AGENT_TO_TOOL,
    "ACTION_GROUP_RESPONSE": TOOL_TO_AGENT,
    "KNOWLEDGE_BASE_LOOKUP": AGENT_TO_TOOL,
    "KNOWLEDGE_BASE_RESPONSE": TOOL_TO_AGENT,
    "POST_PROCESSING": TO_FINAL,
}
BOUNDARY_NODE_TYPE = {AGENT_TO_TOOL: "tool", TO_FINAL: "final"}
FILTER_CHECK = {"PROMPT_ATTACK": "PROMPT_ATTACK_CHECK"}
ACTION_RESULT = {
    "NONE": "PASS", "ANONYMIZED": "WARN", "MASKED": "WARN", "BLOCKED": "BLOCK",
    "GUARDRAIL_INTERVENED": "BLOCK", "INTERVENED": "BLOCK",
}
LABEL_CONFIDENCE = {"NONE": 0.05, "LOW": 0.4, "MEDIUM": 0.65, "HIGH": 0.92}
RISK_WORDS = {"finance": "high", "payment": "high", "health": "high", "medical": "high", "compliance": "medium"}
COST_PER_UNIT_USD = 0.000075


def session_records(spark: SparkSession, path: str | list[str], multiline: bool = True) -> Checked:
    """Sessions from files that hold one object, a list, or (not `multiline`) an object a line.

    Malformed files or lines, values of a wrong type anywhere in a session, and files without any JSON are rejects; a
    truncated file is one reject, with all its sessions.
    """
    raw = (spark.read.schema(f"{SESSION}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
           .json(path, multiLine=multiline).withColumn(FILE, F.col("_metadata.file_path")))
    checked = _judged(raw)
    if not multiline:
        return checked
    # file names and sizes only; the content is read of the smallest files
    blank = (spark.read.format("binaryFile").load(path).filter("length < 64").filter(F.trim(F.translate(F.col("content").cast("string"), "\t\n\r", "   ")) == "")
             .select(F.col("path").alias(FILE), F.lit("").alias(RECORD), F.lit("no JSON").alias(REASON)))
    return Checked(checked.judged.unionByName(blank, allowMissingColumns=True))


def read_sessions(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """One row per session object; reading a malformed one raises. `session_records` sets rejects apart instead."""
    return session_records(spark, path, multiline).strict()


def text_records(texts: DataFrame, column: str) -> Checked:
    """Sessions from a column of JSON texts, one object each."""
    parsed = F.from_json(column, f"{SESSION}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    return _judged(texts.select(F.lit(None).cast("string").alias(FILE), F.col(column).alias(RECORD), parsed.alias("s")).select(FILE, RECORD, "s.*"))


def parse_sessions(texts: DataFrame, column: str) -> DataFrame:
    """The rows of `read_sessions` from a column of JSON texts; a malformed one raises."""
    return text_records(texts, column).strict()


def _no_number(x: Column) -> Column:
    return x.isNotNull() & x.try_cast("double").isNull()


def _judged(raw: DataFrame) -> Checked:
    parsed = F.transform("traceEvents", lambda t: F.struct(t.alias("text"), F.from_json(
        t, f"{EVENT}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("event")))

    def broken(x: Column) -> Column:
        e = x.event
        scores = F.exists(e.guardrailTrace.assessments, lambda a: F.coalesce(F.exists(
            a.contextualGroundingPolicy.filters, lambda f: _no_number(f.score) | _no_number(f.threshold)), F.lit(False)))
        return (e.isNull() | e[CORRUPT].isNotNull() | _no_number(e.latencyMs) | _no_number(e.usageUnits)
                | F.coalesce(scores, F.lit(False)))

    at = F.array_position(F.transform("parsed", broken), True)
    events = F.transform("parsed", lambda x: x.event.dropFields(CORRUPT).withField("outputNull", F.when(
        x.event.outputText.isNull(), F.array_contains(F.json_object_keys(x.text), "outputText")).otherwise(F.lit(False))))
    reason = (F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed JSON or a value of a wrong type"))
              .when(F.coalesce(at, F.lit(0)) > 0, F.concat(F.lit("a value of a wrong type in traceEvents["), (at - 1).cast("string"), F.lit("]"))))
    record = F.coalesce(CORRUPT, F.col(RECORD) if RECORD in raw.columns else F.to_json(F.struct("agentId", "sessionId", "traceEvents")))
    return Checked(raw.withColumn("parsed", parsed).select("agentId", "sessionId", events.alias("traceEvents"), FILE,
                                                           record.alias(RECORD), reason.alias(REASON)))


def _lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit(""))), F.lit(default))


def _check(kind, result, confidence, severity) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for c, n in (
        (kind, "guardrail_type"), (result, "guardrail_result"), (confidence, "confidence"), (severity, "severity"))])


def _result(action: Column) -> Column:
    return _lookup(ACTION_RESULT, F.coalesce(action, F.lit("NONE")), "PASS")


def _optional(condition: Column, check: Column) -> Column:
    return F.array_compact(F.array(F.when(condition, check)))


def _some(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def _content(a: Column) -> Column:
    return F.coalesce(F.transform(a.contentPolicy.filters, lambda f: _check(
        _lookup(FILTER_CHECK, f["type"], "TOXICITY_CHECK"), _result(f.action),
        _lookup(LABEL_CONFIDENCE, F.coalesce(f.confidence, F.lit("NONE")), 0.05),
        F.coalesce(f.filterStrength, f.confidence, F.lit("NONE")))), F.array())


def _personal_data(a: Column) -> Column:
    """One check per assessment: the worst action over all entities."""
    found = a.sensitiveInformationPolicy.piiEntities
    blocked = F.exists(found, lambda e: e.action.isin("BLOCKED", "GUARDRAIL_INTERVENED"))
    masked = F.exists(found, lambda e: e.action.isin("ANONYMIZED", "MASKED"))
    check = (F.when(~_some(found), _check("PII_CHECK", "PASS", 0.05, "NONE"))
             .when(blocked, _check("PII_CHECK", "BLOCK", 0.9, "HIGH"))
             .when(masked, _check("PII_CHECK", "WARN", 0.9, "MEDIUM"))
             .otherwise(_check("PII_CHECK", "PASS", 0.9, "NONE")))
    return _optional(a.sensitiveInformationPolicy.isNotNull(), check)


def _words(a: Column) -> Column:
    words = F.from_json(a.wordPolicy, WORDS).customWords
    blocked = F.coalesce(F.exists(words, lambda w: w.action == "BLOCKED"), F.lit(False))
    return _optional(
        _some(F.json_object_keys(a.wordPolicy)),
        _check("SENSITIVE_INFO_CHECK", F.when(blocked, "BLOCK").otherwise("PASS"),
               F.when(_some(words), 0.8).otherwise(0.05), F.when(blocked, "HIGH").otherwise("NONE")))


def _grounding(a: Column) -> Column:
    def check(f: Column) -> Column:
        score = F.coalesce(f.score.try_cast("double"), F.lit(1.0))
        enough = score >= F.coalesce(f.threshold.try_cast("double"), F.lit(0.75))
        action = F.coalesce(f.action, F.lit("NONE"))
        fallback = F.when(enough, "PASS").otherwise("WARN")
        result = F.when(action.isin(list(ACTION_RESULT)), _result(action)).otherwise(fallback)
        return _check("GROUNDING_CHECK", result, F.round(score, 3), F.when(enough, "NONE").otherwise("MEDIUM"))

    filters = F.filter(a.contextualGroundingPolicy.filters, lambda f: f["type"] == "GROUNDING")
    return F.coalesce(F.transform(filters, check), F.array())


def _fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 12)


def _risk(e: Column, source: Column, target: Column) -> Column:
    names = F.lower(F.concat_ws(" ", source, target, e.modelId))
    level = F.when(F.coalesce(e.riskTag, F.lit("")) != "", e.riskTag)
    for word, risk in RISK_WORDS.items():
        level = level.when(names.contains(word), risk)
    return level.otherwise("low")


def _hop(e: Column) -> Column:
    """The columns that every check of one event shares; texts leave only as fingerprints."""
    boundary = _lookup(EVENT_BOUNDARY, F.coalesce(e.eventType, F.lit("ORCHESTRATION")), INTERNAL)
    source, target = F.coalesce(e.sourceNode, F.lit("User")), F.coalesce(e.targetNode, F.lit("FinalAnswer"))
    units = F.coalesce(e.usageUnits.try_cast("double"), F.lit(1.0))
    trace = e.guardrailTrace
    return F.struct(
        source.alias("source_node"), target.alias("target_node"), boundary.alias("trust_boundary"),
        _lookup(BOUNDARY_NODE_TYPE, boundary, "agent").alias("node_type"),
        F.concat(F.coalesce(trace.guardrailId, F.lit("unspecified")), F.lit(":"),
                 F.coalesce(trace.guardrailVersion, F.lit("1"))).alias("policy_id"),
        _fingerprint(e.inputText).alias("input_text_hash"),
        # an absent output is the input; one given as null is empty
        _fingerprint(F.when(e.outputNull, F.lit("")).otherwise(F.coalesce(e.outputText, e.inputText))).alias("output_text_hash"),
        _risk(e, source, target).alias("risk_level"),
        F.coalesce(e.latencyMs.try_cast("double"), F.lit(100.0)).cast(MONEY).alias("latency_ms"),
        F.round(units * COST_PER_UNIT_USD, 6).cast(MONEY).alias("estimated_cost_usd"),
        F.coalesce(e.timestamp, F.lit("")).alias("timestamp"))


def _event_checks(e: Column) -> Column:
    per_assessment = F.transform(
        F.coalesce(e.guardrailTrace.assessments, F.array()),
        lambda a: F.concat(_content(a), _personal_data(a), _words(a), _grounding(a)))
    return F.transform(F.flatten(per_assessment), lambda c: F.struct(_hop(e).alias("hop"), c.alias("check")))


def sessions_to_trace(sessions: DataFrame, workflow_prefix: str = "agent_", template: str = "session_import",
                      behavior: str = "session_trace") -> DataFrame:
    """One trace row per check, numbered in event order within its session object.

    Events keep their input order where `eventOrder` ties; events without a check give no row.
    """
    events = F.transform(F.coalesce("traceEvents", F.array()), lambda e, i: F.struct(
        F.coalesce(e.eventOrder, F.lit(0)).alias("at"), i.alias("i"), e.alias("event")))
    flat = F.flatten(F.transform(F.array_sort(events), lambda x: _event_checks(x.event)))
    rows = sessions.select(
        F.concat(F.lit(workflow_prefix), F.coalesce("agentId", F.lit("unknown_agent"))).alias("workflow_id"),
        F.coalesce("sessionId", F.lit("unknown_session")).alias("request_id"),
        F.posexplode(flat).alias("pos", "row"))
    target = F.col("row.hop.target_node")
    return rows.select(
        "workflow_id", "request_id", (F.col("pos") + 1).alias("step_id"),
        F.concat("workflow_id", F.lit("_"), target).alias("node_id"),
        F.col("row.hop.source_node"), target.alias("target_node"), F.col("row.hop.node_type"),
        F.col("row.hop.node_type").alias("step_type"), target.alias("agent_name"),
        F.col("row.check.guardrail_type"), F.col("row.hop.policy_id"),
        F.col("row.hop.output_text_hash").alias("text_hash"), F.col("row.hop.input_text_hash"),
        F.col("row.hop.output_text_hash"),
        (F.col("row.hop.input_text_hash") != F.col("row.hop.output_text_hash")).alias("text_changed"),
        F.col("row.hop.trust_boundary"), F.col("row.hop.risk_level"),
        F.col("row.hop.risk_level").alias("edge_risk_level"), F.col("row.check.guardrail_result"),
        F.col("row.check.severity"), F.col("row.check.confidence"), F.col("row.hop.latency_ms"),
        F.col("row.hop.estimated_cost_usd"), F.col("row.hop.timestamp"),
        F.lit(template).alias("workflow_template"), F.lit(behavior).alias("behavior_pattern"),
    ).select(*TRACE.fieldNames())
