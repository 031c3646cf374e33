"""Traces that Spark derives from the given tables, by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from hopsight.functions.ordered import large_groups, position_in_group
from hopsight.policy import AGENT_TO_TOOL, INTERNAL, TO_FINAL, TOOL_TO_AGENT, USER_TO_AGENT
from hopsight.schema import MONEY, TRACE
from hopsight.session import stored, stored_by, tasks_for, tune
from hopsight.sources.sessions import parse_sessions, sessions_to_trace

# Vocabulary of the trace and session formats.
CHECK_TYPES = ["PII_CHECK", "PROMPT_ATTACK_CHECK", "TOXICITY_CHECK", "SENSITIVE_INFO_CHECK", "GROUNDING_CHECK"]
EVENT_TYPES = ["ORCHESTRATION", "ACTION_GROUP_INVOCATION", "ACTION_GROUP_RESPONSE", "KNOWLEDGE_BASE_LOOKUP",
               "KNOWLEDGE_BASE_RESPONSE", "SOMETHING_ELSE"]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus"]


#: Stands for an output that is given as null, which `to_json` would leave out.
NULL_MARK = "(given as null)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _hash12(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def _step() -> Column:
    """The target of a line that ends no request."""
    supplier = F.col("l_suppkey")
    return (F.when(F.col("l_discount") >= 0.09, F.concat(F.lit("Tool"), (supplier % 2).cast("string")))
            .otherwise(F.concat(F.lit("Agent"), (supplier % 5).cast("string"))))


def _target(line: DataFrame) -> DataFrame:
    line = line.withColumn("target_node", F.when(
        (F.col("pos") == F.col("last")) & (F.col("o_orderstatus") != "P"), "FinalAnswer").otherwise(_step()))
    return line.withColumn("back", F.when((F.col("l_partkey") % 5 == 0) & (F.col("pos") >= 2), 2).otherwise(1))


def _request(order: str) -> Column:
    return F.concat(F.lit("req_"), F.col(order).cast("string"))


def _hops(lines: DataFrame, orders: DataFrame, tasks: int) -> DataFrame:
    """Lines with their position, target and the target they come from, from one shuffle by request and one window.

    A line before another is not the last, so its target is known without its place; `last` is `pos` on the last one only.
    `tasks` bounds the orders of a task as it does the lines, so a task's orders are held as a hash table and only the window sorts.
    """
    line = (lines.withColumn("request_id", _request("l_orderkey")).repartition(tasks, "request_id")
            .join(orders.withColumn("of", _request("o_orderkey")).hint("shuffle_hash"),
                  (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("request_id") == F.col("of"))).drop("o_orderkey", "of"))
    order = W.partitionBy("l_orderkey", "request_id").orderBy(*LINE_ORDER)
    pos = F.row_number().over(order) - 1
    line = line.withColumn("step", _step()).withColumns({
        "pos": pos, "last": pos + F.coalesce(F.lead(F.lit(1)).over(order), F.lit(0)),
        "one": F.lag("step", 1).over(order), "two": F.lag("step", 2).over(order)})
    return _target(line).withColumn("before", F.when(F.col("back") == 2, F.col("two")).otherwise(F.col("one"))).drop("step", "one", "two")


def _hops_of_large(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """The same for orders of more lines than one task should take."""
    lines = lines.withColumn("request_id", _request("l_orderkey"))
    line = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    line = stored(position_in_group(line, ["l_orderkey"], LINE_ORDER, "pos"))
    line = _target(line.join(line.groupBy("l_orderkey").agg(F.max("pos").alias("last")), "l_orderkey"))
    before = line.select("l_orderkey", F.col("pos").alias("from_pos"), F.col("target_node").alias("before"))
    return line.withColumn("from_pos", F.col("pos") - F.col("back")).join(before, ["l_orderkey", "from_pos"], "left").drop("from_pos")


def order_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one request per order and workflow per customer; a check per line item, in the order of its lines.

    The lines' own values set the graph: a part number divisible by 5 branches off the node before the
    last, a high discount calls a tool, only orders that are not pending end in an answer, a line of
    the highest tax crosses a boundary of no listed kind. Untaxed large lines were exported twice.
    """
    tune(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    large, tasks = large_groups(lines, ["l_orderkey"]), tasks_for(spark, max(lines.count(), orders.count()))
    if large is None:
        line = _hops(lines, orders, tasks)
    else:
        line = _hops(lines.join(large, "l_orderkey", "left_anti"), orders, tasks).unionByName(
            _hops_of_large(lines.join(large, "l_orderkey", "left_semi"), orders))
    line = (line.withColumn("source_node", F.coalesce("before", F.lit("User")))
            .withColumn("copy", F.explode(F.when((F.col("l_tax") == 0) & (F.col("l_quantity") > 25), F.array(F.lit(0), F.lit(1)))
                                          .otherwise(F.array(F.lit(0))))))
    source, target, tax, customer = (F.col(c) for c in ("source_node", "target_node", "l_tax", "o_custkey"))
    tool = target.startswith("Tool")
    boundary = (F.when(source == "User", USER_TO_AGENT).when(target == "FinalAnswer", TO_FINAL).when(tool, AGENT_TO_TOOL)
                .when(source.startswith("Tool"), TOOL_TO_AGENT).when(tax == 0.08, "AGENT_TO_ARCHIVE").otherwise(INTERNAL))
    kind = F.when(target == "FinalAnswer", "final").when(tool, "tool").otherwise("agent")
    result = F.when(F.col("l_quantity") < 3, "WARN").when(F.col("l_quantity") < 5, "BLOCK").otherwise("PASS")
    level = (F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown")
             .when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("medium"))
    request, changed = F.col("request_id"), tax >= 0.07

    def text(more: Column) -> Column:
        return _hash12(F.concat(F.lit("text_"), (customer % 10 + more).cast("string")))

    trace = line.select(
        F.concat(F.lit("wf_"), customer.cast("string")).alias("workflow_id"), "request_id",
        (F.col("pos") + 1).cast("int").alias("step_id"), F.concat(request, F.lit("_"), target).alias("node_id"),
        "source_node", "target_node", kind.alias("node_type"), kind.alias("step_type"), target.alias("agent_name"),
        _pick(CHECK_TYPES, F.col("l_partkey") % 2 * (1 + F.col("l_partkey") % 3)).alias("guardrail_type"),
        F.concat(F.lit("policy_v"), F.when(F.col("l_discount") == 0.05, "2").otherwise("1")).alias("policy_id"),
        text(changed.cast("int")).alias("text_hash"), text(F.lit(0)).alias("input_text_hash"),
        text(changed.cast("int")).alias("output_text_hash"), changed.alias("text_changed"), boundary.alias("trust_boundary"),
        level.alias("risk_level"), F.when(F.col("l_quantity") == 50, "high").otherwise(level).alias("edge_risk_level"),
        result.alias("guardrail_result"),
        F.when(result == "BLOCK", "HIGH").when(result == "WARN", "MEDIUM").otherwise("NONE").alias("severity"),
        F.lit(0.5).alias("confidence"), (F.col("l_quantity") * 10 + tax * 100).cast(MONEY).alias("latency_ms"),
        (F.floor("l_extendedprice").cast("decimal(18,6)") / 1000000).cast(MONEY).alias("estimated_cost_usd"),
        F.date_trunc("second", "l_shipdate").cast("timestamp_ntz").cast("string").alias("timestamp"),
        F.when(customer % 7 != 6, F.concat(F.lit("t"), (customer % 7).cast("string"))).alias("workflow_template"),
        F.concat(F.lit("b"), "o_orderstatus").alias("behavior_pattern")).select(*TRACE.fieldNames())
    return stored_by(trace, ["request_id"], tasks) if large is None else stored(trace)


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one request per user and day; cyclic graphs, several requests per workflow.

    The step is the position in a group of any size; the previous hop is found by joining on
    (request, step), whose groups are single rows.
    """
    tune(spark)
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("ts").cast("date").cast("string").alias("day"), "value",
        F.when(F.col("event_type") == "purchase", "FinalAnswer").when(F.col("event_type") == "error", "LookupTool")
        .otherwise(F.concat("event_type", F.lit("Agent"))).alias("target_node"))
    e = (position_in_group(e, ["user_id", "day"], ["ts", "event_id"], "pos")
         .withColumn("step_id", F.col("pos") + 1).drop("pos").checkpoint())
    before = e.select("user_id", "day", (F.col("step_id") + 1).alias("step_id"), F.col("target_node").alias("before"))
    e = (e.join(before, ["user_id", "day", "step_id"], "left")
         .withColumn("source_node", F.coalesce("before", F.lit("User"))))
    source, target, n = F.col("source_node"), F.col("target_node"), F.col("event_id") % 10
    boundary = (F.when(source == "User", USER_TO_AGENT).when(target == "FinalAnswer", TO_FINAL)
                .when(target == "LookupTool", AGENT_TO_TOOL).when(source == "LookupTool", TOOL_TO_AGENT)
                .otherwise(INTERNAL))
    risk = (F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "medium")
            .when(F.col("value") < 150, "high").otherwise("unknown"))
    kind = F.when(target == "FinalAnswer", "final").when(target == "LookupTool", "tool").otherwise("agent")
    user = F.col("user_id").cast("string")
    request = F.concat(F.lit("req_"), user, F.lit("_"), "day")
    text = _hash12(F.concat(F.lit("text_"), (F.col("user_id") % 4).cast("string")))
    return e.select(
        F.concat(F.lit("wf_"), user).alias("workflow_id"), request.alias("request_id"), "step_id",
        F.concat(request, F.lit("_"), target).alias("node_id"), "source_node", "target_node",
        kind.alias("node_type"), kind.alias("step_type"), target.alias("agent_name"),
        _pick(CHECK_TYPES[:3], F.col("event_id") % 3).alias("guardrail_type"),
        F.concat(F.lit("policy_v"), (F.col("user_id") % 2).cast("string")).alias("policy_id"),
        text.alias("text_hash"), text.alias("input_text_hash"), text.alias("output_text_hash"),
        F.lit(False).alias("text_changed"), boundary.alias("trust_boundary"), risk.alias("risk_level"),
        risk.alias("edge_risk_level"),
        F.when(n == 0, "WARN").when(n == 1, "BLOCK").otherwise("PASS").alias("guardrail_result"),
        F.lit("NONE").alias("severity"), F.lit(0.5).alias("confidence"),
        F.col("value").cast(MONEY).alias("latency_ms"),
        (F.floor("value").cast("decimal(18,6)") / 1000000).cast(MONEY).alias("estimated_cost_usd"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").cast("string").alias("timestamp"),
        F.lit("sessions").alias("workflow_template"), F.lit("events").alias("behavior_pattern"),
    ).select(*TRACE.fieldNames()).checkpoint()


def session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as nested session JSON, one object per conversation, events in reverse order."""
    tune(spark)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    c = position_in_group(c, ["conv_id"], ["turn", "text"], "pos").checkpoint()
    last = c.groupBy("conv_id").agg(F.max("pos").alias("last"))
    c = c.join(last, "conv_id")
    pos, conv = F.col("pos"), F.col("conv_id")

    def target(at: Column) -> Column:
        return (F.when(at == 0, "PlannerAgent").when(at == F.col("last"), "FinalAnswer")
                .when(at % 5 == 2, "PaymentAgent").when(at % 5 == 3, "ComplianceAgent")
                .otherwise(F.concat(F.lit("Agent"), at.cast("string"))))

    v = (conv * 3 + pos) % 8

    def text_struct(**fields) -> Column:
        return F.struct(*[(f if isinstance(f, Column) else F.lit(f)).alias(n) for n, f in fields.items()])

    content = (F.when(v == 0, F.array(text_struct(type="PROMPT_ATTACK", confidence="LOW", action="NONE")))
               .when(v == 5, F.array(text_struct(type="HATE", confidence="HIGH", action="BLOCKED"))))
    nothing = F.array().cast("array<struct<type:string,match:string,action:string>>")
    entities = (F.when(v.isin(0, 1), nothing)
                .when(v == 2, F.array(text_struct(type="EMAIL", match="m", action="ANONYMIZED")))
                .when(v == 3, F.array(text_struct(type="NAME", match="m", action="NONE"),
                                      text_struct(type="EMAIL", match="m", action="BLOCKED"))))
    word_map = "map<string,array<struct<match:string,action:string>>>"
    words = (F.when(v == 4, F.create_map(F.lit("customWords"), F.array(text_struct(match="w", action="BLOCKED"))))
             .when(v == 5, F.create_map().cast(word_map)))
    grounding = F.when(v == 6, F.array(
        text_struct(type="RELEVANCE", score=0.1, threshold=0.75), text_struct(type="GROUNDING", score=0.6, threshold=0.75)))
    assessment = F.struct(
        F.when(content.isNotNull(), F.struct(content.alias("filters"))).alias("contentPolicy"),
        F.when(entities.isNotNull(), F.struct(entities.alias("piiEntities"))).alias("sensitiveInformationPolicy"),
        words.alias("wordPolicy"),
        F.when(grounding.isNotNull(), F.struct(grounding.alias("filters"))).alias("contextualGroundingPolicy"))
    checked = F.struct(
        F.concat(F.lit("g"), (conv % 3).cast("string")).alias("guardrailId"),
        F.when(pos % 2 == 1, "2").alias("guardrailVersion"), F.array(assessment).alias("assessments"))
    event = F.struct(
        pos.alias("eventOrder"),
        F.when(pos == 0, "PRE_PROCESSING").when(pos == F.col("last"), "POST_PROCESSING")
        .otherwise(_pick(EVENT_TYPES, (conv + pos) % 6)).alias("eventType"),
        F.when(pos == 0, "User").otherwise(target(pos - 1)).alias("sourceNode"), target(pos).alias("targetNode"),
        F.col("text").alias("inputText"), F.when(pos % 8 == 5, NULL_MARK).when(pos % 4 == 3, F.concat("text", F.lit(" ."))).alias("outputText"),
        F.when(conv % 7 == 0, "high").when(conv % 7 == 1, "").alias("riskTag"), F.lit("model-a").alias("modelId"),
        (pos + 50).cast("double").alias("latencyMs"),
        F.when(pos % 2 == 0, (pos % 3 + 1).cast("double")).alias("usageUnits"),
        F.concat(F.lit("2024-01-01T"), F.lpad((pos % 24).cast("string"), 2, "0"), F.lit(":00:00Z")).alias("timestamp"),
        F.when(v != 7, checked).alias("guardrailTrace"))
    grouped = (c.select(conv, F.struct(pos.alias("pos"), event.alias("event")).alias("x"))
               .groupBy("conv_id").agg(F.array_sort(F.collect_list("x"), lambda a, b: b.pos - a.pos).alias("events")))
    text = F.to_json(F.struct(
        F.concat(F.lit("bot"), (conv % 5).cast("string")).alias("agentId"),
        F.concat(F.lit("sess_"), conv.cast("string")).alias("sessionId"),
        F.transform("events", lambda x: x.event).alias("traceEvents")))
    return grouped.select(F.replace(text, F.lit(f'"outputText":"{NULL_MARK}"'), F.lit('"outputText":null')).alias("json"))


def session_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_to_trace(parse_sessions(session_texts(spark, sf_dir), "json"))
