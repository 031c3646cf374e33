"""Node and edge tables: one directed graph per (workflow_id, request_id).

Edges are one partial aggregation over the trace. Nodes follow from the edges, because the
first row that shows a node is also the first row of one of its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hopsight.policy import PROTECTED, TO_FINAL
from hopsight.schema import KEY

HOP = [*KEY, "source_node", "target_node"]

# What a trace without the optional column means.
_OPTIONAL = {
    "node_id": "string", "node_type": "string", "agent_name": "string", "input_text_hash": "string",
    "output_text_hash": "string", "edge_risk_level": "string", "latency_ms": "decimal(18,6)",
    "estimated_cost_usd": "decimal(18,6)",
}
_CHECK_COLUMNS = [
    "node_id", "node_type", "agent_name", "guardrail_type", "policy_id", "text_hash",
    "input_text_hash", "output_text_hash", "text_changed", "trust_boundary", "risk_level",
    "edge_risk_level", "guardrail_result", "latency_ms", "estimated_cost_usd", "timestamp",
]

#: Of an edge's first check: what paths and the plan read, and what only the node table reads.
FIRST = ["step_id", "tie", "trust_boundary", "edge_risk_level", "risk_level", "guardrail_type", "node_type"]
_SHOWN = ["node_id", "agent_name", "input_text_hash", "output_text_hash"]

PATH_COLUMNS = ["node_id", "agent_name", "guardrail_type", "policy_id", "text_hash", "text_changed", "risk_level",
                "guardrail_result", "latency_ms", "estimated_cost_usd"]


def read_columns(trace: DataFrame) -> DataFrame:
    """The columns that `checks` reads, as far as the trace has them."""
    return trace.select(*HOP, "step_id", *[c for c in _CHECK_COLUMNS if c in trace.columns])


def checks(trace: DataFrame) -> DataFrame:
    """The trace columns that the graph stages read, plus two tie-breaks.

    They order rows of one key that share a step: `tie` where graphs are built, `path_tie` along
    paths, each over the columns read there only. Rows with equal ties agree in those columns, so
    their order cannot change a result.
    """
    have = set(trace.columns)
    fill = {"edge_risk_level": F.col("risk_level")}
    cols = [F.col(c) if c in have else fill.get(c, F.lit(None)).cast(_OPTIONAL[c]).alias(c)
            for c in _CHECK_COLUMNS]
    named = trace.select(*HOP, "step_id", *cols).withColumn(
        "text_changed", F.coalesce("text_changed", F.lit(False)))
    named = named.withColumn("tie", F.xxhash64(*HOP, "step_id", *_CHECK_COLUMNS))
    named = named.withColumn("path_tie", F.xxhash64(*HOP, "step_id", *PATH_COLUMNS))
    for name, default in {"_node_id": F.concat_ws("_", "request_id", "target_node"),
                          "_node_type": F.lit("agent"), "_agent_name": F.col("target_node"),
                          "_input_text_hash": F.lit(""), "_output_text_hash": F.lit("")}.items():
        named = named.withColumn(name, F.col(name[1:]) if name[1:] in have else default)
    return named


def edge_rollup(rows: DataFrame, of_first: list[str] | None = None) -> DataFrame:
    """One row per hop of a key, with its first check (or those columns of it, step and tie first) and its counts."""
    of_first = of_first or [*FIRST, *_SHOWN]
    first = F.min(F.struct(*[F.col(f"_{c}").alias(c) if f"_{c}" in rows.columns else F.col(c) for c in of_first]))
    nulls = F.count_if(F.col("policy_id").isNull())
    return rows.groupBy(*HOP).agg(
        first.alias("first"),
        F.count("*").alias("check_count"),
        F.count_if("text_changed").alias("changed_count"),
        F.count_if(F.col("guardrail_result") == "WARN").alias("warn_count"),
        F.count_if(F.col("guardrail_result") == "BLOCK").alias("block_count"),
        ((F.min("policy_id") != F.max("policy_id")).eqNullSafe(True)
         | ((nulls > 0) & (nulls < F.count("*")))).alias("policy_drift"),
        F.min("timestamp").alias("first_timestamp"))


def node_rollup(edges: DataFrame) -> DataFrame:
    """One row per node of a key; attributes come from the row and role that showed it first."""
    def role(name, order, node_id, node_type, agent, shown_in, shown_out, checks_in):
        return F.struct(
            F.col(name).alias("node_name"),
            F.struct(F.col("first.step_id"), F.col("first.tie"), F.lit(order).alias("role"),
                     node_id.alias("node_id"), node_type.alias("node_type"), agent.alias("agent_name"),
                     F.col("first.risk_level"), shown_in.alias("input_text_hash"),
                     shown_out.alias("output_text_hash")).alias("shown"),
            checks_in.alias("checks"))

    source = role("source_node", 0, F.concat_ws("_", "request_id", "source_node"),
                  F.when(F.col("source_node") == "User", "user").otherwise("agent"),
                  F.col("source_node"), F.col("first.input_text_hash"), F.col("first.input_text_hash"),
                  F.lit(0).cast("long"))
    target = role("target_node", 1, F.col("first.node_id"), F.col("first.node_type"),
                  F.col("first.agent_name"), F.col("first.input_text_hash"),
                  F.col("first.output_text_hash"), F.col("check_count"))
    return (edges.select(*KEY, F.explode(F.array(source, target)).alias("r")).select(*KEY, "r.*")
            .groupBy(*KEY, "node_name")
            .agg(F.min("shown").alias("shown"), F.sum("checks").alias("check_count")))


def node_table(edges: DataFrame) -> DataFrame:
    s = "shown."
    return node_rollup(edges).select(
        F.col(s + "node_id"), *KEY, "node_name", F.col(s + "node_type"), F.col(s + "agent_name"),
        F.col(s + "risk_level"), F.col(s + "input_text_hash"), F.col(s + "output_text_hash"),
        F.col("check_count").alias("guardrail_check_count"))


def edge_table(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.concat_ws("_", "request_id", "source_node", "target_node").alias("edge_id"),
        *HOP, F.col("first.trust_boundary"), is_protected("first.trust_boundary").alias("protected_boundary"),
        (F.col("changed_count") > 0).alias("text_changed_on_edge"), F.col("first.edge_risk_level"),
        F.col("check_count").alias("guardrail_check_count"))


def is_protected(column: str) -> Column:
    """Graph tables and features use the fixed protected set, whatever the policy says."""
    return F.coalesce(F.col(column).isin(PROTECTED), F.lit(False))


def end_nodes(edges: DataFrame) -> DataFrame:
    """Per key: start node, final nodes and dead ends with their order of appearance."""
    nodes = node_rollup(edges)
    order = F.struct("shown.step_id", "shown.tie", "shown.role")
    start = (nodes.filter("shown.node_type = 'user'").groupBy(*KEY)
             .agg(F.min_by("node_name", order).alias("start_node")))
    sources = edges.select(*KEY, F.col("source_node").alias("node_name")).distinct()
    dead = nodes.join(sources, [*KEY, "node_name"], "left_anti")
    final = nodes.filter("shown.node_type = 'final'")
    kinds = (final.withColumn("kind", F.lit("final"))
             .unionByName(dead.filter("NOT shown.node_type <=> 'final'").withColumn("kind", F.lit("leaf"))))
    kinds = kinds.join(start, KEY, "left").filter("NOT node_name <=> start_node").select(*KEY, "node_name", "kind")
    return kinds.unionByName(start.select(*KEY, F.col("start_node").alias("node_name"), F.lit("start").alias("kind")))


def boundary_presence(edges: DataFrame) -> DataFrame:
    """Per key: is there an edge, and so a check, on the final-response boundary?"""
    return edges.groupBy(*KEY).agg(
        F.bool_or(F.col("first.trust_boundary").eqNullSafe(TO_FINAL)).alias("has_final_boundary"))
