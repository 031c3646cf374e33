"""Column contracts of every table that crosses a stage boundary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

KEY = ["workflow_id", "request_id"]
MONEY = T.DecimalType(18, 6)

# The trace layout, in its documented order.
TRACE = T.StructType([
    T.StructField("workflow_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("step_id", T.IntegerType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("source_node", T.StringType()),
    T.StructField("target_node", T.StringType()),
    T.StructField("node_type", T.StringType()),
    T.StructField("step_type", T.StringType()),
    T.StructField("agent_name", T.StringType()),
    T.StructField("guardrail_type", T.StringType()),
    T.StructField("policy_id", T.StringType()),
    T.StructField("text_hash", T.StringType()),
    T.StructField("input_text_hash", T.StringType()),
    T.StructField("output_text_hash", T.StringType()),
    T.StructField("text_changed", T.BooleanType()),
    T.StructField("trust_boundary", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("edge_risk_level", T.StringType()),
    T.StructField("guardrail_result", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("latency_ms", MONEY),
    T.StructField("estimated_cost_usd", MONEY),
    T.StructField("timestamp", T.StringType()),
    T.StructField("workflow_template", T.StringType()),
    T.StructField("behavior_pattern", T.StringType()),
])

# Columns without which a table is refused.
TRACE_REQUIRED = [
    "workflow_id", "request_id", "step_id", "source_node", "target_node", "trust_boundary",
    "guardrail_type", "policy_id", "text_hash", "text_changed", "guardrail_result", "risk_level",
    "timestamp", "behavior_pattern",
]
PLAN_REQUIRED = {
    "workflow_id": "string", "request_id": "string", "step_id": "int", "guardrail_type": "string",
    "trust_boundary": "string", "recommended_decision": "string", "reason": "string",
    "reused_from_step_id": "int", "safe_to_optimize": "boolean", "graph_path_id": "string",
    "path_type": "string", "protected_boundary": "boolean", "audit_required": "boolean",
}
REDUNDANT_REQUIRED = {
    "workflow_id": "string", "request_id": "string", "path_id": "string", "path_type": "string",
    "path_nodes": "string", "guardrail_type": "string", "policy_id": "string", "text_hash": "string",
    "first_step_id": "int", "duplicate_step_id": "int", "duplicate_reason": "string",
    "optimization_allowed": "boolean", "blocked_by": "string", "recommended_decision": "string",
}
METRICS_REQUIRED = [
    "original_guardrail_calls", "optimized_guardrail_calls", "guardrail_call_reduction_percent",
    "latency_saved_percent", "cost_saved_percent", "boundary_coverage_preserved_percent",
    "high_risk_preservation_percent", "human_review_count",
]


class ContractError(ValueError):
    """A table lacks a column, carries it in a wrong type, or has no rows."""


def require_columns(df: DataFrame, expected: dict[str, str], table: str) -> DataFrame:
    """Raise unless `df` has every expected column in its type; runs no job."""
    actual = dict(df.dtypes)
    missing = sorted(set(expected) - set(actual))
    if missing:
        raise ContractError(f"{table} lacks column(s) {missing}; it has {sorted(actual)}")
    wrong = {c: actual[c] for c, t in expected.items() if actual[c] != t}
    if wrong:
        raise ContractError(f"{table} has wrong types {wrong}; expected {({c: expected[c] for c in wrong})}")
    return df


def require_rows(n: int, table: str) -> None:
    """Raise for a table of which no rows were counted."""
    if not n:
        raise ContractError(f"{table} has zero rows")


def require(df: DataFrame, expected: dict[str, str], table: str) -> DataFrame:
    """Raise unless `df` has every expected column in its type and at least one row."""
    require_columns(df, expected, table)
    require_rows(int(not df.isEmpty()), table)
    return df


def _expected_trace() -> dict[str, str]:
    return {c: TRACE[c].dataType.simpleString() for c in TRACE_REQUIRED}


def require_trace(df: DataFrame) -> DataFrame:
    return require(df, _expected_trace(), "trace")


_WHOLE = (T.ByteType, T.ShortType, T.LongType)


def admit_trace(df: DataFrame) -> DataFrame:
    """A trace whose required columns are there in their types; runs no job.

    Steps of another whole-number type are taken as they are read: one that is no int raises then.
    """
    if "step_id" in df.columns and isinstance(df.schema["step_id"].dataType, _WHOLE):
        step = F.col("step_id")
        narrow = step.try_cast("int")
        df = df.withColumn("step_id", F.when(step.isNotNull() & narrow.isNull(), F.raise_error(
            F.concat(F.lit("step_id is no int: "), step.cast("string"))).cast("int")).otherwise(narrow))
    return require_columns(df, _expected_trace(), "trace")


def contract_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, and the rows without a key, a step, a check type or a boundary): one row a table, from one pass over it."""
    parts = [df.agg(F.count("*").alias("rows"), F.count_if(F.col("workflow_id").isNull() | F.col("request_id").isNull()).alias("without_key"),
                    *[F.count_if(F.col(c).isNull()).alias(f"without_{c}") if c in df.columns else F.lit(None).cast("long").alias(f"without_{c}")
                      for c in ("step_id", "guardrail_type", "trust_boundary")])
             .select(F.lit(name).alias("table"), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def require_plan(df: DataFrame) -> DataFrame:
    return require(df, PLAN_REQUIRED, "plan")


def require_redundant(df: DataFrame) -> DataFrame:
    """An empty report is legal, so only its columns and types are checked then."""
    missing = sorted(set(REDUNDANT_REQUIRED) - set(df.columns))
    if missing or not df.isEmpty():
        require(df, REDUNDANT_REQUIRED, "redundant checks")
    return df


def require_metrics(df: DataFrame) -> DataFrame:
    """The eight headline figures must be in the `overall` or `safety` struct."""
    have = {f.name for part in ("overall", "safety") if part in df.columns
            for f in df.schema[part].dataType.fields}
    missing = sorted(set(METRICS_REQUIRED) - have)
    if missing:
        raise ContractError(f"metrics lack {missing}; they have {sorted(have)}")
    return df
