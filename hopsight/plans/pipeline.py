"""The whole analysis as lazily built tables over one trace."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from hopsight import schema
from hopsight.functions.ordered import large_groups
from hopsight.operators import features as feature_ops, graph, paths, plan as plan_ops, redundancy
from hopsight.operators.path_checks import HEAVY_ROWS, PathChecks
from hopsight.plans import audit, explain, metrics as metric_ops, serving
from hopsight.policy import completed
from hopsight.schema import KEY
from hopsight.session import buckets_of, persist, stored_by, tasks_for, tune
from hopsight.sources import sinks


class Analysis:
    """Every table of the analysis; each is built on first use.

    Building the topologies runs small jobs (size checks, one per hop). Everything else is
    lazy. The trace and its graphs are stored by key in the checkpoint folder, so later stages need no
    shuffle by key; small tables with several readers are persisted until `release()`.
    """

    def __init__(self, trace: DataFrame, policy: dict | None = None, strict: bool = False,
                 scenario: str | None = None, wide_edges: int = paths.WIDE_EDGES,
                 heavy_rows: int = HEAVY_ROWS, max_hops: int | None = None, max_paths: int | None = None,
                 dense_paths: int = paths.DENSE_PATHS):
        tune(trace.sparkSession)
        self._given = buckets_of(trace, KEY)
        trace = schema.admit_trace(trace)
        self.trace = trace if scenario is None else trace.filter(F.col("workflow_template") == scenario)
        if "edge_risk_level" not in trace.columns:
            self.trace = self.trace.withColumn("edge_risk_level", F.col("risk_level"))
        self.policy = completed(policy or {})
        self.strict = strict
        self._limits = (wide_edges, heavy_rows, max_hops, max_paths, dense_paths)
        self._held: list[DataFrame] = []

    def _hold(self, df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
        self._held.append(persist(df, keep_partitioning))
        return self._held[-1]

    def release(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()

    @cached_property
    def _buckets(self) -> tuple[list[str], int | None]:
        """Columns and number of the stored tables' buckets; no number if a key has more rows than one task should take."""
        if self._given is not None:
            return self._given
        if large_groups(self.trace, KEY, self._limits[1]) is not None:
            return KEY, None
        return KEY, tasks_for(self.trace.sparkSession, self.trace.count())

    @property
    def _tasks(self) -> int | None:
        return self._buckets[1]

    def _hold_by_key(self, df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
        """Tables as large as the trace are stored by key; small ones are persisted."""
        if self._tasks is None or not keep_partitioning:
            return self._hold(df, keep_partitioning)
        return stored_by(df, *self._buckets)

    @cached_property
    def keyed(self) -> DataFrame:
        """What the stages read of the trace, shuffled once: stored by key, unless it is already or a key is too large for that."""
        rows = graph.read_columns(self.trace)
        return rows if self._tasks is None or self._given else stored_by(rows.repartition(self._tasks, *KEY), KEY, self._tasks)

    @cached_property
    def checks(self) -> DataFrame:
        return graph.checks(self.keyed)

    @cached_property
    def rollup(self) -> DataFrame:
        rollup = graph.edge_rollup(self.checks)
        return self._hold(rollup) if self._tasks is None else rollup

    @property
    def nodes(self) -> DataFrame:
        return graph.node_table(self.rollup)

    @property
    def edges(self) -> DataFrame:
        return graph.edge_table(self.rollup)

    @cached_property
    def topologies(self) -> paths.Topologies:
        wide_edges, _, *limits = self._limits
        most = self.keyed.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        return paths.build(self.rollup, self._hold_by_key, wide_edges, *limits, most_checks=most,
                           placed=None if self._tasks is None else graph.edge_rollup(self.checks, graph.FIRST))

    @cached_property
    def path_checks(self) -> PathChecks:
        return PathChecks(self.checks, self.topologies, self._limits[1], self._tasks is not None)

    @cached_property
    def paths(self) -> DataFrame:
        return paths.path_table(self.topologies)

    @cached_property
    def plan_with_paths(self) -> DataFrame:
        """The plan plus `path_idx`, which orders a workflow's rows."""
        gaps = plan_ops.missing_final_rows(self.topologies.keys)
        return plan_ops.executed_rows(self.path_checks, self.policy, self.strict).unionByName(gaps)

    @property
    def plan(self) -> DataFrame:
        return self.plan_with_paths.select(*plan_ops.PLAN_COLUMNS)

    @cached_property
    def redundant(self) -> DataFrame:
        return redundancy.redundant_checks(self.path_checks, self.paths, self.policy)

    @cached_property
    def features(self) -> DataFrame:
        return feature_ops.workflow_features(self.path_checks, self.policy["risk_score_weights"])

    @cached_property
    def ledger(self) -> DataFrame:
        """Sums per boundary that metrics and the boundary matrix share."""
        return self._hold(metric_ops.ledger(self.trace, self.plan, self.policy, ["trust_boundary"]))

    @cached_property
    def workflow_ledger(self) -> DataFrame:
        """The sums per workflow that scenarios are made of; not all sums of `ledger`."""
        return self._hold(metric_ops.workflow_ledger(self.trace, self.plan, self.policy))

    @cached_property
    def metrics(self) -> DataFrame:
        return metric_ops.metrics(self.ledger, self.features)

    @cached_property
    def scenarios(self) -> DataFrame:
        return metric_ops.scenario_metrics(self.workflow_ledger)

    @cached_property
    def boundary_matrix(self) -> DataFrame:
        return metric_ops.boundary_matrix(self.ledger, self.policy)

    @cached_property
    def request_times(self) -> DataFrame:
        return self.topologies.keys.select(*KEY, "request_time")

    def explanations(self, top_n: int = 25) -> DataFrame:
        decided = paths.path_table(self.topologies, self.topologies.paths)
        return explain.explanations(self.plan_with_paths, decided, self.request_times, top_n)

    def summary(self) -> DataFrame:
        return serving.run_summary(self.metrics, self.nodes, self.edges, self.redundant)

    def accounting(self) -> DataFrame:
        return audit.plan_accounting(self.keyed, self.plan)

    def hold_checks(self) -> None:
        """Worth its space when plan, redundancy and features are all wanted, each by several readers."""
        self.path_checks.hold(self._hold)
        for df in (self.plan_with_paths, self.features):
            if not df.is_cached:
                self._hold(df)

    def write(self, folder: str, format: str = "parquet", top_n: int = 25) -> dict[str, dict[str, int]]:
        """Stage every table, check contracts and gates on what was staged, then publish all of it or nothing.

        Returns the rows and rows without a key that were counted while each table was written. A failure before the end,
        also of a contract or a gate, leaves an earlier result in `folder` whole.
        """
        schema.require_columns(self.plan, schema.PLAN_REQUIRED, "plan")
        schema.require_columns(self.redundant, schema.REDUNDANT_REQUIRED, "redundant checks")
        schema.require_metrics(self.metrics)
        self.hold_checks()
        tables = {
            "graph_nodes": self.nodes, "graph_edges": self.edges, "workflow_graph_summary": self.features,
            "redundant_paths": self.redundant, "optimized_plan": self.plan,
            "boundary_coverage_matrix": self.boundary_matrix, "scenario_metrics": self.scenarios}
        with sinks.Staged(self.trace.sparkSession, folder) as staged:
            counted = staged.write(tables, format) | staged.write({"metrics": self.metrics, "explanations": self.explanations(top_n)}, "json")
            for name in ("graph_edges", "optimized_plan"):  # every check of the trace is on an edge
                schema.require_rows(counted[name]["rows"], {"graph_edges": "trace", "optimized_plan": "plan"}[name])
            metric_ops.enforce_gate(staged.read("metrics", "json", self.metrics.schema))
            metric_ops.enforce_matrix_gate(staged.read("boundary_coverage_matrix", format, self.boundary_matrix.schema), self.policy)
            staged.publish(counted)
        return counted
