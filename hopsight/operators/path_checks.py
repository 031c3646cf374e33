"""Checks on their edge, and each check with the previous check of its type on a path."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from hopsight.functions.ordered import previous_in_group
from hopsight.operators.graph import HOP, PATH_COLUMNS
from hopsight.operators.paths import Topologies
from hopsight.schema import KEY
from hopsight.session import bounded

HEAVY_ROWS = 1_000_000


class Part:
    """Keys that take the same route: their checks and their edges."""

    def __init__(self, rows: DataFrame, edges: DataFrame, heavy: bool, bounded_tasks: bool = False):
        self.rows, self.edges, self.heavy, self.bounded_tasks = rows, edges, heavy, bounded_tasks
        self.held: DataFrame | None = None

    def on_edges(self) -> DataFrame:
        """Each check with its edge's boundary, risk, order and topology."""
        if self.held is not None:
            return self.held
        side = self.edges.select(*HOP, "topology_id", "edge_ord", F.col("trust_boundary").alias("edge_boundary"),
                                 F.col("edge_risk_level").alias("edge_risk"))
        if self.heavy:
            side = bounded(side)
        elif self.bounded_tasks:  # no sort by four names on either side
            side = side.hint("shuffle_hash")
        return self.rows.select(*HOP, "step_id", "path_tie", *PATH_COLUMNS).join(side, HOP)


class PathChecks:
    """Splits keys by the number of (check, path) rows they expand to.

    Ordinary keys are hashed by key once; every later window and aggregate on them reuses that
    partitioning. Heavy keys (a third of all rows may share one) never meet in one task: they
    use a broadcast or skew-split join and range-cut windows. With `bounded_tasks`, tables by key are stored in buckets
    whose number grows with the rows, so the edges of a bucket's few-edge keys fit a hash table.
    """

    def __init__(self, rows: DataFrame, topo: Topologies, heavy_rows: int = HEAVY_ROWS, bounded_tasks: bool = False):
        self.topo = topo
        tables = [topo.edges] + ([topo.wide_edges] if topo.wide_edges is not None else [])
        routes, heavy = [], None
        if topo.max_load > heavy_rows:
            found = self._heavy_keys(tables, heavy_rows)
            if not found.isEmpty():
                keys = bounded(found)
                heavy = reduce(DataFrame.unionByName, [t.join(keys, KEY, "left_semi") for t in tables]).checkpoint()
                tables = [t.join(keys, KEY, "left_anti") for t in tables]
                routes.append(Part(rows.join(keys, KEY, "left_semi"), heavy, True))
                rows = rows.join(keys, KEY, "left_anti")
        if len(tables) > 1:
            keys = bounded(topo.wide_edges.select(*KEY).distinct())
            routes.append(Part(rows.join(keys, KEY, "left_semi"), tables[1], False))
            rows = rows.join(keys, KEY, "left_anti")
        self.parts = [Part(rows, tables[0], False, bounded_tasks), *routes]

    def _heavy_keys(self, tables: list[DataFrame], heavy_rows: int) -> DataFrame:
        uses = self.topo.side(self.topo.path_steps.groupBy("topology_id", "edge_ord").agg(F.count("*").alias("uses")))
        load = F.sum(F.col("check_count") * F.coalesce("uses", F.lit(1)))
        loads = [t.join(uses, ["topology_id", "edge_ord"], "left").groupBy(*KEY).agg(load.alias("load")) for t in tables]
        return reduce(DataFrame.unionByName, loads).filter(F.col("load") > heavy_rows).select(*KEY).checkpoint()

    def hold(self, hold: Callable[..., DataFrame]) -> None:
        """Keep the placed checks for several readers instead of shuffling the trace for each."""
        for part in self.parts:
            part.held = part.held if part.held is not None else hold(part.on_edges(), keep_partitioning=True)

    def per_part(self, build: Callable[[Part], DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [build(part) for part in self.parts])

    def along_paths(self, part: Part, steps: DataFrame) -> DataFrame:
        """One row per check and path of `steps`, with `prev`, the check of its type just before it, and `seq`.

        `seq` sorts as the checks do in the comparison, so it tells exact copies of a check apart.
        """
        placed = self.topo.place(part.on_edges(), steps)
        group = [*KEY, "path_idx", "guardrail_type"]
        order = ["step_id", "pos", "path_tie"]
        value = F.struct("step_id", "risk_level", "text_hash", "policy_id", "guardrail_result")
        if part.heavy:
            return previous_in_group(placed, group, order, value, "prev", "seq")
        ordered = W.partitionBy(*group).orderBy(*order)
        return placed.withColumn("prev", F.lag(value).over(ordered)).withColumn("seq", F.row_number().over(ordered))

    def deciding_steps(self) -> DataFrame:
        """The steps of those paths that are the first for some edge: no other path decides in the plan."""
        steps = self.topo.path_steps
        first = steps.select("topology_id", F.col("first_path").alias("path_idx")).distinct()
        return steps.join(first, ["topology_id", "path_idx"], "left_semi")
