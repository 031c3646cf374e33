"""Path enumeration: simple paths start -> final, plus dead-end paths that add an edge.

Path sets depend only on the order of edges and the node types. Keys with few edges are
therefore renamed to ordinals and reduced to distinct topologies, each enumerated once. A key
with many edges is its own topology and stays in rows, so no array grows with the data.
A dense topology, one without cycles but with many paths, is not enumerated unless its paths
are asked for: `shapes` answers how many there are, which edges they cover, and which decide.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hopsight import session
from hopsight.functions.ordered import position_in_group
from hopsight.operators import shapes as shape_ops
from hopsight.operators.graph import FIRST, node_rollup
from hopsight.policy import TO_FINAL
from hopsight.schema import KEY
from hopsight.session import bounded, is_small

WIDE_EDGES = 256
WIDE_PATHS = 1_000_000
DENSE_PATHS = 4096
FRONTIER_ROWS_PER_TASK = 200_000
SHARED_KEYS = 1_000

KEY_COLUMNS = [*KEY, "topology_id", "names", "node_count", "high_risk_node_count", "first_final", "has_final", "first_type", "request_time"]
#: What later stages read of an edge; the rest of the rollup ends in the topology or in KEY_COLUMNS.
EDGE_COLUMNS = ["source_node", "target_node", "trust_boundary", "edge_risk_level", "check_count", "changed_count", "warn_count",
                "block_count", "policy_drift"]


class PathExplosion(RuntimeError):
    """An optional guard on hops or paths was exceeded; nothing was truncated."""


@dataclass
class Topologies:
    keys: DataFrame            # KEY_COLUMNS; of the key's checks has_final, first_type and request_time
    edges: DataFrame           # key, topology_id, edge_ord, EDGE_COLUMNS; few-edge keys, by key
    wide_edges: DataFrame | None   # the same for keys with many edges
    wide_nodes: DataFrame | None   # key, node_ord, node_name of those keys
    paths: DataFrame           # topology_id, path_idx, path_type, labels, edge_ords; of dense topologies the deciding ones
    path_steps: DataFrame      # topology_id, path_idx, path_type, pos, edge_ord, first_path; the same
    path_edges: int            # rows of `path_steps`
    max_load: int              # no key expands to more (check, path) rows than this
    routes: DataFrame          # topology_id, path_count, max_path_length
    covered: DataFrame         # topology_id, edge_ord on any path
    dense: DataFrame | None    # topology_id, kinds, links of dense topologies
    list_dense: Callable[[], DataFrame] | None   # enumerates their paths

    @cached_property
    def every_path(self) -> DataFrame:
        """All paths of all topologies, the dense ones enumerated now."""
        if self.dense is None:
            return self.paths
        listed = self.paths.join(self.dense.select("topology_id"), "topology_id", "left_anti")
        return listed.unionByName(self.list_dense()).checkpoint()

    @cached_property
    def every_step(self) -> DataFrame:
        return self.path_steps if self.dense is None else _steps(self.every_path)

    def side(self, df: DataFrame) -> DataFrame:
        """Broadcast `df`, which has at most the rows of `path_steps`, if those are proven few."""
        return F.broadcast(df) if self.path_edges <= session.BROADCAST_ROWS else df

    @cached_property
    def shared(self) -> DataFrame:
        """Topologies of more than SHARED_KEYS keys: few, as each takes that many."""
        counts = self.keys.groupBy("topology_id").agg(F.count("*").alias("n"))
        return bounded(counts.filter(F.col("n") > SHARED_KEYS).select("topology_id").checkpoint())

    def per_key(self, keys: DataFrame, table: DataFrame, how: str = "inner", on: tuple[str, ...] = ("topology_id",)) -> DataFrame:
        """Rows of the size of `keys` joined with `table` by topology.

        If the paths are not few, shared topologies are joined by their own (broadcast if proven few),
        and the others by a shuffle in which no topology has more than SHARED_KEYS keys.
        """
        if self.path_edges <= session.BROADCAST_ROWS:
            return keys.join(F.broadcast(table), list(on), how)
        shared = bounded(table.join(self.shared, "topology_id", "left_semi"))
        rare = table.join(self.shared, "topology_id", "left_anti")
        return (keys.join(self.shared, "topology_id", "left_semi").join(shared, list(on), how)
                .unionByName(keys.join(self.shared, "topology_id", "left_anti").join(rare, list(on), how)))

    def uncovered(self, edges: DataFrame) -> DataFrame:
        """The edges of `edges` that lie on no path; dealt by topology only where few steps allow a broadcast."""
        on = ["topology_id", "edge_ord"]
        if self.path_edges <= session.BROADCAST_ROWS:
            return edges.join(F.broadcast(self.covered), on, "left_anti")
        by_key = self.per_key(self.keys.select(*KEY, "topology_id"), self.covered).drop("topology_id")
        return edges.join(by_key, [*KEY, "edge_ord"], "left_anti")

    def place(self, rows: DataFrame, steps: DataFrame) -> DataFrame:
        """Rows on edges, which may be as many as the trace's, with the path steps of their edge.

        They are never dealt by topology: few steps are broadcast, others are first carried to their keys.
        """
        if self.path_edges <= session.BROADCAST_ROWS:
            return rows.join(F.broadcast(steps), ["topology_id", "edge_ord"])
        by_key = self.per_key(self.keys.select(*KEY, "topology_id"), steps).drop("topology_id")
        return rows.join(by_key, [*KEY, "edge_ord"])


def path_id() -> Column:
    mark = F.when(F.col("path_type") == "final", "_p").otherwise("_o")
    return F.concat("request_id", mark, F.col("path_idx").cast("string"))


def node_names(labels: str, names: str) -> Column:
    """Labels are ordinals into `names`, or the names themselves where `names` is NULL."""
    return (F.when(F.col(names).isNull(), F.col(labels))
            .otherwise(F.transform(labels, lambda i: F.get(F.col(names), i.try_cast("int")))))


def build(edges: DataFrame, hold: Callable[..., DataFrame], wide_edges: int = WIDE_EDGES,
          max_hops: int | None = None, max_paths: int | None = None, dense_paths: int = DENSE_PATHS,
          *, most_checks: int, placed: DataFrame | None = None) -> Topologies:
    """`edges` is the edge rollup; `hold` keeps tables that several results read; no key has more than `most_checks` checks.

    `placed` is the rollup without what only the node table reads, if it is to be made for itself.
    """
    few, many = _placed_columns(edges) if placed is None else placed, None
    sizes = edges.groupBy(*KEY).agg(F.count("*").alias("n"))
    # A key has no more edges than checks.
    if most_checks > wide_edges and (sizes.agg(F.max("n")).first()[0] or 0) > wide_edges:
        wide_keys = bounded(sizes.filter(F.col("n") > wide_edges).select(*KEY))
        few = few.join(wide_keys, KEY, "left_anti")
        many = edges.join(wide_keys, KEY, "left_semi")
    keys, shapes, ordered = _few(few, hold)
    dense = list_dense = answered = None
    answers = shape_ops.answers(shapes, dense_paths).checkpoint()
    is_dense = F.col("acyclic") & (F.col("path_count") > dense_paths)
    n_dense, most_dense, most_steps = answers.agg(F.count_if(is_dense), F.max("path_count"), F.max(F.aggregate(
        "deciding", F.lit(0), lambda n, p: n + F.size(p.edge_ords)))).first()
    if n_dense:
        _guard(int(most_dense), (1 << 63) - 1 if max_paths is None else max_paths)
        answered = answers.filter(is_dense)
        ids = bounded(answered.select("topology_id"))
        dense = shapes.join(ids, "topology_id", "left_semi")
        shapes = shapes.join(ids, "topology_id", "left_anti")

        def list_dense() -> DataFrame:
            return _enumerate(*_shape_rows(dense), max_hops)
    shape_edges, shape_nodes = _shape_rows(shapes)
    wide = wide_nodes = None
    if many is not None:
        wide_info, wide, wide_shape_edges, nodes = _many(many)
        wide_shape_nodes = nodes.select("topology_id", "label", "node_ord", "kind")
        wide_nodes = nodes.select(*KEY, "node_ord", F.col("label").alias("node_name"))
        keys = keys.unionByName(wide_info)
        shape_edges = shape_edges.unionByName(wide_shape_edges)
        shape_nodes = shape_nodes.unionByName(wide_shape_nodes)
    paths = _enumerate(shape_edges, shape_nodes, max_hops, contract=many is not None and max_hops is None)
    routes = paths.groupBy("topology_id").agg(
        F.count("*").alias("path_count"), F.max(F.size("edge_ords")).alias("max_path_length"), F.sum(F.size("edge_ords")).alias("edges"))
    path_edges, most_paths = (x or 0 for x in routes.agg(F.sum("edges"), F.max("path_count")).first())
    _guard(most_paths, max_paths)
    routes, covered = routes.drop("edges"), paths.select("topology_id", F.explode("edge_ords").alias("edge_ord")).distinct()
    steps = _steps(paths)
    if answered is not None:
        deciding = answered.select("topology_id", F.explode("deciding").alias("p")).select("topology_id", "p.*")
        paths = paths.unionByName(deciding.drop("first_for"))
        first = deciding.select("topology_id", F.col("path_idx").alias("first_path"), F.explode("first_for").alias("edge_ord"))
        steps = steps.unionByName(_flat_steps(deciding).join(first, ["topology_id", "edge_ord"]))
        routes = routes.unionByName(answered.select("topology_id", F.col("path_count").cast("long").alias("path_count"), "max_path_length"))
        covered = covered.unionByName(answered.select("topology_id", F.explode("covered").alias("edge_ord")))
        path_edges += n_dense * most_steps
        most_paths = max(most_paths, wide_edges)
    steps = steps.checkpoint()
    return Topologies(keys, ordered, wide, wide_nodes, paths, steps, path_edges, most_checks * max(most_paths, 1),
                      routes, covered, dense, list_dense)


def _guard(paths: int, most: int | None) -> None:
    if most is not None and paths > most:
        raise PathExplosion(f"a graph has {paths} paths, more than {most}")


def _flat_steps(paths: DataFrame) -> DataFrame:
    return paths.select("topology_id", "path_idx", "path_type", F.posexplode("edge_ords").alias("pos", "edge_ord"))


def _steps(paths: DataFrame) -> DataFrame:
    steps = _flat_steps(paths)
    first = steps.groupBy("topology_id", "edge_ord").agg(F.min("path_idx").alias("first_path"))
    return steps.join(first, ["topology_id", "edge_ord"])


def _placed_columns(edges: DataFrame) -> DataFrame:
    """Without what only the node table reads of an edge's first check."""
    return edges.withColumn("first", F.struct(*[F.col(f"first.{c}") for c in FIRST]))


def _in_first(column: str) -> str:
    return f"first.{column}" if column in FIRST else column


def _few(edges: DataFrame, hold: Callable[..., DataFrame]):
    payload = ["first", *[c for c in edges.columns if c not in (*KEY, "first")]]
    hop = F.struct(*payload)  # sorts by the first check's step and tie
    hops = edges.groupBy(*KEY).agg(F.sort_array(F.collect_list(hop)).alias("hops"))
    # Lists of their own, so that they are not taken out of the hops again for every node.
    lists = {c: F.col(f"hops.{_in_first(c)}") for c in [*EDGE_COLUMNS, "node_type", "risk_level", "guardrail_type", "first_timestamp"]}
    hops = hops.withColumns(lists).withColumnsRenamed({"source_node": "sources", "target_node": "targets"})
    # A node is shown by the first hop that touches it, as its source if it is both ends.
    named = hops.withColumn("names", F.array_distinct(F.flatten(
        F.zip_with("sources", "targets", lambda s, t: F.array(s, t)))))

    def node(n: Column) -> Column:
        out, into = (F.coalesce(F.array_position(F.col(c), n), F.lit(0)) for c in ("sources", "targets"))
        return F.struct(n.alias("node_name"), out.alias("out"), into.alias("into"))

    def shown(s: Column) -> Column:
        as_target = (s.into > 0) & ((s.out == 0) | (s.into < s.out))
        return F.struct(
            s.node_name.alias("node_name"),
            F.when(as_target, F.element_at("node_type", s.into.cast("int")))
            .when(s.node_name == "User", "user").otherwise("agent").alias("node_type"),
            F.element_at("risk_level", F.when(as_target, s.into).when(s.out > 0, s.out).cast("int")).alias("risk_level"))
    joined = named.withColumn("nodes", F.transform(F.transform("names", node), shown))
    kinds = F.transform("nodes", lambda n: F.when(n.node_type.isin("user", "final"), n.node_type).otherwise("-"))
    links = F.zip_with("sources", "targets", lambda s, t: F.concat_ws(
        ">", F.array_position("names", s) - 1, F.array_position("names", t) - 1))
    joined = joined.withColumn("kinds", F.array_join(kinds, ",")).withColumn("links", F.array_join(links, ","))
    topology = F.sha2(F.concat_ws("|", "kinds", "links"), 256)
    # Held by key: every later join and window on keys starts from this partitioning.
    kept = F.arrays_zip("sources", "targets", *EDGE_COLUMNS[2:])
    shaped = hold(joined.select(
        *KEY, topology.alias("topology_id"), "names", "kinds", "links", kept.alias("hops"), F.size("nodes").alias("node_count"),
        F.size(F.filter("nodes", lambda n: n.risk_level == "high")).alias("high_risk_node_count"),
        F.get(F.filter("nodes", lambda n: n.node_type == "final"), F.lit(0)).node_name.alias("first_final"),
        F.coalesce(F.array_contains("trust_boundary", TO_FINAL), F.lit(False)).alias("has_final"),
        F.get("guardrail_type", F.lit(0)).alias("first_type"), F.array_min("first_timestamp").alias("request_time")),
        keep_partitioning=True)
    keys = shaped.select(*KEY_COLUMNS)
    ordered = (shaped.select(*KEY, "topology_id", F.posexplode("hops").alias("edge_ord", "hop"))
               .select(*KEY, "topology_id", "edge_ord", F.col("hop.sources").alias("source_node"),
                       F.col("hop.targets").alias("target_node"), *[F.col(f"hop.{c}") for c in EDGE_COLUMNS[2:]]))
    shapes = hold(shaped.groupBy("topology_id")
                  .agg(*[F.split(F.any_value(c), ",").alias(c) for c in ("kinds", "links")]))
    return keys, shapes, ordered


def _shape_rows(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges and the nodes of topologies, a row each."""
    shape_edges = (shapes.select("topology_id", F.posexplode("links").alias("edge_ord", "link"))
                   .select("topology_id", "edge_ord", F.substring_index("link", ">", 1).alias("src"),
                           F.substring_index("link", ">", -1).alias("tgt")))
    shape_nodes = (shapes.select("topology_id", F.posexplode("kinds").alias("node_ord", "kind"))
                   .select("topology_id", F.col("node_ord").cast("string").alias("label"), "node_ord", "kind"))
    return shape_edges, shape_nodes


def _many(edges: DataFrame):
    own = F.concat_ws("\u0001", F.lit("key"), *KEY).alias("topology_id")
    more = ["step_id", "tie", "guardrail_type", "first_timestamp"]
    flat = edges.select(*KEY, own, *[F.col(_in_first(c)) for c in EDGE_COLUMNS], *[F.col(_in_first(c)).alias(f"_{c}") for c in more])
    placed = position_in_group(flat, KEY, ["_step_id", "_tie"], "edge_ord").checkpoint()
    ordered = placed.select(*KEY, "topology_id", "edge_ord", *EDGE_COLUMNS)
    nodes = node_rollup(edges).select(
        *KEY, own, F.col("node_name").alias("label"), F.col("shown.step_id").alias("_step"),
        F.col("shown.tie").alias("_tie"), F.col("shown.role").alias("_role"),
        F.col("shown.risk_level").alias("_risk"), F.col("shown.node_type").alias("kind"))
    nodes = position_in_group(nodes, ["topology_id"], ["_step", "_tie", "_role"], "node_ord").checkpoint()
    of_edges = placed.select(*KEY, "topology_id", F.col("trust_boundary").eqNullSafe(TO_FINAL).alias("_final"), "_first_timestamp",
                             F.struct("_step_id", "_tie", "_guardrail_type").alias("_first"))
    info = nodes.unionByName(of_edges, allowMissingColumns=True).groupBy(*KEY, "topology_id").agg(
        F.lit(None).cast("array<string>").alias("names"),
        F.count("node_ord").cast("int").alias("node_count"),
        F.count_if(F.col("_risk") == "high").cast("int").alias("high_risk_node_count"),
        F.min_by(F.when(F.col("kind") == "final", F.col("label")),
                 F.when(F.col("kind") == "final", F.col("node_ord"))).alias("first_final"),
        F.bool_or("_final").alias("has_final"), F.min("_first")["_guardrail_type"].alias("first_type"),
        F.min("_first_timestamp").alias("request_time"))
    shape_edges = ordered.select("topology_id", "edge_ord", F.col("source_node").alias("src"),
                                 F.col("target_node").alias("tgt"))
    return info, ordered, shape_edges, nodes


def _contracted(hops: DataFrame) -> DataFrame:
    """`hops` with each chain of nodes that have one way in, one way out and are no end, as one hop.

    Every node of a chain finds the edge that leads into the chain, and its distance from there, by pointer doubling: the
    rounds are the logarithm of the longest chain. Nodes that find none lie on a cycle without a way in, which no walk reaches.
    """
    topo = ["topology_id"]
    ways_in = hops.groupBy(*topo, F.col("tgt").alias("label")).agg(
        F.count("*").alias("n_in"), F.min("node").alias("before"), F.min("edge_ord").alias("edge_in"), F.max("end_kind").alias("end"))
    ways_out = hops.groupBy(*topo, F.col("node").alias("label")).agg(F.count("*").alias("n_out"))
    inner = (ways_in.join(ways_out, [*topo, "label"]).filter("n_in = 1 AND n_out = 1 AND end IS NULL")
             .select(*topo, "label", "before", "edge_in").checkpoint())
    n, longest = inner.groupBy(*topo).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()

    def side(df: DataFrame) -> DataFrame:
        """A table of no more rows than there are inner nodes."""
        return F.broadcast(df) if n <= session.BROADCAST_ROWS else df
    of = side(inner.select(*topo, F.col("label").alias("before"), F.lit(True).alias("inside")))
    at = inner.join(of, [*topo, "before"], "left").select(
        *topo, "label", F.when(F.col("inside"), F.col("before")).alias("pointer"),
        F.when(F.col("inside").isNull(), F.col("edge_in")).alias("head"), F.when(F.col("inside"), 1).otherwise(0).alias("away")).checkpoint()
    for turn in range(longest.bit_length()):
        there = at.select(*topo, F.col("label").alias("pointer"), F.col("pointer").alias("next"), F.col("head").alias("found"), F.col("away").alias("more"))
        at = at.join(side(there), [*topo, "pointer"], "left").select(
            *topo, "label", F.col("next").alias("pointer"), F.coalesce("head", "found").alias("head"), (F.col("away") + F.coalesce("more", F.lit(0))).alias("away"))
        if turn % 2 or turn == longest.bit_length() - 1:
            at = at.checkpoint()
    inside = at.filter("head IS NOT NULL").select(*topo, F.col("label").alias("node"), "head", "away")
    onward = F.struct("tgt", "node_ord", "goes_on", "end_kind")
    chains = (hops.join(side(inside), [*topo, "node"]).groupBy(*topo, F.col("head").alias("edge_ord")).agg(
        F.array_sort(F.collect_list(F.struct("away", "node", F.col("edge_ord").alias("out")))).alias("c"), F.max_by(onward, "away").alias("w")))
    own = inner.select(*topo, F.col("label").alias("node"))
    outer = hops.join(side(own), [*topo, "node"], "left_anti")
    entries = outer.select(*topo, F.col("node").alias("first"), "edge_ord")
    long = (entries.join(side(chains), [*topo, "edge_ord"])
            .select(*topo, F.col("first").alias("node"), F.concat(F.transform("c", lambda x: x.node), F.array("w.tgt")).alias("labels"),
                    F.concat(F.array("edge_ord"), F.transform("c", lambda x: x.out)).alias("edge_ords"), "w.*"))
    plain = (outer.join(side(own.withColumnRenamed("node", "tgt")), [*topo, "tgt"], "left_anti")
             .select(*topo, "node", F.array("tgt").alias("labels"), F.array("edge_ord").alias("edge_ords"), "tgt", "node_ord", "goes_on", "end_kind"))
    return plain.unionByName(long.select(*plain.columns)).checkpoint()


def _enumerate(edges: DataFrame, nodes: DataFrame, max_hops: int | None, contract: bool = False) -> DataFrame:
    start = (nodes.filter("kind = 'user'").groupBy("topology_id")
             .agg(F.min_by("label", "node_ord").alias("start")))
    with_out = edges.select("topology_id", F.col("src").alias("label"), F.lit(True).alias("goes_on")).distinct()
    ends = (nodes.join(start, "topology_id").filter(F.col("label") != F.col("start"))
            .join(with_out, ["topology_id", "label"], "left")
            .select("topology_id", F.col("label").alias("tgt"), "node_ord", "goes_on",
                    F.when(F.col("kind") == "final", 0).when(F.col("goes_on").isNull(), 1).alias("end_kind")))
    hops = (edges.filter("src <> tgt").join(ends, ["topology_id", "tgt"])
            .select("topology_id", F.col("src").alias("node"), "tgt", "edge_ord", "node_ord", "goes_on", "end_kind")
            .checkpoint())
    if contract:
        hops = _contracted(hops)
    else:
        hops = hops.select("topology_id", "node", F.array("tgt").alias("labels"), F.array("edge_ord").alias("edge_ords"), "tgt", "node_ord", "goes_on", "end_kind")
    hops = hops.withColumnsRenamed({"labels": "hop_labels", "edge_ords": "hop_edges"})
    few = is_small(hops)
    walks = start.select("topology_id", F.col("start").alias("node"), F.array("start").alias("labels"),
                         F.array().cast("array<int>").alias("edge_ords"))
    if few:
        hops, walks = F.broadcast(hops), walks.coalesce(1)
    found, depth, tasks, seen = [], 0, 1, 0
    while True:
        step = (walks.join(hops, ["topology_id", "node"])
                .filter(~F.array_contains("labels", F.col("tgt")))
                .select("topology_id", F.col("tgt").alias("node"), F.concat("labels", "hop_labels").alias("labels"),
                        F.concat("edge_ords", "hop_edges").alias("edge_ords"),
                        "end_kind", F.col("node_ord").alias("end_ord"), "goes_on")
                .checkpoint())
        rows = step.count()
        if rows == 0:
            break
        depth, seen = depth + 1, seen + rows
        if max_hops is not None and depth > max_hops:
            raise PathExplosion(f"walks go on after {max_hops} hops")
        found.append(step.filter("end_kind IS NOT NULL"))
        walks = step.filter("goes_on").select("topology_id", "node", "labels", "edge_ords")
        if few and rows > tasks * FRONTIER_ROWS_PER_TASK:
            tasks = -(-2 * rows // FRONTIER_ROWS_PER_TASK)
            walks = walks.repartition(tasks, "topology_id", "node", "edge_ords")
    spark = edges.sparkSession
    if not found:
        return spark.createDataFrame(
            [], "topology_id string, path_idx long, path_type string, labels array<string>, edge_ords array<int>")
    ended = found[0]
    for more in found[1:]:
        ended = ended.unionByName(more)
    ended = ended.select("topology_id", "end_kind", "end_ord", "labels", "edge_ords")
    final = ended.filter("end_kind = 0")
    covered = final.select("topology_id", F.explode("edge_ords").alias("edge_ord")).distinct()
    dead = (ended.filter("end_kind = 1").select("*", F.explode("edge_ords").alias("edge_ord"))
            .join(F.broadcast(covered) if few else covered, ["topology_id", "edge_ord"], "left_anti")
            .drop("edge_ord").distinct())
    return _number(final.unionByName(dead), seen)


def _number(ended: DataFrame, at_most: int) -> DataFrame:
    """Number the paths of a graph; `at_most` bounds how many paths there are in all."""
    order = ["end_kind", "end_ord", "edge_ords"]
    wide = False
    if at_most > WIDE_PATHS:
        ended = ended.checkpoint()
        wide = (ended.groupBy("topology_id").count().agg(F.max("count")).first()[0] or 0) > WIDE_PATHS
    if wide:
        numbered = position_in_group(ended, ["topology_id"], order, "path_idx")
    else:
        numbered = ended.withColumn(
            "path_idx", F.row_number().over(W.partitionBy("topology_id").orderBy(*order)) - 1)
    kind = F.when(F.col("end_kind") == 0, "final").otherwise("orphan_branch").alias("path_type")
    return numbered.select("topology_id", F.col("path_idx").cast("long").alias("path_idx"), kind, "labels", "edge_ords").checkpoint()


def path_table(topo: Topologies, paths: DataFrame | None = None) -> DataFrame:
    """All paths of all keys, named and numbered; or those of `paths`."""
    return (topo.per_key(topo.keys, topo.every_path if paths is None else paths)
            .select(*KEY, F.col("path_idx").cast("int") if paths is None else "path_idx", "path_type", path_id().alias("path_id"),
                    node_names("labels", "names").alias("path_nodes"), "edge_ords"))


def ordered_nodes(topo: Topologies) -> DataFrame:
    """Every node with its position by first appearance."""
    few = topo.keys.select(*KEY, F.posexplode("names").alias("node_ord", "node_name"))
    return few if topo.wide_nodes is None else few.unionByName(topo.wide_nodes)
