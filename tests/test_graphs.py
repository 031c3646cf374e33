"""Micro-graphs and random graphs against SQL, hand-written rows, and each other on every execution route."""

import random

import pytest

from checks import compare, oracle as o, registry
from hopsight import Analysis, session
from hopsight.plans import audit
from tests import traces
from tests.traces import MICRO, combined, row, scrambled

TRACE = "trace AS MATERIALIZED (SELECT * FROM given)"
ROUTES = [{}, {"heavy_rows": 1}, {"wide_edges": 1}, {"wide_edges": 3, "heavy_rows": 5}, {"dense_paths": 0}, {"dense_paths": 1, "heavy_rows": 1}]


def equals_sql(spark, rows, strict=False, **limits):
    """Every graph result of the trace equals SQL; SQL leaves the order of tied steps open, so there may be none but exact copies."""
    import duckdb
    import pyarrow as pa

    a, con = Analysis(traces.frame(spark, rows), strict=strict, **limits), duckdb.connect()
    con.register("given", pa.Table.from_pylist(rows))
    if strict:
        a.hold_checks()
    plan = o.plan_sql(strict)
    for name, table, chain, select in (
            ("nodes", a.nodes, o.GRAPH, registry._NODES), ("edges", a.edges, o.GRAPH, registry._EDGES),
            ("paths", a.paths, o.PATHS, registry._PATHS), ("plan", a.plan, plan, registry._PLAN_SELECT),
            ("redundant", a.redundant, o.REDUNDANT, "SELECT * FROM redundant"),
            ("features", a.features, o.PATHS + o.FEATURES, "SELECT * FROM features"),
            ("accounting", a.accounting(), plan, registry._ACCOUNTING),
            ("uncovered", audit.uncovered_edges(a.topologies), o.PATHS, registry._UNCOVERED)):
        said = compare.differences(registry.flat(table), con, o.query(TRACE, chain, select))
        assert said == "", f"{name}: {said}"
    a.release()


def results(spark, rows, **limits):
    a = Analysis(traces.frame(spark, rows), **limits)
    out = [sorted(map(str, t.collect())) for t in (a.plan, a.redundant, a.features, a.paths, a.nodes)]
    a.release()
    return out


WITHOUT_TIES = set(MICRO) - {"repeated_steps"}


def test_micro_graphs(spark):
    equals_sql(spark, combined(WITHOUT_TIES))
    a = Analysis(traces.frame(spark, combined()))
    missing = {(r.workflow_id, r.problem) for r in a.accounting().collect()}
    assert ("no_user", "missing_from_plan") in missing and ("repeated_steps", "step_id_repeated") in missing
    uncovered = {(r.workflow_id, r.source_node, r.target_node) for r in audit.uncovered_edges(a.topologies).collect()}
    assert {("self_loop", "A", "A"), ("cycle_without_exit", "B", "A"), ("no_user", "A", "B")} <= uncovered
    assert not any(w == "diamond" for w, _, _ in uncovered)


def test_hand_written_plan(spark):
    """Decisions of the diamond and of the dead end, written down by hand."""
    a = Analysis(traces.frame(spark, combined({"diamond", "dead_end_shares_prefix"})))
    found = {(r.workflow_id, r.step_id): (r.recommended_decision, r.reused_from_step_id, r.graph_path_id[-3:]) for r in a.plan.collect()}
    skip, keep = "SKIP_REDUNDANT_WITH_AUDIT", "KEEP"
    assert found == {
        ("diamond", 1): (keep, None, "_p0"), ("diamond", 2): (skip, 1, "_p0"), ("diamond", 3): (skip, 1, "_p1"),
        ("diamond", 4): (skip, 2, "_p0"), ("diamond", 5): (skip, 3, "_p1"), ("diamond", 6): (keep, None, "_p0"),
        ("dead_end_shares_prefix", 1): (keep, None, "_p0"), ("dead_end_shares_prefix", 2): (keep, 1, "_o1"),
        ("dead_end_shares_prefix", 3): (keep, 2, "_o1"), ("dead_end_shares_prefix", 4): (keep, None, "_p0")}


@pytest.mark.parametrize("seed,strict,limits", [
    (1, False, {}), (2, True, {}), (3, False, {"heavy_rows": 4}), (5, True, {"wide_edges": 3, "heavy_rows": 5}),
    (6, False, {"dense_paths": 0}), (7, True, {"dense_paths": 1, "heavy_rows": 4})])
def test_random_graphs(spark, seed, strict, limits):
    equals_sql(spark, scrambled(seed, ties=False), strict, **limits)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_routes_and_input_order_agree_on_ties_and_copies(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(session, "BROADCAST_ROWS", broadcast_rows)
    rows = scrambled(6, keys=9) + combined()
    rows += random.Random(2).choices(rows, k=40)
    expected = results(spark, rows)
    for i, limits in enumerate(ROUTES[1:]):
        mixed = random.Random(i).sample(rows, len(rows))
        assert results(spark, mixed, **limits) == expected, limits


COPIES = [("high", "PASS", False, "high_risk_check_kept"), ("high", "PASS", True, "high_risk_duplicate_requires_human_review"),
          ("odd", "PASS", False, "first_occurrence_on_this_graph_path"), ("odd", "PASS", True, "unclassified_risk_escalated_for_safety"),
          ("low", "WARN", False, "first_occurrence_on_this_graph_path"), ("low", "BLOCK", True, "conflicting_guardrail_results")]


def test_exact_copies_are_planned_by_their_first(spark):
    """A copied row's first copy decides, whatever the route: only what came before it counts, never itself."""
    rows = []
    for i, (risk, result, earlier, _) in enumerate(COPIES):
        key = {"request_id": f"r{i}"}
        rows.append(row(1, "User", "A", guardrail_type="PII_CHECK" if earlier else "TOXICITY_CHECK", **key))
        rows += [row(2, "A", "B", risk_level=risk, edge_risk_level=risk, guardrail_result=result, **key)] * 3
        rows.append(row(3, "B", "FinalAnswer", **key))
    expected = {f"r{i}": (reason, 1 if "human_review" in reason or "escalated" in reason or "conflicting" in reason else None)
                for i, (_, _, _, reason) in enumerate(COPIES)}
    for limits in ROUTES:
        plan = Analysis(traces.frame(spark, rows), **limits).plan.filter("step_id = 2").collect()
        assert {r.request_id: (r.reason, r.reused_from_step_id) for r in plan} == expected, limits
        assert len(plan) == len(COPIES)


def test_one_key_with_a_third_of_all_rows(spark):
    rng = random.Random(7)
    hot = [row(i + 1, *rng.choice([("User", "A"), ("A", "B"), ("B", "A"), ("B", "FinalAnswer")]),
               request_id="hot", risk_level=rng.choice(["low", "medium"]),
               guardrail_result=rng.choice(["PASS", "WARN"])) for i in range(300)]
    hot += [row(500, "A", "B", request_id="hot")] * 300
    cold = [{**r, "request_id": f"cold{i}"} for i in range(100) for r in MICRO["diamond"]]
    equals_sql(spark, hot + cold, heavy_rows=100)


def test_the_plan_expands_deciding_paths_only(spark):
    """12 diamonds in a row: 4,096 paths, of which those that are the first on some edge decide."""
    rows = [row(1, "User", "L0")]
    for i in range(12):
        for side in "ab":
            rows += [row(len(rows) + 1, f"L{i}", f"{side}{i}"), row(len(rows) + 2, f"{side}{i}", f"L{i + 1}")]
    rows.append(row(len(rows) + 1, "L12", "FinalAnswer"))
    a = Analysis(traces.frame(spark, rows))
    assert a.paths.count() == 4096
    assert a.path_checks.deciding_steps().count() <= len(rows) ** 2
    assert a.path_checks.deciding_steps().select("path_idx").distinct().count() <= len(rows)
    assert a.plan.count() == len(rows)


def test_checks_are_not_dealt_by_topology(spark, monkeypatch):
    """With paths that are not few, the checks meet their path steps by key."""
    from hopsight.operators import paths
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(paths, "SHARED_KEYS", 3)
    rows = [{**r, "request_id": f"r{i}"} for i in range(8) for r in MICRO["diamond"]] + scrambled(4, keys=4, ties=False)
    a = Analysis(traces.frame(spark, rows))
    placed = a.topologies.place(a.path_checks.parts[0].on_edges(), a.topologies.path_steps)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "(edge_ord" in plan and not any("topology_id" in x and "edge_ord" in x for x in plan.splitlines() if "Join" in x)
    equals_sql(spark, rows)


def test_path_guards_raise_instead_of_truncating(spark):
    from hopsight.operators.paths import PathExplosion
    rows = [row(1, "User", "L0")]
    for i in range(4):
        for side in "ab":
            rows += [row(len(rows) + 1, f"L{i}", f"{side}{i}"), row(len(rows) + 2, f"{side}{i}", f"L{i + 1}")]
    rows.append(row(len(rows) + 1, "L4", "FinalAnswer"))
    assert Analysis(traces.frame(spark, rows)).paths.count() == 16
    with pytest.raises(PathExplosion):
        Analysis(traces.frame(spark, rows), max_paths=15).topologies
    with pytest.raises(PathExplosion):
        Analysis(traces.frame(spark, rows), max_hops=5).topologies


def diamonds(n, **over):
    """`n` diamonds in a row: 2 ** n paths."""
    rows = [row(1, "User", "L0", **over)]
    for i in range(n):
        for side in "ab":
            rows += [row(len(rows) + 1, f"L{i}", f"{side}{i}", **over), row(len(rows) + 2, f"{side}{i}", f"L{i + 1}", **over)]
    return [*rows, row(len(rows) + 1, f"L{n}", "FinalAnswer", **over)]


def test_dense_graphs_are_answered_without_listing_paths(spark):
    """40 diamonds have 2 ** 40 paths; counts, coverage, the plan and the busiest path come without them."""
    rows = diamonds(40) + [row(900, "b7", "Nowhere"), row(901, "Lost", "Lost2")] + [row(902, "b3", "L4")] * 3
    a = Analysis(traces.frame(spark, rows + [{**r, "request_id": "small"} for r in MICRO["diamond"]]))
    features = {r.request_id: r for r in a.features.collect()}
    big = features["r"]
    assert big.path_count == 2 ** 40 + 2 ** 7 and big.max_path_length == 82 and features["small"].path_count == 2
    names = big.highest_redundancy_path.split(" -> ")
    assert names[:2] == ["User", "L0"] and names[-1] == "FinalAnswer" and len(names) == 83 and "b3" in names and names.count("a3") == 0
    assert all(f"a{i}" in names for i in range(40) if i != 3)
    assert {(r.source_node, r.target_node) for r in audit.uncovered_edges(a.topologies).collect()} == {("Lost", "Lost2")}
    plan = a.plan.filter("request_id = 'r'").collect()
    assert sorted(r.step_id for r in plan) == [r["step_id"] for r in sorted(rows, key=lambda r: r["step_id"]) if r["step_id"] not in (901, 902)] + [902]
    by = {r.step_id: r for r in plan}
    assert by[2].graph_path_id == "r_p0" and by[4].graph_path_id == f"r_p{2 ** 39}" and by[900].path_type == "orphan_branch"
    assert by[900].graph_path_id == f"r_o{2 ** 40}"
    assert a.explanations(5).count() == 1
    with pytest.raises(Exception, match="more than 1000"):
        Analysis(traces.frame(spark, rows), max_paths=1000).topologies


def test_dense_answers_equal_the_listing(spark):
    """The same graphs with and without listing, where both can run."""
    rows = diamonds(7) + [row(300, "a2", "End"), row(301, "L1", "L3"), row(302, "L3", "X", node_type="final"), row(303, "X", "L5")]
    rows += [{**r, "request_id": "other"} for r in rows if r["step_id"] % 5]
    rows += random.Random(4).choices(rows, k=60)
    assert results(spark, rows, dense_paths=4) == results(spark, rows)


def test_a_long_chain_takes_few_jobs(spark):
    """2,000 hops, with a branch, a dead end and a cycle without a way in: doubling, not a job a hop."""
    rows = [row(1, "User", "n0")] + [row(i + 2, f"n{i}", f"n{i + 1}") for i in range(1998)]
    rows += [row(2000, "n1998", "FinalAnswer"), row(2001, "n700", "side"), row(2002, "side", "n900"), row(2003, "n1000", "dead"), row(2004, "c0", "c1"), row(2005, "c1", "c0")]
    sc = spark.sparkContext
    sc.setJobGroup("chain", "long chain")
    a = Analysis(traces.frame(spark, rows))
    paths = {r.path_id: r for r in a.paths.collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((i, len(r.path_nodes)) for i, r in paths.items()) == [("r_o2", 1003), ("r_o3", 805), ("r_p0", 2001), ("r_p1", 1803)]
    assert paths["r_p0"].path_nodes == ["User", *[f"n{i}" for i in range(1999)], "FinalAnswer"] and paths["r_p0"].edge_ords == list(range(2000))
    assert paths["r_o2"].path_nodes[-2:] == ["n1000", "dead"]
    assert {(r.source_node, r.target_node) for r in audit.uncovered_edges(a.topologies).collect()} == {("c0", "c1"), ("c1", "c0")}
    assert jobs < 120, jobs
    a.release()


def test_equal_shapes_share_one_topology(spark):
    rows = [{**r, "request_id": f"r{i}", "source_node": r["source_node"].replace("B", f"B{i}"),
             "target_node": r["target_node"].replace("B", f"B{i}")} for i in range(5) for r in MICRO["diamond"]]
    a = Analysis(traces.frame(spark, rows))
    assert a.topologies.paths.select("topology_id").distinct().count() == 1
    assert a.paths.count() == 10
    assert {"User", "A", "B3", "D", "FinalAnswer"} in [set(r.path_nodes) for r in a.paths.collect()]
