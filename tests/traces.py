"""Helpers to write small traces, and traces that tests share."""

import random
from decimal import Decimal

from hopsight.schema import TRACE

INTERNAL = "AGENT_TO_AGENT_INTERNAL"


def row(step, source, target, **over):
    kind = {"FinalAnswer": "final"}.get(target, "tool" if target.endswith("Tool") else "agent")
    boundary = ("USER_TO_AGENT" if source == "User" else "AGENT_TO_FINAL_RESPONSE" if kind == "final"
                else "AGENT_TO_TOOL" if kind == "tool" else INTERNAL)
    base = dict(
        workflow_id="w", request_id="r", step_id=step, node_id=f"n_{target}", source_node=source, target_node=target,
        node_type=kind, step_type=kind, agent_name=target, guardrail_type="PII_CHECK", policy_id="p1", text_hash="h1",
        input_text_hash="h1", output_text_hash="h1", text_changed=False, trust_boundary=boundary, risk_level="low",
        edge_risk_level="low", guardrail_result="PASS", severity="NONE", confidence=0.5, latency_ms=Decimal("100"),
        estimated_cost_usd=Decimal("0.001"), timestamp="2024-01-01 00:00:00", workflow_template="t",
        behavior_pattern="b")
    unknown = set(over) - set(base)
    assert not unknown, unknown
    return {**base, **over}


def frame(spark, rows):
    names = TRACE.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], TRACE)


MICRO = {
    "diamond": [row(1, "User", "A"), row(2, "A", "B"), row(3, "A", "C"), row(4, "B", "D"), row(5, "C", "D"),
                row(6, "D", "FinalAnswer")],
    "fan_out_in": [row(1, "User", "A"), row(2, "A", "XTool"), row(3, "A", "YTool"), row(4, "XTool", "B"),
                   row(5, "YTool", "B"), row(6, "B", "FinalAnswer")],
    "final_on_the_way_to_another": [row(1, "User", "A"), row(2, "A", "F1", node_type="final"),
                                    row(3, "F1", "B"), row(4, "B", "F2", node_type="final")],
    "dead_end_shares_prefix": [row(1, "User", "A"), row(2, "A", "B"), row(3, "B", "C"), row(4, "A", "FinalAnswer")],
    "no_user": [row(1, "A", "B"), row(2, "B", "FinalAnswer")],
    "self_loop": [row(1, "User", "A"), row(2, "A", "A"), row(3, "A", "FinalAnswer")],
    "cycle_without_exit": [row(1, "User", "A"), row(2, "A", "B"), row(3, "B", "A")],
    "repeated_steps": [row(1, "User", "A"), row(2, "A", "B"), row(2, "A", "B", policy_id="p2"),
                       row(2, "B", "FinalAnswer"), row(3, "B", "FinalAnswer")],
    "null_policy_and_text": [row(1, "User", "A", policy_id=None), row(2, "A", "B", policy_id=None),
                             row(3, "B", "C", policy_id=None, text_hash=None), row(4, "C", "D", text_hash=None),
                             row(5, "D", "FinalAnswer")],
    "mixed_boundary_on_edge": [row(1, "User", "A"), row(2, "A", "B"), row(3, "A", "B", trust_boundary="AGENT_TO_TOOL"),
                               row(4, "B", "C", trust_boundary="TOOL_TO_AGENT"), row(5, "B", "C")],
    "edge_only_high": [row(1, "User", "A"), row(2, "A", "B", edge_risk_level="high"), row(3, "A", "B"),
                       row(4, "B", "FinalAnswer")],
    "unknown_boundary": [row(1, "User", "A", trust_boundary="OTHER"), row(2, "A", "B", trust_boundary="OTHER")],
    "single_row": [row(1, "User", "A")],
    "exact_copies": [row(1, "User", "A")] * 3 + [row(2, "A", "B")] * 4 + [row(3, "B", "FinalAnswer")] * 2,
    "unclassified_risk": [row(1, "User", "A"), row(2, "A", "B", risk_level="odd"), row(3, "B", "C", risk_level=None)],
    "user_is_typed_target": [row(1, "A", "User", node_type="user"), row(2, "User", "B"), row(3, "B", "FinalAnswer")],
}


def combined(names=None):
    return [{**r, "workflow_id": name, "request_id": f"req_{name}"} for name, rows in MICRO.items()
            if names is None or name in names for r in rows]


def scrambled(seed, keys=12, ties=True):
    rng, rows = random.Random(seed), []
    names = ["User", "A", "B", "C", "D", "XTool", "FinalAnswer"]
    for k in range(keys):
        for i in range(rng.randint(1, 14)):
            source, target = ("User" if i == 0 else rng.choice(names)), rng.choice(names[1:])
            rows.append(row(
                rng.randint(1, 9) if ties and k % 3 == 0 else i + 1, source, target, workflow_id=f"w{k % 5}", request_id=f"r{k}",
                guardrail_type=rng.choice(["PII_CHECK", "TOXICITY_CHECK"]), policy_id=rng.choice(["p1", "p1", "p2", None]),
                text_hash=rng.choice(["h1", "h1", "h2", None]), text_changed=rng.random() < 0.1,
                risk_level=rng.choice(["low", "low", "medium", "high", "odd"]),
                edge_risk_level=rng.choice(["low", "low", "high"]),
                guardrail_result=rng.choice(["PASS", "PASS", "PASS", "WARN", "BLOCK"])))
    return rows


def clean(keys=60, seed=3):
    """Traces whose checks all lie on a path, once each: what the gates and audits accept."""
    rng, rows = random.Random(seed), []
    shapes = [MICRO[n] for n in ("diamond", "fan_out_in", "dead_end_shares_prefix", "single_row")]
    shapes.append([row(1, "User", "A"), row(2, "A", "B"), row(3, "B", "C"), row(4, "C", "D"), row(5, "D", "FinalAnswer")])
    for k in range(keys):
        risk = rng.choice(["low", "low", "medium", "high", "unknown"])
        rows += [{**r, "workflow_id": f"w{k % 20}", "request_id": f"r{k}", "risk_level": risk, "edge_risk_level": risk,
                  "workflow_template": f"t{k % 20 % 4}", "policy_id": rng.choice(["p1"] * 5 + ["p2"]),
                  "guardrail_result": rng.choice(["PASS"] * 6 + ["WARN", "BLOCK"])} for r in rng.choice(shapes)]
    return rows
