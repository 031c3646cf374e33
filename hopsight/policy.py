"""Placement policy: plain values that become literals in the expressions."""

from __future__ import annotations

from copy import deepcopy
from decimal import Decimal

# Boundaries, decisions and the default policy.
USER_TO_AGENT = "USER_TO_AGENT"
AGENT_TO_TOOL = "AGENT_TO_TOOL"
TOOL_TO_AGENT = "TOOL_TO_AGENT"
TO_FINAL = "AGENT_TO_FINAL_RESPONSE"
INTERNAL = "AGENT_TO_AGENT_INTERNAL"
PROTECTED = [USER_TO_AGENT, AGENT_TO_TOOL, TOOL_TO_AGENT, TO_FINAL]

KEEP = "KEEP"
REUSE = "REUSE_PREVIOUS_DECISION"
SKIP = "SKIP_REDUNDANT_WITH_AUDIT"
MOVE = "MOVE_TO_BOUNDARY"
REVIEW = "HUMAN_REVIEW_REQUIRED"

ADDED_CHECK_LATENCY_MS = Decimal("260.0")
ADDED_CHECK_COST_USD = Decimal("0.0003")

DEFAULT_POLICY = {
    "protected_boundaries": PROTECTED,
    "never_reuse_previous_results": ["WARN", "BLOCK"],
    "skip_allowed_risk_levels": ["low"],
    "reuse_allowed_risk_levels": ["low", "medium"],
    "savings_model": {KEEP: 0.0, REVIEW: 0.0, MOVE: 0.0, REUSE: 0.8, SKIP: 1.0},
    "risk_score_weights": {
        "high_risk_boundary": 3,
        "tool_boundary": 2,
        "missing_final_check": 2,
        "policy_drift": 1,
        "text_mutation": 1,
        "warn_result": 1,
        "block_result": 2,
    },
}


def with_overrides(**changes) -> dict:
    """The default policy with some entries replaced."""
    unknown = set(changes) - set(DEFAULT_POLICY)
    if unknown:
        raise KeyError(f"unknown policy entries {sorted(unknown)}")
    return {**deepcopy(DEFAULT_POLICY), **changes}


def completed(policy: dict) -> dict:
    """`policy` with the default for every entry, and every risk weight, that it does not give."""
    given = with_overrides(**policy)
    return {**given, "risk_score_weights": {**DEFAULT_POLICY["risk_score_weights"], **given["risk_score_weights"]}}
