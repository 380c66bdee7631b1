"""Token budgets of JSON answers, on the driver: answers are small."""

from __future__ import annotations

import json

from graphloom.functions.text import estimate_tokens

DETAILS = frozenset({"full_body", "context", "path", "error_log", "notes", "details"})
LISTS = frozenset({"results", "symbols", "neighbors", "impacted_symbols", "references"})
MOST = 10


def tokens_of(value) -> int:
    return estimate_tokens(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def without(value, keys: frozenset):
    """The value without these keys, at any depth."""
    if isinstance(value, dict):
        return {k: without(v, keys) for k, v in value.items() if k not in keys}
    return [without(v, keys) for v in value] if isinstance(value, list) else value


def truncate_results(value, most: int = MOST):
    """Known lists cut to ``most`` rows, and the count beside them."""
    if isinstance(value, list):
        return [truncate_results(v, most) for v in value]
    if not isinstance(value, dict):
        return value
    out, count = {}, value.get("count")
    for k, v in value.items():
        if k == "count":
            continue
        cut = truncate_results(v, most)
        if k in LISTS and isinstance(cut, list) and len(cut) > most:
            cut = cut[:most]
            if isinstance(count, int) and not isinstance(count, bool) and count > most:
                count = most
        out[k] = cut
    return {**out, "count": count} if "count" in value else out


STRATEGIES = (
    ("StripDocstrings", lambda v: without(v, frozenset({"docstring"}))),
    ("StripSignatures", lambda v: without(v, frozenset({"signature"}))),
    ("RemoveDetails", lambda v: without(v, DETAILS)),
    ("TruncateResults", truncate_results),
)


def enforce_budget(value, budget: int) -> tuple:
    """(value, truncated, last strategy): strategies in order until it fits."""
    if tokens_of(value) <= budget:
        return value, False, None
    name = None
    for name, apply in STRATEGIES:
        value = apply(value)
        if tokens_of(value) <= budget:
            break
    return value, True, name


def budgeted(value, budget: int | None) -> dict | None:
    """The answer with its token figures, reduced to the budget; None without a budget."""
    if not budget or budget <= 0:
        return None
    reduced, cut, name = enforce_budget(value, budget)
    used = tokens_of(reduced)
    over = used > budget
    out = {"result": reduced, "budget_requested": budget, "tokens_used": used, "budget_remaining": 0 if over or cut else budget - used, "truncated": over or cut}
    return {**out, "compression_applied": name} if cut else out
