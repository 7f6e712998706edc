"""What a model reads: prompts of packs and targets, working sets, and the plan of a task's queries. All of it is made on
the driver, from rows that a limit has already bounded."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.operators import graph, pack
from sparkweave.operators.model import FACET_ORDER

BOUNDARY = "Boundary: authority_effect=none; no_apply=true."


def tokens(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def fitted(rows: list, render: Callable[[list], str], budget: int, least: int = 0) -> tuple[str, list]:
    """The text of the most leading rows that fits the budget, but of `least` rows at any rate."""
    rows = list(rows)
    text = render(rows)
    while len(rows) > least and tokens(text) > budget:
        rows.pop()
        text = render(rows)
    return text, rows


def pack_prompt(chosen: DataFrame, task: str, budget: int) -> tuple[str, int, int]:
    """(text, its tokens, rows in it) of a pack's rows; the last rows go while the whole text is over the budget."""
    rows = [r.asDict() for r in chosen.orderBy("position").collect()]
    words = pack.task_terms(task)

    def render(kept: list[dict]) -> str:
        missing = [w for w in words if not any(w in r["row"].lower() for r in kept)]
        lines = ["# Context pack", "", f"Task: {task}", BOUNDARY, f"Budget: {budget} tokens, {len(kept)} rows", "", "## Rows"]
        lines += [f"- {r['kind']} id={r['id']} score={r['score']} row={r['row']}" for r in kept] or ["- none"]
        return "\n".join(lines + (["", "## Missing terms", "- " + ", ".join(missing)] if missing else [])) + "\n"

    text, kept = fitted(rows, render, budget)
    return text, tokens(text), len(kept)


def review_prompt(adjudicated: DataFrame, budget: int, most: int = 100) -> tuple[str, int]:
    """Targets by priority, as many as fit."""
    rows = [r.asDict() for r in adjudicated.orderBy(F.desc("priority_score"), "target").limit(most).collect()]
    line = lambda r: f"- {r['target']} verdict={r['verdict']} priority={r['priority_score']} confidence={r['confidence_score']} risks={','.join(r['risk_flags']) or 'none'}"
    text, kept = fitted(rows, lambda kept: "\n".join(["# Target review", "", BOUNDARY, "", "## Priority", *([line(r) for r in kept] or ["- none"])]) + "\n", budget)
    return text, len(kept)


def target_prompt(found: dict[str, list[dict]], target: str, budget: int) -> tuple[str, dict[str, int]]:
    """A target's matches; rows go from edges, conflicts, sources, entities, in that order of kinds, last rows first, but
    one entity and one source stay."""
    kept = {k: list(found.get(k, ())) for k in ("entity", "source", "edge", "conflict")}

    def render() -> str:
        out = [f"# Target: {target}", "", BOUNDARY]
        for k, rows in kept.items():
            out += ["", f"## {k}", *(f"- {r['id']} score={r['score']}" for r in rows)]
        return "\n".join(out) + "\n"

    text = render()
    while tokens(text) > budget:
        kind = next((k for k in ("edge", "conflict", "source", "entity") if len(kept[k]) > (k in ("source", "entity"))), None)
        if kind is None:
            break
        kept[kind].pop()
        text = render()
    return text, {k: len(v) for k, v in kept.items()}


def _cut(text: str, limit: int) -> str:
    limit = max(8, limit)
    return text if len(text) <= limit else text[: limit - 1].rstrip() + "..."


def working_set(index: DataFrame, limit: int = 24, max_tokens: int | None = None, min_facets: int = 4, label_chars: int = 96, value_chars: int = 160, balance: bool = True) -> dict:
    """Facet rows for a task, without identity: the best of each facet first (or by rank alone), as many as fit.

    A row that doesn't fit is skipped and the next is tried; the first row stays in any case, with a warning.
    """
    ordered = graph.balanced(index, list(FACET_ORDER), limit, min_facets if balance else 0)
    candidates = [{"row_id": r.row_id, "facet": r.facet, "label": _cut(r.label or "", label_chars), "value": _cut(r.value or "", value_chars), "score": r.score} for r in ordered.collect()]
    kept: list[dict] = []
    payload = lambda rows: {"rows": rows, "authority_effect": "none", "no_apply": True}
    size = lambda rows: tokens(json.dumps(payload(rows), ensure_ascii=True, indent=2, sort_keys=True))
    for row in candidates:
        if max_tokens is None or not kept or size([*kept, row]) <= max_tokens:
            kept.append(row)
    facets = {r["facet"] for r in kept}
    warnings = [w for w, when in (("no_rows", not kept), ("token_budget_applied", len(kept) < len(candidates)), ("minimum_exceeds_token_budget", max_tokens is not None and bool(kept) and size(kept) > max_tokens), ("facet_coverage_not_met", balance and len(facets) < min_facets)) if when]
    return tx.without_identity(payload(kept)) | {"facets": sorted(facets), "estimated_tokens": size(kept), "omitted": len(candidates) - len(kept), "warnings": warnings, "status": "warn" if warnings else "pass"}


def task_plan(task: str, folder: str, token_budget: int = 4000, limit: int = 50, presets_most: int = 3) -> list[dict]:
    """Steps of a task, as arguments of the command line: a health gate, a pack, then the presets that the task's words
    lead to. A preset that the read model lacks is optional."""
    steps = [{"id": "00_health_gate", "argv": ["doctor", folder], "role": "gate_first", "optional": False}, {"id": "01_pack", "argv": ["pack", folder, "--task", task, "--token-budget", str(token_budget), "--limit", str(limit)], "role": "read_first", "optional": False}]
    for n, (preset, _) in enumerate(pack.route(task, presets_most), 1):
        steps.append({"id": f"1{n}_view_{preset}", "argv": ["query", folder, "--preset", preset, "--limit", str(limit)], "role": "expand_if_needed", "optional": False})
        steps.append({"id": f"2{n}_read_model_{preset}", "argv": ["sql", folder, "--preset", preset, "--limit", str(limit)], "role": "expand_if_read_model_available", "optional": True})
    return steps
