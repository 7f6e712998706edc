"""Handoffs: what a model is given, what it costs, and whether that is still so; context bundles; the one-plane audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import text as tx

#: Share of a context's token budget that contents may use.
CONTENT_SHARE = 0.65
CUT_MARK = "\n...<truncated>...\n"


def measured(files: DataFrame, content: str = "content") -> DataFrame:
    """path, bytes, sha256, estimated_tokens of text files: what a handoff records of an artifact."""
    text = F.coalesce(F.col(content), F.lit(""))
    return files.select("path", F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"), F.when(text == "", 0).otherwise(tx.estimate_tokens(text)).cast("long").alias("estimated_tokens"))


def artifact_checks(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """id, role, passed: of each recorded artifact (role, path, bytes, sha256, estimated_tokens), whether its file exists and
    still is what was recorded. One equi-join by path; a missing file fails every check."""
    now = actual.select(F.col("path").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("bytes", "sha256", "estimated_tokens")])
    both = recorded.join(now, F.col("path") == F.col("_p"), "left")
    named = F.coalesce("path", F.lit("")) != ""
    checks = [("artifact_path_present", named), ("artifact_exists", F.col("_p").isNotNull())] + [(f"artifact_{c}_match", F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))) for c in ("bytes", "sha256", "estimated_tokens")]
    rows = both.select("role", F.explode(F.array(*[F.struct(F.lit(k).alias("id"), v.alias("passed")) for k, v in checks])).alias("c"), named.alias("_named"))
    return rows.filter(F.col("_named") | (F.col("c.id") == "artifact_path_present")).select(F.concat("c.id", F.lit(":"), "role").alias("id"), "role", "c.passed")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)


def savings_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round(F.greatest(F.lit(0.0), (before - after) / before * 100), 3)).otherwise(0.0)


def economics(prompt: Column, machine: Column) -> list[Column]:
    """What a prompt of so many tokens costs against the whole context."""
    return [prompt.alias("model_prompt_estimated_tokens"), machine.alias("machine_context_estimated_tokens"), ratio(prompt, machine).alias("model_prompt_to_machine_context_ratio"), F.greatest(F.lit(0), machine - prompt).cast("long").alias("estimated_token_savings"), savings_percent(machine, prompt).alias("estimated_token_savings_percent")]


GATES = ("continuation", "context_gate", "context_advantage", "public_boundary_audit", "prompt_present")


def build(task: str, targets: list[str], gates: dict[str, bool], prompt: str, machine_context: str, paths: dict[str, str]) -> dict:
    """A handoff: allowed only if all gates pass; then it names the prompt, else none. gates: GATES but the last."""
    passed = {**{g: bool(gates.get(g)) for g in GATES[:-1]}, "prompt_present": bool(prompt.strip())}
    allowed = all(passed.values())
    tokens = lambda t: max(1, (len(t) + 3) // 4) if t else 0
    p, m = tokens(prompt) if allowed else 0, tokens(machine_context)
    cost = {"status": "measured" if allowed else "not_applicable", "model_prompt_estimated_tokens": p, "machine_context_estimated_tokens": m, "model_prompt_to_machine_context_ratio": round(p / m, 6) if allowed and m else 0.0, "estimated_token_savings": max(0, m - p) if allowed else 0, "estimated_token_savings_percent": round(max(0.0, (m - p) / m * 100), 3) if allowed and m else 0.0}
    read = [r for r in ("context_gate", "context_advantage", "public_boundary_audit", "model_prompt") if paths.get(r) and (allowed or r != "model_prompt")]
    boundary = {"authority_effect": "none", "no_apply": True, "mutation_allowed": False, "external_model_calls": False, "source_or_authority_mutation": False}
    return {
        "ok": allowed, "status": "pass_handoff" if allowed else "fail_handoff", "authority_effect": "none", "no_apply": True, "task": task, "targets": targets, "safety_boundaries": boundary,
        "decision": {"handoff_allowed": allowed, "failed_gates": [g for g, ok in passed.items() if not ok]},
        "model_handoff": {"read_first": [paths[r] for r in read], "read_first_artifacts": [{"role": r, "path": paths[r]} for r in read], "audit_artifacts": [{"role": "machine_context", "path": paths.get("machine_context", "")}], "model_prompt_source": paths.get("model_prompt", "") if allowed else "", "machine_context_source": paths.get("machine_context", ""), "model_prompt_format": "markdown", "model_prompt_estimated_tokens": p, "machine_context_estimated_tokens": m, "token_economics": cost},
    }


def verify(handoff: dict, actual: dict[str, dict]) -> list[tuple[str, bool]]:
    """(id, passed) of a handoff against the artifacts as they are now: path to bytes, sha256, estimated_tokens."""
    part = lambda x, k: x.get(k) if isinstance(x.get(k), dict) else {}
    safety, model, allowed = part(handoff, "safety_boundaries"), part(handoff, "model_handoff"), part(handoff, "decision").get("handoff_allowed") is True
    cost, out = part(model, "token_economics"), []
    out += [("authority_effect_none", handoff.get("authority_effect") == "none"), ("no_apply_true", handoff.get("no_apply") is True)]
    out += [(f"safety_{k}", safety.get(k) == v and type(safety.get(k)) is type(v)) for k, v in (("authority_effect", "none"), ("no_apply", True), ("mutation_allowed", False), ("external_model_calls", False), ("source_or_authority_mutation", False))]
    out += [("ok_matches_decision", handoff.get("ok") is allowed), ("status_matches_ok", handoff.get("status") in (("pass_handoff", "warn_handoff") if handoff.get("ok") is True else ("fail_handoff",))), ("model_handoff_present", bool(model))]
    rows = [r for k in ("read_first_artifacts", "audit_artifacts") for r in model.get(k) or [] if isinstance(r, dict)]
    by_role = {}
    for r in rows:
        role, path = str(r.get("role") or "unknown"), str(r.get("path") or "")
        by_role[role] = r
        now = actual.get(path)
        out += [(f"artifact_path_present:{role}", bool(path)), (f"artifact_exists:{role}", now is not None)] + [(f"artifact_{k}_match:{role}", now is not None and r.get(k) == now[k]) for k in ("bytes", "sha256", "estimated_tokens")]
    out += [(f"{r}_listed", r in by_role) for r in ("context_gate", "context_advantage", "public_boundary_audit", "machine_context")]
    source, first = str(model.get("model_prompt_source") or ""), model.get("read_first") or []
    machine, prompt = (int((by_role.get(r) or {}).get("estimated_tokens") or 0) for r in ("machine_context", "model_prompt"))
    out.append(("machine_context_tokens_match", model.get("machine_context_estimated_tokens") == machine))
    if handoff.get("ok") is True:
        want = {"status": "measured", "model_prompt_estimated_tokens": prompt, "machine_context_estimated_tokens": machine, "model_prompt_to_machine_context_ratio": round(prompt / machine, 6) if machine else 0.0, "estimated_token_savings": max(0, machine - prompt), "estimated_token_savings_percent": round(max(0.0, (machine - prompt) / machine * 100), 3) if machine else 0.0}
        out += [("model_prompt_source_present", bool(source)), ("model_prompt_format_markdown", model.get("model_prompt_format") == "markdown"), ("model_prompt_source_in_read_first", source in first), ("model_prompt_source_matches_artifact", source == (by_role.get("model_prompt") or {}).get("path"))]
        out += [(f"token_economics_{k}_match", cost.get(k) == v) for k, v in want.items()]
    else:
        out += [("model_prompt_source_empty_when_blocked", source == ""), ("model_prompt_tokens_zero_when_blocked", not model.get("model_prompt_estimated_tokens")), ("token_economics_not_applicable", cost.get("status") == "not_applicable"), ("token_savings_zero_when_blocked", not cost.get("estimated_token_savings"))]
    return out


def cut(text: str, tokens: int) -> tuple[str, bool]:
    """(text, whether it was cut) in at most so many tokens, with a mark at the cut."""
    if not text or tokens <= 0:
        return "", bool(text)
    if max(1, (len(text) + 3) // 4) <= tokens:
        return text, False
    room = 4 * tokens - len(CUT_MARK)
    return (text[:room].rstrip() + CUT_MARK, True) if room >= 0 else (CUT_MARK[: 4 * tokens], True)


def bundle(rows: list[dict], contents: dict[str, str], mode: str = "read-first", budget: int = 4000, most: int = 1200) -> dict:
    """A context from a read plan's rows (order, role, path): contents in order while the budget's share lasts, each cut at
    `most` tokens; files that lack or come too late are told."""
    roles = ("read_first",) if mode == "read-first" else ("read_first", "read_next_if_decision_allows")
    left, chosen, skipped = int(max(1, max(1, budget) * CONTENT_SHARE)), [], []
    for r in sorted((r for r in rows if r.get("role") in roles), key=lambda r: int(r.get("order") or 0)):
        if r["path"] not in contents:
            skipped.append({**r, "reason": "missing_artifact"})
        elif left <= 0:
            skipped.append({**r, "reason": "token_budget_exhausted"})
        else:
            text, was_cut = cut(contents[r["path"]], min(max(1, most), left))
            n = max(1, (len(text) + 3) // 4) if text else 0
            chosen.append({**r, "order": len(chosen) + 1, "selected_estimated_tokens": n, "truncated": was_cut, "content": text})
            left -= n
    missing = sum(r["reason"] == "missing_artifact" for r in skipped)
    status = "fail_context" if missing else "warn_context" if skipped or any(r["truncated"] for r in chosen) else "pass_context"
    return {"ok": not missing, "status": status, "mode": mode, "sections": chosen, "skipped": skipped, "selected_estimated_tokens": sum(r["selected_estimated_tokens"] for r in chosen), "missing_artifact_count": missing, "authority_effect": "none", "no_apply": True}


def plane_audit(commands: set[str], required: set[str], hidden: set[str], capabilities: list[dict], facets: set[str] | None, leaks: bool = False, require_owned: bool = False, min_facets: int = 4) -> dict:
    """Whether all surfaces are one plane: names, owners, facets and identity. 100 less 25 an error and 8 a warning."""
    partial = sorted(c["capability_id"] for c in capabilities if c.get("integration_status") == "native_partial")
    checks = [("no_hidden_aliases", not commands & hidden, "error"), ("required_commands_present", required <= commands, "error"), ("no_unknown_capabilities", all(c.get("known", True) for c in capabilities), "error"), ("all_capabilities_owned", not partial, "error" if require_owned else "warn"), ("identity_hidden", not leaks, "error")]
    if facets is None:
        checks.append(("context_index_available", False, "warn"))
    else:
        checks.append(("context_index_has_facets", len(facets) >= max(1, min_facets) and {"command", "capability"} <= facets, "error"))
    errors, warnings = ([i for i, ok, s in checks if not ok and s == level] for level in ("error", "warn"))
    return {"ok": not errors, "status": "fail" if errors else "warn" if warnings else "pass", "score": max(0, min(100, 100 - 25 * len(errors) - 8 * len(warnings))), "checks": checks, "errors": errors, "warnings": warnings}
