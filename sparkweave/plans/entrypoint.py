"""Whether a model may be started, and on what: the entrypoint's decision, and whether a handoff is ready for a request."""

from __future__ import annotations

from sparkweave.operators import handoff as ho
from sparkweave.operators import resolve


def _status(x: dict) -> str:
    return str(x.get("status") or "")


def decide(ok: bool, prompt_source: str, prompt_format: str, source_ids_exposed: bool | None, verification: dict, advantage: dict, economics: dict, prompt_pack: dict, errors: list[dict] | None = None) -> dict:
    """use, use_with_caution or do_not_use: every check must pass, but for measured economics, which only warns."""
    checks = [
        ("model_input_passed", bool(ok), "error"), ("verification_passed", verification.get("ok") is True and _status(verification).startswith("pass"), "error"), ("context_advantage_available", bool(advantage), "error"),
        ("context_advantage_not_failed", _status(advantage).startswith(("pass", "warn")), "error"), ("source_identity_hidden", source_ids_exposed is False, "error"), ("prompt_source_present", bool(prompt_source), "error"),
        ("prompt_format_markdown", prompt_format == "markdown", "error"), ("prompt_pack_public", prompt_pack.get("authority_effect") == "none" and prompt_pack.get("no_apply") is True, "error"), ("token_economics_measured", _status(economics) == "measured", "warn"),
    ]
    failed = [i for i, passed, s in checks if not passed and s == "error"]
    warned = [i for i, passed, s in checks if not passed and s == "warn"] + [str(e.get("id") or "model_input_error") for e in errors or () if ok]
    decision = "do_not_use" if failed else "use_with_caution" if warned or _status(advantage).startswith("warn") else "use"
    return {"ok": not failed, "decision": decision, "status": {"do_not_use": "fail", "use_with_caution": "warn", "use": "pass"}[decision], "checks": [(i, p) for i, p, _ in checks], "errors": failed, "warnings": warned, "authority_effect": "none", "no_apply": True}


def binding(handoff: dict, task: str = "", targets: list[str] | None = None) -> dict:
    """Whether a handoff was made for this task and these targets; what isn't asked for isn't checked."""
    asked, wanted = task.strip(), resolve.clean_targets(targets or [])
    made = handoff.get("targets") if isinstance(handoff.get("targets"), list) else []
    checks = [("task_matches", asked == str(handoff.get("task") or "").strip())] * bool(asked) + [("targets_match", wanted == resolve.clean_targets(made))] * bool(wanted)
    failed = [i for i, passed in checks if not passed]
    return {"ok": not failed, "status": "not_checked" if not checks else "fail" if failed else "pass", "errors": failed}


def ready(handoff: dict | None, actual: dict[str, dict], task: str = "", targets: list[str] | None = None, fingerprint: str = "") -> dict:
    """A prompt that may be used now, or why not: the handoff must be there, made of today's inputs and for this request, and
    verified against its artifacts as they are."""
    if not handoff:
        return {"ok": False, "status": "fail", "prompt_source": "", "reasons": ["handoff_unreadable"]}
    recorded = str((handoff.get("input_fingerprint") or {}).get("digest") or "")
    reasons = ["inputs_changed"] * bool(fingerprint and recorded and fingerprint != recorded)
    reasons += binding(handoff, task, targets)["errors"]
    reasons += [i for i, ok in ho.verify(handoff, actual) if not ok]
    reasons += ["handoff_blocked"] * (handoff.get("ok") is not True)
    source = (handoff.get("model_handoff") or {}).get("model_prompt_source") or ""
    return {"ok": not reasons, "status": "fail" if reasons else "pass", "prompt_source": "" if reasons else source, "reasons": reasons, "request_binding": binding(handoff, task, targets)["status"]}
