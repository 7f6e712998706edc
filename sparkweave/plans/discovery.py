"""What a repository has for a model to start from, and the next command to give. Files are only looked at; nothing is run."""

from __future__ import annotations

import hashlib
import os
import shlex
from collections.abc import Iterable

from sparkweave.operators import resolve
from sparkweave.plans import entrypoint, prompts
from sparkweave.sources import scan

FOLDER = ".sparkweave"
#: Where each kind of artifact is looked for, best first.
PLACES = {"handoffs": (f"{FOLDER}/handoff.json", "handoff.json"), "manifests": ("sparkweave.json", f"{FOLDER}/manifest.json"), "graphs": (f"{FOLDER}/read_model", "read_model")}
BOUNDARY = {"authority_effect": "none", "no_apply": True, "mutation_allowed": False, "external_model_calls": False, "source_or_authority_mutation": False}


def measure(root: str, paths: Iterable[str]) -> dict[str, dict]:
    """bytes, sha256 and estimated tokens of each file that is there, by its path as given."""
    out = {}
    for path in paths:
        whole = os.path.join(root, path)
        if path and os.path.isfile(whole):
            with open(whole, "rb") as f:
                content = f.read()
            out[path] = {"bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "estimated_tokens": prompts.tokens(content.decode("utf-8", "replace")) if content else 0}
    return out


def artifacts(handoff: dict) -> list[str]:
    """Paths of the files that a handoff recorded."""
    model = handoff.get("model_handoff") if isinstance(handoff.get("model_handoff"), dict) else {}
    rows = [r for part in ("read_first_artifacts", "audit_artifacts") for r in model.get(part) or () if isinstance(r, dict)]
    return [str(r.get("path") or "") for r in rows]


def discover(root: str, handoff: str = "") -> dict:
    """State of a repository: ready_model_input, blocked_model_input, blocked_handoff_unreadable, manifest_available,
    graph_available or not_configured. A handoff that is named is the only one looked at, and must be there."""
    found = {kind: [p for p in (os.path.join(root, x) for x in places) if os.path.exists(p)] for kind, places in PLACES.items()}
    if handoff:
        found["handoffs"] = [handoff] * os.path.isfile(handoff)
    chosen = handoff or next(iter(found["handoffs"]), "")
    state = "manifest_available" if found["manifests"] else "graph_available" if found["graphs"] else "not_configured"
    reasons: list[str] = []
    if chosen:
        try:
            content = scan.strict_json(chosen)
        except (OSError, ValueError):
            content = {}
        verdict = entrypoint.ready(content, measure(root, artifacts(content)))
        reasons = verdict["reasons"]
        state = "blocked_handoff_unreadable" if not content else "ready_model_input" if verdict["ok"] else "blocked_model_input"
    return {"ok": True, "status": state, "root": root, "ready_for_model_input": state == "ready_model_input", "selected_handoff": chosen, "discovered": found, "diagnostics": reasons, "recommended_next_command": command(root, state, chosen, found["manifests"]), "authority_effect": "none", "no_apply": True, "safety_boundaries": BOUNDARY}


def command(root: str, state: str, handoff: str, manifests: list[str], task: str = "", targets: Iterable[str] = (), output: str = "") -> str:
    """The command line of this library that comes next."""
    output = output or os.path.join(root, FOLDER)
    model = os.path.join(output, "read_model")
    if handoff:
        argv = ["release" if state == "ready_model_input" else "verify-handoff", handoff, "--root", root]
    elif manifests:
        argv = ["run", model, "--manifest", manifests[0], "--root", root, "--task", task or "<task>", *(x for t in targets for x in ("--target", t))]
    else:
        argv = ["scan", root, output]
    return "python -m sparkweave " + shlex.join(argv)


def route(root: str, task: str = "", targets: Iterable[str] = (), handoff: str = "", output: str = "") -> dict:
    """The next action for a request and its steps. Only a verified handoff ends in model input; a manifest needs a task."""
    seen, task, targets = discover(root, handoff), task.strip(), resolve.clean_targets(list(targets))
    state, found = seen["status"], seen["discovered"]
    status, action, ok = {
        "ready_model_input": ("ready", "release_model_input", True), "blocked_model_input": ("blocked", "verify_handoff", False), "blocked_handoff_unreadable": ("blocked", "verify_handoff", False),
        "manifest_available": ("needs_handoff", "build_handoff", True) if task else ("needs_task", "build_handoff", False), "graph_available": ("needs_manifest_refresh", "scan_and_build", True), "not_configured": ("needs_bootstrap", "scan_and_build", True),
    }[state]
    line = command(root, state, seen["selected_handoff"], found["manifests"], task, targets, output)
    steps = [{"action": action, "command": line, "terminal_model_input": action == "release_model_input"}]
    if status == "needs_handoff":
        steps.append({"action": "rediscover", "command": "python -m sparkweave " + shlex.join(["discover", root]), "terminal_model_input": False})
    return {"ok": ok, "status": status, "root": root, "task": task, "targets": targets, "discovery_status": state, "action": action, "model_input_ready": seen["ready_for_model_input"], "recommended_next_command": line, "route_steps": [{"step_id": f"{n:02}_{s['action']}", **s} for n, s in enumerate(steps)], "requires_user_input": ["task_required"] * (status == "needs_task"), "authority_effect": "none", "no_apply": True, "safety_boundaries": BOUNDARY}


def select(source: dict, path: str = "", prefer: str = "prompt-file", allow_caution: bool = False) -> dict:
    """What a model reads of an artifact with an entrypoint decision: its prompt file, the prompt inside it, or the artifact
    itself for an audit; nothing where the decision forbids it."""
    decision = source.get("entrypoint_decision") if isinstance(source.get("entrypoint_decision"), dict) else {}
    inside = source.get("prompt_pack") if isinstance(source.get("prompt_pack"), dict) else {}
    verdict, file, text = decision.get("decision"), str(source.get("prompt_source") or inside.get("prompt_source") or ""), bool(inside.get("prompt_text"))
    checks = [("entrypoint_decision_present", bool(decision)), ("entrypoint_decision_allows_model_use", verdict == "use" or (allow_caution and verdict == "use_with_caution")), ("authority_effect_none", (source.get("authority_effect") or "none") == "none"), ("no_apply_true", source.get("no_apply") is True)]
    order = {"audit-json": ("audit_json", "prompt_file", "prompt_pack"), "prompt-pack": ("prompt_pack", "prompt_file")}.get(prefer, ("prompt_file", "prompt_pack"))
    there = {"audit_json": path, "prompt_file": file, "prompt_pack": path if text else ""}
    mode = next((m for m in order if there[m]), "blocked") if dict(checks)["entrypoint_decision_allows_model_use"] else "blocked"
    errors = [i for i, passed in checks if not passed] + ["no_model_input_selected"] * (mode == "blocked")
    warnings = ["entrypoint_decision_caution_allowed"] * (verdict == "use_with_caution" and allow_caution) + ["prompt_file_missing_using_prompt_pack"] * (mode == "prompt_pack" and prefer != "prompt-pack")
    ref = "" if errors else there[mode]
    return {"ok": not errors, "status": "fail" if errors else "warn" if warnings else "pass", "mode": "blocked" if errors else mode, "model_input_ref": ref, "errors": errors, "warnings": warnings, "authority_effect": "none", "no_apply": True, "safety_boundaries": BOUNDARY}
