"""Run profiles: a request written down as JSON. They are read strictly, written once checked, and run by onboarding."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from sparkweave.operators import contracts, resolve
from sparkweave.plans import discovery
from sparkweave.sources import scan

#: The fields of a profile, by what they hold.
FIELDS = {
    "path": ("root", "output_dir", "handoff", "quality_policy", "target_review_policy", "efficiency_policy", "context_gate_policy", "memory_import_cache_dir"),
    "paths": ("manifests", "baselines"),
    "strings": ("targets",),
    "boolean": ("hash_files", "include_memory_import", "include_details", "include_content", "include_prompt", "allow_caution_model_entrypoint"),
    "integer": ("workflow_token_budget", "context_token_budget", "max_artifact_tokens", "query_limit", "max_presets", "max_rows", "max_files", "max_parse_bytes"),
    "string": ("task", "context_mode", "model_entrypoint_preference"),
}
PREFERENCES = ("prompt-file", "prompt-pack", "audit-json")
ENVELOPE = ("schema_version", "authority_effect", "no_apply", "profile_id", "description")
#: What a new profile says where the caller says nothing.
DEFAULTS = {
    "workflow_token_budget": 4000, "context_token_budget": 4000, "context_mode": "read-first", "max_artifact_tokens": 1200, "query_limit": 10, "max_presets": 3, "max_rows": 80, "max_files": 5000, "max_parse_bytes": 1_000_000,
    "hash_files": False, "include_memory_import": False, "include_details": False, "include_content": True, "include_prompt": True, "model_entrypoint_preference": "prompt-file", "allow_caution_model_entrypoint": False,
}

VERSION = contracts.version("agent_profile")
_HOLDS = {"path": str, "string": str, "paths": list, "strings": list, "boolean": bool, "integer": int}


def _fits(kind: str, value) -> bool:
    return isinstance(value, _HOLDS[kind]) and not (kind == "integer" and isinstance(value, bool))


def _report(checks: list[tuple[str, bool]], **more) -> dict:
    errors = [i for i, passed in checks if not passed]
    return {"ok": not errors, "status": "fail" if errors else "pass", "checks": checks, "errors": errors, "authority_effect": "none", "no_apply": True, **more}


def load(path: str) -> dict:
    """A profile's checks and its fields, paths made whole against its own folder. Null fields count as left out, fields of
    another type and unknown ones are errors; blank list items go."""
    path = os.path.abspath(os.path.expanduser(path))
    try:
        raw = scan.strict_json(path)
    except (OSError, ValueError):
        raw = {}
    kinds = {f: kind for kind, fields in FIELDS.items() for f in fields}
    unknown = sorted(set(raw) - set(kinds) - set(ENVELOPE))
    checks = [("profile_exists", os.path.isfile(path)), ("profile_json_object", bool(raw)), ("schema_version", raw.get("schema_version") == VERSION), ("authority_effect_none", raw.get("authority_effect") in (None, "none")), ("no_apply_not_false", raw.get("no_apply") is not False), ("unknown_keys_absent", not unknown)]
    given = {f: raw[f] for f in kinds if raw.get(f) is not None}
    checks += [(f"{f}_{kinds[f]}", _fits(kinds[f], v)) for f, v in given.items()]
    whole = lambda v: os.path.normpath(os.path.join(os.path.dirname(path), os.path.expanduser(v.strip()))) if v.strip() else ""
    items = lambda v: [s for s in (str(x).strip() for x in v) if s]
    read: dict[str, Callable] = {"path": whole, "paths": lambda v: [whole(x) for x in items(v)], "strings": items}
    fields = {f: read.get(kinds[f], lambda v: v)(v) for f, v in given.items() if _fits(kinds[f], v)}
    if "model_entrypoint_preference" in fields:
        checks.append(("model_entrypoint_preference_valid", fields["model_entrypoint_preference"] in PREFERENCES))
    return _report(checks, profile_path=path, profile_id=str(raw.get("profile_id") or os.path.splitext(os.path.basename(path))[0]), description=str(raw.get("description") or ""), normalized=fields, unknown=unknown)


def init(root: str, path: str, task: str, targets: list[str] = (), manifests: list[str] = (), handoff: str = "", write: bool = True, profile_id: str = "", description: str = "", **settings) -> dict:
    """A profile for a request. Every file that it names must be there, and a manifest (by default those that discovery
    finds) or a handoff must be named. It is written only if all checks pass, with paths relative to its folder, and read again."""
    root = os.path.abspath(os.path.expanduser(root))
    at = lambda p: os.path.normpath(os.path.join(root, os.path.expanduser(p)))
    path, task, targets = at(path), task.strip(), resolve.clean_targets(list(targets))
    folder = os.path.dirname(path)
    named = {"manifests": [at(p) for p in manifests] or [p for p in map(at, discovery.PLACES["manifests"]) if os.path.isfile(p)], "baselines": [at(p) for p in settings.pop("baselines", ())]}
    single = {f: at(settings.pop(f)) for f in FIELDS["path"][3:] if settings.get(f)} | ({"handoff": at(handoff)} if handoff else {})
    output = at(settings.pop("output_dir", "") or folder)
    values = {**DEFAULTS, **settings}
    checks = [("root_exists", os.path.isdir(root)), ("task_present", bool(task)), ("model_entrypoint_preference_valid", values["model_entrypoint_preference"] in PREFERENCES), ("known_settings", not set(values) - set(DEFAULTS)), ("manifest_or_handoff_present", bool(named["manifests"] or handoff))]
    checks += [(f"{kind[:-1]}_exists", os.path.isfile(p)) for kind, paths in named.items() for p in paths]
    checks += [(f"{f}_exists", os.path.isdir(p) if f.endswith("_dir") else os.path.isfile(p)) for f, p in single.items()]
    relative = lambda p: os.path.relpath(p, folder)
    profile = {"schema_version": VERSION, "profile_id": profile_id or f"{os.path.basename(root)}_profile", "description": description, "authority_effect": "none", "no_apply": True, "root": relative(root), "output_dir": relative(output), "task": task, "targets": targets, **values}
    profile |= {kind: [relative(p) for p in paths] for kind, paths in named.items() if paths} | {f: relative(p) for f, p in single.items()}
    validation: dict = {}
    if write and all(passed for _, passed in checks):
        os.makedirs(folder, exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(profile, f, indent=2, sort_keys=True)
        validation = load(path)
        checks.append(("written_profile_valid", validation["ok"]))
    return _report(checks, profile_path=path, profile=profile, profile_validation_summary={k: validation[k] for k in ("ok", "status") if k in validation}, warnings=["no_targets"] * (not targets), safety_boundaries=discovery.BOUNDARY)


def onboard(root: str, path: str, task: str, **settings) -> dict:
    """A profile is made and read, and the route of its request decided; each part runs only if the one before passed."""
    made = init(root, path, task, **settings)
    if not made["ok"]:
        return _report([("profile_init", False)], profile_path=made["profile_path"], profile_init_summary={k: made[k] for k in ("ok", "status", "errors")}, model_input_ready=False, safety_boundaries=discovery.BOUNDARY)
    read = load(path if os.path.isabs(path) else os.path.join(root, path))
    want = read["normalized"]
    way = discovery.route(want.get("root", root), want.get("task", ""), want.get("targets", ()), want.get("handoff", ""), want.get("output_dir", ""))
    return _report([("profile_init", True), ("profile_validation", read["ok"]), ("route_ready", way["ok"])], profile_path=read["profile_path"], profile_init_summary={k: made[k] for k in ("ok", "status", "errors")}, profile_validation_summary={k: read[k] for k in ("ok", "status", "errors")}, route=way, model_input_ready=way["model_input_ready"], safety_boundaries=discovery.BOUNDARY)
