"""Discovery, routes, profiles, onboarding, entrypoint selection, contracts and capabilities."""

import json
import shlex

import pytest

from sparkweave.__main__ import main, parser
from sparkweave.operators import audits, capabilities, contracts, handoff
from sparkweave.plans import discovery, profile


def write(path, x):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(x if isinstance(x, str) else json.dumps(x))
    return str(path)


def handed(root):
    """A handoff in a repository, recorded from its files."""
    roles = ("context_gate", "context_advantage", "public_boundary_audit", "model_prompt", "machine_context")
    texts = {r: f"{r} text " * 9 for r in roles}
    for r, t in texts.items():
        write(root / f"{r}.md", t)
    made = handoff.build("a task", ["x"], dict.fromkeys(handoff.GATES[:-1], True), texts["model_prompt"], texts["machine_context"], {r: f"{r}.md" for r in roles})
    now = discovery.measure(str(root), [f"{r}.md" for r in roles])
    for part in ("read_first_artifacts", "audit_artifacts"):
        for a in made["model_handoff"][part]:
            a.update(now[a["path"]])
    return write(root / ".sparkweave" / "handoff.json", made)


def test_discovery_and_routes(tmp_path):
    root = str(tmp_path)
    got = discovery.route(root)
    assert (got["ok"], got["status"], got["action"]) == (True, "needs_bootstrap", "scan_and_build")
    (tmp_path / ".sparkweave" / "read_model").mkdir(parents=True)
    assert discovery.route(root)["status"] == "needs_manifest_refresh"
    manifest = write(tmp_path / "sparkweave.json", {})
    assert (got := discovery.route(root))["status"] == "needs_task" and got["requires_user_input"] == ["task_required"] and not got["ok"]
    got = discovery.route(root, "it's a task", ["x y", "x y", ""])
    assert [s["step_id"] for s in got["route_steps"]] == ["00_build_handoff", "01_rediscover"] and got["targets"] == ["x y"]
    asked = parser().parse_args(shlex.split(got["recommended_next_command"])[3:])
    assert (asked.command, asked.task, asked.target, asked.manifest) == ("run", "it's a task", ["x y"], manifest)

    path = handed(tmp_path)
    got = discovery.route(root, "a task")
    assert (got["status"], got["model_input_ready"], got["route_steps"][0]["terminal_model_input"]) == ("ready", True, True)
    write(tmp_path / "model_prompt.md", "changed")
    got = discovery.discover(root)
    assert got["status"] == "blocked_model_input" and "artifact_sha256_match:model_prompt" in got["diagnostics"] and discovery.route(root)["action"] == "verify_handoff"
    write(tmp_path / ".sparkweave" / "handoff.json", "[]")
    assert discovery.discover(root)["status"] == "blocked_handoff_unreadable" == discovery.discover(root, path + ".gone")["status"]


def test_profiles(tmp_path):
    write(tmp_path / "sparkweave.json", {})
    made = profile.init(str(tmp_path), "conf/p.json", " a task ", ["t", "t"], query_limit=5)
    assert made["ok"] and made["profile"]["root"] == ".." and made["profile"]["manifests"] == ["../sparkweave.json"] and made["profile_validation_summary"]["ok"]
    read = profile.load(str(tmp_path / "conf" / "p.json"))
    assert read["normalized"]["manifests"] == [str(tmp_path / "sparkweave.json")] and read["normalized"]["root"] == str(tmp_path) and read["normalized"]["query_limit"] == 5
    assert read["profile_id"] == f"{tmp_path.name}_profile" and not read["unknown"]

    assert profile.init(str(tmp_path), "q.json", "", manifests=["gone.json"])["errors"] == ["task_present", "manifest_exists"] and not (tmp_path / "q.json").exists()
    assert profile.init(str(tmp_path), "q.json", "t", nonsense=1)["errors"] == ["known_settings"]
    bad = write(tmp_path / "bad.json", {"schema_version": profile.VERSION, "no_apply": False, "hash_files": 1, "max_rows": True, "targets": "t", "root": None, "extra": 0, "model_entrypoint_preference": "mail"})
    assert profile.load(bad)["errors"] == ["no_apply_not_false", "unknown_keys_absent", "targets_strings", "hash_files_boolean", "max_rows_integer", "model_entrypoint_preference_valid"]
    assert profile.load(str(tmp_path / "none.json"))["errors"] == ["profile_exists", "profile_json_object", "schema_version"]

    assert (got := profile.onboard(str(tmp_path), "r.json", "a task"))["ok"] and got["route"]["status"] == "needs_handoff" and not got["model_input_ready"]
    assert profile.onboard(str(tmp_path), "s.json", "")["errors"] == ["profile_init"]
    handed(tmp_path)
    assert profile.onboard(str(tmp_path), "r.json", "a task")["model_input_ready"]


@pytest.mark.parametrize(
    "prefer, change, mode, warnings",
    [
        ("prompt-file", {}, "prompt_file", []),
        ("prompt-pack", {}, "prompt_pack", []),
        ("audit-json", {}, "audit_json", []),
        ("prompt-file", {"prompt_source": ""}, "prompt_pack", ["prompt_file_missing_using_prompt_pack"]),
        ("prompt-file", {"entrypoint_decision": {"decision": "use_with_caution"}}, "blocked", []),
        ("audit-json", {"entrypoint_decision": {"decision": "do_not_use"}}, "blocked", []),
        ("prompt-file", {"no_apply": False}, "blocked", []),
        ("prompt-file", {"prompt_source": "", "prompt_pack": {}}, "blocked", []),
    ],
)
def test_selection(prefer, change, mode, warnings):
    source = {"entrypoint_decision": {"decision": "use"}, "prompt_source": "p.md", "prompt_pack": {"prompt_text": "x"}, "no_apply": True} | change
    got = discovery.select(source, "a.json", prefer)
    assert (got["mode"], got["warnings"], got["ok"]) == (mode, warnings, mode != "blocked") and bool(got["model_input_ref"]) == got["ok"]


def test_caution_may_be_allowed():
    source = {"entrypoint_decision": {"decision": "use_with_caution"}, "prompt_source": "p.md", "no_apply": True}
    assert discovery.select(source, allow_caution=True)["status"] == "warn"


def test_contracts(spark):
    kinds = contracts.registry()
    assert len(kinds) == 52 == contracts.table(spark).count()
    for kind, s in kinds.items():
        whole = {f: {"boolean": True, "string": "s", "array": [], "integer": 1}.get(str((s["properties"].get(f) or {}).get("type")), {}) for f in s["required"]}
        whole |= {f: p["const"] for f, p in s["properties"].items() if "const" in p}
        assert all(passed for _, passed in audits.contract_checks(s, whole)), kind
        for f in s["required"]:
            assert [i for i, passed in audits.contract_checks(s, {k: v for k, v in whole.items() if k != f}) if not passed] == [f"$.{f}:required"]


def test_capabilities(spark):
    commands = set(parser()._subparsers._group_actions[0].choices)
    named = [c for _, cs, _, _ in capabilities.CAPABILITIES.values() for c in cs]
    assert len(named) == len(set(named)) and set(named) | {"capabilities"} == commands
    assert {k for _, _, ks, _ in capabilities.CAPABILITIES.values() for k in ks} <= set(contracts.REQUIRED)
    got = capabilities.ownership(["Import-Graph", " rank-sources", "teleport", ""])
    assert [(r["function"], r["capability_id"], r["decision"]) for r in got] == [("Import-Graph", "repository_scan", "use_native"), ("rank-sources", "ranking", "use_native"), ("teleport", "", "build")]
    assert capabilities.table(spark).count() == len(capabilities.CAPABILITIES)


def test_commands(tmp_path, capsys):
    root = str(tmp_path)
    assert main(["discover", root]) == 0 and json.loads(capsys.readouterr().out)["status"] == "not_configured"
    path = handed(tmp_path)
    assert main(["release", path, "--root", root]) == 0 and json.loads(capsys.readouterr().out)["prompt_text"].startswith("model_prompt text")
    write(tmp_path / "context_gate.md", "")
    assert main(["verify-handoff", path, "--root", root]) == 2 and main(["route", root]) == 2
    capsys.readouterr()
    bad = write(tmp_path / "v.json", {"schema_version": contracts.version("verify"), "ok": True, "status": "s", "checks": [], "authority_effect": "none", "no_apply": True})
    assert main(["validate", bad]) == 2 and json.loads(capsys.readouterr().out)["errors"] == ["$.errors:required"]
    assert main(["contracts"]) == 0 and len(capsys.readouterr().out.splitlines()) == 52
    assert main(["capabilities", "--function", "find"]) == 0 and json.loads(capsys.readouterr().out)["capability_id"] == "search"
