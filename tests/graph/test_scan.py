import json
import subprocess

import pytest

from sparkweave.operators import handoff
from sparkweave.plans import workflow
from sparkweave.sources import scan


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_a_scan_can_be_built_from(spark, tmp_path):
    tree, out = tmp_path / "tree", tmp_path / "out"
    write(tree, {"src/pkg/__init__.py": "", "src/pkg/a.py": "import pkg.b\n\n\ndef f():\n    pass\n", "src/pkg/b.py": "class B:\n    pass\n", "web/x.ts": "import {y} from './y'\n", "web/y.ts": "export class Y {}\n", "bad.py": "def (", "README.md": "x"})
    got = scan.scan(spark, str(tree), str(out), hashes=True)
    s = got["summary"]
    assert (s["file_count"], s["symbol_count"], s["dependency_edge_count"], s["surface_count"], s["truncated"]) == (7, 3, 2, 3, False) and s["parse_failures"] == {"python:syntax_error": 1}
    assert {e["from"]: e["to"] for e in json.loads((out / "dependencies.json").read_text())["edges"]} == {"src/pkg/a.py": "src/pkg/b.py", "web/x.ts": "web/y.ts"}
    assert {x["symbol_fqn"] for x in got["payloads"]["symbols.json"]["symbols"]} == {"pkg.a.f", "pkg.b.B", "web.y.Y"}
    assert scan.scan(spark, str(tree), most=3)["summary"]["truncated"] and sorted(p.name for p in tree.iterdir()) == ["README.md", "bad.py", "src", "web"]
    built = workflow.build(spark, scan.strict_json(str(out / "manifest.json")), str(out))
    values = {(r.entity_type, r.value) for r in built.entities.collect()}
    assert {("surface_id", "source_code"), ("owner_id", "source_owner"), ("symbol_fqn", "pkg.b.B"), ("path", "web/y.ts"), ("claim_id", "repo_scan_inventory_present")} <= values
    assert {r.edge_type for r in built.edges.collect()} >= {"OWNS", "REFERENCES_SYMBOL", "SUPPORTS", "DERIVES_FROM", "DECLARES"} and built.conflicts.count() == 0


def test_driver_side_sources(tmp_path):
    (tmp_path / "a.json").write_text("[1, \"\", \"x\"]")
    (tmp_path / "b.txt").write_text("# c\n\n one \ntwo\n")
    assert scan.targets(str(tmp_path / "a.json")) == ["1", "x"] and scan.targets(str(tmp_path / "b.txt")) == ["one", "two"]
    with pytest.raises(ValueError):
        scan.strict_json(str(tmp_path / "a.json"))
    assert scan.git(str(tmp_path))["head_commit"] == "" and not scan.git(str(tmp_path))["dirty"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert scan.git(str(tmp_path))["dirty_count"] == 2
    status = lambda *a, **k: scan.memory_source(*a, **k)[0]["status"]
    assert status() == "optional_disabled" and status(True, "/m", str(tmp_path), program="/bin/p") == "loaded"
    broken = [scan.memory_source(True, str(tmp_path / "m"), str(tmp_path), program="/bin/p"), scan.memory_source(True, "", str(tmp_path), program="/bin/p"), scan.memory_source(tracked=["x"])]
    assert [s["status"] for s, _ in broken] == ["error", "error", "optional_disabled"]
    assert [c["conflict_id"] for _, found in broken for c in found] == ["codebase_memory_repo_local_cache", "codebase_memory_cache_missing", "codebase_memory_tracked_graph"]
    assert {c["conflict_type"] for _, found in broken for c in found} == {"codebase_memory_policy_violation"}
    text = scan.markdown("T", {"a": 1}, {"Rows": [{"x": i} for i in range(100)], "None": []})
    assert text.startswith("# T\n\n- a: `1`\n") and text.count("| `") == 80 and text.endswith("- none\n")


def test_handoffs_are_verified(spark):
    gates = dict.fromkeys(handoff.GATES[:-1], True)
    roles = ("context_gate", "context_advantage", "public_boundary_audit", "model_prompt", "machine_context")
    texts = {r: r * n for r, n in zip(roles, (3, 4, 5, 10, 60), strict=True)}
    rows = spark.createDataFrame([(r, t) for r, t in texts.items()], "path string, content string")
    actual = {r.path: {k: r[k] for k in ("bytes", "sha256", "estimated_tokens")} for r in handoff.measured(rows).collect()}

    def made(gates):
        out = handoff.build("t", ["x"], gates, texts["model_prompt"], texts["machine_context"], {r: r for r in roles})
        for part in ("read_first_artifacts", "audit_artifacts"):
            for a in out["model_handoff"][part]:
                a.update(actual[a["path"]])
        return out

    good, blocked = made(gates), made({**gates, "context_gate": False})
    assert good["ok"] and all(ok for _, ok in handoff.verify(good, actual))
    assert not blocked["ok"] and blocked["decision"]["failed_gates"] == ["context_gate"] and all(ok for _, ok in handoff.verify(blocked, actual))
    changed = {**actual, "model_prompt": {**actual["model_prompt"], "sha256": "0"}}
    assert [i for i, ok in handoff.verify(good, changed) if not ok] == ["artifact_sha256_match:model_prompt"]
    good["model_handoff"]["token_economics"]["estimated_token_savings"] = 1
    good["safety_boundaries"]["no_apply"] = 1
    assert [i for i, ok in handoff.verify(good, actual) if not ok] == ["safety_no_apply", "token_economics_estimated_token_savings_match"]
    recorded = spark.createDataFrame([("a", "model_prompt", 1, "x", 1), ("b", None, 1, "x", 1), ("c", "gone", 1, "x", 1)], "role string, path string, bytes long, sha256 string, estimated_tokens long")
    failed = {r.id for r in handoff.artifact_checks(recorded, handoff.measured(rows)).filter("not passed").collect()}
    assert failed == {f"artifact_{k}_match:{r}" for r in "ac" for k in ("bytes", "sha256", "estimated_tokens")} | {"artifact_path_present:b", "artifact_exists:c"}


def test_bundles_stay_within_their_budget():
    plan = [{"order": 2, "role": "read_first", "path": "b"}, {"order": 1, "role": "read_first", "path": "a"}, {"order": 3, "role": "read_next_if_decision_allows", "path": "c"}, {"order": 4, "role": "read_first", "path": "gone"}]
    texts = {"a": "x" * 400, "b": "y" * 4000, "c": "z"}
    got = handoff.bundle(plan, texts, budget=300)
    assert [s["path"] for s in got["sections"]] == ["a", "b"] and got["sections"][1]["truncated"] and got["selected_estimated_tokens"] <= 195 and got["status"] == "fail_context"
    assert handoff.bundle(plan[:3], texts, "all", 100)["skipped"][0]["reason"] == "token_budget_exhausted" and handoff.bundle(plan[1:2], texts)["status"] == "pass_context"
    for n in range(30):
        text, was_cut = handoff.cut("w" * 500, n)
        assert was_cut and len(text) <= 4 * n


def test_plane_audit():
    able = [{"capability_id": "a", "integration_status": "native_partial"}]
    assert handoff.plane_audit({"x"}, {"x"}, {"old"}, able, {"command", "capability", "claim", "path"})["score"] == 92
    bad = handoff.plane_audit({"old"}, {"x"}, {"old"}, able, None, leaks=True, require_owned=True)
    assert bad["score"] == 0 and bad["status"] == "fail" and len(bad["errors"]) == 4
