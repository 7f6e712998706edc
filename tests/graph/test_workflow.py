import json

import pytest

from sparkweave.__main__ import main
from sparkweave.plans import workflow


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps({"claims": [{"claim_id": "ready", "verifiers": ["v"]}], "surfaces": [{"surface_id": "ui", "owner": "me", "path": "ui/x.py"}]}))
    return tmp_path, {"sources": [{"source_id": "truth", "role": "current_truth", "path": "truth.json", "required": True, "verifier": "v"}]}


def test_run_and_decide(spark, tree):
    root, manifest = tree
    steps = workflow.run(spark, manifest, str(root), "claim evidence", ["ready", "never heard"])
    assert [s.name for s in steps] == ["build", "verify", "doctor", "quality_gate", "brief", "review", "review_gate"]
    assert [s.ok for s in steps[:4]] == [True] * 4 and not steps[-1].ok and workflow.decision(steps)["action"] == "stop"
    assert workflow.decision(steps[:5])["action"] == "continue" and workflow.decision(steps[:5], False)["action"] == "continue_with_caution"
    assert workflow.model_input(steps[:5], "p", "f", "f") == {"allowed": True, "prompt": "p", "reasons": [], "authority_effect": "none", "no_apply": True}
    assert workflow.model_input(steps[:5], "p", "f", "g")["prompt"] == "" and workflow.model_input(steps, "p", "f")["allowed"] is False
    assert workflow.run(spark, {"sources": []}, str(root), "t", [])[0].ok is False
    assert workflow.timed(lambda: 1, 2)["seconds_mean"] >= 0


def test_command_line(spark, tree, capsys):
    root, manifest = tree
    (root / "m").mkdir()
    (root / "m" / "manifest.txt").write_text(json.dumps(manifest))
    folder = str(root / "model")
    assert main(["build", folder, "--manifest", str(root / "m" / "manifest.txt"), "--root", str(root)], spark) == 0
    capsys.readouterr()
    assert main(["rank", folder, "--limit", "2"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert main(["sql", folder, "--preset", "claim-lineage"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {x["kind"] for x in lines} == {"entity", "edge"} and all("detail" not in x for x in lines if x["kind"] == "edge")
