from sparkweave.operators import handoff
from sparkweave.plans import entrypoint

GOOD = {"ok": True, "prompt_source": "p.md", "prompt_format": "markdown", "source_ids_exposed": False, "verification": {"ok": True, "status": "pass"}, "advantage": {"status": "pass"}, "economics": {"status": "measured"}, "prompt_pack": {"authority_effect": "none", "no_apply": True}}


def test_decisions():
    assert entrypoint.decide(**GOOD)["decision"] == "use"
    for change in ({"economics": {}}, {"advantage": {"status": "warn_x"}}, {"errors": [{"id": "late"}]}):
        assert entrypoint.decide(**{**GOOD, **change})["decision"] == "use_with_caution"
    for change, why in (({"ok": False}, "model_input_passed"), ({"source_ids_exposed": None}, "source_identity_hidden"), ({"prompt_source": ""}, "prompt_source_present"), ({"prompt_pack": {}}, "prompt_pack_public"), ({"verification": {"ok": True, "status": "fail"}}, "verification_passed")):
        got = entrypoint.decide(**{**GOOD, **change})
        assert got["decision"] == "do_not_use" and got["errors"] == [why]


def test_readiness():
    roles = ("context_gate", "context_advantage", "public_boundary_audit", "model_prompt", "machine_context")
    made = handoff.build("a task", ["x", "y"], dict.fromkeys(handoff.GATES[:-1], True), "prompt" * 3, "context" * 30, {r: r for r in roles})
    made["input_fingerprint"] = {"digest": "d1"}
    tokens = {"model_prompt": 5, "machine_context": 53}
    actual = {r: {"bytes": 1, "sha256": r, "estimated_tokens": tokens.get(r, 2)} for r in roles}
    for part in ("read_first_artifacts", "audit_artifacts"):
        for a in made["model_handoff"][part]:
            a.update(actual[a["path"]])
    assert entrypoint.ready(made, actual, " a task ", ["x", "x", "y"], "d1") == {"ok": True, "status": "pass", "prompt_source": "model_prompt", "reasons": [], "request_binding": "pass"}
    assert entrypoint.ready(made, actual)["request_binding"] == "not_checked"
    assert entrypoint.ready(made, actual, "other", ["y", "x"], "d2")["reasons"] == ["inputs_changed", "task_matches", "targets_match"]
    assert entrypoint.ready(made, {**actual, "model_prompt": {**actual["model_prompt"], "bytes": 2}})["reasons"] == ["artifact_bytes_match:model_prompt"]
    assert entrypoint.ready(None, actual)["reasons"] == ["handoff_unreadable"]
    blocked = {**made, "ok": False}
    assert "handoff_blocked" in entrypoint.ready(blocked, actual)["reasons"]
