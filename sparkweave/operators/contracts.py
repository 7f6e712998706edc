"""The contracts of all artifacts: which fields each kind must have, as schemas that `audits.validate` takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Required top-level fields of each kind of artifact, beside the envelope.
REQUIRED = {
    "schema_registry": "status artifact_schemas summary",
    "contract_validation": "ok status checks errors",
    "capabilities": "status package contracts commands",
    "native_integration_plan": "ok status integration_policy summary capabilities nativeization_sequence safety_boundaries",
    "unified_plane_audit": "ok status summary checks errors warnings safety_boundaries",
    "context_advantage": "ok status source_identity_policy policy summary checks errors warnings safety_boundaries",
    "operator_context": "ok status summary operator_rows doctor_summary query_summaries recommended_commands safety_boundaries",
    "memory_ledger": "ok status summary rows reuse_index safety_boundaries",
    "unified_index": "ok status source_identity_policy summary rows safety_boundaries",
    "unified_working_set": "ok status optimization_policy source_identity_policy summary rows expansion_plan safety_boundaries",
    "manifest": "authority_boundary sources",
    "federation": "status ok sources entities edges conflicts query_presets summary",
    "repo_scan": "ok status summary outputs",
    "bootstrap": "ok status scan build verify doctor outputs",
    "quality_gate_policy": "",
    "quality_gate": "ok status policy checks errors summary",
    "manifest_compose": "ok status summary",
    "verify": "ok status checks errors",
    "query": "preset status row_count rows source_identity_policy",
    "public_boundary_audit": "ok status summary rows checks errors warnings safety_boundaries",
    "read_model_query": "preset row_count rows source_identity_policy",
    "resolve": "status target summary matched_entities related_sources related_edges related_conflicts",
    "adjudication": "status target verdict confidence_score support conflict_summary recommended_use",
    "target_review": "status target_count reviewed_count summary rows priority_order",
    "target_review_gate_policy": "",
    "target_review_gate": "ok status policy checks errors summary",
    "context_pack": "status task token_budget estimated_tokens prompt_estimated_tokens prompt_text coverage rows summary",
    "task_brief": "status task selected_presets doctor_summary context_budget coverage context_pack query_plan recommended_commands safety_boundaries",
    "agent_intake": "ok status task bootstrap_summary quality_gate_summary task_brief_summary quality_gate task_brief outputs safety_boundaries",
    "workflow_plan": "status task steps gates token_efficiency safety_boundaries",
    "workflow_run": "ok status task step_results model_handoff outputs safety_boundaries",
    "efficiency_report": "ok status workflow_run_ref artifacts model_context_budget safety_boundaries",
    "efficiency_gate_policy": "",
    "efficiency_gate": "ok status policy checks errors summary",
    "agent_ci": "ok status decision workflow_run_summary efficiency_report_summary efficiency_gate_summary contract_validation_summary contract_validations next_reads artifact_read_plan outputs safety_boundaries",
    "agent_context": "ok status input_ref mode summary sections skipped safety_boundaries",
    "agent_context_gate_policy": "",
    "agent_context_gate": "ok status source_identity_policy policy checks errors summary",
    "agent_handoff": "ok status decision agent_ci_summary agent_context_summary agent_context_gate_summary unified_plane_audit_summary context_advantage_summary public_boundary_audit_summary agent_handoff_verification_summary model_handoff outputs safety_boundaries",
    "agent_handoff_verification": "ok status checks errors summary",
    "agent_model_input": "ok status source_identity_policy prompt_pack verification_summary context_advantage_summary entrypoint_decision checks errors safety_boundaries",
    "agent_discovery": "ok status root ready_for_model_input discovered recommended_next_command safety_boundaries",
    "model_entrypoint_selection": "ok status input_ref input_artifact_kind entrypoint_decision selected_model_input recommended_reader safety_boundaries",
    "agent_route": "ok status root discovery_status action recommended_next_command route_steps wrapper_contract safety_boundaries",
    "agent_ready": "ok status source_identity_policy root action_taken route_summary handoff_summary input_freshness request_binding model_input_summary prompt_source prompt_estimated_tokens prompt_pack context_advantage_summary entrypoint_decision safety_boundaries",
    "agent_profile": "",
    "agent_profile_validation": "ok status profile_path normalized checks errors",
    "agent_profile_init": "ok status profile_path profile profile_validation_summary checks errors safety_boundaries",
    "agent_onboard": "ok status profile_path profile_init_summary profile_validation_summary agent_ready_summary model_input_ready entrypoint_decision model_entrypoint_selection model_entrypoint_selection_summary safety_boundaries",
    "input_fingerprint": "ok status root digest manifests sources",
    "input_fingerprint_compare": "status comparable matches",
    "request_binding": "ok status requested_task handoff_task requested_targets handoff_targets",
}

#: Kinds that people write: they may leave the envelope's boundary out.
WRITTEN_BY_HAND = {"quality_gate_policy", "target_review_gate_policy", "efficiency_gate_policy", "agent_context_gate_policy", "agent_profile", "manifest"}
TYPES = {"ok": "boolean", "status": "string", "checks": "array", "errors": "array", "warnings": "array", "rows": "array", "summary": "object", "outputs": "object", "safety_boundaries": "object", "row_count": "integer", "sources": ["array", "object"], "steps": "array"}


def version(kind: str) -> str:
    return f"sparkweave_{kind}_v1"


def schema(kind: str) -> dict:
    """One kind's contract. Every artifact that is made, not written by hand, says that it has no authority and applies nothing."""
    fields = REQUIRED[kind].split()
    made = kind not in WRITTEN_BY_HAND
    known = {"schema_version": {"type": "string", "const": version(kind)}, "authority_effect": {"type": "string", "const": "none"}, "no_apply": {"type": "boolean", "const": True}}
    return {
        "type": "object", "required": ["schema_version", *(["authority_effect", "no_apply"] if made else []), *fields],
        "properties": known | {f: {"type": TYPES[f]} for f in fields if f in TYPES}, "additionalProperties": True,
    }


def registry() -> dict[str, dict]:
    return {kind: schema(kind) for kind in REQUIRED}


def table(spark: SparkSession) -> DataFrame:
    """artifact_kind, schema_version, required: a row a contract."""
    return spark.createDataFrame([(k, s["properties"]["schema_version"]["const"], s["required"]) for k, s in registry().items()], "artifact_kind string, schema_version string, required array<string>")
