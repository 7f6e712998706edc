"""What this library can do, by capability: its commands and contracts, other names for it, and who should own a function."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: id: (name, commands, contracts, other names)
CAPABILITIES = {
    "repository_scan": ("Scan of a code tree", ("scan",), ("repo_scan",), ("scan repository", "code inventory", "import graph")),
    "graph_build": ("Payloads to a graph", ("build", "run"), ("federation", "bootstrap", "manifest_compose", "manifest"), ("assemble", "federate", "compose")),
    "health": ("Doctor and verification", ("doctor",), ("verify", "quality_gate"), ("verify", "lint graph")),
    "search": ("Presets and text search", ("query", "sql", "search"), ("query", "read_model_query"), ("lookup", "find")),
    "ranking": ("Entities and sources by rank", ("rank", "rank-sources"), (), ("rank entities", "source risk")),
    "tracing": ("Neighbours of what matches", ("trace",), (), ("graph walk", "neighbours")),
    "review": ("Verdicts on targets", ("resolve",), ("resolve", "adjudication", "target_review", "target_review_gate"), ("adjudicate", "target review")),
    "packing": ("Packs under a token budget", ("pack",), ("context_pack", "task_brief"), ("context pack", "token budget")),
    "facets": ("One index over all facets", ("index",), ("unified_index", "unified_working_set", "unified_plane_audit"), ("unified index", "working set")),
    "handoff": ("Handoffs, their verification and release", ("verify-handoff", "release"), ("agent_handoff", "agent_handoff_verification", "agent_model_input", "model_entrypoint_selection"), ("model input", "hand over")),
    "discovery": ("State of a repository and the next step", ("discover", "route"), ("agent_discovery", "agent_route", "agent_ready"), ("readiness", "next step")),
    "profiles": ("Run profiles and onboarding", ("validate-profile", "init-profile", "onboard"), ("agent_profile", "agent_profile_validation", "agent_profile_init", "agent_onboard"), ("profile", "runner")),
    "contracts": ("Contracts of artifacts", ("contracts", "validate"), ("schema_registry", "contract_validation"), ("schema", "schema registry")),
}


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def names() -> dict[str, str]:
    """Every name that a capability goes by, in plain form, to its id: id, title, commands, other names; the first one wins."""
    out: dict[str, str] = {}
    for i, (title, commands, _, others) in CAPABILITIES.items():
        for n in (i, title, *commands, *others):
            out.setdefault(plain(n), i)
    return out


def ownership(functions: list[str]) -> list[dict]:
    """For each function asked about: the capability that has it, or that it is to be built."""
    known = names()
    rows = []
    for f in dict.fromkeys(x.strip() for x in functions if x.strip()):
        i = known.get(plain(f), "")
        rows.append({"function": f, "capability_id": i, "commands": list(CAPABILITIES[i][1]) if i else [], "decision": "use_native" if i else "build"})
    return rows


def table(spark: SparkSession) -> DataFrame:
    """capability_id, capability_name, integration_status, commands, contracts: what `facets.capabilities` takes, and more."""
    rows = [(i, title, "native_available", list(commands), list(kinds)) for i, (title, commands, kinds, _) in CAPABILITIES.items()]
    return spark.createDataFrame(rows, "capability_id string, capability_name string, integration_status string, commands array<string>, contracts array<string>")
