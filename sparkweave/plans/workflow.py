"""Workflows over the operators: build, check, decide. Work is Spark's; decisions are made on its one-row summaries."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import assess, gates, pack, presets, project, resolve
from sparkweave.operators.model import Graph
from sparkweave.sources import manifest as mf
from sparkweave.sources import read_model, scan


@dataclass
class Step:
    name: str
    ok: bool
    status: str
    detail: dict = field(default_factory=dict)


def build(spark: SparkSession, manifest: dict, root: str, head: str = "", folder: str | None = None, memory: bool = False, cache_dir: str = "") -> Graph:
    """A manifest's sources, and the optional memory's pseudo-source with its policy conflicts, as a graph; written as a read
    model if a folder is named, and read back from it. The memory itself is never read."""
    bad = [i for i, ok in mf.checks(manifest) if not ok]
    if bad:
        raise ValueError(f"invalid manifest: {', '.join(bad)}")
    sources, _, _ = mf.compose([(f"{root.rstrip('/')}/manifest.json", manifest)])
    rows = mf.loaded(mf.specs(spark, sources), mf.payloads(spark, root), head)
    checked = assess.with_quality(rows)
    entities, edges, conflicts = project.build(rows)
    known, broken = scan.memory_source(memory, cache_dir, root, scan.tracked_memory(root) if "://" not in root else [])
    fields = "source_id string, role string, required boolean, status string, path string, verifier string, authority_effect string, no_apply boolean"
    pseudo = assess.with_quality(spark.createDataFrame([known], fields))
    checked = checked.drop("raw").unionByName(pseudo, allowMissingColumns=True)
    policy = spark.createDataFrame(broken, "conflict_id string, conflict_type string, severity string, source_id string, detail string").withColumn("entity_id", F.lit(None).cast("string"))
    graph = Graph(checked, entities, edges, conflicts.unionByName(assess.source_conflicts(checked)).unionByName(policy))
    if folder is None:
        return graph
    read_model.write(graph, folder)
    return read_model.read(spark, folder)[0]


def _checks(df: DataFrame) -> list[str]:
    return [r.id for r in df.filter("not passed and severity = 'error'").collect()]


def bootstrap(spark: SparkSession, manifest: dict, root: str, head: str = "", folder: str | None = None) -> tuple[Graph | None, list[Step]]:
    """Build, verify, doctor; what follows a failed build is left out."""
    try:
        graph = build(spark, manifest, root, head, folder)
    except ValueError as e:
        return None, [Step("build", False, "fail", {"error": str(e)})]
    summary = {r.metric: r.value for r in assess.summary(graph).collect()}
    failed = _checks(assess.verify(graph, assess.fusion(graph)))
    health = {r.status for r in assess.doctor(graph).collect()}
    worst = next(s for s in ("fail", "warn", "pass") if s in health)
    return graph, [Step("build", summary["error_count"] == 0, "pass" if summary["error_count"] == 0 else "fail", summary), Step("verify", not failed, "fail" if failed else "pass", {"failed": failed}), Step("doctor", worst != "fail", worst)]


def run(spark: SparkSession, manifest: dict, root: str, task: str, targets: list[str], policy: dict | None = None, review_policy: dict | None = None, head: str = "", folder: str | None = None) -> list[Step]:
    """Bootstrap, quality gate, brief, review, review gate. Steps after a failed bootstrap, or without targets, are left out."""
    graph, steps = bootstrap(spark, manifest, root, head, folder)
    if graph is None:
        return steps
    listed = graph.sources.select("source_id", "role").collect()
    gate = gates.quality_gate(spark, steps[0].detail, {r[0] for r in listed}, {r[1] for r in listed}, set(presets.VIEW_PRESETS), gates.Policy.of(policy, gates.QUALITY_POLICY), {s.name: s.ok for s in steps})
    failed = _checks(gate)
    steps.append(Step("quality_gate", not failed, "fail" if failed else "pass", {"failed": failed}))
    chosen = pack.pack(graph, task).count()
    steps.append(Step("brief", True, "pass" if chosen else "warn", {"presets": pack.route(task), "rows": chosen}))
    if targets := resolve.clean_targets(targets):
        judged = resolve.adjudicate(spark, graph, targets).cache()
        review = resolve.review(judged).first().asDict()
        flags = {r.risk_flag: r.n for r in resolve.risk_flag_counts(judged).collect()}
        steps.append(Step("review", True, review["status"], review))
        failed = _checks(gates.review_gate(spark, review, flags, set(targets), gates.Policy.of(review_policy, gates.REVIEW_POLICY)))
        steps.append(Step("review_gate", not failed, "fail" if failed else "pass", {"failed": failed}))
        judged.unpersist()
    return steps


def decision(steps: list[Step], reviewed: bool = True) -> dict:
    """stop if a step failed; continue_with_caution if one warns or nothing was reviewed; else continue."""
    stops = [s.name for s in steps if not s.ok]
    cautions = [s.name for s in steps if s.ok and s.status in ("warn", "blocked")] + ([] if reviewed else ["no_targets"])
    action = "stop" if stops else "continue_with_caution" if cautions else "continue"
    return {"action": action, "continue": not stops, "stop_reasons": stops, "cautions": cautions}


def model_input(steps: list[Step], prompt: str, fingerprint: str, expected: str | None = None) -> dict:
    """A prompt, only if all went well and the inputs are still those it was made from; else none, and why."""
    choice = decision(steps)
    why = choice["stop_reasons"] + (["inputs_changed"] if expected is not None and expected != fingerprint else []) + ([] if prompt.strip() else ["prompt_empty"])
    return {"allowed": not why, "prompt": prompt if not why else "", "reasons": why, "authority_effect": "none", "no_apply": True}


def timed(f: Callable[[], object], times: int = 5) -> dict[str, float]:
    """Seconds of some calls: min, max, mean, median."""
    took = []
    for _ in range(max(1, times)):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    return {"seconds_min": min(took), "seconds_max": max(took), "seconds_mean": statistics.mean(took), "seconds_median": statistics.median(took)}
