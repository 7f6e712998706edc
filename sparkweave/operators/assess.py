"""Source quality, conflicts, reviews and health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.operators.model import EDGE_KINDS, Graph, score_or

READY = ("loaded", "stale")


def drifted() -> Column:
    """The source claims an effect, or permits to apply something."""
    return (F.coalesce(F.nullif("authority_effect", F.lit("")), F.lit("none")) != "none") | F.coalesce(~F.col("no_apply"), F.lit(False))


def not_ready() -> Column:
    return F.coalesce("required", F.lit(False)) & ~F.coalesce("status", F.lit("")).isin(*READY)


def with_quality(sources: DataFrame) -> DataFrame:
    """quality_score from 100 down to 0, and what took points, in order."""
    status = F.coalesce("status", F.lit(""))
    no_verifier = F.coalesce("verifier", F.lit("")) == ""
    rules = [
        (status == "stale", 20, F.lit("stale")), (status.isin("missing", "error"), 60, status), (status == "optional_unavailable", 10, F.lit("optional_unavailable")),
        (not_ready(), 30, F.lit("required_not_loaded")), (drifted(), 50, F.lit("authority_boundary_violation")), (no_verifier, 5, F.lit("no_verifier")),
    ]
    lost = sum((F.when(when, points).otherwise(0) for when, points, _ in rules), F.lit(0))
    return sources.withColumn("quality_score", F.greatest(F.lit(0), F.lit(100) - lost).cast("int")).withColumn("quality_reasons", F.filter(F.array(*[F.when(when, why) for when, _, why in rules]), lambda x: x.isNotNull()))


def source_conflicts(sources: DataFrame) -> DataFrame:
    """Missing, stale and drifted sources."""
    q = lambda c: tx.or_null(tx.quoted(F.col(c)))
    kinds = [
        (not_ready(), "source_missing", "error", {"status": q("status"), "path": q("path")}),
        (F.col("status") == "stale", "source_stale", "warning", {"source_head": q("head_commit"), "current_head": q("stale_for")}),
        (drifted(), "authority_advisory_mixed", "error", {"authority_effect": q("authority_effect"), "no_apply": tx.or_null(F.col("no_apply").cast("string"))}),
    ]
    found = F.array(*[F.when(when, F.struct(F.lit(kind).alias("conflict_type"), F.lit(severity).alias("severity"), tx.json_object(detail).alias("detail"))) for when, kind, severity, detail in kinds])
    rows = sources.select("source_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c"))
    return rows.select(F.concat_ws(":", "c.conflict_type", "source_id").alias("conflict_id"), "c.conflict_type", "c.severity", "source_id", F.lit(None).cast("string").alias("entity_id"), "c.detail")


def fusion(graph: Graph) -> DataFrame:
    """Five reviewers' verdicts."""
    c = graph.conflicts.agg(
        *[F.coalesce(F.bool_or((F.col("severity") == s) & (F.col("conflict_type") == k)), F.lit(False)).alias(a) for a, s, k in (("mixed", "error", "authority_advisory_mixed"), ("policy", "error", "codebase_memory_policy_violation"), ("bare", "warning", "claim_without_evidence"), ("stale", "warning", "source_stale"))]
    )
    s = graph.sources.agg(F.coalesce(F.bool_or((F.col("source_id") == "codebase_memory_mcp") & F.col("status").isin("optional_disabled", "optional_unavailable")), F.lit(False)).alias("no_memory"), F.coalesce(F.bool_or(not_ready()), F.lit(False)).alias("missing"))
    verdicts = [("authority_boundary_reviewer", F.when(F.col("mixed"), "blocked").otherwise("pass")), ("source_graph_reviewer", F.when(F.col("no_memory"), "warn").otherwise("pass")), ("evidence_lineage_reviewer", F.when(F.col("missing"), "blocked").when(F.col("bare"), "warn").otherwise("pass")), ("operator_projection_reviewer", F.when(F.col("stale"), "warn").otherwise("pass")), ("external_tool_adoption_reviewer", F.when(F.col("policy"), "blocked").otherwise("pass"))]
    one = c.withColumn("k", F.lit(1)).join(s.withColumn("k", F.lit(1)), "k")  # two single rows
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), v.alias("verdict")) for r, v in verdicts])).alias("x")).select("x.*")


def counts(df: DataFrame, **rules: Column) -> DataFrame:
    return df.agg(*[F.count_if(rule).cast("long").alias(name) if rule is not None else F.count("*").alias(name) for name, rule in rules.items()])


def summary(graph: Graph) -> DataFrame:
    """(metric, value) rows: one pass over each relation."""
    status, severity = F.col("status"), F.col("severity")
    parts = [
        counts(graph.sources, source_count=None, loaded_source_count=status == "loaded", stale_source_count=status == "stale", missing_source_count=status == "missing", required_source_count=F.col("required")),
        counts(graph.entities, entity_count=None, claim_count=F.col("entity_type") == "claim_id"), counts(graph.edges, edge_count=None),
        counts(graph.conflicts, conflict_count=None, error_count=severity == "error", warning_count=severity == "warning"),
    ]
    return _unioned(parts)


def hints(graph: Graph) -> DataFrame:
    """How many rows each preset would find."""
    value = F.lower(F.coalesce("value", F.lit("")))
    kind = F.col("entity_type")
    named = {"claim-lineage": kind == "claim_id", "code-to-authority": kind.isin("path", "symbol_fqn"), "r19-context": F.contains(value, F.lit("r19")), "operator-projection": F.contains(value, F.lit("operator")) | F.contains(value, F.lit("dashboard")) | F.contains(value, F.lit("governance"))}
    return _unioned([counts(graph.entities, **named), counts(graph.conflicts, **{"surface-splits": F.contains("conflict_type", F.lit("surface"))}), counts(graph.sources, **{"stale-sources": F.col("status").isin("stale", "missing", "error", "optional_unavailable")})])


def _unioned(parts: list[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        rows = p.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in p.columns]), F.array(*[F.col(f"`{c}`") for c in p.columns]))).alias("metric", "value"))
        out = rows if out is None else out.union(rows)
    return out


def verify(graph: Graph, roles: DataFrame) -> DataFrame:
    """Invariants of a built graph as (id, passed, severity, observed): passed if nothing is observed against it."""
    checks = [
        ("required_sources_ready", "error", graph.sources.agg(F.count_if(not_ready()).alias("n"))),
        ("authority_boundary", "error", graph.sources.agg(F.count_if(drifted()).alias("n"))),
        ("edge_kinds", "error", graph.edges.agg(F.count_if(~F.col("edge_type").isin(*EDGE_KINDS)).alias("n"))),
        ("entity_ids_unique", "error", graph.entities.agg((F.count("*") - F.count_distinct("entity_id")).alias("n"))),
        ("edge_ids_unique", "error", graph.edges.agg((F.count("*") - F.count_distinct("edge_id")).alias("n"))),
        ("edges_join_entities", "error", graph.edges.select(F.explode(F.array("from_entity", "to_entity")).alias("entity_id")).distinct().join(graph.entities, "entity_id", "left_anti").agg(F.count("*").alias("n"))),
        ("fusion_roles", "warning", roles.agg((F.lit(5) - F.count_distinct("role")).alias("n"))),
        ("no_error_conflicts", "warning", graph.conflicts.agg(F.count_if(F.col("severity") == "error").alias("n"))),
    ]
    out = None
    for name, severity, found in checks:
        row = found.select(F.lit(name).alias("id"), (F.col("n") == 0).alias("passed"), F.lit(severity).alias("severity"), F.col("n").cast("long").alias("observed"))
        out = row if out is None else out.union(row)
    return out


def doctor(graph: Graph) -> DataFrame:
    """Seven health checks: what was observed, and pass, warn or fail."""
    q = score_or(F.col("quality_score"), 100)
    s = graph.sources.agg(F.count_if(not_ready()).alias("required_sources"), F.count_if(F.col("status") == "stale").alias("fresh_sources"), F.count_if(q < 60).alias("source_quality"), F.count_if(drifted()).alias("authority_boundary"))
    c = graph.conflicts.agg(F.count_if(F.col("severity") == "error").alias("error_conflicts"), F.count_if(F.col("severity") == "warning").alias("warning_conflicts"))
    e = graph.entities.agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("graph_not_empty"))
    worst = {"required_sources": "fail", "fresh_sources": "warn", "source_quality": "warn", "authority_boundary": "fail", "error_conflicts": "fail", "warning_conflicts": "warn", "graph_not_empty": "fail"}
    rows = _unioned([s, c, e])
    status = F.create_map(*[F.lit(x) for kv in worst.items() for x in kv])
    return rows.select(F.col("metric").alias("id"), F.col("value").cast("long").alias("observed"), F.when(F.col("value") == 0, "pass").otherwise(status[F.col("metric")]).alias("status"))


def operator_context(graph: Graph, limit: int | None = 50) -> DataFrame:
    """What an operator should look at, in order: conflicts, sources that aren't ready, stale or of low quality, surfaces."""
    q = score_or(F.col("quality_score"), 100)
    parts = [
        graph.conflicts.select(F.lit(0).alias("part"), F.lit("conflict").alias("kind"), F.col("conflict_id").alias("label"), F.col("severity").alias("status")),
        graph.sources.filter(not_ready()).select(F.lit(1), F.lit("required_source"), "source_id", "status"),
        graph.sources.filter("status = 'stale'").select(F.lit(2), F.lit("stale_source"), "source_id", "status"),
        graph.sources.filter(q < 80).select(F.lit(3), F.lit("low_quality_source"), "source_id", "status"),
        graph.entities.filter("entity_type = 'surface_id'").select(F.lit(4), F.lit("surface"), "value", F.lit("observed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    if limit is not None:
        out = out.orderBy("part", "label").limit(max(1, limit))
    key = F.concat_ws(":", "kind", "label")
    return out.select(F.concat(F.lit("operator:"), F.col("kind"), F.lit(":"), _safe(F.col("label")), F.lit(":"), F.left(F.sha2(key, 256), F.lit(16))).alias("row_id"), "part", "kind", "label", "status")


def _safe(x: Column) -> Column:
    from sparkweave.functions.ids import safe_id

    return safe_id(x, 48)
