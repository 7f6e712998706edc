"""Degree, ranks, traces, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.operators import containment
from sparkweave.sources import shared
from sparkweave.operators.model import FACETS, INDEX_WEIGHTS, RANK_WEIGHTS, Graph, chosen, score_or, top


def degrees(edges: DataFrame, weights: dict[str, int] = RANK_WEIGHTS) -> DataFrame:
    """entity_id, degree, weighted_degree. Each edge makes two rows, summed in each task before the only shuffle."""
    ends = edges.select(chosen(F.col("edge_type"), weights, 1).alias("w"), F.explode(F.array("from_entity", "to_entity")).alias("entity_id"))
    return ends.filter("entity_id <> ''").groupBy("entity_id").agg(F.count("*").alias("degree"), F.sum("w").cast("long").alias("weighted_degree"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def degree_summary(graph: Graph, limit: int | None = 20) -> DataFrame:
    """The entities with most edges; of equals the least id."""
    d = top(degrees(graph.edges).select("entity_id", "degree"), limit, F.desc("degree"), F.asc("entity_id"))
    return d.join(graph.entities.select("entity_id", "entity_type", "value"), "entity_id", "left")


def source_scores(graph: Graph) -> DataFrame:
    """entity_id, source_score: the mean quality of its sources, rounded half to even; of unknown sources 100; 0 of none."""
    quality = graph.sources.select(F.col("source_id").alias("s"), score_or(F.col("quality_score"), 100).alias("q"))
    one = graph.entities.select("entity_id", F.explode_outer("source_ids").alias("s"))
    return one.join(quality, "s", "left").groupBy("entity_id").agg(F.when(F.count("s") > 0, F.bround(F.avg(F.when(F.col("s").isNotNull(), F.coalesce("q", F.lit(100)))), 0)).otherwise(0).cast("long").alias("source_score"))


def entity_rank(graph: Graph, limit: int | None = 20) -> DataFrame:
    """Weighted degree x 10 + degree x 3 + source score, + 10 for claims, surfaces and symbols."""
    rows = graph.entities.select("entity_id", "entity_type", "value").join(degrees(graph.edges), "entity_id", "left").join(source_scores(graph), "entity_id", "left")
    d, w, s = (F.coalesce(c, F.lit(0)).cast("long") for c in ("degree", "weighted_degree", "source_score"))
    bonus = F.when(F.col("entity_type").isin("claim_id", "surface_id", "symbol_fqn"), 10).otherwise(0)
    out = rows.select("entity_id", "entity_type", "value", (w * 10 + d * 3 + s + bonus).alias("score"), d.alias("degree"), w.alias("weighted_degree"), s.alias("source_score"))
    return top(out, limit, F.desc("score"), F.asc("entity_type"), F.asc("value"))


def source_rank(graph: Graph, limit: int | None = 20) -> DataFrame:
    """Risk: what quality lacks, + 50 an error, 10 a warning, 5 if required."""
    severity = F.col("severity")
    c = graph.conflicts.groupBy("source_id").agg(F.count("*").alias("conflict_count"), F.count_if(severity == "error").alias("error_count"), F.count_if(severity == "warning").alias("warning_count"))
    n = {k: F.coalesce(k, F.lit(0)).cast("long") for k in ("conflict_count", "error_count", "warning_count")}
    q = score_or(F.col("quality_score"), 100).cast("long")
    required = F.coalesce("required", F.lit(False))
    out = graph.sources.join(c, "source_id", "left").select("source_id", "role", required.alias("required"), "status", q.alias("quality_score"), *[v.alias(k) for k, v in n.items()], (100 - q + n["error_count"] * 50 + n["warning_count"] * 10 + required.cast("int") * 5).cast("long").alias("risk_score"))
    return top(out, limit, F.desc("risk_score"), F.asc("source_id"))


def conflict_hits(graph: Graph) -> DataFrame:
    """entity_id, conflict_count, level: how many texts of conflicts (id, type, severity, entity) have the entity's id or value
    in them, and their greatest severity."""
    level = chosen(F.col("severity"), {"error": 3, "warning": 2, "info": 1}, 0)
    texts = graph.conflicts.select(F.explode(F.array("conflict_id", "conflict_type", "severity", "entity_id")).alias("text"), level.alias("level")).filter("text is not null").groupBy("text").agg(F.count("*").alias("n"), F.max("level").alias("level"))
    keys = graph.entities.select("entity_id", F.coalesce(F.nullif("value", F.lit("")), F.col("entity_id")).alias("needle")).filter("entity_id <> ''")
    hits = keys.join(containment.counts(keys.select("needle"), texts).hint("merge"), "needle").select("entity_id", "n", "level")
    apart = keys.filter(~F.contains("entity_id", F.col("needle")))  # else a text with the id has the value too
    by_id = containment.pairs(apart.select(F.col("entity_id").alias("needle")), texts).withColumnRenamed("needle", "_id").join(apart.hint("merge"), F.col("_id") == F.col("entity_id"))
    hits = hits.union(by_id.filter(~F.contains("text", F.col("needle"))).select("entity_id", "n", "level"))
    return hits.groupBy("entity_id").agg(F.sum("n").alias("conflict_count"), F.max("level").alias("level"))


def entity_facets(graph: Graph, limit: int | None = 200) -> DataFrame:
    """Entities as facet rows: weighted degree x 12 + degree x 4 + sources x 8, + 30 for surfaces, claims and symbols, - 15 for
    each text of a conflict that has the entity's id or value in it."""
    hits = conflict_hits(graph)
    rows = graph.entities.join(degrees(graph.edges, INDEX_WEIGHTS).hint("merge"), "entity_id", "left").join(hits.hint("merge"), "entity_id", "left")
    d, w, n = (F.coalesce(c, F.lit(0)).cast("long") for c in ("degree", "weighted_degree", "conflict_count"))
    facet, evidence = chosen(F.col("entity_type"), FACETS, "entity"), F.size("source_ids").cast("long")
    score = w * 12 + d * 4 + evidence * 8 + F.when(facet.isin("surface", "claim", "symbol"), 30).otherwise(0) - n * 15
    row_id = F.concat(F.lit("urow:"), F.left(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[tx.quoted(c) for c in (facet, F.col("entity_type"), F.col("value"), F.col("entity_id"))]), F.lit("]")), 256), F.lit(16)))
    out = rows.select(row_id.alias("row_id"), facet.alias("facet"), F.coalesce(F.nullif("label", F.lit("")), F.col("value")).alias("label"), "value", "entity_type", score.cast("long").alias("score"), d.alias("edge_count"), w.alias("weighted_edge_score"), evidence.alias("evidence_count"), n.alias("conflict_count"), chosen(F.coalesce("level", F.lit(0)), {3: "error", 2: "warning", 1: "info"}, "none").alias("highest_conflict_severity"))
    return top(out, limit, F.desc("score"), F.asc("facet"), F.asc("label"))


def conflict_facets(graph: Graph, limit: int | None = 200) -> DataFrame:
    """Conflicts as facet rows: 300 an error, 200 a warning, else 100."""
    kind = F.col("conflict_type")
    row_id = F.concat(F.lit("urow:"), F.left(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[tx.quoted(c) for c in (F.lit("conflict"), kind, F.col("conflict_id"))]), F.lit("]")), 256), F.lit(16)))
    out = graph.conflicts.select(row_id.alias("row_id"), F.lit("conflict").alias("facet"), kind.alias("label"), F.col("conflict_id").alias("value"), F.lit("conflict").alias("entity_type"), chosen(F.col("severity"), {"error": 300, "warning": 200}, 100).cast("long").alias("score"), *[F.lit(0).cast("long").alias(c) for c in ("edge_count", "weighted_edge_score", "evidence_count", "conflict_count")], F.col("severity").alias("highest_conflict_severity"))
    return top(out, limit, F.desc("score"), F.asc("facet"), F.asc("value"))


def unified_index(graph: Graph, query: str = "", limit: int = 200, more: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Facet rows of all kinds, cut per kind before the query's terms filter them, then merged and cut. more: rows of further
    kinds (memory, commands, capabilities: see `facets`), each cut to the limit by its own order; columns that a kind lacks
    are null."""
    rows = entity_facets(graph, limit).unionByName(conflict_facets(graph, limit))
    for other in more:
        rows = rows.unionByName(other, allowMissingColumns=True)
    words = [t.lower() for t in query.replace("/", " ").replace("_", " ").split() if len(t) >= 2]
    text = F.lower(F.concat_ws(" ", *(c for c in ("row_id", "facet", "label", "value", "entity_type", "artifact_kind") if c in rows.columns)))
    score = sum((F.contains(text, F.lit(w)).cast("long") for w in words), F.lit(0).cast("long"))
    rows = rows.withColumn("query_match_score", score)
    if words:
        rows = rows.filter("query_match_score > 0")
    return top(rows, limit, F.desc("score"), F.desc("query_match_score"), F.asc("facet"), F.asc("label"), F.asc("row_id"))


def trace(graph: Graph, match: Column, depth: int = 2, limit: int | None = None) -> DataFrame:
    """entity_id, depth: entities within `depth` undirected steps of the entities that match.

    A frontier a step: only nodes reached by the last step are joined with the edges, at both ends, and nodes known before
    are dropped by an anti-join. Each step's nodes are checkpointed, so that no step is run again and a lost executor costs
    none. With a limit, nodes beyond the seeds are admitted by depth, then by id, while there is room.
    """
    ends = graph.edges.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b"))
    known = frontier = shared.checkpointed(graph.entities.filter(match).select("entity_id", F.lit(0).alias("depth")))
    for step in range(1, max(0, depth) + 1):
        last = frontier.select(F.col("entity_id").alias("k"))
        out, back = (ends.join(last, F.col(x) == F.col("k"), "left_semi").select(F.col(y).alias("entity_id")) for x, y in (("a", "b"), ("b", "a")))
        frontier = shared.checkpointed(out.union(back).distinct().join(known, "entity_id", "left_anti").select("entity_id", F.lit(step).alias("depth")))
        known = known.union(frontier)
    if limit is not None:
        seeds = known.filter("depth = 0")
        rest = known.filter("depth > 0").orderBy("depth", "entity_id").limit(max(0, limit - seeds.count()))
        known = seeds.union(rest)
    return known


def trace_edges(graph: Graph, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """The edges between a trace's nodes: two semi-joins. With a limit, the first ones by id."""
    ids = nodes.select(F.col("entity_id").alias("n"))
    inside = graph.edges.join(ids, F.col("from_entity") == F.col("n"), "left_semi").join(ids, F.col("to_entity") == F.col("n"), "left_semi")
    return top(inside, limit, F.asc("edge_id"))


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed), changed_fields. Of rows that share a key one is taken, the greatest."""
    side = lambda df, s: df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max(F.struct(*[F.col(f) for f in fields])).alias(s))
    both = side(before, "_b").join(side(after, "_a"), key, "full_outer")
    fields_changed = F.filter(F.array(*[F.when(~F.col(f"_b.{f}").eqNullSafe(F.col(f"_a.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size(fields_changed) > 0, "changed")
    return both.select(key, kind.alias("change"), F.when(kind == "changed", F.array_join(fields_changed, ",")).otherwise("").alias("changed_fields")).filter("change is not null")


def fingerprint(columns: list[str]) -> Column:
    """A digest of the columns' canonical JSON."""
    return F.sha2(tx.json_object({c: tx.or_null(tx.quoted(F.col(c).cast("string"))) for c in columns}), 256)


def fingerprints(sources: DataFrame, columns: list[str], key: str = "source_id") -> DataFrame:
    """key, fingerprint: a digest of the columns' canonical JSON."""
    return sources.select(key, fingerprint(columns).alias("fingerprint"))


def compare_fingerprints(current: DataFrame, previous: DataFrame, key: str = "source_id") -> DataFrame:
    """key, change: new, unchanged, changed or removed."""
    both = current.select(key, F.col("fingerprint").alias("_n")).join(previous.select(key, F.col("fingerprint").alias("_o")), key, "full_outer")
    return both.select(key, F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed").when(F.col("_n") == F.col("_o"), "unchanged").otherwise("changed").alias("change"))


def balanced(rows: DataFrame, order: list[str], limit: int, min_facets: int) -> DataFrame:
    """The best row of each facet, in the order given, for the first min_facets facets that have one; then the rest by rank."""
    best = Window.partitionBy("facet").orderBy(F.desc("score"), F.asc("label"), F.asc("row_id"))
    at = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("facet"))
    ranked = rows.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= limit)  # at most limit rows a facet go on
    facet_rank = ranked.filter("_n = 1").filter(at > 0).select("row_id", at.alias("_at")).orderBy("_at").limit(max(0, min_facets)).select("row_id", F.col("_at").alias("_first"))
    out = ranked.join(F.broadcast(facet_rank), "row_id", "left")
    return out.orderBy(F.asc_nulls_last("_first"), F.desc("score"), F.asc("facet"), F.asc("label"), F.asc("row_id")).limit(max(1, limit)).drop("_n", "_first")
