"""Targets: what a graph says about each, how far to trust it, and which to review first.

All targets are handled together, in one pass over each relation (see `automaton`). What is kept of a relation is at most
the limit for each target; it is checkpointed, so the relations after it read that and not what it was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.operators import automaton, many, presets
from sparkweave.operators.automaton import terms_of  # noqa: F401  terms of one target
from sparkweave.operators.model import Graph, chosen
from sparkweave.sources import shared

# Bases of related conflicts and of verdicts; words that give a role its tier.
CONFLICT_BASES = {"error": 90, "warning": 60, "info": 20}
VERDICT_BASES = {"blocked": 100, "no_match": 90, "advisory_only": 80, "warn": 60, "supported": 10}
AUTHORITY_WORDS, EVIDENCE_WORDS = "truth|authority|claim|surface|policy|contract", "evidence|receipt|inventory"


def clean_targets(targets: list[str]) -> list[str]:
    """Trimmed, without empty ones and repeats, in order."""
    return list(dict.fromkeys(t for t in (str(x).strip() for x in targets) if t))


def _best(df: DataFrame, limit: int) -> DataFrame:
    """The first rows of each target by score, then id. Spark cuts each task's rows to the limit before the shuffle."""
    w = Window.partitionBy("target_no").orderBy(F.desc("score"), F.asc("id"))
    return shared.checkpointed(df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n"))


def relations(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, edges, sources and conflicts as rows (id, text, extra, keys, base); entities have no keys."""
    return (
        graph.entities.select(F.col("entity_id").alias("id"), presets.entity_text().alias("text"), F.to_json("source_ids").alias("extra")),
        graph.edges.select(F.col("edge_id").alias("id"), presets.edge_text().alias("text"), F.col("source_id").alias("extra"), F.array("from_entity", "to_entity").alias("keys"), F.lit(50).alias("base")),
        graph.sources.select(F.col("source_id").alias("id"), presets.source_text().alias("text"), F.lit("").alias("extra"), F.array("source_id").alias("keys"), F.lit(70).alias("base")),
        graph.conflicts.select(F.col("conflict_id").alias("id"), presets.conflict_text().alias("text"), F.col("severity").alias("extra"), F.array("source_id").alias("keys"), chosen(F.col("severity"), CONFLICT_BASES, 0).alias("base")),
    )


def matches(graph: Graph, targets: list[str], limit: int = 20) -> dict[str, DataFrame]:
    """entity, edge, source and conflict rows of each target: (target_no, id, score, ...), best first, cut per target.

    Each relation is read once, whatever the targets. An edge at a kept entity, and a source or conflict of a source that is
    cited, gain points in that pass; so no row of a hub is joined to the targets that reach it.
    """
    limit = max(1, limit)
    rows_of_entities, rows_of_edges, rows_of_sources, rows_of_conflicts = relations(graph)
    entities = _best(automaton.best_rows(rows_of_entities, targets, limit), limit)
    entities = entities.select("target_no", "id", "score", F.from_json("extra", "array<string>").alias("source_ids"))
    reached = entities.select(F.col("id").alias("key"), "target_no")
    edges = _best(automaton.best_rows(rows_of_edges, targets, 2 * limit, reached), 2 * limit).withColumnRenamed("extra", "source_id")
    cited = entities.select(F.explode("source_ids").alias("key"), "target_no").union(edges.select("source_id", "target_no")).distinct()
    known = graph.sources.select(F.col("source_id").alias("id"), "role", "status", "required", "quality_score")
    sources = _best(automaton.best_rows(rows_of_sources, targets, limit, cited), limit).drop("extra").join(known, "id")
    cited = cited.union(sources.select("id", "target_no")).distinct()
    conflicts = _best(automaton.best_rows(rows_of_conflicts, targets, limit, cited), limit).withColumnRenamed("extra", "severity")
    return {"entity": entities, "edge": edges, "source": sources, "conflict": conflicts}


def tier() -> Column:
    role = F.lower(F.coalesce("role", F.lit("")))
    return F.when(F.contains(role, F.lit("advisory")), "advisory").when(role.rlike(AUTHORITY_WORDS), "authority").when(role.rlike(EVIDENCE_WORDS), "evidence").otherwise("context")


def adjudicate(spark: SparkSession, graph: Graph, targets: list[str], limit: int = 20) -> DataFrame:
    """One row a target: counts, status, support by tier, risk flags, confidence (0 to 100), verdict, priority (0 to 150)."""
    targets = clean_targets(targets)
    return _adjudicated(spark.createDataFrame(list(enumerate(targets)), "target_no int, target string"), matches(graph, targets, limit))


def _adjudicated(rows: DataFrame, m: dict[str, DataFrame], whose: dict[str, DataFrame] | None = None) -> DataFrame:
    """Targets (target_no, target) with what their matches say of them. whose: kinds whose matches some targets share, as
    (target_no, who): the matches are those of `who`."""

    def n(kind: str, *more: Column) -> DataFrame:
        counted = m[kind].groupBy("target_no").agg(F.count("*").alias(f"{kind}_count"), *more)
        if kind not in (whose or {}):
            return counted
        return whose[kind].join(counted.withColumnRenamed("target_no", "who"), "who").drop("who")

    t, s = tier(), F.col("severity")
    by_tier = [F.count_if(t == k).alias(f"{k}_sources") for k in ("authority", "evidence", "advisory", "context")]
    for part in (n("entity"), n("edge"), n("source", *by_tier, F.count_if(~F.coalesce("status", F.lit("")).isin("loaded", "stale")).alias("unavailable_sources"), F.count_if(F.col("status") == "stale").alias("stale_sources")), n("conflict", F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "info").alias("infos"))):
        rows = rows.join(part, "target_no", "left")
    rows = rows.drop("target_no").na.fill(0)
    c = F.col
    none = (c("entity_count") == 0) & (c("source_count") == 0) & (c("edge_count") == 0)
    status = F.when(none, "no_match").when((c("errors") > 0) | (c("warnings") > 0), "warn").otherwise("matched")
    unbacked = (c("authority_sources") == 0) & (c("evidence_sources") == 0)
    flags = [
        (none, "target_not_found"), (c("errors") > 0, "error_conflict_present"), (c("warnings") > 0, "warning_conflict_present"), (unbacked, "no_authority_or_evidence_source"),
        ((c("advisory_sources") > 0) & (c("authority_sources") == 0), "advisory_without_authority"), (c("unavailable_sources") > 0, "unavailable_source_present"), (c("stale_sources") > 0, "stale_source_present"),
    ]
    points = lambda when, p: F.when(when, p).otherwise(0)
    least = lambda most, x: F.least(F.lit(most), x)
    confidence = (
        points(c("entity_count") > 0, 25) + points(c("edge_count") > 0, 15) + least(25, c("authority_sources") * 15) + least(20, c("evidence_sources") * 10) + least(10, c("advisory_sources") * 5)
        - least(40, c("errors") * 40) - least(25, c("warnings") * 15) - points(unbacked, 25) - points(c("stale_sources") > 0, 10) - points(c("unavailable_sources") > 0, 15)
    )
    rows = rows.withColumns({"status": status, "risk_flags": F.filter(F.array(*[F.when(w, F.lit(f)) for w, f in flags]), lambda x: x.isNotNull()), "confidence_score": F.greatest(F.lit(0), F.least(F.lit(100), confidence)).cast("long")})
    verdict = F.when(none, "no_match").when(c("errors") > 0, "blocked").when(unbacked, "advisory_only").when((c("confidence_score") >= 70) & (F.size("risk_flags") == 0), "supported").otherwise("warn")
    rows = rows.withColumn("verdict", verdict)
    priority = chosen(c("verdict"), VERDICT_BASES, 50) + least(20, F.size("risk_flags") * 5) + least(20, c("errors") * 10 + c("warnings") * 5) + F.floor(F.greatest(F.lit(0), 50 - c("confidence_score")) / 5)
    return rows.withColumn("priority_score", F.greatest(F.lit(0), F.least(F.lit(150), priority)).cast("long"))


def adjudicate_all(graph: Graph, targets: DataFrame, limit: int = 20, at_once: int = 20_000) -> DataFrame:
    """Adjudication of any number of targets, which are targets' only column. Each relation is searched once, whatever the
    targets; the driver holds at most `at_once` beginnings of their words (or one for each first character)."""
    name, limit = targets.columns[0], max(1, limit)
    targets = shared.checkpointed(targets.select(F.btrim(F.col(name).cast("string")).alias("target")).filter("target <> ''").distinct())
    targets = targets.withColumn("target_no", F.monotonically_increasing_id())
    of_word = shared.checkpointed(many.words_of(targets))
    words = shared.checkpointed(of_word.select("word").distinct())
    heads = many.beginnings(words, at_once)
    entities, edges, sources, conflicts = relations(graph)

    def searched(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        hits = many.found(rows.drop("keys"), words, heads)
        return rows.drop("text"), hits, many.scores(hits, of_word)

    kept = many.best_rows(*searched(entities), limit).select("target_no", "id", "score", F.from_json("extra", "array<string>").alias("source_ids"))
    kept_edges = many.best_rows(*searched(edges), 2 * limit, kept.select(F.col("id").alias("key"), "target_no"))
    cited = shared.checkpointed(kept.select(F.explode("source_ids").alias("key"), "target_no").union(kept_edges.select(F.col("extra").alias("key"), "target_no")).distinct())
    found = searched(sources)
    of_source, gains = many.alike(cited, found[-1])
    known = graph.sources.select(F.col("source_id").alias("id"), "role", "status", "required", "quality_score")
    kept_sources = shared.checkpointed(many.best_rows(*found, limit, gains).drop("extra").join(known, "id"))
    # Targets that share their sources only have such as they cite.
    cited = cited.union(kept_sources.select("id", "target_no")).distinct()
    found = searched(conflicts)
    of_conflict, gains = many.alike(cited, found[-1])
    kept_conflicts = many.best_rows(*found, limit, gains).withColumnRenamed("extra", "severity")
    return shared.checkpointed(_adjudicated(targets, {"entity": kept, "edge": kept_edges, "source": kept_sources, "conflict": kept_conflicts}, {"source": of_source, "conflict": of_conflict}))


def review(adjudicated: DataFrame) -> DataFrame:
    """One row: how many targets of each verdict, mean confidence, greatest priority, and the review's status."""
    counted = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICT_BASES]
    out = adjudicated.agg(F.count("*").alias("target_count"), *counted, F.coalesce(F.round(F.avg("confidence_score"), 3), F.lit(0.0)).alias("average_confidence"), F.coalesce(F.max("priority_score"), F.lit(0)).alias("max_priority_score"))
    return out.withColumn("status", F.when(F.col("blocked") > 0, "blocked").when(F.col("warn") + F.col("advisory_only") + F.col("no_match") > 0, "warn").otherwise("pass"))


def risk_flag_counts(adjudicated: DataFrame) -> DataFrame:
    return adjudicated.select(F.explode("risk_flags").alias("risk_flag")).groupBy("risk_flag").agg(F.count("*").alias("n"))
