"""Named queries over a graph: as it is projected (view presets), and over its read model's tables (SQL presets)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.operators.model import Graph


def _q(name: str) -> Column:
    return tx.or_null(tx.quoted(F.col(name)))


def source_text() -> Column:
    """A source's row as canonical JSON."""
    plain = {c: _q(c) for c in ("source_id", "role", "status", "path", "verifier", "authority_effect", "head_commit", "stale_for")}
    flags = {c: tx.or_null(F.col(c).cast("string")) for c in ("required", "no_apply")}
    quality = {"quality": tx.json_object({"reasons": tx.json_strings(F.col("quality_reasons")), "score": F.col("quality_score").cast("string")})}
    return tx.json_object(plain | flags | quality)


def entity_text() -> Column:
    return tx.json_object({c: _q(c) for c in ("entity_id", "entity_type", "label", "value")} | {"metadata": F.coalesce("metadata", F.lit("{}")), "source_ids": tx.json_strings(F.col("source_ids"))})


def edge_text() -> Column:
    return tx.json_object({c: _q(c) for c in ("edge_id", "edge_type", "from_entity", "to_entity", "source_id", "evidence")})


def conflict_text() -> Column:
    """A conflict without an entity has no such key."""
    return tx.json_object({c: _q(c) for c in ("conflict_id", "conflict_type", "severity", "source_id")} | {"entity_id": tx.quoted(F.col("entity_id")), "detail": F.coalesce("detail", F.lit("null"))})


def search_index(graph: Graph, fusion: DataFrame | None = None) -> DataFrame:
    """(kind, row_id, text) of every row: the read model's searchable table."""
    parts = [
        graph.sources.select(F.lit("source").alias("kind"), F.col("source_id").alias("row_id"), source_text().alias("text")),
        graph.entities.select(F.lit("entity"), "entity_id", entity_text()), graph.edges.select(F.lit("edge"), "edge_id", edge_text()), graph.conflicts.select(F.lit("conflict"), "conflict_id", conflict_text()),
    ]
    if fusion is not None:
        parts.append(fusion.select(F.lit("fusion"), "role", tx.json_object({"role": _q("role"), "verdict": _q("verdict")})))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def has(text: Column, *needles: str) -> Column:
    return tx.has_any(F.lower(text), [n.lower() for n in needles])


def _rows(df: DataFrame, part: int, kind: str, key: str) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.col(key).alias("id"))


def _branches(*parts: DataFrame, limit: int | None) -> DataFrame:
    """Branches one after another, each by id: the order that a limit cuts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out if limit is None else out.orderBy("part", "id").limit(max(1, limit))


def surface_splits(g: Graph, limit: int | None = 50) -> DataFrame:
    return _branches(_rows(g.conflicts.filter(has(conflict_text(), "surface")), 0, "conflict", "conflict_id"), _rows(g.entities.filter(has(entity_text(), "surface")), 1, "entity", "entity_id"), limit=limit)


def claim_lineage(g: Graph, limit: int | None = 50) -> DataFrame:
    """Claims, and the edges that touch one at either end: two semi-joins, so an edge between claims comes once."""
    claims = g.entities.filter("entity_type = 'claim_id'")
    ids = claims.select(F.col("entity_id").alias("c"))
    start = g.edges.join(ids, F.col("from_entity") == F.col("c"), "left_semi")
    end = g.edges.join(ids, F.col("from_entity") == F.col("c"), "left_anti").join(ids, F.col("to_entity") == F.col("c"), "left_semi")
    return _branches(_rows(claims, 0, "entity", "entity_id"), _rows(start.union(end), 1, "edge", "edge_id"), limit=limit)


def stale_sources(g: Graph, limit: int | None = 50) -> DataFrame:
    words = ("stale", "missing", "optional_unavailable")
    return _branches(_rows(g.sources.filter(has(source_text(), *words)), 0, "source", "source_id"), _rows(g.conflicts.filter(has(conflict_text(), *words)), 1, "conflict", "conflict_id"), limit=limit)


def code_to_authority(g: Graph, limit: int | None = 50) -> DataFrame:
    return _branches(_rows(g.entities.filter(F.col("entity_type").isin("path", "symbol_fqn")), 0, "entity", "entity_id"), limit=limit)


def everywhere(g: Graph, *needles: str, limit: int | None = 50) -> DataFrame:
    """Rows of any relation whose text has one of the needles."""
    return _branches(_rows(g.sources.filter(has(source_text(), *needles)), 0, "source", "source_id"), _rows(g.entities.filter(has(entity_text(), *needles)), 1, "entity", "entity_id"), _rows(g.edges.filter(has(edge_text(), *needles)), 2, "edge", "edge_id"), _rows(g.conflicts.filter(has(conflict_text(), *needles)), 3, "conflict", "conflict_id"), limit=limit)


def r19_context(g: Graph, limit: int | None = 50, needle: str = "r19") -> DataFrame:
    return everywhere(g, needle, limit=limit)


def operator_projection(g: Graph, limit: int | None = 50) -> DataFrame:
    return everywhere(g, "operator", "dashboard", "governance", limit=limit)


VIEW_PRESETS: dict[str, Callable] = {"surface-splits": surface_splits, "claim-lineage": claim_lineage, "stale-sources": stale_sources, "code-to-authority": code_to_authority, "r19-context": r19_context, "operator-projection": operator_projection}

# The read model's presets, over temporary views of these names. LIKE ignores the case of ASCII letters only.
SQL_PRESETS = {
    "source-health": "SELECT source_id, role, required, status, path, quality_score FROM {sources} ORDER BY quality_score, required DESC, source_id",
    "stale-sources": """SELECT kind, id, status, detail FROM (
        SELECT 0 AS part, 'source' AS kind, source_id AS id, status, role AS detail FROM {sources} WHERE status IN ('stale', 'missing', 'error', 'optional_unavailable')
        UNION ALL SELECT 1, 'conflict', conflict_id, severity, detail FROM {conflicts} WHERE conflict_type IN ('source_stale', 'source_missing')) ORDER BY part, id""",
    "claim-lineage": """SELECT kind, id, type, detail FROM (
        SELECT 0 AS part, 'entity' AS kind, entity_id AS id, entity_type AS type, value AS detail FROM {entities} WHERE entity_type = 'claim_id'
        UNION ALL SELECT 1, 'edge', edge_id, edge_type, source_id FROM {edges} LEFT SEMI JOIN (SELECT entity_id AS c FROM {entities} WHERE entity_type = 'claim_id') ON from_entity = c) ORDER BY part, id""",
    "surface-splits": """SELECT kind, id, type, detail FROM (
        SELECT 0 AS part, 'entity' AS kind, entity_id AS id, entity_type AS type, value AS detail FROM {entities} WHERE entity_type = 'surface_id' OR translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%surface%'
        UNION ALL SELECT 1, 'conflict', conflict_id, conflict_type, detail FROM {conflicts} WHERE conflict_type LIKE '%surface%') ORDER BY part, id""",
    "code-to-authority": "SELECT entity_id, entity_type, value FROM {entities} WHERE entity_type IN ('path', 'symbol_fqn') ORDER BY entity_type, value",
}


def sql_preset(spark: SparkSession, g: Graph, name: str, limit: int | None = 50, search: str = "", index: DataFrame | None = None) -> DataFrame:
    """A preset over the read model. `operator-projection` and `search` look into the search index, the stored one if it is
    given. Rows are put in order only to be cut: without a limit they come in any order."""
    if name in ("operator-projection", "search"):
        low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        found = tx.has_any(low, ["operator", "dashboard", "governance"]) if name == "operator-projection" else tx.ascii_like(F.col("text"), f"%{search}%")
        out = (search_index(g) if index is None else index).filter(found).select("kind", F.col("row_id").alias("id"), "text")
        out = out if limit is None else out.orderBy("kind", "id")
    elif name in SQL_PRESETS:
        text = SQL_PRESETS[name] if limit is not None else SQL_PRESETS[name].rpartition(" ORDER BY ")[0]
        out = spark.sql(text, **{name: getattr(g, name) for name in ("sources", "entities", "edges", "conflicts") if f"{{{name}}}" in text})
    else:
        raise ValueError(f"no such preset: {name}")
    return out if limit is None else out.limit(max(1, limit))


def public(rows: DataFrame) -> DataFrame:
    """Rows that may leave: no identity columns, no id of a source, no detail of an edge, and no identity in JSON texts."""
    kind = F.col("kind") if "kind" in rows.columns else F.lit("")
    out = rows.drop(*tx.IDENTITY_KEYS)
    cols = []
    for c, t in out.dtypes:
        x = tx.public_json(F.col(c)) if t == "string" and c in ("text", "detail", "metadata") else F.col(c)
        if c == "id":
            x = F.when(kind != "source", x)
        if c == "detail":
            x = F.when(kind != "edge", x)
        cols.append(x.alias(c))
    return out.select(*cols)
