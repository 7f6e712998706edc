"""The graph's relations, and the fixed values of its scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of edges with the weights of the entity rank and of the facet index.
EDGE_KINDS = ("DECLARES", "SUPPORTS", "ADVISES", "OWNS", "DERIVES_FROM", "REFERENCES_SYMBOL", "CONFLICTS_WITH", "STALE_FOR")
RANK_WEIGHTS = {"SUPPORTS": 4, "OWNS": 3, "REFERENCES_SYMBOL": 3, "DERIVES_FROM": 2, "DECLARES": 1, "ADVISES": 1, "CONFLICTS_WITH": -3, "STALE_FOR": -2}
INDEX_WEIGHTS = {"SUPPORTS": 5, "OWNS": 4, "REFERENCES_SYMBOL": 4, "DERIVES_FROM": 3, "DECLARES": 2, "ADVISES": 1, "CONFLICTS_WITH": -4, "STALE_FOR": -3}
# Base scores of edges in a context pack (others 40), facets of entity types (others "entity").
PACK_EDGE_SCORES = {"SUPPORTS": 75, "OWNS": 70, "REFERENCES_SYMBOL": 65, "DERIVES_FROM": 55, "CONFLICTS_WITH": 60, "STALE_FOR": 55}
FACETS = {"surface_id": "surface", "symbol_fqn": "symbol", "claim_id": "claim", "path": "path", "artifact_id": "artifact", "contract_id": "contract", "task_id": "task", "thread_id": "thread", "commit_sha": "commit"}
FACET_ORDER = ("conflict", "claim", "surface", "symbol", "path", "memory", "command", "capability", "artifact", "contract", "task", "entity")


@dataclass
class Graph:
    """sources(source_id, role, status, required, path, verifier, authority_effect, no_apply, head_commit, stale_for, quality_score,
    quality_reasons), entities(entity_id, entity_type, value, label, source_ids, metadata), edges(edge_id, edge_type,
    from_entity, to_entity, source_id, evidence), conflicts(conflict_id, conflict_type, severity, source_id, entity_id,
    detail). metadata and detail are JSON texts."""

    sources: DataFrame
    entities: DataFrame
    edges: DataFrame
    conflicts: DataFrame


def chosen(column: Column, table: dict, other) -> Column:
    """table[column], or other."""
    out = F
    for k, v in table.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(other))


def score_or(score: Column, other: int) -> Column:
    """A score of zero or null counts as `other`."""
    return F.coalesce(F.nullif(score, F.lit(0)), F.lit(other))


def top(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first rows in an order, at least one; without a limit all of them."""
    return df if limit is None else df.orderBy(*order).limit(max(1, limit))
