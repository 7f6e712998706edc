"""The read model: a graph's relations and its search index as Parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import assess, presets
from sparkweave.operators.model import Graph
from sparkweave.sources import keys, shared

TABLES = ("sources", "entities", "edges", "conflicts", "search_index")
#: Keys of the tables that have one. Conflicts may repeat.
KEYS = {"sources": "source_id", "entities": "entity_id", "edges": "edge_id"}


def counters(table: str) -> dict[str, Column]:
    """What a build reports of a table; counted while it is written."""
    if table == "sources":
        states = {f"{s}_source_count": F.count_if(F.col("status") == s) for s in ("loaded", "stale", "missing")}
        return {"source_count": F.count("*")} | states | {"required_source_count": F.count_if(F.col("required"))}
    if table == "entities":
        return {"entity_count": F.count("*"), "claim_count": F.count_if(F.col("entity_type") == "claim_id")}
    if table == "edges":
        return {"edge_count": F.count("*")}
    return {"conflict_count": F.count("*"), "error_count": F.count_if(F.col("severity") == "error"), "warning_count": F.count_if(F.col("severity") == "warning")}


def write(graph: Graph, folder: str, fusion: bool = True) -> dict[str, int]:
    """All tables anew; entities and edges by kind, so that queries of a kind read no other. The relations are written first
    and the search index is made of what was written, so nothing is built twice. Returns the build's counters, taken in the
    writing passes. A key that is missing or repeats raises keys.RepeatedKey, which names the table; the model then has
    no search index, so `read` refuses it."""
    spark = graph.sources.sparkSession
    shared.drop(spark, f"{folder}/search_index")
    said = {}
    for name, rows, by in (("sources", graph.sources, None), ("entities", graph.entities, "entity_type"), ("edges", graph.edges, "edge_type"), ("conflicts", graph.conflicts, None)):
        seen = Observation()
        _put(rows.observe(seen, *(c.alias(k) for k, c in counters(name).items())), f"{folder}/{name}", by)
        said |= seen.get
        if name in KEYS:
            keys.check(spark.read.parquet(f"{folder}/{name}").select(KEYS[name]), KEYS[name], name)
    stored = Graph(*(spark.read.parquet(f"{folder}/{name}").select(*rows.columns) for name, rows in (("sources", graph.sources), ("entities", graph.entities), ("edges", graph.edges), ("conflicts", graph.conflicts))))
    _put(presets.search_index(stored, assess.fusion(stored) if fusion else None), f"{folder}/search_index", "kind")
    return said


class WhenRead(Graph):
    """A graph's relations as tables of plain rows, each written when it is first read; later reads are of the table.

    Rows keep the tasks that made them and no kind gets a folder of its own, so nothing is sorted for the writing, and texts
    of rows are made from the tables when they are searched."""

    def __init__(self, made: Graph) -> None:
        self._made = made

    def _table(self, name: str) -> DataFrame:
        rows = getattr(self._made, name)
        path = shared.fresh(rows.sparkSession, name)
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    sources = cached_property(lambda self: self._table("sources"))
    entities = cached_property(lambda self: self._table("entities"))
    edges = cached_property(lambda self: self._table("edges"))
    conflicts = cached_property(lambda self: self._table("conflicts"))


def _put(rows: DataFrame, path: str, by: str | None) -> None:
    """A folder for each kind; each task writes its own rows, so no kind has to fit one task."""
    (rows.write.partitionBy(by) if by else rows.write).mode("overwrite").parquet(path)


def read(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame]:
    """The graph and its search index; a missing table is an error that names it."""
    tables = {}
    for name in TABLES:
        try:
            tables[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception as e:
            raise FileNotFoundError(f"the read model lacks {name}: build it again") from e
    return Graph(*(tables[n] for n in TABLES[:4])), tables["search_index"]
