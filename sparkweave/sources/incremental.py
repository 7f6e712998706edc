"""A read model that is kept up to date: only sources whose fingerprints changed are projected and written again.

Each table has a partition for each source, and a source's rows depend on that source alone: its entities with their first
place in it, its edges, its conflicts, and the degrees of its own edges. What spans sources (an entity's sources, its label,
its degree) is a sum or a minimum over them, taken when it is read, so a change of one source never touches another's rows.

Partitions are replaced whole (dynamic partition overwrite). `marks` holds the fingerprints: those of the sources that an update
touches are set to a pending one first and to their own last. An update that dies on the way leaves pending marks, so the next
one does the same sources again, or empties those that went since, and ends in the same state. Sources are those of a manifest: a folder each, written by as many tasks as a source's rows have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import graph, project
from sparkweave.operators.model import RANK_WEIGHTS, chosen
from sparkweave.sources import keys, shared

#: Columns and the one that is null in the row that only marks a source as written.
TABLES = {
    "sightings": ("entity_id string, entity_type string, value string, label string, metadata string, ord long", "entity_id"),
    "edges": ("edge_id string, edge_type string, from_entity string, to_entity string, evidence string", "edge_id"),
    "conflicts": ("conflict_id string, conflict_type string, severity string, entity_id string, detail string", "conflict_id"),
    "degrees": ("entity_id string, degree long, weighted_degree long", "entity_id"),
    "marks": ("ordinal long, fingerprint string", "fingerprint"),
}
#: What a source's rows are made of; a change of any of them projects it again.
MADE_OF = ["role", "status", "path", "raw"]
#: The fingerprint of a source that is being written; no digest equals it.
PENDING = "pending"
#: Ids that are broadcast at most (some 100 bytes each); more are met by a shuffle.
BROADCAST_IDS = 100_000


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's rows with their source_id; of a folder without the table none."""
    columns, key = TABLES[table]
    schema = f"{columns}, source_id string"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{table}").filter(F.col(key).isNotNull())


def _replace(rows: DataFrame, touched: DataFrame, folder: str, table: str) -> None:
    """The touched sources' partitions: their rows, and one row without a key for each source, so that a source that has no
    rows (any more) is emptied too."""
    names = [c.strip().split()[0] for c in TABLES[table][0].split(",")]
    out = rows.select(*names, "source_id").unionByName(touched.select("source_id"), allowMissingColumns=True)
    out.write.partitionBy("source_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/{table}")


def _only(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "source_id", "left_semi")


def update(sources: DataFrame, folder: str) -> DataFrame:
    """Bring the folder to what sources(ordinal, source_id, role, status, path, raw) say; without a folder it is a full build.
    Returns source_id, change (new, changed, removed, unchanged). Unchanged sources are neither parsed nor written; of those
    that only moved in the order, the mark alone is written. A null, empty or repeated source_id is an error."""
    spark = sources.sparkSession
    prints = sources.select("source_id", F.col("ordinal").cast("long").alias("ordinal"), graph.fingerprint(MADE_OF).alias("fingerprint"))
    now, before = shared.checkpointed(prints), shared.checkpointed(stored(spark, folder, "marks"))
    keys.check(now, "source_id", "sources")
    found = shared.checkpointed(graph.compare_fingerprints(now, before))
    touched = found.filter("change <> 'unchanged'").select("source_id")
    n = touched.count()
    if n:
        _replace(touched.select("source_id", F.lit(0).cast("long").alias("ordinal"), F.lit(PENDING).alias("fingerprint")), touched, folder, "marks")
        facts = shared.fresh(spark, "facts")
        project.facts(_only(sources, touched, n)).write.parquet(facts)
        rows = spark.read.parquet(facts)
        once = project.sightings(rows).groupBy("source_id", "entity_id").agg(*(F.min_by(c, "ord").alias(c) for c in ("entity_type", "value", "label", "metadata")), F.min("ord").alias("ord"))
        _replace(once, touched, folder, "sightings")
        _replace(project.edges_of(rows), touched, folder, "edges")
        _replace(project.conflicts_of(rows), touched, folder, "conflicts")
        _replace(_degrees(_only(stored(spark, folder, "edges"), touched, n)), touched, folder, "degrees")
        shared.drop(spark, facts)
    moved = now.join(before, ["source_id", "ordinal", "fingerprint"], "left_anti")
    marks = moved.select("source_id").union(found.filter("change = 'removed'").select("source_id"))
    _replace(moved, marks, folder, "marks")
    return found


def _degrees(edges: DataFrame) -> DataFrame:
    """Degrees by source: each edge's two ends, summed in each task before the only shuffle."""
    weight = chosen(F.col("edge_type"), RANK_WEIGHTS, 1)
    ends = edges.select("source_id", weight.alias("w"), F.explode(F.array("from_entity", "to_entity")).alias("entity_id"))
    return ends.filter("entity_id <> ''").groupBy("source_id", "entity_id").agg(F.count("*").alias("degree"), F.sum("w").cast("long").alias("weighted_degree"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities of all sources, as a full build makes them."""
    order = stored(spark, folder, "marks").select("source_id", "ordinal")
    return project.merged(stored(spark, folder, "sightings").join(order, "source_id"))


def degrees(spark: SparkSession, folder: str) -> DataFrame:
    """entity_id, degree, weighted_degree: the sums of the sources' own."""
    return stored(spark, folder, "degrees").groupBy("entity_id").agg(F.sum("degree").alias("degree"), F.sum("weighted_degree").alias("weighted_degree"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "edges")


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "conflicts")
