"""Incremental rebuilds: fingerprints of source files as they arrive, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON files of a folder: path, seen, sha256."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("seen"), F.sha2("content", 256).alias("sha256"))


def upsert(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Takes in what has arrived since the last call. Each batch is a Parquet folder of its own, named by its number, so a
    batch that is run again replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("path").agg(F.max_by(F.struct("seen", "sha256"), "seen").alias("x")).select("path", "x.*", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{table}/batch={number}")

    arrivals(spark, folder).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest fingerprint of each path."""
    return spark.read.parquet(table).groupBy("path").agg(F.max_by("sha256", F.struct("seen", "batch")).alias("fingerprint"))
