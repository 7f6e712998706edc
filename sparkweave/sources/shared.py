"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither is named, a temporary one if all runs on this
    machine; on a cluster that is an error, as executors couldn't read it."""
    sc = spark.sparkContext
    held = lambda: sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not held().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="sparkweave-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not held().isDefined():
        sc.setCheckpointDir(named)
    return (named or held().get()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once: cuts lineage and outlives executors."""
    folder(df.sparkSession)
    return df.checkpoint()


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet."""
    return f"{folder(spark)}/sparkweave/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """A table that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
