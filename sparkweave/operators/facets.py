"""Facet rows beside those of the graph: remembered artifacts, commands, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.operators.model import top

# Commands that score most.
FIRST_COMMANDS = ("unify-context", "select-context", "prepare-model-input", "decide-continuation")


def row_id(*parts: Column) -> Column:
    rendered = F.concat_ws(",", *[tx.or_null(tx.quoted(p)) for p in parts])
    return F.concat(F.lit("urow:"), F.left(F.sha2(F.concat(F.lit("["), rendered, F.lit("]")), 256), F.lit(16)))


def memory(ledger: DataFrame, limit: int | None = 200) -> DataFrame:
    """Ledger rows: 140 if reusable, else 60, and the savings in per cent, rounded half to even."""
    c = F.col
    label = F.coalesce(F.nullif("task", F.lit("")), F.nullif("artifact_kind", F.lit("")), F.lit("memory"))
    score = F.when(c("reusable"), 140).otherwise(60) + F.bround(F.coalesce("estimated_token_savings_percent", F.lit(0.0)), 0).cast("long")
    out = ledger.select(row_id(F.lit("memory"), c("artifact_kind"), c("path"), c("task"), c("model_prompt_source")).alias("row_id"), F.lit("memory").alias("facet"), label.alias("label"), c("path").alias("value"), score.cast("long").alias("score"), "artifact_kind")
    return top(out, limit, F.desc("score"), F.asc("artifact_kind"), F.asc("label"), F.asc("row_id"))


def commands(rows: DataFrame, limit: int | None = 200) -> DataFrame:
    """Commands (command, intent): 120 for the ones that start work, else 85."""
    out = rows.select(row_id(F.lit("command"), F.col("command")).alias("row_id"), F.lit("command").alias("facet"), F.col("command").alias("label"), F.col("intent").alias("value"), F.when(F.col("command").isin(*FIRST_COMMANDS), 120).otherwise(85).cast("long").alias("score"))
    return top(out, limit, F.desc("score"), F.asc("label"))


def capabilities(rows: DataFrame, limit: int | None = 200) -> DataFrame:
    """Capabilities (capability_id, capability_name, integration_status): 130 if wholly native, else 90."""
    name = F.coalesce(F.nullif("capability_name", F.lit("")), F.col("capability_id"))
    out = rows.select(row_id(F.lit("capability"), F.col("capability_id")).alias("row_id"), F.lit("capability").alias("facet"), name.alias("label"), F.col("capability_id").alias("value"), F.when(F.col("integration_status") == "native_available", 130).otherwise(90).cast("long").alias("score"))
    return top(out, limit, F.desc("score"), F.asc("value"))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    """One row: for each key a map of its values' counts, its keys in order."""
    out = None
    for k in keys:
        n = rows.filter(F.coalesce(k, F.lit("")) != "").groupBy(k).agg(F.count("*").alias("n"))
        one = n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k).alias("key"), F.col("n").alias("value"))))).alias(f"{k}_counts")).withColumn("_k", F.lit(1))
        out = one if out is None else out.join(one, "_k")
    return out.drop("_k")
