"""Corpus preparation: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each stage's rows
as Parquet in the shared folder and reads them again, so a lost executor costs at most the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import common, decontaminate, line_dedup, near_dup, packing, quality, tokens

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them. Rows with a null id are judged like
    others, repeated rows alike; an empty table stays empty; all columns go through."""
    judged = quality.rules(docs, common.read(spark, sf_dir, "labels"), into="__sw_quality")
    return judged.filter("__sw_quality.kept").select(*common.named(*docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, with the text and length that are left. A null text becomes empty. Rows
    that share an id are one document, and a row with a null id keeps its lines; other columns go through."""
    out = line_dedup.dedup(docs, into="__sw_lines").withColumn("text", F.col("__sw_lines.kept"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*common.named(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays. Texts without words and rows with a null id
    are no duplicates and stay; rows that share an id stay or go together."""
    return near_dup.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go. Null ids and texts without words leak nothing and stay; an empty benchmark
    keeps all."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and placed in training sequences, by the columns of packing.pack. Null texts are empty, null ids
    and repeated rows are packed like others; no documents give no rows."""
    return packing.pack(docs, tokens.vocabulary(VOCABULARY))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_jaccard_join", drop_near_duplicates), ("benchmark_decontamination", decontaminated), ("packing", packed)]

#: SQL can't express the stages' hashed models and sketches; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
