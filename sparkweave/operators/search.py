"""Substring search by a stored index of three-character grams.

Of each text the grams that aren't common are stored as postings, in buckets by gram and in order of gram; so a search
reads the counts of its own grams, the postings of the rarest few, and of the texts the row groups that hold their rows.
Every row found is tested against the whole pattern: the rows are those of a scan with LIKE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import text as tx

GRAM, BUCKETS = 3, 64
TEXTS, COUNTS, POSTINGS = "kind string, row_id string, text string, row_key bigint", "gram string, n bigint, stored boolean", "gram string, row_key bigint, bucket int"
#: A gram in more rows than this share of all (and than the least number) narrows little and isn't stored.
COMMON_SHARE, COMMON_LEAST = 0.02, 200
#: Postings of so many grams are met; keys that are looked up as a list, and joined beyond.
RAREST, MAX_LISTED = 4, 2_000


def lower_ascii(text: F.Column) -> F.Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bucket(gram: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write(index: DataFrame, folder: str) -> None:
    """Tables of an index (kind, row_id, text): texts in order of key, counts of all grams, postings of those that aren't
    common. A key is a hash of kind and id; two rows that share one are told apart by the test of their texts."""
    spark = index.sparkSession
    keyed = index.select("kind", "row_id", "text", F.xxhash64("kind", "row_id").alias("row_key"))
    keyed.repartitionByRange("row_key").sortWithinPartitions("row_key").write.mode("overwrite").parquet(f"{folder}/texts")
    texts = spark.read.schema(TEXTS).parquet(f"{folder}/texts")
    low = lower_ascii(F.col("text"))
    starts = F.sequence(F.lit(1), F.length("low") - (GRAM - 1))
    grams = F.when(F.length("low") >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substr("low", i, F.lit(GRAM)))))
    each = texts.select("row_key", low.alias("low")).select("row_key", F.explode(grams).alias("gram"))
    common = max(COMMON_LEAST, int(COMMON_SHARE * texts.count()))
    counted = each.groupBy("gram").agg(F.count("*").alias("n")).select("gram", "n", (F.col("n") <= common).alias("stored"))
    counted.write.mode("overwrite").parquet(f"{folder}/counts")
    rare = spark.read.schema(COUNTS).parquet(f"{folder}/counts").filter("stored").select("gram")
    postings = each.join(rare, "gram").select("gram", "row_key", _bucket(F.col("gram")).alias("bucket"))
    postings.repartitionByRange("bucket", "gram", "row_key").sortWithinPartitions("bucket", "gram", "row_key").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")


def grams_of(needle: str) -> list[str]:
    """Grams that each text which is LIKE %needle% has. An escaped pattern gives none."""
    if "\\" in needle:
        return []
    low = re.sub("[A-Z]", lambda m: m[0].lower(), needle)
    return sorted({run[i : i + GRAM] for run in re.split("[%_]", low) for i in range(len(run) - GRAM + 1)})


def candidates(spark: SparkSession, folder: str, needle: str) -> DataFrame | None:
    """Keys (row_key) of all rows that can match; None if every row can."""
    grams = grams_of(needle)
    if not grams:
        return None
    known = {r.gram: r for r in spark.read.schema(COUNTS).parquet(f"{folder}/counts").filter(F.col("gram").isin(grams)).collect()}
    postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    if len(known) < len(grams):  # a gram that no text has
        return postings.select("row_key").limit(0)
    stored = sorted((r.n, g) for g, r in known.items() if r.stored)[:RAREST]
    if not stored:
        return None
    wanted = [g for _, g in stored]
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"))).collect()]
    found = postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    return found.groupBy("row_key").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select("row_key")


def find(spark: SparkSession, folder: str, needle: str) -> DataFrame:
    """(kind, id, text) of the rows whose text is LIKE %needle%, by any case of ASCII letters."""
    texts = spark.read.schema(TEXTS).parquet(f"{folder}/texts")
    keys = candidates(spark, folder, needle)
    if keys is not None:
        listed = [r.row_key for r in keys.limit(MAX_LISTED + 1).collect()]
        texts = texts.filter(F.col("row_key").isin(listed)) if len(listed) <= MAX_LISTED else texts.join(keys, "row_key", "left_semi")
    return texts.filter(tx.ascii_like(F.col("text"), f"%{needle}%")).select("kind", F.col("row_id").alias("id"), "text")
