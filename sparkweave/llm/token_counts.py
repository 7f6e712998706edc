"""Token counts through a digest cache: join, encode only distinct misses, append them."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"


def count(docs: DataFrame, vocabulary: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens of the whole text, over_limit (more than `limit`).

    The cache is a Parquet folder of (digest of the normalised content, digest of the tokenizer's version, count); rows
    are only ever appended. Without a path a new one is made in the shared folder. Content is normalised only as far
    as the vocabulary itself can't tell: where it drops white space, runs of spaces, tabs and line ends become one
    space. A null text counts as empty; repeated rows and null ids get a row each; an empty table gives no rows.

    Text moves once, a text at most once from each task however many copies it has, and only if its count isn't known.
    """
    spark = docs.sparkSession
    data, kind = tokens.load(vocabulary)
    version, blob = tokens.version(data, kind), spark.sparkContext.broadcast({"data": data, "kind": kind})
    cache = cache or f"{common.shared_dir(spark)}/sparkweave/token-cache-{uuid.uuid4().hex}"
    text = F.coalesce(F.col("_text"), F.lit(""))
    content = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")) if kind == "json" and tokens.drops_space(data) else text
    rows = common.keyed(docs, id_col, text_col).select("_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("_digest"), content.alias("_content"))

    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    def known() -> DataFrame:
        """What the cache holds for this tokenizer; two jobs that append the same text do no harm."""
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def once(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keep = [i for i, d in enumerate(batch.column(0).to_pylist()) if not (d in seen or seen.add(d))]
            if keep:
                yield batch.take(pa.array(keep, pa.int64()))

    def encode(batches):
        encoder, seen = tokens.encoder_of(blob.value), set()
        for batch in batches:
            at = [i for i, d in enumerate(batch.column(0).to_pylist()) if not (d in seen or seen.add(d))]
            part = batch.take(pa.array(at, pa.int64()))
            for lo, hi, _, starts in encoder.slices(part.column(1)):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array([version] * (hi - lo)), pa.array(np.diff(starts).astype(np.int64))], ["digest", "tokenizer", "n_tokens"])

    firsts = common.per_batch(rows.select(F.col("_digest").alias("digest"), F.col("_content").alias("content")), once, "digest binary, content string")
    misses = firsts.join(known(), "digest", "left_anti").repartition("digest")
    common.per_batch(misses, encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = common.checkpointed(known())  # a plain table, so that Spark splits the rows of a text with many copies
    return rows.select("_id", "n_bytes", "_digest").join(counts, F.col("_digest") == F.col("digest"), "left").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
