"""Toxicity: non-negative positive-unlabelled learning of a linear classifier over hashed words."""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Confirmed toxic rows, and unlabelled rows, that are learnt from at most: those with the least hash of their id.
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
#: Buckets of hashed features, and those with weights: a model is at most this large.
BUCKETS, MAX_FEATURES = 1 << 20, 50_000
FOLDS = 5
#: Files that the sample is written to.
SAMPLE_FILES = 8
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)


def features(word: str) -> list[str]:
    """A word, and its first letters: words of one stem share them."""
    return [word, *(f"{word[:n]}+" for n in PREFIXES if len(word) > n)]


class Hashed(dict):
    """Word to the buckets of its features."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > common.CACHED_WORDS // 4:
            self.clear()
        self[word] = out = tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in features(word))
        return out


def row_of(hashed: Hashed, text: str | None) -> np.ndarray:
    """Distinct buckets of a text."""
    out: set[int] = set()
    for w in {*WORD.findall((text or "").lower())}:
        out.update(hashed[w])
    return np.fromiter(out, np.int64, len(out))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) that minimise the non-negative risk: prior * R+(positive) + max(0, R-(unlabelled) -
    prior * R-(positive)), with the logistic loss. Where the second term falls below zero, its gradient is reversed.

    A feature's values are scaled by how much more often positives have it than unlabelled rows, so that a few rows
    suffice; only features of two positives or more, that positives have more often by far, get weights.
    """
    n, m = len(positive), len(unlabelled)
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0), -4.0
    p, u = (np.bincount(np.concatenate([x for x in rows] or [np.zeros(0, np.int64)]), minlength=BUCKETS).astype(float) for rows in (positive, unlabelled))
    ratio = np.log((p + 0.5) / (n + 1)) - np.log((u + 0.5) / (m + 1))
    # positives are a share of the unlabelled rows too: a feature of positives alone has a ratio of -log(prior)
    keep = np.nonzero((p >= 2) & (ratio > 0.4 * -np.log(prior)))[0]
    keep = keep[np.argsort(-(ratio[keep] * np.sqrt(p[keep])), kind="stable")][:MAX_FEATURES]
    keep.sort()
    scale = np.maximum(ratio[keep], 0)
    number = np.full(BUCKETS, -1, np.int64)
    number[keep] = np.arange(len(keep))

    def flat(rows):
        cols = [number[x] for x in rows]
        cols = [c[c >= 0] for c in cols]
        return np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols) if cols else np.zeros(0, np.int64)

    (pr, pc), (ur, uc) = flat(positive), flat(unlabelled)
    w, b = np.zeros(len(keep)), -2.0
    mean, var, mb, vb = np.zeros(len(keep)), np.zeros(len(keep)), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp = np.bincount(pr, w[pc] * scale[pc], n) + b
        zu = np.bincount(ur, w[uc] * scale[uc], m) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1.0 if negative >= 0 else -1.0
        gp = prior * ((sigmoid(zp) - 1) * (sign > 0) - sign * sigmoid(zp)) / n
        gu = sign * sigmoid(zu) / m
        g = scale * (np.bincount(pc, gp[pr], len(keep)) + np.bincount(uc, gu[ur], len(keep))) + l2 * w
        gb = gp.sum() + gu.sum()
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w = np.maximum(0, w - rate * (mean / a) / (np.sqrt(var / c) + 1e-8))
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return keep, w * scale, float(b)


def learnable(id_col: Column) -> Column:
    """Whether a row's label may be learnt from: crc32 of the id as text, mod FOLDS, is not 0."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(FOLDS)) != 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """The classifier. Positives: rows that labels mark toxic; unlabelled: any labelled rows, their labels unseen, but for
    their share of toxic ones, which is the class prior. Held-out rows' labels take no part."""
    marks = labels.select(F.col(common.quoted(id_col)).alias("_l"), F.col("toxic").cast("int").alias("_toxic")).filter(F.col("_l").isNotNull() & F.col("_toxic").isNotNull() & learnable(F.col("_l"))).groupBy("_l").agg(F.max("_toxic").alias("_toxic"))
    prior = marks.agg(F.avg("_toxic")).first()[0] or 0.0
    order = [F.xxhash64("_l"), F.col("_l")]
    sample = marks.filter("_toxic = 1").orderBy(*order).limit(max_positive).select("_l", F.lit(True).alias("_p")).union(marks.orderBy(*order).limit(max_unlabelled).select("_l", F.lit(False).alias("_p")))
    rows = common.keyed(docs, id_col, text_col).join(F.broadcast(sample), F.col("_id") == F.col("_l")).select("_p", "_text", "_id")

    def hashed_rows(batches):
        hashed = Hashed()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [row_of(hashed, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())], ["_p", "_id", "_x"])

    made = common.per_batch(rows, hashed_rows, f"_p boolean, _id {rows.schema['_id'].dataType.simpleString()}, _x binary")
    made = common.written(made.repartition(SAMPLE_FILES), "toxicity-sample")  # so that the driver reads few files, whatever the corpus has
    positive, unlabelled = [], []
    for r in sorted(made.toLocalIterator(), key=lambda r: (r[0], str(r[1]), bytes(r[2]))):  # max_positive + max_unlabelled rows
        (positive if r[0] else unlabelled).append(np.frombuffer(r[2], "<i4").astype(np.int64))
    return fit(positive, unlabelled, min(0.9, max(1e-3, prior)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """One row per row of docs: id, held_out (its label was never learnt from), score (0 to 1), predicted (score >= 0.5).

    A null or empty text has no features and gets the bias alone. Without any toxic label all scores are low. Rows with
    a null id are scored too and count as held out if the crc32 of an empty text says so; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keep, weights, bias = train(docs, labels, id_col, text_col, **bounds)
    model = spark.sparkContext.broadcast((dict(zip(keep.tolist(), weights.tolist(), strict=True)), bias))  # MAX_FEATURES at most

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight, bias = model.value
        memo: dict[str, tuple[tuple[int, float], ...]] = {}
        hashed = Hashed()
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                hit: dict[int, float] = {}
                for w in {*WORD.findall((t or "").lower())}:
                    got = memo.get(w)
                    if got is None:
                        if len(memo) > common.CACHED_WORDS // 2:
                            memo.clear()
                        memo[w] = got = tuple((k, weight[k]) for k in hashed[w] if k in weight)
                    if got:
                        hit.update(got)
                z = bias + sum(hit[k] for k in sorted(hit))
                out.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            yield pa.array(out, pa.float64())

    rows = common.keyed(docs, id_col, text_col)
    scored = rows.select("_id", scores("_text").alias("score"))
    return scored.select(F.col("_id").alias(id_col), (~learnable(F.col("_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
