"""Quality rules: base statistics, and a hashed n-gram log-likelihood ratio against a trusted target.

DataFrame functions only. Counts are integers and the model's weights are whole thousandths, so a score doesn't depend
on the order in which anything is added.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, quoted

SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Buckets of hashed words and word pairs: the model's fixed size.
BUCKETS = 1 << 14
#: Trusted ids that are broadcast at most (some 70 bytes each): none, unless a caller knows its ids to be few, as a text's way
#: may not change with the number of ids. Ids are joined, with as many salts a document id, so that neither null ids nor one
#: id's many rows meet in one task. Either way all trusted rows count.
MAX_BROADCAST, SALTS = 0, 16
#: Counts that the corpus's own distribution adds to a bucket's target count on average, so that little evidence says little.
PRIOR = 10
#: A document is kept if its mean log ratio a n-gram is this or more.
THRESHOLD = -0.06


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE[1:], " " * 5), " "), "")


def buckets_of(words: Column) -> Column:
    """Bucket of each word, in the lower half, and of each pair of words that follow each other, in the upper."""
    half = BUCKETS // 2
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(half)).cast("int")
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: bucket(w, F.get(words, i + 1)) + half)
    return F.concat(F.transform(words, lambda w: bucket(w)), pairs)


def repeated(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(in_order, lambda a: F.sort_array(F.transform(F.filter(a, lambda x, p: F.coalesce(F.get(a, p - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(a, p + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), x - F.get(s, j - 1)))), F.lit(0), lambda n, x: n + x))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def flagged(rows: DataFrame, trusted: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """rows with `_in`: 1 where the id is a trusted one, otherwise 0. Null ids are in no case."""
    ids = trusted.select(F.col("_id").alias("_t")).filter("_t is not null").distinct()
    if max_broadcast and ids.limit(max_broadcast + 1).count() <= max_broadcast:
        joined = rows.join(F.broadcast(ids), F.col("_id") == F.col("_t"), "left")
    else:
        salted = ids.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # By merging: ids with salts pack so well in a shuffle that Spark would take them for small and broadcast them.
        joined = rows.join(salted.hint("merge"), (F.col("_id") == F.col("_t")) & (F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int") == F.col("_s")), "left")
    return joined.select(F.col("_t").isNotNull().cast("long").alias("_in"), "_text")


def model(rows: DataFrame, trusted: DataFrame, max_broadcast: int = MAX_BROADCAST) -> list[int]:
    """Thousandths of log(target share / corpus share) of each bucket. The corpus is every row, the target every row of a
    trusted `_id`: both counts grow with the input, and only their sums by bucket reach the driver."""
    grams = flagged(rows, trusted, max_broadcast).select("_in", F.explode(let(words_of(F.coalesce("_text", F.lit(""))), buckets_of)).alias("_bucket"))
    counts = {r[0]: (r[1], r[2]) for r in grams.groupBy("_bucket").agg(F.count("*"), F.sum("_in")).collect()}  # BUCKETS rows at most
    raw, target = (sum(c[i] for c in counts.values()) for i in (0, 1))
    share = [(counts.get(i, (0, 0))[0] + 1) / (raw + BUCKETS) for i in range(BUCKETS)]
    prior = PRIOR * BUCKETS
    return [round(1000 * math.log((counts.get(i, (0, 0))[1] + prior * p) / (target + prior) / p)) for i, p in enumerate(share)]


def rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_broadcast: int = MAX_BROADCAST, id_col: str = "doc_id", text_col: str = "text", into: str = "_quality") -> DataFrame:
    """docs with a struct column `into`: the base statistics, base_failed, llr (mean log ratio a n-gram) and kept. A column
    of that name gives way; all others, whatever their names, go through.

    Trusted are labels' rows of quality 1. A null text has no words and fails the base; so do texts of under 50 words
    and texts half of whose words or more lie in repeated windows. With no trusted row every ratio is 0 and the base
    alone decides. Null ids are scored like others; an empty table gives no rows. Each text is shuffled once to meet the
    trusted ids, and the bucket counts, summed in each task first; rows are scored in place.
    """
    weights = model(keyed(docs, id_col, text_col), labels.filter("quality = 1").select(F.col(quoted(id_col)).alias("_id")), max_broadcast)
    table = F.from_json(F.lit(json.dumps(weights, separators=(",", ":"))), "array<int>")
    text = F.coalesce(docs[quoted(text_col)].cast("string"), F.lit(""))

    def judged(words: Column) -> Column:
        n = F.size(words)
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
        grams = F.greatest(2 * n - 1, F.lit(1))
        total = F.aggregate(buckets_of(words), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
        base = F.struct(
            n.cast("long").alias("n_words"), F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), repeated(words).cast("long").alias("n_repeat_words"), (total / grams / 1000).alias("llr"),
        )

        def verdict(b: Column) -> Column:
            failed = (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
            return F.struct(*[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), b["llr"].alias("llr"), (~failed & (b["llr"] >= threshold)).alias("kept"))

        return let(base, verdict)

    return docs.select(*[docs[quoted(c)] for c in docs.columns if c != into], let(words_of(text), judged).alias(into))
