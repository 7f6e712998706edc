"""Any number of targets against a relation in one pass, by joins: the driver holds bounded beginnings of their words only.

Rows with the same matched words score alike for every target, so of each such set only the rows with the least ids can be
among a target's best, and of those that share a key with a target too. What is joined are sets and targets, never rows of a hub.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.operators.automaton import terms_of
from sparkweave.sources import shared

#: Lengths of beginnings that are tried: the longest of which there are few enough is used.
LENGTHS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256)


def words_of(targets: DataFrame) -> DataFrame:
    """(target_no, word, points): 20 a distinct term, 100 for the whole target. targets: target_no, target."""

    def split(batches):
        for batch in batches:
            out = [(n, w, p) for n, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) for w, p in [*((w, 20) for w in terms_of(t)), (t.lower(), 100)]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32()))], ["target_no", "word", "points"])

    return targets.select("target_no", "target").mapInArrow(split, "target_no bigint, word string, points int")


def beginnings(words: DataFrame, most: int) -> list[tuple[str, bool, list[int]]]:
    """(beginning, whether it is a word, lengths of longer words that begin with it): as long ones as give at most `most`."""
    counted = words.agg(*[F.count_distinct(F.left("word", F.lit(k))) for k in LENGTHS]).first()
    k = max((k for k, n in zip(LENGTHS, counted, strict=True) if n <= most), default=LENGTHS[0])
    size = F.length("word")
    rows = words.groupBy(F.left("word", F.lit(k)).alias("head")).agg(F.max(size <= k), F.collect_set(F.when(size > k, size)))
    return [(head, own, sorted(longer)) for head, own, longer in rows.collect()]


def found(rows: DataFrame, words: DataFrame, heads: list[tuple[str, bool, list[int]]]) -> DataFrame:
    """rows without text and with `words`, all that their texts contain, in order; only rows that have some.

    A text is searched for beginnings; what begins there and is as long as a word of that beginning is joined with the words.
    """
    columns = [c for c in rows.columns if c != "text"]
    held = rows.sparkSession.sparkContext.broadcast(heads)

    def search(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for head, own, longer in held.value:
            automaton.add_word(head, (head, own, longer))
        if held.value:
            automaton.make_automaton()
        find = automaton.iter if held.value else (lambda text: ())
        for batch in batches:
            at, sure, maybe = [], [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                known, asked = set(), set()
                for end, (head, own, longer) in find(text or ""):
                    start = end + 1 - len(head)
                    if own:
                        known.add(head)
                    asked.update(text[start : start + n] for n in longer if start + n <= len(text))
                if known or asked:
                    at.append(i)
                    sure.append(sorted(known))
                    maybe.append(sorted(asked))
            if at:
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.array(sure, pa.list_(pa.string())), pa.array(maybe, pa.list_(pa.string()))], [*columns, "_sure", "_maybe"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    marked = shared.checkpointed(rows.select(F.lower("text").alias("text"), *columns).mapInArrow(search, f"{fields}, _sure array<string>, _maybe array<string>"))
    more = marked.select("id", F.explode("_maybe").alias("word")).distinct().join(words, "word", "left_semi").groupBy(F.col("id").alias("_id")).agg(F.collect_set("word").alias("_more"))
    if not any(longer for _, _, longer in heads):
        out = marked.withColumn("_all", F.col("_sure"))
    else:  # an id may stand in several rows: a word found in one of them is looked for among what each may have
        own = F.array_intersect("_maybe", F.coalesce("_more", F.array().cast("array<string>")))
        out = marked.join(more, F.col("id") == F.col("_id"), "left").withColumn("_all", F.concat("_sure", own))
    return shared.checkpointed(out.select(*columns, F.array_sort("_all").alias("words")).filter(F.size("words") > 0))


def scores(hits: DataFrame, of_word: DataFrame) -> DataFrame:
    """(words, target_no, score) of every set of matched words and every target that has one of them."""
    sets = hits.select("words").distinct()
    each = sets.select("words", F.explode("words").alias("word")).join(of_word, "word")
    return shared.checkpointed(each.groupBy("words", "target_no").agg((F.sum("points") + F.max(F.when(F.col("points") == 20, 10).otherwise(0))).cast("long").alias("score")))


def first(df: DataFrame, limit: int, by: list[str], *order) -> DataFrame:
    """The first rows of each group. Spark cuts each task's rows to the limit before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def best_rows(rows: DataFrame, hits: DataFrame, scored: DataFrame, limit: int, gains: DataFrame | None = None) -> DataFrame:
    """(target_no, id, score, extra): the best `limit` rows of each target by score and then id; an id counts once.

    rows: id, extra, and where gains are given keys and base; hits: found() of them; scored: scores() of hits. gains:
    (key, target_no); a row with such a key gains its base for that target, and counts for it even without a match.
    A row among a target's best gains for it, or is among the best by matches alone.
    """
    least = first(hits.select("id", "extra", "words"), limit, ["words"], "id")
    sets = scored.join(least.groupBy("words").agg(F.min("id").alias("_least")), "words")
    sets = first(sets, limit, ["target_no"], F.desc("score"), "_least").select("words", "target_no", "score")
    out = sets.join(least, "words").select("target_no", "id", "score", "extra")
    if gains is not None:
        keys = gains.select("key").distinct()
        with_key = rows.select("id", "extra", "base", F.explode(F.array_distinct("keys")).alias("key")).join(keys, "key", "left_semi")
        matched = hits.select(F.col("id").alias("_id"), F.col("extra").alias("_extra"), F.col("base").alias("_base"), F.col("words")).distinct()
        same = (F.col("id") == F.col("_id")) & F.col("extra").eqNullSafe(F.col("_extra")) & (F.col("base") == F.col("_base"))
        of_key = first(with_key.join(matched, same, "left").select("key", "base", "words", "id", "extra"), limit, ["key", "base", "words"], "id")
        gained = of_key.join(gains.distinct(), "key").join(scored.withColumnsRenamed({"target_no": "_t", "words": "_w"}), (F.col("target_no") == F.col("_t")) & (F.col("words") == F.col("_w")), "left")
        out = out.union(gained.select("target_no", "id", (F.col("base") + F.coalesce("score", F.lit(0))).cast("long").alias("score"), "extra"))
    out = out.groupBy("target_no", "id").agg(F.max("score").alias("score"), F.max_by("extra", "score").alias("extra"))
    return shared.checkpointed(first(out, limit, ["target_no"], F.desc("score"), "id"))


def alike(gains: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((target_no, who), gains of those `who`): targets that match no row and gain the same keys have the same best rows, so
    the least of them stands for all; the others stand for themselves."""
    sets = gains.groupBy("target_no").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    own = scored.select("target_no").distinct().withColumn("_own", F.lit(True))
    sets = sets.join(own, "target_no", "full")
    one = sets.filter("_own is null").groupBy("keys").agg(F.min("target_no").alias("who"))
    who = sets.filter("_own").select("target_no", F.col("target_no").alias("who")).union(sets.filter("_own is null").join(one, "keys").select("target_no", "who"))
    who = shared.checkpointed(who)
    return who, gains.join(who.filter("target_no = who").select("target_no"), "target_no", "left_semi").select("key", "target_no").distinct()
