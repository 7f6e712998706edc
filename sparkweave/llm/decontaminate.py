"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage.

The index is block-max: postings are in item order and cut into blocks, and each block of a term's postings knows its
largest impact. Impacts are divided by the item's score for its own text, so one threshold means the same share of any
item. A passage is a pair of neighbouring chunks of words. Whole batches of passages are first held against the block
maxima (an upper bound of what any item of a block can score); only passages and blocks whose bound reaches the
threshold are walked document at a time with WAND pivots, and what they retrieve is verified on the words themselves.

An index is a dict of plain values, so executors need nothing but this module's pickled functions to read it.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

K1, B = 0.9, 0.4
#: Items of a block, and UTF-8 bytes of the item texts that one broadcast index holds (each word makes a posting of 12
#: bytes and a block entry of 8 at most): larger benchmarks are indexed in shards, of which one pass over the documents searches AT_ONCE.
BLOCK_ITEMS, SHARD_BYTES, AT_ONCE = 8, 8 << 20, 4
#: Bounds (passage and block) that are held at once.
BOUNDS = 4_000_000
ANSWER = re.compile(r"(?:^|\n)\s*(?:answer|a)\s*[:.]\s*", re.I)


def split_item(words: list[str], text: str) -> tuple[list[str], list[str]]:
    """Question and answer: at a line that begins with "Answer:", else the last quarter of the words is the answer."""
    if m := ANSWER.search(text):
        question, answer = text[: m.start()].lower().split(), text[m.end() :].lower().split()
        if question and answer:
            return question, answer
    cut = max(1, len(words) - max(1, len(words) // 4))
    return words[:cut], words[cut:] or words


def index_of(rows: list[tuple], corpus: tuple[int, int, int] | None = None, df: dict[str, int] | None = None) -> dict:
    """The index of rows (id, text): ids and texts of items, `terms` from word to number, postings of term t at
    first[t]:first[t + 1] of items and impacts, its blocks at bfirst[t]:bfirst[t + 1] of blocks and tops.

    corpus: items, words, and words of the longest item of the whole benchmark, and df: how many of its items have each
    word. By default the rows are all of it.
    """
    rows = sorted(((i, t) for i, t in rows if t and t.split()), key=lambda r: str(r[0]))
    words = [t.lower().split() for _, t in rows]
    if df is None:
        df = {}
        for w in words:
            for x in set(w):
                df[x] = df.get(x, 0) + 1
    n, total, longest = corpus or (len(words), sum(map(len, words)), max(map(len, words), default=1))
    mean = total / max(1, n)
    terms = {x: i for i, x in enumerate(sorted({x for w in words for x in w}))}
    idf = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) for x in terms}
    term, item, impact = [], [], []
    for i, w in enumerate(words):
        count: dict[str, int] = {}
        for x in w:
            count[x] = count.get(x, 0) + 1
        own = {x: idf[x] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)) for x, tf in count.items()}
        whole = sum(own.values())
        for x, v in own.items():
            term.append(terms[x])
            item.append(i)
            impact.append(v / whole)
    term, item, impact = np.array(term, np.int64), np.array(item, np.int32), np.array(impact, np.float64)
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    key = term * (len(words) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS
    at = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.zeros(0, np.int64)
    tops = np.maximum.reduceat(impact, at) if len(at) else impact
    numbers = np.arange(len(terms) + 1)
    return {
        "ids": [i for i, _ in rows], "texts": [t for _, t in rows], "terms": terms, "first": np.searchsorted(term, numbers), "items": item, "impacts": impact,
        "bfirst": np.searchsorted(term[at], numbers), "blocks": item[at] // BLOCK_ITEMS, "tops": np.nextafter(tops.astype(np.float32), np.float32(9)), "chunk": longest, "n_blocks": -(-len(words) // BLOCK_ITEMS),
    }


def bounds(index: dict, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
    """[row, block]: the sum of the block maxima of each row's terms."""
    a, n = index["bfirst"][term], index["bfirst"][term + 1] - index["bfirst"][term]
    at = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
    key = np.repeat(row, n) * index["n_blocks"] + index["blocks"][at]
    return np.bincount(key, index["tops"][at], rows * index["n_blocks"]).reshape(rows, index["n_blocks"])


def retrieve(index: dict, query: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Block-max WAND: every item of these blocks whose score for the distinct terms is the threshold or more."""
    out, first, items, impacts = [], index["first"], index["items"], index["impacts"]
    for block in blocks:
        low, high = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS
        cursors = []  # item, end, position, block maximum
        for t in query:
            c, d = index["bfirst"][t], index["bfirst"][t + 1]
            k = c + np.searchsorted(index["blocks"][c:d], block)
            if k < d and index["blocks"][k] == block:
                a, b = first[t], first[t + 1]
                p, e = a + np.searchsorted(items[a:b], low), a + np.searchsorted(items[a:b], high)
                cursors.append([int(items[p]), int(e), int(p), float(index["tops"][k])])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= threshold:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(float(impacts[c[2]]) for c in cursors if c[0] == pivot)
                if score >= threshold:
                    out.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            for c in cursors:
                while c[2] < c[1] and items[c[2]] < goal:
                    c[2] += 1
                c[0] = int(items[c[2]]) if c[2] < c[1] else -1
            cursors = [c for c in cursors if c[0] >= 0]
    return out


def overlap(part: list[str], passage: list[str], n: int = 2) -> float:
    """Share of the part's n-grams of words that the passage has."""
    n = min(n, len(part))
    grams = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return sum(g in have for g in grams) / len(grams) if grams else 0.0


def hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question_overlap: float = 0.5, answer_overlap: float = 0.35, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document id and item that it leaks: id, item_id, the best passage's score (share of the item's own
    BM25 score), question_overlap and answer_overlap (shares of word pairs that a passage has).

    Words are runs without white space, in lower case. A chunk is as long as the benchmark's longest item, so that any
    item lies within some passage whole. Scores don't depend on shards: document frequencies, lengths and chunks are
    the whole benchmark's. Items and texts that are null, empty or without words, and rows with a null id,
    leak nothing; rows that share an id are one document; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = common.keyed(docs, id_col, text_col).filter("_id is not null and _text is not null")
    items = benchmark.select(F.col(common.quoted(item_col)).alias("_item"), F.col(common.quoted(item_text)).cast("string").alias("_text")).filter("_item is not null and _text is not null")
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = -(-int(size) // SHARD_BYTES) or 1
    id_type, item_type = rows.schema["_id"].dataType.simpleString(), items.schema["_item"].dataType.simpleString()
    corpus = dfs = out = None
    if shards > 1:
        corpus, dfs = _statistics(items)
    kind = to_arrow_type(items.schema["_item"].dataType)
    searchers = []
    for shard in range(shards):  # one for any benchmark of up to SHARD_BYTES
        part = items if shards == 1 else items.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(shards)) == shard)
        texts = [tuple(r) for r in part.collect()]
        index = index_of(texts, corpus, dfs and _frequencies(dfs, texts)) | {"type": kind}
        searchers.append(_searcher(spark.sparkContext.broadcast(index), threshold, question_overlap, answer_overlap))
    for lo in range(0, shards, AT_ONCE):
        found = common.per_batch(rows, _each(searchers[lo : lo + AT_ONCE]), f"_id {id_type}, _item {item_type}, _score double, _q double, _a double")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("_id", "_item").agg(F.max("_score").alias("score"), F.max("_q").alias("question_overlap"), F.max("_a").alias("answer_overlap"))
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "score", "question_overlap", "answer_overlap")


def _statistics(items: DataFrame) -> tuple[tuple[int, int, int], DataFrame]:
    """(items, words, words of the longest item), and a table of how many items have each word."""

    def count(batches):
        for batch in batches:
            words = [t.lower().split() for t in batch.column(0).to_pylist()]
            for w in filter(None, words):
                own = sorted(set(w))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([len(w)] + [None] * (len(own) - 1), pa.int64())], ["word", "n"])

    seen = common.written(common.per_batch(items.select("_text"), count, "word string, n bigint"), "benchmark-words")
    n, total, longest = seen.agg(F.count("n"), F.sum("n"), F.max("n")).first()
    return (n, total or 0, longest or 1), common.checkpointed(seen.groupBy("word").agg(F.count("*").alias("df")))


def _frequencies(dfs: DataFrame, texts: list[tuple]) -> dict[str, int]:
    """df of a shard's own words: no more than the shard has."""
    own = dfs.sparkSession.createDataFrame([(x,) for x in sorted({x for _, t in texts for x in t.lower().split()})], "word string")
    return {r.word: r.df for r in dfs.join(own, "word").collect()}


def _each(searchers: list):
    """Every searcher over each batch: the corpus is read once for all of them."""
    if len(searchers) == 1:
        return searchers[0]

    def search(batches):
        for batch in batches:
            for one in searchers:
                yield from one([batch])

    return search


def _searcher(held, threshold: float, least_q: float, least_a: float):
    def search(batches):
        index = held.value
        number, none, size_of = index["terms"], len(index["terms"]), index["chunk"]
        parts: dict[int, tuple] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            out, at = [], 0
            while at < len(texts) and none:
                terms, chunk_of, doc_of, n_chunks, size = [], [], [], 0, 0
                while at < len(texts) and size < common.FLAT_WORDS:
                    w = texts[at].lower().split()
                    if w:
                        chunks = np.arange(len(w)) // size_of
                        terms.append(np.fromiter(map(number.get, w, repeat(none)), np.int64, len(w)))
                        chunk_of.append(chunks + n_chunks)
                        doc_of += [at] * (int(chunks[-1]) + 1)
                        n_chunks += int(chunks[-1]) + 1
                    size, at = size + len(w), at + 1
                if not n_chunks:
                    continue
                terms, chunk_of, doc_of = np.concatenate(terms), np.concatenate(chunk_of), np.array(doc_of)
                known = terms < none
                pair = np.unique(chunk_of[known] * none + terms[known])  # distinct terms of each chunk
                chunk, term = pair // none, pair % none
                firsts = np.searchsorted(chunk, np.arange(n_chunks + 1))
                joined = np.append(doc_of[1:] == doc_of[:-1], False)
                step = max(2, BOUNDS // index["n_blocks"])
                for lo in range(0, n_chunks, step - 1):  # by runs of chunks that share one, to bound memory
                    hi = min(n_chunks, lo + step)
                    own = slice(firsts[lo], firsts[hi])
                    bound = bounds(index, chunk[own] - lo, term[own], hi - lo)
                    last = hi if hi == n_chunks else hi - 1
                    passage = bound[: last - lo].copy()
                    more = np.nonzero(joined[lo:last])[0]
                    passage[more] += bound[more + 1]
                    for c in lo + np.nonzero(passage.max(axis=1) >= threshold)[0]:
                        query = np.unique(term[firsts[c] : firsts[c + 2] if joined[c] else firsts[c + 1]])
                        exact = bounds(index, np.zeros(len(query), np.int64), query, 1)[0]
                        found = retrieve(index, query, np.nonzero(exact >= threshold)[0], threshold)
                        if found:
                            d = int(doc_of[c])
                            k = int(c) - int(np.searchsorted(doc_of, d))
                            words = texts[d].lower().split()[k * size_of : (k + 2) * size_of]
                            for i, score in found:
                                if i not in parts:
                                    parts[i] = split_item(index["texts"][i].lower().split(), index["texts"][i])
                                q, a = (overlap(p, words) for p in parts[i])
                                if q >= least_q and a >= least_a:
                                    out.append((d, i, min(1.0, score), q, a))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([o[0] for o in out], pa.int64())), pa.array([index["ids"][o[1]] for o in out], index["type"]), *(pa.array([o[k] for o in out], pa.float64()) for k in (2, 3, 4))], ["_id", "_item", "_score", "_q", "_a"])

    return search


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that leak an item. Rows with a null id stay."""
    leaks = hits(docs, benchmark, id_col=id_col, **options).select(F.col(common.quoted(id_col)).alias("__sw_leak")).distinct()
    return docs.join(leaks, docs[common.quoted(id_col)] == F.col("__sw_leak"), "left_anti")
