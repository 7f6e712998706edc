"""Decontamination against a plain scorer of every passage and item, in one index or in shards."""

import math
import random
import subprocess
import sys
from pathlib import Path

import pytest

from sparkweave.llm import decontaminate

WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "la le li lo lu ma me mi mo mu".split()]


def plain_hits(docs, items, threshold=0.6, least_q=0.5, least_a=0.35):
    words = {i: t.lower().split() for i, t in items if t and t.split()}
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    size = max(map(len, words.values()))
    out = {}
    for d, t in docs:
        w = t.lower().split()
        for k in range(-(-len(w) // size)):
            passage = w[k * size : (k + 2) * size]
            for i, own in words.items():
                weight = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * own.count(x) * 1.9 / (own.count(x) + 0.9 * (0.6 + 0.4 * len(own) / mean)) for x in set(own)}
                score = sum(v for x, v in weight.items() if x in passage) / sum(weight.values())
                pairs = {(passage[j], passage[j + 1]) for j in range(len(passage) - 1)}
                q, a = (sum(p in pairs for p in zip(part, part[1:])) / max(1, len(part) - 1) for part in decontaminate.split_item(own, dict(items)[i]))
                if score >= threshold - 1e-9 and q >= least_q and a >= least_a:
                    old = out.get((d, i), (0, 0, 0))
                    out[d, i] = tuple(map(max, old, (min(1.0, score), q, a)))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, text(rng.randint(12, 40))) for i in range(50)]
    docs = []
    for d in range(60):
        t = text(rng.randint(20, 300))
        for _ in range(rng.randint(0, 2)):
            leak = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(leak) // 3)):
                leak[rng.randrange(len(leak))] = rng.choice(WORDS)
            at = rng.randrange(len(t))
            t[at:at] = leak
        docs.append((d, " ".join(t)))
    return docs, [(i, " ".join(w[:8]) + " ? Answer: " + " ".join(w[8:]) if i % 3 == 0 else " ".join(w)) for i, w in items]


@pytest.mark.parametrize("shard_bytes", [decontaminate.SHARD_BYTES, 1500])
def test_hits_are_all_that_a_plain_scorer_finds(spark, monkeypatch, tables, shard_bytes):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard_bytes)
    docs, items = tables
    want = plain_hits(docs, items)
    got = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in got}
    assert len(want) > 20 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_small_runs_of_chunks_change_nothing(spark, monkeypatch, tables):
    docs, items = tables
    monkeypatch.setattr(decontaminate, "BOUNDS", 1)
    got = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain_hits(docs, items).keys()


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver alone finds the package, on its own sys.path; each operator that has Python workers must still run."""
    root = Path(__file__).resolve().parents[2]
    (tmp_path / "alone.py").write_text(f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}}).getOrCreate()
from sparkweave.llm import decontaminate, html_text, line_dedup, near_dup, packing, substring_dedup, token_counts, tokens, toxicity
text = " ".join(f"w{{i}}" for i in range(90))
docs = spark.createDataFrame([(1, text, "s"), (2, text, "s")], "doc_id long, text string, source string")
bench = spark.createDataFrame([(7, text)], "item_id long, text string")
labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
words = tokens.vocabulary("word_bpe_49k.json")
assert decontaminate.hits(docs, bench).count() == 2
assert substring_dedup.passages(docs).count() == 1 and near_dup.links(docs).count() == 2 and line_dedup.dedup(docs).count() == 2
assert token_counts.count(docs, words).count() == 2 and packing.pack(docs, words).count() >= 2
assert toxicity.score(docs, labels).count() == 2 and html_text.main_text(docs, "text").count() == 2
print("all ran")
""")
    run = subprocess.run([sys.executable, "alone.py"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all ran" in run.stdout, run.stderr[-3000:]


def test_item_ids_of_any_type(spark):
    text = "which of these words is the one that answers the question Answer: it is this one here"
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of the kind")], "doc_id long, text string")
    for kind, value in (("int", "7"), ("smallint", "7"), ("decimal(10,2)", "7.25"), ("date", "'2024-02-29'"), ("string", "'a'"), ("double", "0.5"), ("binary", "X'0102'")):
        items = spark.sql(f"SELECT cast({value} AS {kind}) AS item_id, '{text}' AS text")
        got = decontaminate.hits(docs, items)
        assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
        assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1, items.first().item_id)]
