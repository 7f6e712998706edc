"""Any number of targets by joins: the same best rows as one by one, and each relation read as often for many as for few."""

import random

import pytest
import test_targets
from pyspark.sql import functions as F

from sparkweave.operators import many, resolve
from sparkweave.operators.model import Graph
from sparkweave.plans import testbed


@pytest.mark.parametrize("most", [2, 6, 1000])
def test_best_rows_by_joins(spark, monkeypatch, most):
    rng = random.Random(5)
    rows = test_targets.made(rng, 700)
    targets = [*test_targets.TARGETS, "customer/1", "customer/12", "权", "A", "beta gamma"]
    monkeypatch.setattr(test_targets, "TARGETS", targets)
    for r, w in zip(rows, ["customer/123 is here", "xcustomer/1", "a", "Beta Gamma", "权威 a"] * 9, strict=False):
        r["text"] = w
    gains = {(f"k{k}", t) for k in range(0, 9, 2) for t in range(0, len(targets), 3)}
    df = spark.createDataFrame(rows, "id string, text string, extra string, keys array<string>, base int").repartition(3)
    given = spark.createDataFrame(sorted(gains), "key string, target_no bigint")
    of_word = many.words_of(spark.createDataFrame(list(enumerate(targets)), "target_no bigint, target string"))
    words = of_word.select("word").distinct()
    hits = many.found(df.drop("keys"), words, many.beginnings(words, most))
    scored = many.scores(hits, of_word)

    def got(*more):
        out = {n: [] for n in range(len(targets))}
        for r in many.best_rows(df, hits, scored, 6, *more).orderBy("target_no", F.desc("score"), "id").collect():
            out[r.target_no].append((r.id, r.score, r.extra))
        return out

    assert got() == test_targets.plain_best(rows, 6)
    assert got(given) == test_targets.plain_best(rows, 6, gains)


def test_relations_are_read_as_often_for_many_targets_as_for_few(spark):
    made = testbed.graph(spark, "/root/testdata/sf0.001")
    reads = []

    class Counted(Graph):
        def __init__(self):
            pass

        def __getattribute__(self, name):
            if name in ("entities", "edges", "sources", "conflicts"):
                reads.append(name)
            return getattr(made, name)

    def read(n):
        reads.clear()
        assert resolve.adjudicate_all(Counted(), spark.range(n).select(F.concat(F.lit("customer/"), "id")), at_once=2).count() == n
        return sorted(reads)

    assert read(9) == read(2)
