"""Digest trees: one digest whatever the partitions, and what has changed between two."""

import hashlib

from pyspark.sql import functions as F

from sparkweave.operators import audits


def test_a_tree_does_not_know_partitions(spark):
    rows = spark.range(3000).select(F.concat(F.lit("row "), F.col("id") % 700).alias("x")).union(spark.range(900).select(F.lit("hot")))
    trees = [sorted(map(tuple, audits.merkle(rows.repartition(n), F.col("x")).collect())) for n in (1, 16)]
    assert trees[0] == trees[1] and trees[0][0][3] == 3900
    leaf = lambda x: hashlib.sha256(x.encode()).hexdigest()
    one = audits.merkle(spark.createDataFrame([("a",), ("a",), (None,)], "x string"), F.col("x"), 0).collect()
    said = "\n".join(sorted([f"{leaf('a')}:2", f"{leaf('null')}:1"]))
    assert [tuple(r) for r in one] == [(0, "", leaf(said), 3)]
    assert audits.merkle(rows.limit(0), F.col("x")).count() == 0


def test_changes_are_found(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("x"))
    changed = rows.filter("x <> '77'").union(spark.createDataFrame([("new",), ("88",)], "x string"))
    got = audits.merkle_changes(audits.merkle(rows, F.col("x")), audits.merkle(changed, F.col("x"))).collect()
    want = {hashlib.sha256(x.encode()).hexdigest()[:4] for x in ("77", "new", "88")}
    assert {r.prefix for r in got} == want and sum(r.rows_after - r.rows_before for r in got) == 1
