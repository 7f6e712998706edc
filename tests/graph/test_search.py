"""Search by stored grams against a scan with LIKE."""

from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.operators import search
from sparkweave.sources import shared


def test_search_gives_the_rows_of_a_scan(spark):
    words = ["Alpha", "beta", "GAMMA", "x_y", "100%", "déjà", "權威證據", "a\\b", "", "ab"]
    rows = [("entity" if i % 2 else "edge", f"r{i}", f"common {words[i % 10]}-{words[i // 10 % 10]} {i}") for i in range(2000)] + [("edge", "r0", "common twin"), ("source", None, None), ("source", "s", "")]
    index = spark.createDataFrame(rows, "kind string, row_id string, text string").repartition(3)
    folder = shared.fresh(spark, "search-test")
    search.write(index, folder)
    for needle in ("alpha-gamma", "ALPHA", "a_pha", "common", "om", "", "%", "beta%77", "權威證", "déjà-x", "nowhere", "100%", "x_y-x", "a\\\\b", "twin", "beta 1011", "common Alpha"):
        want = index.filter(tx.ascii_like(F.col("text"), f"%{needle}%")).select("kind", "row_id", "text")
        got = search.find(spark, folder, needle)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect()))), needle
    assert search.candidates(spark, folder, "common") is None and search.candidates(spark, folder, "a\\\\b") is None
    assert search.candidates(spark, folder, "nowhere").count() == 0
    few = search.candidates(spark, folder, "beta 101")
    assert 0 < few.count() < 400
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan
    assert [r.id for r in search.find(spark, folder, "beta 1011").collect()] == ["r1011"]
    search.MAX_LISTED, most = 3, search.MAX_LISTED
    try:
        assert search.find(spark, folder, "alpha-gamma").count() == index.filter("lower(text) like '%alpha-gamma%'").count()
    finally:
        search.MAX_LISTED = most
    empty = shared.fresh(spark, "search-empty")
    search.write(index.limit(0), empty)
    assert search.find(spark, empty, "alpha").count() == 0
