"""Trusted ids beyond the bound never reach the driver."""

from sparkweave.llm import quality


def test_more_trusted_ids_than_the_bound_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} end") for i in range(600)], "_id long, _text string")
    trusted = spark.createDataFrame([(i,) for i in range(1, 600, 2)], "_id long")
    joined = quality.flagged(rows, trusted, 100)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, quality.flagged(rows, trusted, 1000).collect()))
    joined.foreach(lambda r: None)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert quality.MAX_BROADCAST <= 100_000


def test_few_trusted_ids_are_joined_like_many(spark):
    """So that what is shuffled grows with the texts alone, and not by a leap at some number of ids."""
    rows = spark.createDataFrame([(i, f"w{i % 7} end") for i in range(60)] + [(None, "none"), (3, "again")], "_id long, _text string")
    trusted = spark.createDataFrame([(3,), (3,), (5,), (None,), (1000,)], "_id long")
    joined = quality.flagged(rows, trusted)
    assert sorted((r._in, r._text) for r in joined.collect()) == sorted([(int(i in (3, 5)), f"w{i % 7} end") for i in range(60)] + [(0, "none"), (1, "again")])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
