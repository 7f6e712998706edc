import __spark_entry__ as entry


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0].score >= rows[-1].score


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
