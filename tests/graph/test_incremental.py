"""A read model kept up to date, and keys of stored tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkweave.operators import assess, graph, project
from sparkweave.operators.model import Graph
from sparkweave.plans import testbed
from sparkweave.sources import incremental, keys, read_model

FIELDS = "ordinal long, source_id string, role string, status string, path string, raw string"


def sources(spark, **raw):
    return spark.createDataFrame([(n, k, "r", "loaded", f"{k}.json", v) for n, (k, v) in enumerate(raw.items())], FIELDS)


def claims(*ids, label="l"):
    return '{"claims": [' + ", ".join(f'{{"claim_id": "{i}", "label": "{label}", "verifiers": ["v"]}}' for i in ids) + "]}"


def same(spark, folder, rows):
    """The folder equals a full build of the rows."""
    entities, edges, conflicts = project.build(rows)
    plain = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert plain(incremental.entities(spark, folder)) == plain(entities)
    assert plain(incremental.edges(spark, folder)) == plain(edges)
    assert plain(incremental.conflicts(spark, folder)) == plain(conflicts)
    assert plain(incremental.degrees(spark, folder)) == plain(graph.degrees(edges))


def parts(folder):
    return {(p.parts[-3], p.parts[-2], p.name) for p in Path(folder).rglob("*.parquet")}


def test_updates_equal_full_builds(spark, tmp_path):
    at = str(tmp_path / "m")
    first = sources(spark, a=claims("1", "2"), b=claims("2", label="other"), c=claims("3"), **{"007": claims("7")})
    assert {r.change for r in incremental.update(first, at).collect()} == {"new"}
    same(spark, at, first)
    before = parts(at)
    # a names another claim, b has no rows of its own any more, c goes, d comes; 007 only moves in the order
    then = sources(spark, d=claims("2", label="mine"), a=claims("1", "9"), b="not json", **{"007": claims("7")})
    found = {r.source_id: r.change for r in incremental.update(then, at).collect()}
    assert found == {"a": "changed", "b": "changed", "c": "removed", "d": "new", "007": "unchanged"}
    same(spark, at, then)
    kept = {x for x in before if x[1] == "source_id=007" and x[0] != "marks"}
    assert kept and kept <= parts(at)  # an unchanged source's files are the same ones
    assert {r.change for r in incremental.update(then, at).collect()} == {"unchanged"}
    none = then.limit(0)
    assert {r.change for r in incremental.update(none, at).collect()} == {"removed"}
    same(spark, at, none)


def test_an_update_that_died_is_done_again(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "m")
    first, then = sources(spark, a=claims("1"), b=claims("2"), c=claims("3")), sources(spark, a=claims("4"), b=claims("2"), d=claims("5"))
    incremental.update(first, at)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental, "_degrees", dies)
        with pytest.raises(RuntimeError):
            incremental.update(then, at)
    last = sources(spark, b=claims("2"), a=claims("4"))  # d, which the dead update had begun to write, is gone again
    found = {r.source_id: r.change for r in incremental.update(last, at).collect()}
    assert found == {"a": "changed", "b": "unchanged", "c": "removed", "d": "removed"}
    same(spark, at, last)


def test_sources_need_ids(spark, tmp_path):
    rows = sources(spark, a=claims("1"))
    with pytest.raises(keys.RepeatedKey, match="sources: source_id repeats: a .2 rows"):
        incremental.update(rows.union(rows), str(tmp_path / "m"))
    for bad in ("", None):
        with pytest.raises(keys.RepeatedKey, match="sources: a row has no source_id"):
            incremental.update(rows.withColumn("source_id", F.lit(bad).cast("string")), str(tmp_path / "n"))


def test_many_ids_are_met_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "BROADCAST_IDS", 0)
    rows = sources(spark, a=claims("1"), b=claims("1", "2"))
    incremental.update(rows, str(tmp_path / "m"))
    same(spark, str(tmp_path / "m"), rows)


def test_repeated_keys(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k")).union(spark.createDataFrame([("7",), ("7",), ("x",)], "k string"))
    assert [tuple(r) for r in keys.repeated(rows, "k").collect()] == [("7", 3)]
    assert keys.repeated(rows.limit(0), "k").count() == 0
    keys.check(spark.range(10), "id", "t")


def test_a_read_model_with_a_repeated_entity_is_refused(spark, tmp_path):
    g = testbed.graph(spark, "/root/testdata/sf0.001")
    said = read_model.write(g, str(tmp_path), fusion=False)
    assert said == {r.metric: r.value for r in assess.summary(g).collect()}  # counted in the writing passes
    one = g.entities.limit(1)
    twice = Graph(g.sources, g.entities.union(one), g.edges, g.conflicts)
    with pytest.raises(keys.RepeatedKey, match=f"entities: entity_id repeats: {one.first().entity_id} .2 rows"):
        read_model.write(twice, str(tmp_path), fusion=False)
    with pytest.raises(FileNotFoundError, match="search_index"):
        read_model.read(spark, str(tmp_path))
