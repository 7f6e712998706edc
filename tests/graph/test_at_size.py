"""What keeps graph queries within memory and time on large tables, against plain forms of the same."""

import os
import random

from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.operators import automaton, graph, pack, project, resolve
from sparkweave.plans import queries, testbed
from sparkweave.sources import read_model, shared

SF = "/root/testdata/sf0.001"


def _written(spark):
    at = os.path.join(shared.folder(spark).removeprefix("file:"), "sparkweave")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_relations_are_written_when_they_are_read_and_once(spark):
    g, before = read_model.WhenRead(testbed.build(spark, SF)), _written(spark)
    assert g.sources.count() == 5
    assert [x.split("-")[0] for x in _written(spark) - before] == ["sources"]
    assert g.edges.count() == g.edges.count() == testbed.build(spark, SF).edges.count()
    assert sorted(x.split("-")[0] for x in _written(spark) - before) == ["edges", "sources"]


def test_a_search_writes_no_index(spark):
    before = _written(spark)
    queries.queries()["sql_search"](spark, SF).collect()
    assert {x.split("-")[0] for x in _written(spark) - before} <= {"sources", "entities", "edges", "conflicts"}


def test_needles_are_no_patterns(spark):
    needles = ["a.c", "(x", "[", "\\E", "\\", "q|r", "$", " two words", "é"]
    texts = [*needles, "abc", "x", "q", "r", "nothing", "", "-- (x --", "two  words"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t for r in rows.filter(tx.has_any(F.col("t"), needles)).collect()}
    assert got == {t for t in texts if any(n in t for n in needles)}
    assert rows.filter(tx.has_any(F.col("t"), [])).count() == 0


def test_rows_without_a_match_stay_out_of_python(spark):
    df = spark.createDataFrame([(f"r{i}", t, "") for i, t in enumerate(["one a.c", "axc", "b (x", "", "nothing"])], "id string, text string, extra string")
    few = automaton.best_rows(df, ["a.c", "(x"], 5)
    assert sorted((r.target_no, r.id) for r in resolve._best(few, 5).collect()) == [(0, "r0"), (1, "r2")]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan[plan.index("MapInArrow") :]


def test_facts_of_a_payload_come_in_pieces(spark, monkeypatch):
    claims = ", ".join(f'{{"claim_id": "c{i}", "supporting_artifacts": ["a{i % 3}"]}}' for i in range(50))
    rows = spark.createDataFrame([(i, f"s{i}", "claim", "loaded", "p", f'{{"claims": [{claims}]}}') for i in range(3)], "ordinal long, source_id string, role string, status string, path string, raw string").coalesce(1)
    shown = lambda: [sorted(map(str, df.collect())) for df in (project.facts(rows), *project.build(rows))]
    whole = shown()
    monkeypatch.setattr(project, "HELD", 7)
    assert shown() == whole and len(whole[0]) > 300


def test_a_fold_over_what_tasks_hand_on_is_one_over_all_rows(spark):
    rng = random.Random(5)
    for budget, most in ((60, 4), (200, 12), (900, 30)):
        rows = [(rng.choice(["edge", "entity"]), f"k{rng.randrange(40)}", rng.randrange(8), rng.randrange(1, 25), f"row {rng.randrange(10**6)}") for _ in range(1500)]
        df = spark.createDataFrame([(k, i, s, t, r, None, None) for k, i, s, t, r in rows], "kind string, id string, score long, estimated_tokens long, row string, a string, b string").repartition(3)
        keys, used, want = set(), 7, []
        for k, i, s, t, r in sorted(rows, key=lambda x: (-x[2], x[3], x[0], x[1], x[4])):
            if len(want) < most and used + t <= budget and (k, i) not in keys:
                keys.add((k, i))
                used += t
                want.append((k, i, s, t, r))
        handed = pack.firsts(df, budget - 7, most).cache()
        assert handed.count() <= 3 * 24 * most and handed.count() < len(rows)
        fold = pack.Fold(budget, most, 7)
        fold.over(handed)
        assert [(x["kind"], x["id"], -x["less"], x["estimated_tokens"], x["row"]) for x in fold.chosen] == want
    assert pack.firsts(df.limit(0), 50, 3).count() == 0


def test_needles_are_not_built_on_the_driver(spark):
    g = testbed.graph(spark, SF)
    hits = graph.conflict_hits(g)
    hits.foreach(lambda r: None)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
