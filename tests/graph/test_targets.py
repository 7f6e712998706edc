"""Matching of many targets in one pass against a plain loop over rows and targets."""

import random

from pyspark.sql import functions as F

from sparkweave.operators import automaton, resolve
from sparkweave.plans import testbed

TARGETS = ["alpha beta", "ALPHA", "beta/gamma", "gam", "of", "the alpha", "delta:1", "delta:12", "權威", "unheard"]


def plain_score(text, target):
    terms = automaton.terms_of(target)
    hits = sum(t in text.lower() for t in terms)
    return 20 * hits + 100 * (target.lower() in text.lower()) + 10 * (hits > 0)


def plain_best(rows, limit, gains=None):
    out = {}
    for n, target in enumerate(TARGETS):
        scored = []
        for r in rows:
            own = gains is not None and any((k, n) in gains for k in r["keys"])
            s = plain_score(r["text"], target)
            if s or own:
                scored.append((-(s + r["base"] * own), r["id"], r["extra"]))
        out[n] = [(i, -s, e) for s, i, e in sorted(scored)[:limit]]
    return out


def made(rng, n):
    words = ["alpha", "Beta", "beta/gamma", "gamma", "delta:1", "delta:12", "權威", "the", "of", "alpha beta", "zeta"]
    return [{"id": f"r{rng.randrange(10**6)}-{i}", "text": " ".join(rng.choices(words, k=rng.randint(0, 3))), "extra": f"e{i % 3}", "keys": [f"k{i % 7}", f"k{i % 2}"], "base": i % 3 * 30} for i in range(n)]


def test_best_rows_of_each_target(spark, monkeypatch):
    rng = random.Random(3)
    rows = made(rng, 700)
    gains = {(f"k{k}", t) for k in range(0, 9, 2) for t in range(0, len(TARGETS), 3)}
    df = spark.createDataFrame(rows, "id string, text string, extra string, keys array<string>, base int").repartition(3)
    given = spark.createDataFrame(sorted(gains), "key string, target_no int")
    limit = 6

    def got(**more):
        best = resolve._best(automaton.best_rows(df, TARGETS, limit, **more), limit)
        out = {n: [] for n in range(len(TARGETS))}
        for r in best.orderBy("target_no", F.desc("score"), "id").collect():
            out[r.target_no].append((r.id, r.score, r.extra))
        return out

    assert got() == plain_best(rows, limit)
    assert got(gains=given) == plain_best(rows, limit, gains)
    monkeypatch.setattr(automaton, "MAX_BROADCAST", 3)  # the gains are joined
    assert got(gains=given) == plain_best(rows, limit, gains)


def test_a_task_may_put_rows_out_often():
    rng = random.Random(4)
    patterns, rows = automaton.Patterns.of(TARGETS), made(rng, 400)
    best, out = automaton.Best(patterns, 2), {n: [] for n in range(len(TARGETS))}
    for r in rows:
        found = tuple(i for i, w in enumerate(patterns.words) if w in r["text"].lower())
        if found:
            best.add(found, (), 0, (r["id"], r["extra"]))
        if best.held > 50:
            for t, i, s, e in zip(*best.rows().to_pydict().values(), strict=True):
                out[t].append((-s, i, e))
    if best.held:
        for t, i, s, e in zip(*best.rows().to_pydict().values(), strict=True):
            out[t].append((-s, i, e))
    assert {t: [(i, -s, e) for s, i, e in sorted(x)[:2]] for t, x in out.items()} == plain_best(rows, 2)


def test_lists_of_targets_give_what_one_list_gives(spark):
    g = testbed.graph(spark, "/root/testdata/sf0.001")
    names = ["NATION_7", "customer/12", "Brand#2.ECONOMY", "claim_id:77", "unheard-of", " NATION_7 ", ""]
    targets = spark.createDataFrame([(x,) for x in names] + [(None,)], "t string")
    shown = lambda df: sorted(map(str, df.select("target", "verdict", "confidence_score", "risk_flags", "priority_score").collect()))
    assert shown(resolve.adjudicate_all(g, targets, at_once=2)) == shown(resolve.adjudicate(spark, g, names))
    assert resolve.adjudicate_all(g, targets.limit(0)).count() == 0
