"""The non-negative positive-unlabelled learner against plain loops over rows and features."""

import math
import random

import numpy as np
import pytest

from sparkweave.llm import toxicity


def plain_fit(positive, unlabelled, prior, steps, rate=0.05, l2=1e-4):
    count = lambda rows: {b: sum(b in r for r in rows) for b in {x for r in rows for x in r}}
    p, u, n, m = count(positive), count(unlabelled), len(positive), len(unlabelled)
    scale = {}
    for b in p:
        ratio = math.log((p[b] + 0.5) / (n + 1)) - math.log((u.get(b, 0) + 0.5) / (m + 1))
        if p[b] >= 2 and ratio > -0.4 * math.log(prior):
            scale[b] = max(ratio, 0.0)
    w, bias = dict.fromkeys(scale, 0.0), -2.0
    mean, var = dict.fromkeys([*scale, "b"], 0.0), dict.fromkeys([*scale, "b"], 0.0)
    for t in range(1, steps + 1):
        z = lambda r: bias + sum(w[b] * scale[b] for b in r if b in w)  # noqa: B023, E731
        loss = lambda v: math.log1p(math.exp(v))
        negative = sum(loss(z(r)) for r in unlabelled) / m - prior * sum(loss(z(r)) for r in positive) / n
        grad = {b: l2 * w[b] for b in scale} | {"b": 0.0}
        for rows, k in ((positive, n), (unlabelled, m)):
            for r in rows:
                s = 1 / (1 + math.exp(-z(r)))
                if rows is positive:  # prior * R+ less prior * R-, or the reversed second term alone
                    g = prior * (s - 1) / k - prior * s / k if negative >= 0 else prior * s / k
                else:
                    g = s / k if negative >= 0 else -s / k
                grad["b"] += g
                for b in r:
                    if b in scale:
                        grad[b] += g * scale[b]
        for b, g in grad.items():
            mean[b], var[b] = 0.9 * mean[b] + 0.1 * g, 0.999 * var[b] + 0.001 * g * g
            step = rate * (mean[b] / (1 - 0.9**t)) / (math.sqrt(var[b] / (1 - 0.999**t)) + 1e-8)
            if b == "b":
                bias -= step
            else:
                w[b] = max(0.0, w[b] - step)
    return {b: w[b] * scale[b] for b in w}, bias


@pytest.mark.parametrize("prior", [0.02, 0.3])
def test_fit_is_the_plain_learner(prior):
    rng = random.Random(2)
    row = lambda toxic: {rng.randrange(40) for _ in range(8)} | ({100 + rng.randrange(6) for _ in range(2)} if toxic else set())
    positive = [row(True) for _ in range(25)]
    unlabelled = [row(rng.random() < prior) for _ in range(80)]
    arrays = lambda rows: [np.array(sorted(r), np.int64) for r in rows]
    for steps in (1, 7, 120):
        keep, weights, bias = toxicity.fit(arrays(positive), arrays(unlabelled), prior, steps)
        want, want_bias = plain_fit(positive, unlabelled, prior, steps)
        assert dict(zip(keep.tolist(), weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-6, abs=1e-9) and bias == pytest.approx(want_bias)
    assert {100, 101, 102, 103, 104, 105} <= set(keep.tolist())


def test_scores_are_the_models(spark):
    rows = [(i, f"word{i % 7} other{i % 5} " + ("vile nasty" if i % 4 == 0 else "kind")) for i in range(120)] + [(500, None), (501, ""), (None, "vile nasty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    keep, weights, bias = toxicity.train(docs, labels)
    weight = dict(zip(keep.tolist(), weights.tolist(), strict=True))
    got = toxicity.score(docs, labels).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        z = bias + sum(weight.get(b, 0.0) for b in toxicity.row_of(toxicity.Hashed(), text[r.doc_id]).tolist())
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == int(r.score >= 0.5)
    by = {r.doc_id: r.predicted for r in got}
    assert all(by[i] == int(i % 4 == 0) for i in range(120)) and by[500] == by[501] == 0 and by[None] == 1
