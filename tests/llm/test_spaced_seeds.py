"""Copies whose differences leave no run of words as long as a seed."""

import random

import numpy as np
import pytest

from sparkweave.llm import substring_dedup


@pytest.mark.parametrize("k", [5, 6])
def test_copies_with_every_fifth_or_sixth_word_replaced(spark, k):
    """Identity 0.8 and 0.83, and never six equal words in a row."""
    rng = random.Random(k)
    new = lambda n: [f"n{rng.getrandbits(60)}" for _ in range(n)]
    rows = []
    for d in range(0, 60, 2):
        passage = new(60)
        copy = [new(1)[0] if i % k == k - 1 else w for i, w in enumerate(passage)]
        rows += [(d, " ".join(new(30) + passage + new(8))), (d + 1, " ".join(new(100) + copy))]
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert all(r.doc_id == r.ref_doc_id + 1 and r.n_words >= 50 and r.identity >= 0.8 for r in got)
    assert len({r.doc_id for r in got}) >= 28
    text = {i: t.split() for i, t in rows}
    for r in got:  # words at a difference aren't counted as matches
        a, b = text[r.doc_id][r.start : r.end], text[r.ref_doc_id][r.ref_start : r.ref_end]
        assert len(a) != len(b) or round(r.identity * len(a)) == sum(x == y for x, y in zip(a, b, strict=True))


def test_a_match_is_parted_at_its_differences():
    x, y = np.arange(12), np.arange(12)
    y[[3, 9]] = -1
    assert substring_dedup.equal_runs(x, y, np.array([[0, 0, 6], [6, 6, 3], [9, 9, 1]])).tolist() == [[0, 0, 3], [4, 4, 2], [6, 6, 3]]


def test_pairs_of_several_texts_stay_within_their_windows():
    h = np.arange(1, 9, dtype=np.uint64)
    place = np.array([0, 5, 9, 14, 1 << 32, (1 << 32) + 4, (1 << 32) + 8, (1 << 32) + 12])
    keys, places = substring_dedup.pair_seeds(h, place, np.array([0, 5, 1 << 32]), np.array([9, 14, (1 << 32) + 4]))
    assert len(keys) == 2 * (3 + 2 + 1) and sorted(set(places.tolist())) == [0, 5, 9, 14, 1 << 32, (1 << 32) + 4]
