"""Seeds that move in rows of a part each, and what reads them: word hashes, gaps, chains of one match."""

import datetime
import decimal
import random

import numpy as np
import pyarrow as pa
import pytest

from sparkweave.llm import substring_dedup


def words(rng, n):
    return [f"n{rng.getrandbits(60)}" for _ in range(n)]


def test_seeds_of_many_words_make_few_rows(spark, monkeypatch):
    rng, made = random.Random(1), []
    per_batch = substring_dedup.common.per_batch

    def counted(df, f, schema):
        out = per_batch(df, f, schema)
        if f.__name__ == "seed":
            made.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup.common, "per_batch", counted)
    texts = [words(rng, 400) for _ in range(200)]
    texts[150][100:180] = texts[20][300:380]
    got = substring_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)).collect()
    assert [(r.doc_id, r.start, r.end, r.ref_doc_id, r.ref_start, r.ref_end) for r in got] == [(150, 100, 180, 20, 300, 380)]
    assert made and made[0] < 200 * 400 / 50  # a row a seed before: more than half the words


@pytest.mark.parametrize("kind, make", [
    ("string", lambda i: f"d{i:03}"), ("int", lambda i: i - 40), ("decimal(20,2)", lambda i: decimal.Decimal(i)), ("date", lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(i)),
    ("timestamp", lambda i: datetime.datetime(2000, 1, 1) + datetime.timedelta(i)), ("double", lambda i: i / 4),
])
def test_ids_of_any_type(spark, kind, make):
    rng = random.Random(2)
    passage = words(rng, 60)
    rows = [(make(i), " ".join(words(rng, 30) + (passage if i % 7 == 3 else []))) for i in range(80)]
    got = substring_dedup.passages(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == {make(i) for i in range(80) if i % 7 == 3 and i > 3} and all((r.start, r.end) == (30, 90) and r.ref_doc_id < r.doc_id for r in got)


def test_no_text_at_all(spark):
    for rows in ([], [(1, None), (2, ""), (None, "a b c")]):
        assert substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_word_hashes_are_those_of_the_words():
    rng, marks = random.Random(3), "aAb\u03a3\u03c3\u0130\u00df \t\n\x1c\x85\u00a0\u2003\u3000\u200b\U0001f600"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["", " ", "x" * 600_000 + " y z"]
    h, sizes = substring_dedup.word_hashes(texts)
    split = [t.lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in split]
    of = {}
    assert all(of.setdefault(w, v) == v for w, v in zip((w for t in split for w in t), h.tolist(), strict=True))
    assert len(set(of.values())) == len(of)
    assert [len(v) for v in substring_dedup.word_hashes([])] == [0, 0]


def test_numbers_come_back_from_their_planes():
    x, ends = np.array([0, 1, 255, 256, (1 << 30) + 7, 5]), np.array([0, 2, 2, 6])
    parts = substring_dedup.planes(x, 4, ends)
    assert [len(p) for p in parts] == [8, 0, 16] and substring_dedup.numbers(parts, 4).tolist() == x.tolist()


def test_gaps_align_as_a_plain_table_says():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(30))]
        b = [rng.randrange(6) if rng.random() < 0.2 else x for x in a if rng.random() > 0.1]
        best = {(i, 0): (i, 0) for i in range(len(a) + 1)} | {(0, j): (j, 0) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                (e, m), same = best[i - 1, j - 1], a[i - 1] == b[j - 1]
                best[i, j] = min((e + (not same), m - same), *((e + 1, m) for e, m in (best[i - 1, j], best[i, j - 1])))
        errors, matches = best[len(a), len(b)]
        assert substring_dedup.edit(np.array(a, np.int64), np.array(b, np.int64)) == (-matches, errors - matches)


def test_chains_of_one_match_need_enough_equal_words_on_their_diagonal():
    rng = np.random.default_rng(5)
    chain, x, y, want = [], [], [], []
    for i in range(200):
        a, b, at = rng.integers(0, 1 << 32, 80, "u4"), rng.integers(0, 1 << 32, 90, "u4"), int(rng.integers(0, 70))
        same = rng.random(80) < rng.choice([0.3, 0.5, 0.7])
        b[10:][same] = a[same]
        m = [[at, at + 10, 6]] * (1 + (i % 10 == 0))
        for v, into, kind in ((m, chain, "<i4"), (a, x, "<u4"), (b, y, "<u4")):
            into.append(np.array(v, kind).tobytes())
        want.append(len(m) > 1 or int((a == b[10:]).sum()) >= 40)
    got = substring_dedup.hopeful(*(pa.array(v, pa.binary()) for v in (chain, x, y)), 40)
    assert got.tolist() == want and len(set(want)) == 2
    assert substring_dedup.hopeful(*(pa.array([], pa.binary()) for _ in range(3)), 40).tolist() == []
