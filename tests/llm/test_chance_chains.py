"""What chance seeds cost on disk: chains that are no passages move no windows of words, and nothing outlives its use."""

import os
import random
import time

import numpy as np
import pyarrow as pa

from sparkweave.llm import common, substring_dedup


def words(rng, n):
    return [f"n{rng.getrandbits(60)}" for _ in range(n)]


def passages(spark, texts, slices=3):
    return substring_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(slices)).collect()


def test_chance_chains_move_no_windows(spark, monkeypatch):
    rng, made, per_batch = random.Random(1), {}, common.per_batch

    def counted(df, f, schema):
        out = per_batch(df, f, schema)
        if f.__name__ == "cut":
            made[f.__name__] = out.count()
        return out

    monkeypatch.setattr(common, "per_batch", counted)
    phrases, texts = [words(rng, 12) for _ in range(100)], []
    for _ in range(100):
        texts.append([w for phrase in rng.sample(phrases, 4) for w in words(rng, 200) + phrase])
    texts[70][100:180] = texts[3][20:100]
    got = passages(spark, list(enumerate(texts)))
    assert [(r.doc_id, r.start, r.end, r.ref_doc_id, r.ref_start, r.ref_end, r.identity) for r in got] == [(70, 100, 180, 3, 20, 100, 1.0)]
    assert 0 < made["cut"] < 10  # a window or two for each of the shared phrases before


def test_tables_go_when_their_reader_is_done(spark):
    rng = random.Random(2)
    at = f"{common.shared_dir(spark).removeprefix('file:')}/sparkweave"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    passage = words(rng, 60)
    assert len(passages(spark, [(i, words(rng, 30) + passage) for i in range(5)])) == 4
    assert sorted(f.split("-")[0] for f in set(os.listdir(at)) - before) == ["chains", "windows"]  # of the result itself


def test_shuffle_files_go_with_the_write(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    held, before = spark.conf.get(key), files()
    with common.shuffles_dropped(spark):
        table = common.written(spark.range(1000).repartition(7, "id").groupBy("id").count(), "t")
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(key) == held and table.count() == 1000
    common.dropped(table)
    assert not any(os.path.exists(f.removeprefix("file:").removeprefix("//")) for f in table.inputFiles())


def test_steps_lead_back_to_the_ids():
    x = np.array([5, 6, 9, -(1 << 63), (1 << 63) - 1, 0, 7, 7, 3], np.int64)
    for ends in ([0, 9], [0, 0, 3, 3, 5, 9, 9], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]):
        ends = np.array(ends)
        d = substring_dedup.steps(x, ends)
        assert substring_dedup.walked(substring_dedup.numbers(substring_dedup.planes(d, 8, ends), 8), ends).tolist() == x.tolist()
    assert substring_dedup.steps(np.array([100, 101, 99]), np.array([0, 3])).tolist() == [200, 2, 3]
    none = np.array([], np.int64)
    assert substring_dedup.walked(substring_dedup.steps(none, np.array([0])).view(np.int64), np.array([0])).tolist() == []


def test_a_byte_a_word_never_turns_a_passage_away():
    rng = np.random.default_rng(3)
    m, a, b = [np.array([[5, 5, 6]], "<i4").tobytes()] * 3, rng.integers(0, 1 << 32, 60, "u4"), rng.integers(0, 1 << 32, 60, "u4")
    b[:40] = a[:40]
    short = lambda *v: pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in v], pa.binary())
    c = rng.integers(0, 1 << 32, 60, "u4")
    got = substring_dedup.hopeful(pa.array(m, pa.binary()), short(a, a, a), short(b, c, None), 40, "u1")
    assert got.tolist() == [True, False, True]  # unknown words may be any


def test_an_id_of_several_texts_keeps_its_chains(spark):
    rng = random.Random(4)
    passage = words(rng, 60)
    got = passages(spark, [(1, words(rng, 10) + passage), (2, words(rng, 300)), (2, words(rng, 10) + passage), (3, words(rng, 20)), (3, words(rng, 20))])
    assert all((r.doc_id, r.ref_doc_id, r.n_words) == (2, 1, 60) for r in got)
