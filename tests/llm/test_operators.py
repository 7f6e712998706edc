"""Each operator against a brute-force version, and on awkward rows."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from sparkweave.llm import common, decontaminate, html_text, licenses, line_dedup, near_dup, packing, quality, queries, substring_dedup, token_counts, tokens, toxicity

SF = "/root/testdata/sf0.001"
VOCABULARY = tokens.vocabulary("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, _set int, start int, score double, gone string"


def rng_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "la le li lo lu ma me mi mo mu".split()]


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing names."""
    rng = random.Random(3)
    long = "\n".join(rng_text(rng, 12) for _ in range(3000))
    passage = rng_text(rng, 80)
    texts = [None, "", " \n\t ", "one", long, long, passage, passage + " more words here", rng_text(rng, 60) + "\n" + passage, "a b c d e", "A  b c\nd e", passage, "é ß 中   x\x1cy"]
    rows = [(i, t, None, None if i % 3 else "s", None, "x", "y", 1, 2, 0.5, "g") for i, t in enumerate(texts)]
    rows += [(6, passage, "en", "s", 3, None, None, None, None, None, None), (None, passage, None, None, None, "x", None, 1, 2, None, "g"), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 3), int(i in (6, 7))) for i in range(9)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark, awkward):
    passage = awkward.filter("doc_id = 6").first().text.split()
    return spark.createDataFrame([(1, " ".join(passage[10:40])), (2, None), (3, ""), (None, "x y z"), (4, "quite another question here Answer: none")], "item_id long, text string")


def pandas(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


# --- substring dedup ---


def test_passages_find_every_exact_repeat_of_fifty_words(docs, texts):
    got = substring_dedup.passages(docs).toPandas()
    runs = {}
    words = {i: t.lower().split() for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    later = {i for s in runs.values() if len(s) > 1 for i in s if i != min(s)}
    assert later and later <= set(got.doc_id)
    assert {min(s) for s in runs.values() if len(s) > 1} <= set(got.doc_id) | set(got.ref_doc_id)
    for r in got.itertuples():
        a, b = words[r.doc_id][r.start : r.end], words[r.ref_doc_id][r.ref_start : r.ref_end]
        assert len(a) == r.n_words >= 50 and r.ref_doc_id < r.doc_id and r.identity >= 0.8
        assert len(set(a) & set(b)) >= 0.6 * len(set(a))


def test_fuzzy_passages(spark):
    rng = random.Random(5)
    passage = rng_text(rng, 100).split()
    fuzzy = [("x" + w) if i % 17 == 8 else w for i, w in enumerate(passage)]
    del fuzzy[60]
    rows = [(1, rng_text(rng, 200) + " " + " ".join(passage) + " " + rng_text(rng, 50)), (2, rng_text(rng, 70) + " " + " ".join(fuzzy) + " " + rng_text(rng, 90)), (3, rng_text(rng, 400))]
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.ref_doc_id) for r in got] == [(2, 1)]
    assert abs(got[0].start - 70) <= 3 and abs(got[0].end - 169) <= 3 and abs(got[0].ref_start - 200) <= 3 and got[0].identity > 0.88


def test_a_gap_parts_passages_and_loses_none(spark):
    rng = random.Random(6)
    new = lambda n: [f"n{rng.getrandbits(60)}" for _ in range(n)]
    rows, wanted = [], []
    for k, (first, gap_x, gap_y, last) in enumerate([(60, 0, 60, 60), (100, 200, 200, 100), (100, 450, 450, 100), (400, 500, 500, 50)]):
        a, b, x, y = new(first), new(last), 2 * k, 2 * k + 1
        rows += [(x, " ".join(a + new(gap_x) + b)), (y, " ".join(new(7) + a + new(gap_y) + b))]
        wanted += [(y, 7, 7 + first, x, 0, first, 1.0), (y, 7 + first + gap_y, 7 + first + gap_y + last, x, first + gap_x, first + gap_x + last, 1.0)]
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.ref_doc_id, r.ref_start, r.ref_end, r.identity) for r in got) == wanted


def test_a_passage_whose_parts_come_earlier(spark):
    rng = random.Random(8)
    new = lambda n: [f"n{rng.getrandbits(60)}" for _ in range(n)]
    a, b = new(30), new(30)
    parts = [a + new(80), new(9) + b, new(4) + a + b + new(5), new(70) + a + b]
    pieces = [new(10) for _ in range(9)]  # of stock phrases only
    whole = sum(pieces, [])
    parts += [new(3) + x + new(3) for x in pieces] + [new(2) + whole, whole + new(8), new(1) + whole + new(4) + whole]
    got = spark.createDataFrame(list(enumerate(map(" ".join, parts), 1)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.start, r.end, r.ref_doc_id, r.ref_start, r.ref_end) for r in substring_dedup.passages(got).collect()}
    assert got == {(4, 70, 130, 3, 4, 64), (15, 0, 90, 14, 2, 92), (16, 1, 91, 14, 2, 92), (16, 95, 185, 14, 2, 92)}


def test_fuzzy_passages_behind_earlier_pieces(spark):
    rng = random.Random(12)
    new = lambda n: [f"n{rng.getrandbits(60)}" for _ in range(n)]
    rows, wanted = [], set()
    for k in range(40):
        a, b = new(40), new(40)
        fuzzy = list(a + b)
        for i in rng.sample(range(80), 6):
            fuzzy[i] = new(1)[0]
        rows += [(10 * k + 1, new(20) + a + new(9)), (10 * k + 2, new(5) + b), (10 * k + 3, new(30) + a + b + new(8)), (10 * k + 4, new(100) + fuzzy)]
        wanted.add((10 * k + 4, 10 * k + 3))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    got = substring_dedup.passages(df).collect()
    pairs = {(r.doc_id, r.ref_doc_id) for r in got}
    assert pairs <= wanted and len(pairs) >= 0.9 * len(wanted)
    found = [r for r in got if r.end - r.start >= 70 and r.start >= 95 and r.identity >= 0.9]
    assert len(found) >= 0.9 * len(pairs)


def test_stretches_cover_all_that_reach_the_identity():
    rng = np.random.default_rng(4)
    for _ in range(200):
        m, x, y = [], [], []
        for k in range(rng.integers(1, 9)):
            gap, n = int(rng.integers(0, 60)) if k else 0, int(rng.integers(6, 70))
            x += [-1 - len(x) - i for i in range(gap)]
            y += [10**6 + len(y) + i for i in range(gap)]
            m.append((len(x), len(y), n))
            x += range(len(x), len(x) + n)
            y += range(len(x) - n, len(x))
        got = substring_dedup.aligned(np.array(x), np.array(y), np.array(m), 50, 0.8)
        assert all(e - s >= 50 and matches >= 0.8 * columns for _, _, s, e, matches, columns in got)
        covered = {w for _, _, s, e, _, _ in got for w in range(s, e)}
        for i in range(len(m)):
            for j in range(i, len(m)):
                s, e, same = m[i][1], m[j][1] + m[j][2], sum(n for _, _, n in m[i : j + 1])
                assert e - s < 50 or same < 0.8 * (e - s) or set(range(s, e)) <= covered


def test_edit_is_the_edit_distance():
    rng = np.random.default_rng(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(100):
        a, b = (rng.integers(0, 4, rng.integers(1, 25)) for _ in range(2))
        matches, columns = substring_dedup.edit(a, b)
        assert columns - matches == plain(a, b)


def test_chains_are_the_best_collinear_ones():
    rng = np.random.default_rng(2)
    for _ in range(50):
        px, py = rng.integers(0, 120, 12), rng.integers(0, 120, 12)
        m = substring_dedup.runs(px, py)
        order = np.argsort(m[:, 0] + m[:, 2], kind="stable")
        m = m[order]
        best = []
        for i in range(len(m)):
            x, y, n = m[i]
            before = [best[j] - substring_dedup.GAP_COST * (x - m[j, 0] - m[j, 2] + y - m[j, 1] - m[j, 2]) for j in range(i) if m[j, 0] + m[j, 2] <= x and m[j, 1] + m[j, 2] <= y]
            best.append(n + max([0, *before]))
        first = substring_dedup.chains(px, py)[0]
        score = float(first[0, 2])
        for a, b in zip(first[:-1], first[1:]):
            assert a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1]
            score += b[2] - substring_dedup.GAP_COST * (b[0] - a[0] - a[2] + b[1] - a[1] - a[2])
        assert score == pytest.approx(max(best))


# --- decontamination ---


def test_hits_are_the_verbatim_leaks(spark, docs, texts):
    items = {r.item_id: r.text for r in common.read(spark, SF, "benchmark").collect()}
    flat = lambda t: f" {' '.join(t.lower().split())} "
    want = {(d, i) for i, t in items.items() for d, x in texts.items() if flat(t) in flat(x)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.hits(docs, common.read(spark, SF, "benchmark")).collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(got)


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(4)
    items = [(i, rng_text(rng, rng.randint(5, 40))) for i in range(60)]
    index = decontaminate.index_of(items)
    for _ in range(40):
        base = rng.choice(items)[1].split()
        query = {*base[: rng.randint(1, len(base))], *rng_text(rng, 20).split()}
        terms = np.array(sorted(index["terms"][w] for w in query if w in index["terms"]))
        got = dict(decontaminate.retrieve(index, terms, np.arange(index["n_blocks"]), 0.4))
        scores = np.zeros(len(index["ids"]))
        for t in terms:
            a, b = index["first"][t], index["first"][t + 1]
            scores[index["items"][a:b]] += index["impacts"][a:b]
        top = scores[: len(scores) // decontaminate.BLOCK_ITEMS * decontaminate.BLOCK_ITEMS].reshape(-1, decontaminate.BLOCK_ITEMS).max(axis=1)
        assert (decontaminate.bounds(index, np.zeros(len(terms), np.int64), terms, 1)[0][: len(top)] >= top).all()
        assert set(got) == set(np.nonzero(scores >= 0.4)[0].tolist())
        assert all(got[i] == pytest.approx(scores[i]) for i in got)


def test_altered_leaks_and_shards(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, rng_text(rng, 40)) for i in range(20)]
    leak = items[7][1].upper().split()
    leak[5] = leak[20] = "other"
    docs = spark.createDataFrame([(1, rng_text(rng, 300) + "\n" + " ".join(leak) + " " + rng_text(rng, 100)), (2, rng_text(rng, 500))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.hits(docs, bench).collect()] == [(1, 7)]
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1000)
    assert [(r.doc_id, r.item_id) for r in decontaminate.hits(docs, bench).collect()] == [(1, 7)]
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [2]


# --- packing and tokens ---


def test_schedule_is_deficit_round_robin():
    rng = random.Random(7)
    for trial in range(60):
        totals = [rng.choice([0, 1, 3, rng.randint(0, 200)]) for _ in range(rng.randint(1, 6))]
        shares = None if trial % 2 else [Fraction(rng.randint(0, 5)) for _ in totals]
        plan = packing.Schedule(totals, shares, 16)
        order = [(i, p.base[i] + j) for p in plan.phases for i, j in sorted(((i, j) for i, x in enumerate(p.totals) for j in range(x)), key=lambda q: (Fraction(2 * q[1] + 1, p.totals[q[0]]), q[0]))]
        assert [plan.rank(q, j) for q, j in order] == list(range(sum(totals)))
        cells = {}
        for q, t in enumerate(totals):
            at = 0
            while at < t:
                n = rng.randint(1, min(40, t - at))
                for s, size, seq, offset in plan.pieces(q, at, n):
                    for k in range(size):
                        assert cells.setdefault((seq, offset + k), (q, at + s + k)) == (q, at + s + k)
                at += n
        assert len(cells) == sum(totals)
        for seq, size in Counter(s for s, _ in cells).items():
            assert {o for s, o in cells if s == seq} == set(range(size)) and size & (size - 1) == 0
        if shares is None:  # deficits stay small however many windows have gone by
            for n in range(0, sum(totals), 16):
                assert all(abs(c - n * t / sum(totals)) <= 1 + len(totals) / 2 for c, t in zip(plan.served(n)[0], totals))


def check_pack(rows, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for d, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_pack_round_trip(docs, texts):
    check_pack(packing.pack(docs, VOCABULARY).collect(), texts)


def test_pack_with_shares_and_shared_queues(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng_text(rng, rng.randint(0, 90)), f"s{i % 7}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    check_pack(packing.pack(docs, VOCABULARY, shares={"s1": 0.5, "s2": 0.5}).collect(), {i: t for i, t, _ in rows})
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    monkeypatch.setattr(packing, "MAX_BROADCAST_STARTS", 1)
    check_pack(packing.pack(docs, VOCABULARY).collect(), {i: t for i, t, _ in rows})


def test_shares_hold_beyond_the_most_queues(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, rng_text(rng, 60), f"s{i % 7}" if i % 7 else None) for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    got = packing.pack(docs, VOCABULARY, shares={"s1": 0.75, "": 0.25}).collect()
    check_pack(got, {i: t for i, t, _ in rows})
    first = Counter()
    for r in got:
        if r.sequence_id == 0:
            first[r.queue] += r.length
    assert set(first) == {"s1", None} and abs(first["s1"] - 3 * first[None]) < 0.05 * sum(first.values())


def test_encoder_gives_the_librarys_ids(texts):
    data, kind = tokens.load(VOCABULARY)
    encoder = tokens.Encoder(data, kind, words=50)
    odd = ["a <|endoftext|> b<|ENDOFTEXT|>c don't é", "", " \t x y\x1cz  q", "ΑΣ ΣΑΣ", "it's IT'LL x²³½ªº ¿¡— a\xadb \xa0 q\x85 µ ß ÿ Ÿ ÀÉ I'D'em 12ab3", "é ́ a", "中文 字　x"]
    assert encoder.by_word
    for t in [*odd, *list(texts.values())[:60]]:
        assert encoder.encode([t])[0].tolist() == encoder.model.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(spark, docs, texts, name, tmp_path):
    path = tokens.vocabulary(name)
    some = docs.filter("doc_id < 40")
    cache = str(tmp_path / "cache")
    got = token_counts.count(some, path, cache).collect()
    if name.endswith(".model"):
        import sentencepiece

        n = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), n(texts[r.doc_id])) and r.over_limit == (r.n_tokens > 2048)
    before = spark.read.parquet(cache).count()
    again = token_counts.count(docs.filter("doc_id < 50"), path, cache).collect()
    assert len(again) == docs.filter("doc_id < 50").count() and spark.read.parquet(cache).count() - before <= 10
    assert spark.read.parquet(cache).groupBy("digest").count().filter("count > 1").count() == 0


# --- near duplicates ---


def brute_links(texts):
    grams = {}
    for i, t in texts.items():
        w = t.lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, up = Counter(), {i: i for i in grams}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    ids = sorted(grams)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if grams[a] and grams[b] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                links[a] += 1
                links[b] += 1
                up[max(top(a), top(b))] = min(top(a), top(b))
    return links, {i: top(i) for i in grams}


def test_links(docs, texts):
    links, classes = brute_links(texts)
    got = near_dup.links(docs).collect()
    assert sum(links.values()) and len(got) == len(texts)
    assert all(r.n_links == links[r.doc_id] and r.class_id == classes[r.doc_id] for r in got)
    assert {r.doc_id for r in near_dup.keep_first(docs).collect()} == set(classes.values())


def test_links_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 8)
    rng = random.Random(9)
    base = rng_text(rng, 120).split()
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(120)] = rng.choice(WORDS)
        texts[i] = " ".join(w)
    texts |= {i: texts[3] for i in range(60, 80)} | {i: rng_text(rng, 50) for i in range(80, 90)}
    links, classes = brute_links(texts)
    got = near_dup.links(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)).collect()
    assert all(r.n_links == links[r.doc_id] and r.class_id == classes[r.doc_id] for r in got)


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        bands, rows = near_dup.bands_for(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 128


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: top(v) for v in up if any(v in e and e[0] != e[1] for e in edges)}


# --- quality, lines, licenses ---


def test_quality(spark, docs, texts):
    import xxhash

    labels = common.read(spark, SF, "labels")
    trusted = {r.doc_id for r in labels.filter("quality = 1").collect()}
    got = quality.rules(docs, labels).select("doc_id", "_quality.*").collect()
    half = quality.BUCKETS // 2

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def buckets(w):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        pairs = [xxhash.xxh64_intdigest(b.encode(), a) for a, b in zip(h, w[1:])]
        return [signed(x) % half for x in h] + [signed(x) % half + half for x in pairs]

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, w in words.items():
        raw.update(b := buckets(w))
        if i in trusted:
            target.update(b)
    share = [(raw[b] + 1) / (raw.total() + quality.BUCKETS) for b in range(quality.BUCKETS)]
    prior = quality.PRIOR * quality.BUCKETS
    weights = [round(1000 * np.log((target[b] + prior * p) / (target.total() + prior) / p)) for b, p in enumerate(share)]
    for r in got:
        w, t = words[r.doc_id], texts[r.doc_id]
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert r.llr == pytest.approx(sum(weights[b] for b in buckets(w)) / max(1, 2 * len(w) - 1) / 1000)
        assert r.kept == (not failed and r.llr >= quality.THRESHOLD)


def test_quality_counts_every_trusted_row(spark):
    rows = spark.createDataFrame([(i if i % 3 else None, f"w{i % 7} w{i % 5} end") for i in range(60)] + [(1, None), (1, "w1 w1")], "_id long, _text string")
    trusted = spark.createDataFrame([(i,) for i in range(1, 60, 2)] + [(None,), (1,)], "_id long")
    wide, salted = (quality.flagged(rows, trusted, most).collect() for most in (1000, 3))
    assert sorted((r["_in"], r["_text"] or "") for r in wide) == sorted((r["_in"], r["_text"] or "") for r in salted)
    assert sum(r["_in"] for r in wide) == sum(i % 3 > 0 and i % 2 for i in range(60)) + 2 and len(wide) == 62
    assert quality.model(rows, trusted, 1000) == quality.model(rows, trusted, 3)


def test_quality_uses_no_python(spark, docs):
    plan = quality.rules(docs, common.read(spark, SF, "labels"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "from_json" not in plan


def brute_lines(texts):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(upper, lower))
    owners = {}
    for i, t in texts.items():
        for x in t.split("\n"):
            owners.setdefault(key(x), set()).add(i)
    return {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or len(owners[key(x)]) < 2 or min(owners[key(x)]) == i) for i, t in texts.items()}


@pytest.mark.parametrize("bits", [line_dedup.MAX_BITS, line_dedup.SEGMENT])
def test_line_dedup(docs, texts, bits):
    want = brute_lines(texts)
    for r in line_dedup.dedup(docs.repartition(3), max_bits=bits).collect():
        assert r._lines.kept == want[r.doc_id] and r._lines.n_lines == texts[r.doc_id].count("\n") + 1
        assert r._lines.n_dropped == r._lines.n_lines - (want[r.doc_id].count("\n") + 1 if want[r.doc_id] or r._lines.n_dropped < r._lines.n_lines else 0)


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    changed = "Copyright (c) 2020 Somebody\n" + mit.replace("License", "Licence").replace(",", " ;").upper() + "\n\nAll rights reserved."
    rows = [(1, mit), (2, changed), (3, mit + " more"), (4, "text\nreleased under the mit licence!\nLicensed under CC BY 4.0."), (5, None)]
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "CC-BY-4.0,MIT"), 5: (None, "")}


# --- pages and toxicity ---


def test_html():
    page = """<html><head><title>T</title><script>var t="<p>no</p>";</script></head><body><header><h1>Site</h1><a>Home</a></header><div id="cookie-notice"><p>We use cookies, please accept.</p></div>
    <div class="layout"><div class="sidebar"><p>Popular posts here, and more.</p></div><div class="content"><h1>Title &amp; more</h1><p>First   paragraph, with <b>bold</b> text.<p>Second one;<br>line two.<ul><li>one<li>two</ul></div></div>
    <section class="comments"><p>Nice article, thanks a lot for sharing it.</p></section><form><p>Subscribe now</p></form><footer>c</footer></body></html>"""
    assert html_text.extract(page) == "Title & more\nFirst paragraph, with bold text.\nSecond one; line two.\none\ntwo"
    assert html_text.extract("<article><p>a</p><div class='ad'>long long advert text, yes.</div><p>b</article>") == "a\nb"
    assert [html_text.extract(x) for x in (None, "", "plain <text & no tags", "<p>only", "<div class='ad'>x</div>", "<!-- x", "<p", "<script>x")] == ["", "", "plain <text & no tags", "only", "", "", "<p", ""]
    assert html_text.extract("<p>" + "x " * 200_000).count("x") == 200_000


def test_html_marks_on_wrappers_and_several_articles():
    article = "<article><h1>Title</h1><p>First text, quite long; with points.</p><div class='ad'>Buy, buy, buy!</div><p>Second text, which is long too.</p></article>"
    text = "Title\nFirst text, quite long; with points.\nSecond text, which is long too."
    for name in ("site has-sidebar", "no-header", "noHeader"):
        assert html_text.extract(f"<body><div class='{name}'><div class='menu'><p>Home, and more.</p></div>{article}</div><footer>c</footer></body>") == text
        assert html_text.extract(f"<body><div class='{name}'>{article.replace('article>', 'div>')}</div></body>") == text
    comments = "".join(f"<p>Comment {i}, and a long one; quite long, in fact.</p>" for i in range(9))
    for name in ("readerComments", "comments"):
        assert html_text.extract(f"<body>{article}<div id='{name}'>{comments}</div></body>") == text
    assert html_text.extract(f"<body><nav>x</nav><div>{article}{article}</div></body>") == text + "\n" + text
    assert html_text.extract(f"<body><div style='display:none'>{article}</div><p>Seen.</p></body>") == "Seen."


def test_html_keeps_articles_of_pages_whole(spark):
    import html

    for r in html_text.main_text(common.read(spark, SF, "pages")).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r._main == "\n".join(x for x in parts if x)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = common.read(spark, sf, "labels")
    got = toxicity.score(common.read(spark, sf, "documents"), labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    hit = got[got.toxic == 1].predicted
    assert hit.mean() > 0.75 and got[got.toxic == 0].predicted.mean() < 0.02
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in got.doc_id)


# --- awkward rows ---


def awkward_calls(docs, labels, benchmark):
    return {
        "op1": lambda: substring_dedup.passages(docs), "op2": lambda: decontaminate.hits(docs, benchmark), "op3": lambda: packing.pack(docs, VOCABULARY), "op4": lambda: near_dup.links(docs), "op5": lambda: token_counts.count(docs, VOCABULARY),
        "op6": lambda: quality.rules(docs, labels), "op7": lambda: licenses.scan(docs), "op8": lambda: line_dedup.dedup(docs), "op9": lambda: html_text.main_text(docs, "text"), "op10": lambda: toxicity.score(docs, labels),
    }


PER_ROW = ("op5", "op6", "op7", "op8", "op9", "op10", "op4")


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_awkward_rows(awkward, labels, benchmark, name):
    rows = awkward_calls(awkward, labels, benchmark)[name]().collect()
    given = [(r.doc_id, r.text or "") for r in awkward.select("doc_id", "text").collect()]
    if name in PER_ROW:
        assert len(rows) == len(given)
        by_id = lambda values: sorted(values, key=repr)
        assert by_id(r.doc_id for r in rows) == by_id(i for i, _ in given)
    if name == "op3":
        data, kind = tokens.load(VOCABULARY)
        want = Counter((i, len(x) + 1) for (i, _), x in zip(given, tokens.Encoder(data, kind).encode([t for _, t in given]), strict=True))
        got: Counter = Counter()
        for r in rows:
            got[r.doc_id, r.doc_tokens] += r.length
        assert got == Counter({k: k[1] * n for k, n in want.items()})
        spans: dict[int, list] = {}
        for r in rows:
            spans.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
        assert all(s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:])) for s in map(sorted, spans.values()))
    if name == "op5":
        data, kind = tokens.load(VOCABULARY)
        want = [(i, len(t.encode()), len(x)) for (i, t), x in zip(given, tokens.Encoder(data, kind).encode([t for _, t in given]), strict=True)]
        assert by_id((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == by_id(want) and all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    if name == "op6":
        words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in given if i != 6}
        assert all(r._quality.n_words == words[r.doc_id] for r in rows if r.doc_id in words and r.doc_id is not None)
        assert all(r._quality.base_failed and not r._quality.kept for r in rows if r._quality.n_words < 50)
        assert all(r.gone == "g" for r in rows if r.doc_id in range(13) and r.source != "s" or r.doc_id == 0)
    if name == "op7":
        assert all(r.license_id is None and r.notices == "" for r in rows) and len({r.digest for r in rows if r.doc_id in (0, 1, 2)}) == 1
    if name == "op8":
        kept = {r.doc_id: r._lines.kept for r in rows if r.doc_id not in (None, 6)}
        want = brute_lines({i: t for i, t in given if i is not None})
        assert kept == {i: t for i, t in want.items() if i != 6}
        assert {r._lines.kept for r in rows if r.doc_id is None} == {t for i, t in given if i is None}
    if name == "op9":
        assert by_id((r.doc_id, r._main) for r in rows) == by_id((i, html_text.extract(t)) for i, t in given)
    if name == "op10":
        empty = {r.score for r in rows if r.doc_id in (0, 1, 2)}
        assert len(empty) == 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    if name == "op1":
        assert {(6, 7), (6, 8), (6, 11), (4, 5)} <= {(r.ref_doc_id, r.doc_id) for r in rows}
    if name == "op2":
        assert {(r.doc_id, r.item_id) for r in rows} == {(6, 1), (7, 1), (8, 1), (11, 1)}
    if name == "op4":
        by = {r.doc_id: r for r in rows}
        assert by[11].class_id == 6 and by[6].n_links >= 3 and by[5].class_id == 4 and by[10].class_id == 9 and by[0].class_id == 0 and by[1].class_id == 1


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_empty_tables(spark, awkward, labels, benchmark, name):
    none = awkward.filter("doc_id = -1")
    assert awkward_calls(none, labels, benchmark)[name]().collect() == []
    rows = awkward_calls(awkward, labels.filter("doc_id = -1"), benchmark.filter("item_id = -1"))[name]().collect()
    assert rows == [] if name == "op2" else rows


# --- pipeline ---


def test_pipeline(spark, docs, texts):
    kept = {r.doc_id: texts[r.doc_id] for r in quality.rules(docs, common.read(spark, SF, "labels")).filter("_quality.kept").select("doc_id").collect()}
    kept = brute_lines(kept)
    classes = brute_links(kept)[1]
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    flat = lambda t: f" {' '.join(t.lower().split())} "
    items = [flat(r.text) for r in common.read(spark, SF, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not any(x in flat(t) for x in items)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(kept)
    check_pack(rows, kept)


def test_stages_return_the_columns_of_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_oracles_name_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_seeds_are_the_least_of_each_window():
    rng = np.random.RandomState(3)
    sizes = rng.randint(0, 30, 60)
    flat = rng.randint(0, 6, sizes.sum()).astype(np.uint64)
    k, w = substring_dedup.K, substring_dedup.WINNOW
    h, text, pos = substring_dedup.seeds_of(flat, sizes)
    got = list(zip(text.tolist(), pos.tolist(), h.tolist(), strict=True))
    want, start = [], 0
    for t, n in enumerate(sizes.tolist()):
        own = common.shingles(flat[start : start + n], k).tolist() if n >= k else []
        runs = range(max(1, len(own) - w + 1)) if own else ()
        places = {min(range(i, min(i + w, len(own))), key=lambda j: (own[j], j)) for i in runs}
        want += [(t, p, own[p]) for p in sorted(places)]
        start += n
    assert got == want


def test_fuzzy_passages_are_mostly_found(spark):
    """Copies of 80 words with 15 % of them replaced at random: at least nine of ten."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for d in range(0, 120, 2):
        passage = text(80)
        copy = list(passage)
        for i in rng.sample(range(1, 79), 12):
            copy[i] = rng.choice(vocabulary)
        rows += [(d, " ".join(text(60) + passage + text(60))), (d + 1, " ".join(text(50) + copy + text(70)))]
    got = {(r.ref_doc_id, r.doc_id) for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) >= 54 and all(y == x + 1 for x, y in got)
