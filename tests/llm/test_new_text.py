"""Best-fit packing, token alignment and fill-in-middle against plain versions of the same."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkweave.llm import best_fit, common, fim, queries, segments, token_align, tokens

SF = "/root/testdata/sf0.001"
BYTES, PIECES = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  a", "a  ", "\n\n x\t y \r\n z;\r\n", "It's 3rd: don't, we'll 'twas x's", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "é ß 中文字 の　x   y z\x85w",
    "a▁b ▁", "x\x1cy \x0b\x0c z", "<P> in a text", "\U0001f600 \U0001f600\U0001f600 ok", "<0x41> <s> </s> <unk>", "word " * 3000, "0123456789" * 700, "fiń é", "\u0000 a", "中" * 500, "tail<S",
]
SCHEMA = "doc_id long, text string, lang string, n long, _id string, _text string, piece int, _unit int"


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, i, "x", None, 3, None) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", 1, "x", "y", 1, 2), (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    a, plain, b = Tokenizer.from_file(BYTES), Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain.encode_special_tokens = True
    return (lambda t: a.encode(t, add_special_tokens=False).ids), (lambda t: plain.encode(t, add_special_tokens=False).ids), b


def test_ids_of_stretches_are_those_of_whole_texts(docs, library):
    a, plain, b = library
    texts = [t or "" for t in ODD] + [r.text or "" for r in docs.collect()]
    texts += ["".join(random.Random(i).choices(["ab", "X", " ", "  ", "\n", "\t", "\r", "'s", "é", " ", " ", "9", ".", "<|endoftext|>", "中"], k=40)) for i in range(400)]
    for path, want, is_plain in ((BYTES, a, False), (BYTES, plain, True), (PIECES, lambda t: b.encode(t), False)):
        got = segments.Encoder(*tokens.load(path), plain=is_plain).encode(texts)
        assert [x.tolist() for x in got] == [want(t) for t in texts]


# --- best-fit packing ---


def plain_best_fit(items, cap):
    rooms, n = [], 0
    for x in sorted(items, reverse=True):
        i = bisect.bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else cap
        n += i >= len(rooms) and room == cap
        bisect.insort(rooms, room - x)
    return sorted(rooms)


def test_counts_are_packed_as_items_are():
    rng = np.random.default_rng(2)
    for k in range(120):
        cap = int(rng.choice([7, 40, 1024]))
        size = rng.integers(1, cap + 1, int(rng.integers(1, 400))) if k % 3 else rng.choice([1, cap // 3 + 1, cap // 2, cap], 200)
        size = np.maximum(size, 1)
        plan = best_fit.plan_of(size, cap, cap)
        at, offset = plan.place(size, best_fit.ranks(size))
        fill = np.bincount(at, size, minlength=plan.bins).astype(int)
        assert sorted(cap - fill) == plain_best_fit(size.tolist(), cap) and (plan.state(at)[0] == fill[at]).all()
        order = np.lexsort((offset, at))
        gapless = np.where(np.append(True, np.diff(at[order]) > 0), 0, np.append(0, (offset + size)[order][:-1]))
        assert (offset[order] == gapless).all()


def check_packing(rows, docs, ids_of, seq_len=1024, end=2):
    """Pieces against the library's ids: every id once, cuts as stated, gapless sequences. Returns (sequences, tokens)."""
    wanted, got, bins = Counter(), Counter(), defaultdict(list)
    for i, text in docs:
        ids = np.array([*ids_of(text or ""), end], "<u4")
        cuts = [0, *range((len(ids) - 1) % seq_len + 1, len(ids) + 1, seq_len)]
        wanted.update((i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)))
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == wanted
    for pieces in bins.values():
        upto = 0
        for offset, length in sorted(pieces):
            assert offset == upto
            upto += length
        assert upto <= seq_len
    return len(bins), sum(r.length for r in rows)


def test_best_fit_packing(spark, docs, library):
    got = queries.op11_best_fit_packing(spark, SF)
    n, total = check_packing(got.collect(), [(r.doc_id, r.text) for r in docs.collect()], library[0])
    assert n <= -(-total // 1024) + 1
    assert got.schema.simpleString() == "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint>"


def test_best_fit_packing_of_odd_rows(spark, odd, library):
    rows = best_fit.pack(odd, BYTES, with_ids=True).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()], library[0])
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert best_fit.pack(odd.limit(0), BYTES).collect() == []


def test_the_tree_packs_as_well_as_one_task(spark, monkeypatch):
    """Many small units under several levels: about as few sequences as one best fit of everything."""
    monkeypatch.setattr(best_fit, "FAN_BITS", 1)
    rng = random.Random(4)
    docs = [(i, "a" * rng.choice([rng.randint(1, 30), rng.randint(30, 90), 200])) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    ids_of = Tokenizer.from_file(BYTES)
    ids_of = lambda t, e=ids_of.encode: e(t, add_special_tokens=False).ids
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        rows = best_fit.pack(df, BYTES, seq_len=32, slack=0, unit_rows=40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n, total = check_packing(rows, docs, ids_of, 32)
    sizes = [(len(ids_of(t)) + 1 - 1) % 32 + 1 for _, t in docs] + [32] * sum(len(ids_of(t)) // 32 for _, t in docs)
    assert len({r.sequence_id >> best_fit.LEVEL_BITS for r in rows}) >= 4
    assert n <= 1.01 * len(plain_best_fit(sizes, 32)) + 1
    # Items that can't share a sequence go up as counts, and each gets one of its own.
    big = spark.createDataFrame([(i, "word " * 17) for i in range(300)], "doc_id long, text string").repartition(4)
    assert check_packing(best_fit.pack(big, BYTES, seq_len=32, unit_rows=20).collect(), [(i, "word " * 17) for i in range(300)], ids_of, 32)[0] == 300


# --- token alignment ---


def plain_alignment(rows, plain, b):
    model, letters = Tokenizer.from_file(BYTES), {c: x for x, c in tokens.BYTE_LETTERS.items()}
    out, pairs, kept = [], Counter(), []
    for i, text in rows:
        links, groups, x, y = [], "", [], []
        if text:
            x, y = plain(" " + text), b.encode(text)
            sx = [bytes(letters[c] for c in model.id_to_token(t)) for t in x]
            sy = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
            if b"".join(sx) != (" " + text).encode() or b"".join(sy) != (" " + text).encode():
                x, y = [], []
            else:
                ex, ey = (np.cumsum(list(map(len, s))).tolist() for s in (sx, sy))
                j = 0
                for k, e in enumerate(ex):
                    s = e - len(sx[k])
                    while ey[j] <= s:
                        j += 1
                    m = j
                    while m < len(ey) and ey[m] - len(sy[m]) < e:
                        links.append((x[k], y[m]))
                        m += 1
                said, lo, lo2 = [], 0, 0
                for e in sorted(set(ex) & set(ey)):
                    hi, hi2 = ex.index(e, lo) + 1, ey.index(e, lo2) + 1
                    said.append(",".join(map(str, x[lo:hi])) + "|" + ",".join(map(str, y[lo2:hi2])))
                    lo, lo2 = hi, hi2
                groups = said
        pairs.update(links)
        kept.append((i, len(x), len(y), groups, links))
    best = defaultdict(int)
    for (_, t), n in pairs.items():
        best[t] = max(best[t], n)
    for i, n, m, groups, links in kept:
        out.append((i, n, m, len(groups), len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return Counter(out)


def rows_of(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_token_alignment(spark, docs, odd, library):
    assert rows_of(queries.op12_token_alignment(spark, SF)) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()], *library[1:])
    got = token_align.align(odd, BYTES, PIECES)
    assert rows_of(got) == plain_alignment([(r.doc_id, r.text) for r in odd.collect()], *library[1:])
    assert got.filter("doc_id in (0, 1, 9)").filter("n_a + n_b + n_groups + n_links + n_best + count_sum > 0 or groups_sha256 <> ''").count() == 0
    assert token_align.align(odd.limit(0), BYTES, PIECES).collect() == []


def test_slices_of_few_texts_and_blocks(spark, docs, library, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows_of(token_align.align(docs, BYTES, PIECES)) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()], *library[1:])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    said = pa.array(["1|2;", "3|4,5;"])
    monkeypatch.setattr(token_align, "BLOCK", 3)
    stretch, starts = np.array([0, 1, 1, 0, 1, 0, 0]), np.array([0, 0, 1, 6, 6, 7])
    want = ["", "1|2", "3|4,5;3|4,5;1|2;3|4,5;1|2", "", "1|2"]
    assert token_align.digests(said, stretch, starts) == [x and hashlib.sha256(x.encode()).hexdigest() for x in want]


def test_group_products_and_whole_texts():
    a, b = tokens.load(BYTES), tokens.load(PIECES)
    for product in (False, True):
        aligner = token_align.Aligner(a, b, product)
        found = aligner.align([" onenerth", " the", " ththreantioning"])
        for k, groups in enumerate(found.said.to_pylist()):
            sizes = [tuple(len(x.split(",")) for x in g.split("|")) for g in groups.rstrip(";").split(";")]
            n, m = sum(x for x, _ in sizes), sum(y for _, y in sizes)
            links = sum(x * y for x, y in sizes) if product else sum(x + y - 1 for x, y in sizes)
            assert found.counts[k].tolist() == [n, m, len(sizes), links]
    aligner.whole, aligner.cutter = True, segments.Cutter(None)
    text = " Anat with by of nteres"
    assert aligner.align([text]).counts[0, 1] == len(aligner.b.model.encode(text[1:]))


# --- fill-in-middle ---


def plain_fim(i, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, odd):
    for df in (docs, odd):
        got = fim.transform(df).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
        want = Counter((r.doc_id, *plain_fim(r.doc_id, r.text or ""), r.text or "") for r in df.collect())
        assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert {r.form for r in got} >= {"plain", "psm"}
    assert fim.transform(odd.limit(0)).collect() == []


def test_cuts_restore_texts_that_look_like_markers():
    texts = pa.array(["<", "<P", "a<S", "S>", "<<<S", "P><M", "é<", "", "abc"])
    h = np.random.default_rng(1).integers(0, 1 << 32, (4, len(texts)))
    for k in range(50):
        h[0], h[1] = h[0] + k, h[1] + 3 * k
        n, form, pre, mid, out = fim.reordered(texts, h, 0, 50, fim.MARKERS)
        for t, f, o, a, m in zip(texts.to_pylist(), form.to_pylist(), out.to_pylist(), pre.to_pylist(), mid.to_pylist(), strict=True):
            x = re.split("<P>|<S>|<M>", o)
            assert t == (o if f == "plain" else x[1] + x[3] + x[2] if f == "psm" else x[2] + x[3] + x[1])
            assert f == "plain" or (len(x[1 if f == "psm" else 2]), len(x[3])) == (a, m)


def test_names_with_dots(spark):
    df = spark.createDataFrame([(7, "some text here")], "`a.id` long, `the.text` string")
    assert fim.transform(df, id_col="a.id", text_col="the.text").columns[0] == "a.id"
    assert best_fit.pack(df, BYTES, id_col="a.id", text_col="the.text").first()["a.id"] == 7
    assert token_align.align(df, BYTES, PIECES, id_col="a.id", text_col="the.text").first()["a.id"] == 7
