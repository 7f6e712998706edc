"""Alignment of two tokenizers' tokens over the same text, and how often the corpus links two ids.

The ends of both tokenizers' tokens cut a text into elementary intervals; each interval has one owner in either
tokenizer, and is the overlap of these two. Where both end, a group closes. The kernel aligns all new stretches of a
batch at once (both tokenizers end a token wherever a text is cut, see `segments`), so a text's alignment is a
concatenation of stretches that its task knows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, segments, tokens

#: Stretches a worker remembers before it starts anew, and stretches whose groups are written out at once.
KNOWN, BLOCK = 300_000, 1 << 20
#: UTF-8 bytes of the texts of a slice; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions first[i], ..., first[i] + size[i] - 1 for all i."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def json_bytes(model) -> pa.Array:
    """The bytes of each id of a byte-level vocabulary."""
    letter = {c: b for b, c in tokens.BYTE_LETTERS.items()}
    names = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
    return pa.array([bytes(map(letter.__getitem__, x)) if all(c in letter for c in x) else x.encode() for x in names], pa.binary())


def piece_bytes(model) -> pa.Array:
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return pa.array([bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)], pa.binary())


def decimal(n: int, ends: str) -> pa.Array:
    """For each id below n its decimal form, followed by either of two ends: entries 2 id and 2 id + 1."""
    return pa.array([f"{i}{e}" for i in range(n) for e in ends], pa.string())


@dataclass
class Aligned:
    """Stretches' alignments: numbers of tokens, groups, links; groups written out; links as a << 32 | b, stretch by
    stretch. A stretch that either tokenizer doesn't give back byte for byte is not good."""

    good: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))
    said: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def plus(self, other: Aligned) -> Aligned:
        return Aligned(np.append(self.good, other.good), np.concatenate([self.counts, other.counts]), pa.concat_arrays([self.said, other.said]), np.append(self.links, other.links))


class Aligner:
    """Two encoders and what is known of each distinct stretch of text. product: link all of a group's ids on one side
    with all on the other, instead of the overlapping ones."""

    def __init__(self, a: tuple[bytes, str], b: tuple[bytes, str], product: bool = False) -> None:
        self.a, self.b, self.product = segments.Encoder(*a, plain=True), segments.Encoder(*b, plain=True), product
        both = None if self.a.pairs is None or self.b.pairs is None else self.a.pairs & self.b.pairs
        self.whole = both is None
        self.cutter = segments.Cutter(both)
        self.bytes_a, self.bytes_b = (piece_bytes(e.model) if e.kind == "model" else json_bytes(e.model) for e in (self.a, self.b))
        self.size_a, self.size_b = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.bytes_a, self.bytes_b))
        self.pool = pa.concat_arrays([decimal(len(self.bytes_a), ",|"), decimal(len(self.bytes_b), ",;")])
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.known, self.first = Aligned(), np.zeros(0, np.int64)

    def ids(self, encoder: segments.Encoder, word: str) -> list[int]:
        """ids of a stretch; of a whole text if either vocabulary keeps texts from being cut. The space before a text is
        the sentencepiece library's own."""
        if self.whole and encoder.kind == "model":
            return encoder.model.encode(word[1:], num_threads=1)
        return encoder.stretch(word)

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's number among the known stretches; new ones are aligned together."""
        if len(self.numbers) > KNOWN or len(self.known.links) > 8 * KNOWN:
            self.forget()
        new = [w for w in words if w not in self.numbers]
        if new:
            found = self.align(new)
            self.first = np.append(self.first, len(self.known.links) + np.cumsum(found.counts[:, 3]) - found.counts[:, 3])
            self.known = self.known.plus(found)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def align(self, words: list[str]) -> Aligned:
        ids_a, ids_b = [self.ids(self.a, w) for w in words], [self.ids(self.b, w) for w in words]
        raw = [w.encode() for w in words]
        good = np.ones(len(words), bool)
        for ids, names in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            good &= np.fromiter((x == y for x, y in zip(self.joined(ids, names), raw, strict=True)), bool, len(raw))
        flat = lambda ids: np.fromiter((t for x, g in zip(ids, good, strict=True) if g for t in x), np.int64)
        size = lambda ids: np.fromiter((len(x) if g else 0 for x, g in zip(ids, good, strict=True)), np.int64, len(ids))
        a, b, n_a, n_b = flat(ids_a), flat(ids_b), size(ids_a), size(ids_b)
        upto = np.cumsum(np.where(good, np.fromiter(map(len, raw), np.int64, len(raw)), 0))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])

        ends = np.union1d(ends_a, ends_b)  # of the elementary intervals
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        closing = ends[(ends_a[own_a] == ends) & (ends_b[own_b] == ends)]
        group_a, group_b = np.searchsorted(closing, ends_a), np.searchsorted(closing, ends_b)
        if self.product:
            in_b = np.bincount(group_b, minlength=len(closing))[group_a]
            own_a, own_b = np.repeat(np.arange(len(a)), in_b), ragged(np.searchsorted(group_b, group_a), in_b)
        links = a[own_a] << 32 | b[own_b]
        within = lambda ends: np.diff(np.append(0, np.searchsorted(ends, upto, side="right")))
        n_links, n_groups = within(ends_a[own_a] if self.product else ends), within(closing)

        # Groups in order, each with its ids of the first tokenizer and then those of the second.
        order = np.empty(len(a) + len(b), np.int64)
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + last(group_a)
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * (len(self.bytes_a) + b) + last(group_b)
        taken = self.pool.take(pa.array(order))
        cuts = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
        cuts = cuts[np.append(0, np.cumsum(n_a + n_b))]
        strings = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(cuts.astype(np.int32)), taken.buffers()[2] if len(taken) else pa.py_buffer(b"")])
        return Aligned(good, np.stack([n_a, n_b, n_groups, n_links], 1), strings, links)

    @staticmethod
    def joined(ids: list[list[int]], names: pa.Array) -> list[bytes]:
        """What the ids of each stretch spell."""
        at = np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))
        taken = names.take(pa.array(np.fromiter((t for x in ids for t in x), np.int64, int(at[-1]))))
        if not len(taken):
            return [b""] * len(ids)
        cuts = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1][at].tolist()
        data = taken.buffers()[2].to_pybytes()
        return [data[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]


def digests(said: pa.Array, stretch: np.ndarray, starts: np.ndarray) -> list[str]:
    """sha256 of each text's groups without the last mark; '' for a text without stretches."""
    out, hashes = [""] * (len(starts) - 1), {}
    for lo in range(0, len(stretch), BLOCK):
        hi = min(lo + BLOCK, len(stretch))
        taken = said.take(pa.array(stretch[lo:hi]))
        cuts, data = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1], memoryview(taken.buffers()[2])
        for i in range(int(np.searchsorted(starts, lo, side="right")) - 1, len(out)):
            s, e = int(starts[i]), int(starts[i + 1])
            if s >= hi:
                break
            if s == e:
                continue
            h = hashes.setdefault(i, hashlib.sha256())
            h.update(data[cuts[max(s, lo) - lo] : cuts[min(e, hi) - lo] - (e <= hi)])
            if e <= hi:
                out[i] = hashes.pop(i).hexdigest()
    return out


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, a: str, b: str, product: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a is a byte-level .json vocabulary, which reads a space and the text; b a sentencepiece model, which adds the space.
    Special tokens' strings are plain text. A text has no tokens, and zeros, if it is null or empty or if either side's
    tokens don't spell it. A link is two tokens that overlap (with `product`, two of one group); its count is how many
    links of the corpus hold its two ids; n_best counts the links whose count no other link of their b id beats. Null ids
    and repeated rows get a row each; an empty table gives no rows.

    Each slice of a task's texts counts its links by pair of ids before anything moves, so a pair makes a row a slice
    however often it occurs. Slices get their pairs' totals back by a join; texts are read once and don't move.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({"a": tokens.load(a), "b": tokens.load(b)})
    rows = common.keyed(docs, id_col, text_col)
    id_type = rows.schema["_id"].dataType.simpleString()
    made = common.written(common.per_batch(rows, _reader(held, product), f"_slice bigint, _id {id_type}, " + "".join(f"{c} bigint, " for c in COUNTS) + "groups_sha256 string, _stretches binary, _n array<bigint>, _first binary, _at binary, _pairs array<bigint>"), "alignments")
    pairs = made.filter(F.col("_pairs").isNotNull()).select("_slice", F.posexplode(F.arrays_zip("_pairs", "_n")).alias("_pos", "x")).select("_slice", "_pos", F.col("x._pairs").alias("_pair"), F.col("x._n").alias("_n"))
    totals = common.checkpointed(pairs.groupBy("_pair").agg(F.sum("_n").alias("_total")))
    b_id = F.col("_pair").bitwiseAND(0xFFFFFFFF)
    most = totals.groupBy(b_id.alias("_b")).agg(F.max("_total").alias("_most"))  # a row for each entry of b's vocabulary at most
    judged = totals.join(F.broadcast(most), b_id == F.col("_b")).select("_pair", "_total", (F.col("_total") == F.col("_most")).cast("long").alias("_best"))
    answers = pairs.join(judged, "_pair").select(F.col("_slice").alias("_of"), "_pos", "_total", "_best")
    schema = f"{common.quoted(id_col)} {id_type}, " + "".join(f"{c} bigint, " for c in [*COUNTS, "n_best", "count_sum"]) + "groups_sha256 string"
    texts = made.select("_slice", "_id", *COUNTS, "groups_sha256", "_stretches", "_first", "_at", F.col("_pairs").isNotNull().alias("_head"))
    return texts.groupBy("_slice").cogroup(answers.groupBy("_of")).applyInArrow(lambda x, y: _scored(x, y, id_col), schema)


def aligner_of(held: dict, product: bool) -> Aligner:
    """The aligner of a broadcast, kept with the worker's copy of it."""
    if "aligner" not in held:
        held["aligner"] = Aligner(held["a"], held["b"], product)
    return held["aligner"]


def _reader(held, product: bool):
    names = ["_slice", "_id", *COUNTS, "groups_sha256", "_stretches", "_n", "_first", "_at", "_pairs"]

    def read(batches):
        from pyspark import TaskContext

        aligner, number = aligner_of(held.value, product), TaskContext.get().partitionId() << 32
        for batch in batches:
            ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)), 0
            while at < len(ends):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                yield _slice(aligner, number, batch.slice(at, upto - at), names)
                at, number = upto, number + 1

    return read


def _slice(aligner: Aligner, number: int, batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """The rows of a slice's texts, after one of the slice itself: its pairs of ids, how many links each has, and which
    pairs each stretch links."""
    texts = pc.fill_null(batch.column(1), "")
    spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    words, starts = aligner.cutter.cut(spaced)
    numbered = words.dictionary_encode()
    local = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int32) if len(words) else np.zeros(0, np.int32)
    stretch = aligner.places(numbered.dictionary.to_pylist())
    known = aligner.known
    sums = lambda x: np.diff(np.append(0, np.cumsum(x))[starts], axis=0)
    good = sums(~known.good[stretch][local]) == 0
    if not good.all():  # texts that their tokens don't spell have none
        keep = np.repeat(good, np.diff(starts))
        local, starts = local[keep], np.append(0, np.cumsum(np.where(good, np.diff(starts), 0)))
    counts = [sums(known.counts[stretch, i][local]) for i in range(4)]
    size, times = known.counts[stretch, 3], np.bincount(local, minlength=len(stretch)).astype(np.int64)
    pairs, pair_at = np.unique(known.links[ragged(aligner.first[stretch], size)], return_inverse=True)
    n = np.bincount(pair_at, np.repeat(times, size), minlength=len(pairs)).astype(np.int64)
    first, at = (x.astype(np.int32).tobytes() for x in (np.append(0, np.cumsum(size)), pair_at))
    k = len(batch)
    lists = [local[s:e].tobytes() for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    head = lambda value, kind: pa.concat_arrays([pa.array([value], kind), pa.nulls(k, kind)])
    body = lambda values, kind: pa.concat_arrays([pa.nulls(1, kind), pa.array(values, kind)])
    flat = pa.list_(pa.int64())
    one = lambda x: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())), pa.nulls(k, flat)])
    ids = pa.concat_arrays([pa.nulls(1, batch.column(0).type), batch.column(0)])
    return pa.RecordBatch.from_arrays([pa.array([number] * (k + 1), pa.int64()), ids, *(body(c, pa.int64()) for c in counts), body(digests(known.said, stretch[local], starts), pa.string()), body(lists, pa.binary()), one(n), head(first, pa.binary()), head(at, pa.binary()), one(pairs)], names)


def _scored(texts: pa.Table, answers: pa.Table, id_col: str) -> pa.Table:
    """n_best and count_sum of a slice's texts from its pairs' totals."""
    is_head = texts.column("_head")
    head, texts = texts.filter(is_head), texts.filter(pc.invert(is_head))
    first, at = (np.frombuffer(head.column(c)[0].as_py(), np.int32) for c in ("_first", "_at"))
    lists = texts.column("_stretches").to_pylist()
    starts, local = np.cumsum([0, *(len(x) // 4 for x in lists)]), np.frombuffer(b"".join(lists), np.int32)
    pos, n_pairs = answers.column("_pos").to_numpy(), int(at.max(initial=-1)) + 1

    def summed(column: str) -> np.ndarray:
        of_pair = np.zeros(n_pairs, np.int64)
        of_pair[pos] = answers.column(column).to_numpy()
        of_stretch = np.diff(np.append(0, np.cumsum(of_pair[at]))[first])
        return np.diff(np.append(0, np.cumsum(of_stretch[local]))[starts])

    out = {id_col: texts.column("_id")} | {c: texts.column(c) for c in COUNTS}
    return pa.table(out | {"n_best": summed("_best"), "count_sum": summed("_total"), "groups_sha256": texts.column("groups_sha256")})
