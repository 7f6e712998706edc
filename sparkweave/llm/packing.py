"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of `seq_len` tokens is filled to target token proportions of the sources. Each window adds a quantum
(seq_len x share) to a queue's deficit counter; a queue is served while its counter holds half a token or more, and
what is left is carried to the next window. Served token by token this is the order of virtual times
(2j + 1) / (2 share) of a queue's tokens j, so the counters at any window follow in closed form from exact integers:
a task starts with the carried deficits of its first window and never needs the windows before it.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Sources get queues of their own up to this number; beyond it queues are shared, by the source's hash.
MAX_QUEUES = 1024
#: Rows of (task, queue) starts that are broadcast at most (24 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_STARTS = 200_000


@dataclass
class Phase:
    """Tokens before it, each queue's tokens before it, and each queue's tokens in it."""

    first: int
    base: list[int]
    totals: list[int]


class Schedule:
    """Which tokens of which queue lie in which sequence. totals: tokens of each queue; shares: target proportions."""

    def __init__(self, totals: list[int], shares: list[Fraction] | None = None, seq_len: int = 2048) -> None:
        self.totals, self.seq_len, self.n = totals, seq_len, sum(totals)
        self.phases: list[Phase] = []
        left, base, first = list(totals), [0] * len(totals), 0
        weights = shares or [Fraction(x) for x in totals]
        while any(left):  # a phase ends as a queue runs dry; the others keep their relative weights
            live = [i for i, x in enumerate(left) if x]
            if not any(weights[i] for i in live):
                weights = [Fraction(x) for x in left]
            most = min(left[i] / weights[i] for i in live if weights[i])
            part = [min(left[i], int(most * weights[i])) if i in live and weights[i] else 0 for i in range(len(left))]
            dry = [i for i in live if weights[i] and left[i] / weights[i] == most]
            part = [left[i] if i in dry else x for i, x in enumerate(part)]
            self.phases.append(Phase(first, list(base), part))
            first, base, left = first + sum(part), [b + x for b, x in zip(base, part, strict=True)], [x - y for x, y in zip(left, part, strict=True)]
        self.full = self.n // seq_len
        self.tail = [self.full * seq_len]  # starts of the last sequences: powers of two, which need no padding
        rest, step = self.n % seq_len, 1 << max(0, seq_len.bit_length() - 1)
        while rest:
            while step > rest:
                step >>= 1
            self.tail.append(self.tail[-1] + step)
            rest -= step
        self.known: OrderedDict[int, tuple[list[int], list[int]]] = OrderedDict()

    def sequence(self, rank: int) -> tuple[int, int, int]:
        """Number, first rank and end rank of the sequence that holds a rank."""
        i = rank // self.seq_len
        if i < self.full:
            return i, i * self.seq_len, (i + 1) * self.seq_len
        k = max(k for k, x in enumerate(self.tail) if x <= rank)
        return self.full + k, self.tail[k], self.tail[k + 1]

    def served(self, n: int) -> tuple[list[int], list[int]]:
        """Tokens of each queue among the first n, and their running sums over the queues before."""
        if n in self.known:
            self.known.move_to_end(n)
            return self.known[n]
        p = next((p for p in reversed(self.phases) if p.first <= n), None)
        if p is None:
            return [0] * len(self.totals), [0] * (len(self.totals) + 1)
        t, all_t, m = p.totals, sum(p.totals), n - p.first
        c = [min(x, (2 * m * x + all_t) // (2 * all_t)) for x in t]
        over = sum(c) - m
        while over > 0:
            i = max((i for i, x in enumerate(c) if x), key=lambda i: (Fraction(2 * c[i] - 1, t[i]), i))
            c[i], over = c[i] - 1, over - 1
        while over < 0:
            i = min((i for i, x in enumerate(c) if x < t[i]), key=lambda i: (Fraction(2 * c[i] + 1, t[i]), i))
            c[i], over = c[i] + 1, over + 1
        out = [b + x for b, x in zip(p.base, c, strict=True)]
        sums = [0]
        for x in out:
            sums.append(sums[-1] + x)
        self.known[n] = out, sums
        if len(self.known) > 4096:
            self.known.popitem(last=False)
        return out, sums

    def rank(self, queue: int, j: int) -> int:
        """How many tokens are served before token j of a queue."""
        p = next(p for p in self.phases if p.base[queue] <= j < p.base[queue] + p.totals[queue])
        i, own = j - p.base[queue], p.totals[queue]
        rank = p.first
        for k, x in enumerate(p.totals):  # tokens i' with (2i' + 1) / x below (2i + 1) / own, or equal in an earlier queue
            if x:
                a, b = (2 * i + 1) * x, 2 * own
                rank += i if k == queue else max(0, min(x, (a - own) // b + 1 if k < queue else -((own - a) // b)))
        return rank

    def pieces(self, queue: int, start: int, length: int):
        """(start in the document, length, sequence, offset) of each piece of a document that starts so in its queue."""
        at = 0
        rank = self.rank(queue, start) if length else 0
        while at < length:
            number, lo, hi = self.sequence(rank)
            (low, low_sums), (high, high_sums) = self.served(lo), self.served(hi)
            take = min(length - at, high[queue] - (start + at))
            yield at, take, number, high_sums[queue] - low_sums[queue] + start + at - low[queue]
            at += take
            if at < length:
                rank = hi
                while self.served(self.sequence(rank)[2])[0][queue] <= start + at:  # sequences without this queue
                    rank = self.sequence(rank)[2]


def pack(docs: DataFrame, vocabulary: str, seq_len: int = 2048, end_id: int = 1, shares: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every token of every document in exactly one piece of a sequence.

    shares: target proportions of sources in a window; those not named share nothing until the named ones run dry. By
    default the corpus's own proportions, which all queues keep to the last window. A document is its text's ids (a
    null text has none) and `end_id`. All sequences have seq_len tokens but the last few, whose lengths are powers of
    two. Null sources form a queue; null ids and repeated rows are packed like others; an empty table gives no rows.

    Ids are made once and written with each task's running starts, so that no token is shuffled and a lost task is
    made again from its own file.
    """
    spark = docs.sparkSession
    data, kind = tokens.load(vocabulary)
    blob = spark.sparkContext.broadcast({"data": data, "kind": kind})
    source = F.col(common.quoted(source_col)).cast("string")
    rows = docs.select(F.col(common.quoted(id_col)).alias("_id"), F.col(common.quoted(text_col)).cast("string").alias("_text"), source.alias("_source"))
    n_sources = rows.select("_source").distinct().limit(MAX_QUEUES + 1).count()
    if n_sources > MAX_QUEUES:
        prefix = "queue-"
        while any(s.startswith(prefix) for s in shares or ()):
            prefix = "_" + prefix
        own = F.coalesce("_source", F.lit("")).isin(list(shares or ()))  # sources with a share keep a queue of their own
        rows = rows.withColumn("_source", F.when(own, F.col("_source")).otherwise(F.concat(F.lit(prefix), F.pmod(F.xxhash64("_source"), F.lit(MAX_QUEUES)))))
    id_type = rows.schema["_id"].dataType

    def encode(batches):
        from pyspark import TaskContext

        part, encoder, seen = TaskContext.get().partitionId(), tokens.encoder_of(blob.value), {}
        for batch in batches:
            for lo, hi, flat, at in encoder.slices(batch.column(1)):
                flat, n = np.insert(flat, at[1:], np.uint32(end_id)), (np.diff(at) + 1).astype(np.int64)
                starts = []
                for s, k in zip(batch.column(2).slice(lo, hi - lo).to_pylist(), n.tolist(), strict=True):
                    starts.append(seen.get(s, 0))
                    seen[s] = starts[-1] + k
                width = 2 if int(flat.max()) < 1 << 16 else 4
                ends = np.append(0, np.cumsum(n)).astype(np.int32) * width
                ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([part] * (hi - lo), pa.int32()), pa.array(starts, pa.int64()), pa.array(n), pa.array([width] * (hi - lo), pa.int32()), ids], ["_id", "_source", "_part", "_start", "_n", "_width", "_ids"])

    made = common.written(common.per_batch(rows, encode, f"_id {id_type.simpleString()}, _source string, _part int, _start bigint, _n bigint, _width int, _ids binary"), "pack-ids")
    parts = common.checkpointed(made.groupBy("_part", "_source").agg(F.sum("_n").alias("n")))
    totals = {r[0]: r[1] for r in parts.groupBy("_source").agg(F.sum("n")).collect()}  # MAX_QUEUES + 1 rows at most, and one for each share
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    named = [Fraction(shares.get(s or "", 0)).limit_denominator(10**6) for s in names] if shares else None
    plan = Schedule([totals[s] for s in names], named, seq_len)
    number = spark.sparkContext.broadcast({s: i for i, s in enumerate(names)})
    starts = parts.select("_part", F.col("_source").alias("_s"), (F.sum("n").over(Window.partitionBy("_source").orderBy("_part")) - F.col("n")).alias("_base"))
    starts = starts.withColumnRenamed("_part", "_p")
    if parts.count() <= MAX_BROADCAST_STARTS:
        starts = F.broadcast(starts)
    placed = made.join(starts, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s"))).select("_id", "_source", (F.col("_base") + F.col("_start")).alias("_at"), "_n", "_width", "_ids")

    def cut(batches):
        for batch in batches:
            ids, sources, ats, widths, blobs = (batch.column(i) for i in (0, 1, 2, 4, 5))
            row, out, crcs = [], [], []
            for i, (s, at, width, x) in enumerate(zip(sources.to_pylist(), ats.to_pylist(), widths.to_pylist(), blobs.to_pylist(), strict=True)):
                x = np.frombuffer(x, f"<u{width}").astype("<u4")
                for p in plan.pieces(number.value[s], at, len(x)):
                    row.append(i)
                    out.append((p[0], p[1], len(x), p[2], p[3]))
                    crcs.append(zlib.crc32(x[p[0] : p[0] + p[1]].tobytes()))
            a = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *map(pa.array, (a[:, 0], a[:, 1], np.array(crcs, np.int64), a[:, 2], a[:, 3], a[:, 4])), sources.take(pa.array(row, pa.int64()))], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    return common.per_batch(placed, cut, f"`{id_col}` {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue string")
