"""Best-fit packing by hierarchical residual packing: documents into as few sequences as possible, none cut that fits.

Each task best-fits what it has read; bins that are nearly full are done, and the others become items of their parent in
a tree of nodes, which best-fits them again, and so on to the root. Items of one size are interchangeable, so a node is
given as counts by size, at most `seq_len` of them however many bins there are, and its packing is a short list of moves.
A document finds its place from the counts of the nodes above it: no row of it ever meets the others'.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, segments, tokens

#: A unit is what a task packs at once: it ends with the batch that brings its rows or pieces to these numbers.
UNIT_ROWS, UNIT_PIECES = 1 << 16, 1 << 21
#: A unit's number is its task's and the unit's within it; a sequence's is a level's, the node's first unit's and the
#: bin's, which are at most 2**24 for each unit below the node.
UNIT_BITS, BIN_BITS, LEVEL_BITS = 14, 24, 60
FAN_BITS = 6
RANK = 1 << 40


@dataclass
class Plan:
    """moves: item size, first rank among items of the size, items in a bin, first bin, fill before it; in order of
    (size, rank). runs: first bin, fill, whether done, rank of the first bin among those of its fill that aren't."""

    moves: np.ndarray
    runs: np.ndarray
    bins: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset in it) of items."""
        m = self.moves
        i = np.searchsorted(m[:, 0] * RANK + m[:, 1], size * RANK + rank, side="right") - 1
        at = rank - m[i, 1]
        return m[i, 3] + at // m[i, 2], m[i, 4] + at % m[i, 2] * size

    def state(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fill, done, rank among the bins of that fill that aren't done) of bins."""
        r = self.runs
        i = np.searchsorted(r[:, 0], bins, side="right") - 1
        return r[i, 1], r[i, 2] == 1, r[i, 3] + bins - r[i, 0]

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """Fills, and how many bins that aren't done have each."""
        n = np.diff(np.append(self.runs[:, 0], self.bins))
        rest = self.runs[:, 2] == 0
        total = np.bincount(self.runs[rest, 1], n[rest]).astype(np.int64) if rest.any() else np.zeros(0, np.int64)
        fills = np.flatnonzero(total)
        return fills, total[fills]


def best_fit(sizes: np.ndarray, counts: np.ndarray, seq_len: int, done: int) -> Plan:
    """Best fit of items, larger ones first: each goes to the fullest bin that holds it. Bins of one fill, and the items
    of one size that go to them, are handled together. Bins of `done` tokens or more are done."""
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(seq_len + 1)]  # by room: (first bin, bins)
    mask, bins, moves = 0, 0, []

    def put(room: int, first: int, n: int) -> None:
        nonlocal mask
        if n:
            open_bins[room].append((first, n))
            mask |= 1 << room

    for i in np.argsort(-sizes):
        size, left, rank = int(sizes[i]), int(counts[i]), 0
        while left:
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    mask &= ~(1 << room)
            else:
                room, first, n = seq_len, bins, -(-left // (seq_len // size))
                bins += n
            each = room // size
            whole = min(n, left // each)
            if whole:
                moves.append((size, rank, each, first, seq_len - room))
                put(room - each * size, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left:  # too few to fill another bin as full
                moves.append((size, rank, left, first + whole, seq_len - room))
                put(room - left * size, first + whole, 1)
                whole, left = whole + 1, 0
            put(room, first + whole, n - whole)
    runs, seen = [], {}
    for first, n, fill in sorted((first, n, seq_len - room) for room, of in enumerate(open_bins) for first, n in of):
        runs.append((first, fill, int(fill >= done), seen.get(fill, 0)))
        seen[fill] = seen.get(fill, 0) + n
    order = np.array(sorted(moves), np.int64).reshape(-1, 5)
    return Plan(order, np.array(runs, np.int64).reshape(-1, 4), bins)


def first_piece(n: np.ndarray, seq_len: int) -> np.ndarray:
    """Tokens of a document's first piece; all others have seq_len."""
    return (n - 1) % seq_len + 1


def plan_of(size: np.ndarray, seq_len: int, done: int) -> Plan:
    counts = np.bincount(size)
    sizes = np.flatnonzero(counts)
    return best_fit(sizes, counts[sizes], seq_len, done)


def ranks(size: np.ndarray) -> np.ndarray:
    """Each item's rank among those of its size, in the order given."""
    order = np.argsort(size, kind="stable")
    of = size[order]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    out = np.empty(len(size), np.int64)
    out[order] = np.arange(len(size)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    return out


def shifts(most_unit: int, most_part: int) -> list[int]:
    """For each level of the tree the bits of a unit's number that its nodes leave out."""
    out, bits = [0], 0
    while most_unit >> bits:  # the units of a task meet first
        bits += FAN_BITS
        out.append(min(bits, UNIT_BITS))
    bits = UNIT_BITS
    while most_part >> (bits - UNIT_BITS):
        bits += FAN_BITS
        out.append(bits)
    return out if len(out) > 1 else [0, FAN_BITS]


def pack(docs: DataFrame, vocabulary: str, seq_len: int = 1024, end_id: int = 2, slack: int = 4, with_ids: bool = False, unit_rows: int = UNIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the piece's ids.

    A document is its text's ids (a null text has none) and end_id, and one piece if it has at most seq_len; a longer one
    is cut into pieces of seq_len after a first that may be shorter. Sequences are gapless from offset 0. A bin with at
    most `slack` tokens of room is done; other bins go up the tree, which starts from units of unit_rows documents or little more. Null ids and repeated rows are packed like others; an
    empty table gives no rows.

    Texts are encoded once and never move: lengths and digests (and with_ids the ids) are written and dealt by unit, which
    a task reads together, with the counts of the nodes above it.
    """
    spark = docs.sparkSession
    data, kind = tokens.load(vocabulary)
    blob = spark.sparkContext.broadcast({"data": data, "kind": kind})
    rows = common.keyed(docs, id_col, text_col)
    id_type = rows.schema["_id"].dataType.simpleString()
    done = seq_len - slack
    names = ["_unit", "_row", "_id", "_n", "_crcs", "_ids", "_fills", "_counts"]

    def encode(batches):
        from pyspark import TaskContext

        encoder, part = segments.encoder_of(blob.value), TaskContext.get().partitionId()
        if part >> (LEVEL_BITS - BIN_BITS - UNIT_BITS):
            raise ValueError(f"more than {1 << (LEVEL_BITS - BIN_BITS - UNIT_BITS)} partitions of documents")
        unit, row, pieces, sizes = 0, 0, 0, []

        def summary():
            fills, counts = plan_of(np.concatenate(sizes), seq_len, done).left()
            head = pa.array([part << UNIT_BITS | unit], pa.int64())
            gone = [pa.nulls(1, t) for t in (pa.int32(), ids.type, pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([head, *gone, pa.array([fills.tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int64()))], names)

        for batch in batches:
            ids = batch.column(0)
            for lo, hi, flat, at in encoder.slices(batch.column(1)):
                flat, n = np.insert(flat, at[1:], np.uint32(end_id)).astype("<u4"), np.diff(at) + 1
                ends = np.append(0, np.cumsum(n))
                first = first_piece(n, seq_len)
                bytes_, crcs = memoryview(flat).cast("B"), []
                for s, e, f in zip((4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist(), (4 * first).tolist(), strict=True):
                    cuts = [s, *range(s + f, e + 1, 4 * seq_len)]
                    crcs.append(np.array([zlib.crc32(bytes_[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], "<u4").tobytes())
                whole = pa.array([bytes_[a:b] for a, b in zip((4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist(), strict=True)], pa.binary()) if with_ids else pa.nulls(hi - lo, pa.binary())
                number = pa.array([part << UNIT_BITS | unit] * (hi - lo), pa.int64())
                yield pa.RecordBatch.from_arrays([number, pa.array(np.arange(row, row + hi - lo, dtype=np.int32)), ids.slice(lo, hi - lo), pa.array(n), pa.array(crcs, pa.binary()), whole, pa.nulls(hi - lo, pa.list_(pa.int32())), pa.nulls(hi - lo, pa.list_(pa.int64()))], names)
                sizes.append(first)
                row, pieces = row + hi - lo, pieces + int((-(-n // seq_len)).sum())
                if row >= unit_rows or pieces >= UNIT_PIECES:
                    yield summary()
                    unit, row, pieces, sizes = unit + 1, 0, 0, []
                    if unit >> UNIT_BITS:
                        raise ValueError(f"more than {1 << UNIT_BITS} units in a partition of documents")
        if sizes:
            yield summary()

    made = common.written(common.per_batch(rows, encode, f"_unit bigint, _row int, _id {id_type}, _n bigint, _crcs binary, _ids binary, _fills array<int>, _counts array<bigint>"), "best-fit")
    units = made.filter(F.col("_row").isNull())
    most = units.agg(F.max(F.col("_unit").bitwiseAND((1 << UNIT_BITS) - 1)), F.max(F.shiftright("_unit", UNIT_BITS))).first()
    left = shifts(most[0] or 0, most[1] or 0)
    above = _tree(units, left, seq_len, done)

    def place(pieces: pa.Table, nodes: pa.Table) -> pa.Table:
        return _placed(pieces.sort_by("_row"), nodes.to_pylist(), left, seq_len, done, with_ids, id_col)

    schema = f"{common.quoted(id_col)} {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + (", ids array<bigint>" if with_ids else "")
    items = made.filter(F.col("_row").isNotNull()).select("_unit", "_row", "_id", "_n", "_crcs", *(["_ids"] if with_ids else []))
    return items.groupBy("_unit").cogroup(above.groupBy("_below")).applyInArrow(place, schema)


def _tree(units: DataFrame, left: list[int], seq_len: int, done: int) -> DataFrame:
    """(unit below, level, ranks before its child's bins by fill, the node's counts by fill) of every node above every unit."""
    node = lambda level: F.shiftright("_unit", left[level])
    bins = units.select(F.col("_unit").alias("_child"), F.explode(F.arrays_zip(F.col("_fills").alias("f"), F.col("_counts").alias("n"))).alias("x")).select("_child", F.col("x.f").alias("_fill"), F.col("x.n").alias("_n"))
    out = []
    for level in range(1, len(left)):
        last = level == len(left) - 1
        parent: Column = F.shiftright("_child", left[level] - left[level - 1])
        bins = bins.select(parent.alias("_node"), "_child", "_fill", "_n")
        before = F.sum("_n").over(Window.partitionBy("_node", "_fill").orderBy("_child")) - F.col("_n")
        bases = bins.withColumn("_base", before).groupBy("_child").agg(F.collect_list(F.struct(F.col("_fill").alias("f"), F.col("_base").alias("n"))).alias("_bases"))
        held = common.checkpointed(bins.groupBy("_node", "_fill").agg(F.sum("_n").alias("_n")))
        counts = held.groupBy("_node").agg(F.collect_list(F.struct(F.col("_fill").alias("f"), F.col("_n").alias("n"))).alias("_held"))
        paths = units.select("_unit", node(level - 1).alias("_child"), node(level).alias("_node"))
        out.append(paths.join(bases, "_child").join(counts, "_node").select(F.col("_unit").alias("_below"), F.lit(level).alias("_level"), "_bases", "_held"))
        if not last:

            def again(t: pa.Table) -> pa.Table:
                fills, n = best_fit(t.column("_fill").to_numpy(), t.column("_n").to_numpy(), seq_len, done).left()
                return pa.table({"_child": pa.array([t.column("_node")[0].as_py()] * len(fills), pa.int64()), "_fill": pa.array(fills, pa.int32()), "_n": pa.array(n, pa.int64())})

            bins = common.checkpointed(held.groupBy("_node").applyInArrow(again, "_child bigint, _fill int, _n bigint"))
    everything = out[0]
    for more in out[1:]:
        everything = everything.union(more)
    return everything


def _placed(items: pa.Table, nodes: list[dict], left: list[int], seq_len: int, done: int, with_ids: bool, id_col: str) -> pa.Table:
    """The pieces of a unit's documents, which are in order. nodes: those above it that bins of it have come to."""
    unit, n = items.column("_unit")[0].as_py(), items.column("_n").to_numpy()
    first, k = first_piece(n, seq_len), -(-n // seq_len)
    by_level = {x["_level"]: x for x in nodes}
    plan = plan_of(first, seq_len, done)
    at, offset = plan.place(first, ranks(first))
    sequence = np.empty(len(n), np.int64)
    here, level, bins = np.arange(len(n)), 0, at
    while len(here):
        root = level == len(left) - 1
        fill, full, rank = plan.state(bins)
        full = full | root
        base = level << LEVEL_BITS | (unit >> left[level] << left[level]) << BIN_BITS
        sequence[here[full]] = base + bins[full]
        here, fill, rank = here[~full], fill[~full], rank[~full]
        level += 1
        if len(here):
            before, held = np.zeros(seq_len + 1, np.int64), by_level[level]["_held"]
            for x in by_level[level]["_bases"]:
                before[x["f"]] = x["n"]
            plan = best_fit(np.array([x["f"] for x in held], np.int64), np.array([x["n"] for x in held], np.int64), seq_len, done)
            bins, more = plan.place(fill, rank + before[fill])
            offset[here] += more
    # The pieces after the first fill sequences of their own, numbered after the unit's bins.
    doc = np.repeat(np.arange(len(n)), k)
    ends = np.cumsum(k)
    piece = np.arange(len(doc)) - np.repeat(ends - k, k)
    head = piece == 0
    start = np.where(head, 0, first[doc] + (piece - 1) * seq_len)
    length = np.where(head, first[doc], seq_len)
    own = (unit << BIN_BITS) + plan_of(first, seq_len, done).bins + np.cumsum(~head) - 1
    crcs = np.frombuffer(b"".join(items.column("_crcs").to_pylist()), "<u4")
    out = {id_col: items.column("_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": crcs.astype(np.int64), "sequence_id": np.where(head, sequence[doc], own), "offset": np.where(head, offset[doc], 0)}
    if with_ids:
        flat = np.frombuffer(b"".join(items.column("_ids").to_pylist()), "<u4").astype(np.int64)
        out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(flat))
    return pa.table(out)
