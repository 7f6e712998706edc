"""N-gram Jaccard self-join by MinHash banding, with links verified on full n-gram sets."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Texts and n-grams of a block: what one verification task holds of one side.
BLOCK_TEXTS, BLOCK_GRAMS = 256, 500_000


def bands_for(threshold: float, recall: float = 0.999, most: int = 128) -> tuple[int, int]:
    """(bands, rows) with the most rows, so the fewest false candidates, that find a pair at the threshold with
    probability `recall` and use at most `most` hashes."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = 1
        while 1 - (1 - threshold**rows) ** bands < recall and bands * rows <= most:
            bands += 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def grams(words: common.Words, text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams: words are runs without white space, in lower case. A text of fewer
    words is one n-gram; a text of none has none."""
    return np.unique(common.shingles(words.of((text or "").lower().split()), n))


def signatures(rows: DataFrame, n: int, bands: int, r: int) -> DataFrame:
    """_id, digest of the n-gram set (null if empty), hash of each band, number of n-grams."""
    rng = np.random.RandomState(7)
    a, b = (rng.randint(0, 1 << 32, bands * r, np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
    turn = np.array([xxhash.xxh3_64_intdigest(f"band {i}") for i in range(bands)], np.uint64)

    def sign(batches):
        words = common.Words()
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                sets, start, size = [], at, 0
                while at < len(texts) and size < common.FLAT_WORDS:
                    sets.append(grams(words, texts[at], n))
                    size, at = size + len(sets[-1]), at + 1
                full = [x for x in sets if len(x)]
                digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                keys = np.zeros((0, bands), np.int64)
                if full:
                    flat = (common.mixed(np.concatenate(full)) >> np.uint64(32)).astype(np.uint32)
                    ends = np.cumsum([0, *map(len, full)])[:-1]
                    h = np.zeros((len(full), bands), np.uint64)
                    for i in range(bands * r):
                        low = np.minimum.reduceat(flat * a[i] + b[i], ends).astype(np.uint64)
                        h[:, i // r] = common.mixed(h[:, i // r] * np.uint64(0xD6E8FEB86659FD93) + low + np.uint64(1))
                    keys = (h ^ turn).astype(np.int64)
                offsets = np.cumsum([0, *(bands * bool(len(x)) for x in sets)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel(), pa.int64())), pa.array([len(x) for x in sets], pa.int64())], ["_id", "_set", "_bands", "_grams"])

    return common.per_batch(rows, sign, f"_id {rows.schema['_id'].dataType.simpleString()}, _set binary, _bands array<bigint>, _grams bigint")


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of sets with each of others."""
    if len(sets) * len(others) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in others] for x in sets], np.int64)
    both = [*sets, *others]
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, gram = np.unique(np.concatenate(both), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    out = np.zeros((len(sets), len(others)), np.float64)
    width = 4096
    for low in range(0, int(gram[-1]) + 1, width):
        i, j = np.searchsorted(gram, (low, low + width))
        m = np.zeros((len(both), width), np.float32)
        m[row[i:j], gram[i:j] - low] = 1
        out += m[: len(sets)] @ m[len(sets) :].T
    return out.astype(np.int64)


def links(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id and n-gram set: id, class_id (least id of its connected component), n_links (rows with another id
    or text whose Jaccard similarity is the threshold or more), n_grams.

    Texts with equal n-gram sets are one node, so a group of copies costs one comparison however large it is. Nodes
    that share a band form candidate groups by stars to the least node, never by pairs. A group's nodes are compared in
    blocks, each pair of blocks in one task, which emits counts and a spanning forest of stars and no pairs; only the forests of
    groups of several blocks are put together. Every pair of a group is verified, so links are lost only with the banding's miss rate (1 - recall at the threshold).

    A text without words, or a row with a null id, links to nothing and is its own class (null ids: a null class).
    An empty table gives no rows.
    """
    exact = Fraction(str(threshold))
    bands, r = bands_for(threshold, recall)
    rows = common.keyed(docs, id_col, text_col)
    id_type = rows.schema["_id"].dataType.simpleString()
    signed = common.written(signatures(rows, n, bands, r), "near-signatures")
    sets = signed.filter("_set is not null and _id is not null").groupBy("_set").agg(F.min("_id").alias("_least"), F.count("*").alias("_copies"), F.first("_bands").alias("_bands"), F.first("_grams").alias("_grams"))
    banded = sets.select("_set", F.explode("_bands").alias("_band"))
    shared = banded.groupBy("_band").agg(F.min("_set").alias("_low"), F.count("*").alias("_n")).filter("_n > 1").select("_band", "_low")
    shared = common.checkpointed(shared)  # both sides are plain tables then, so Spark splits the rows of a hot band
    stars = banded.join(shared, "_band").filter("_set > _low").select(F.col("_set").alias("a"), F.col("_low").alias("b"))
    groups = common.components(stars)
    nodes = groups.join(sets.select("_set", "_least", "_copies", "_grams"), F.col("node") == F.col("_set"))
    blocks = nodes.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("_grams") / BLOCK_GRAMS)).cast("int").alias("_nb"))
    nodes = common.checkpointed(nodes.join(blocks, "root").select("root", "node", "_least", "_copies", "_nb", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int").alias("_block")))

    def with_grams(batches):
        words = common.Words()
        for batch in batches:
            texts, wanted = batch.column("_text").to_pylist(), batch.column("node").to_pylist()
            for i, (t, w) in enumerate(zip(texts, wanted, strict=True)):
                x = grams(words, t, n)
                if xxhash.xxh3_128_digest(x.tobytes()) == w:  # else another row with this id
                    nb, own = batch.column("_nb")[i].as_py(), batch.column("_block")[i].as_py()
                    k = nb
                    one = [batch.column(c).slice(i, 1).take(pa.array([0] * k)) for c in ("root", "node", "_copies", "_nb", "_block")]
                    yield pa.RecordBatch.from_arrays([*one, pa.array([min(own, j) for j in range(nb)], pa.int32()), pa.array([max(own, j) for j in range(nb)], pa.int32()), pa.array([x.tobytes()] * k, pa.binary())], ["root", "node", "copies", "nb", "block", "i", "j", "grams"])

    def verify(batches):
        def close(members):
            members = list(dict((m[0], m) for m in members).values())
            first = [m for m in members if m[3] == key[1]]
            second = [m for m in members if m[3] == key[2]] if key[1] != key[2] else first
            if not first or not second:
                return
            x, y = ([np.frombuffer(m[4], np.uint64) for m in side] for side in (first, second))
            inter = _overlaps(x, y)
            nx, ny = np.array([len(g) for g in x]), np.array([len(g) for g in y])
            near = inter * exact.denominator >= exact.numerator * (nx[:, None] + ny[None, :] - inter)
            if first is second:
                near &= ~np.eye(len(first), dtype=bool)
            counts: dict[bytes, int] = {}
            wx, wy = np.array([m[1] for m in first]), np.array([m[1] for m in second])
            for m, w in zip(first, near.astype(np.int64) @ wy, strict=True):
                counts[m[0]] = counts.get(m[0], 0) + int(w)
            if first is not second:
                for m, w in zip(second, near.T.astype(np.int64) @ wx, strict=True):
                    counts[m[0]] = counts.get(m[0], 0) + int(w)
            up: dict[bytes, bytes] = {}

            def top(v):
                while up.get(v, v) != v:
                    up[v] = up.get(up[v], up[v])
                    v = up[v]
                return v

            for p, q in zip(*np.nonzero(near), strict=True):
                u, v = top(first[p][0]), top(second[q][0])
                if u != v:
                    up[max(u, v)] = min(u, v)
            whole = members[0][2] == 1  # a group of one block: its classes are known here
            edges.extend((v, top(v), 0, whole) for v in list(up))
            edges.extend((k, None, w, whole) for k, w in counts.items() if w)

        def batch_of(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], ["a", "b", "w", "whole"])

        key, members, edges = None, [], []
        for batch in batches:
            for root, node, copies, nb, block, i, j, g in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if (root, i, j) != key:
                    if members:
                        close(members)
                    key, members = (root, i, j), []
                members.append((node, copies, nb, block, g))
            if edges:
                yield batch_of(edges)
                edges.clear()
        if members:
            close(members)
        if edges:
            yield batch_of(edges)

    texts = rows.join(nodes.withColumnRenamed("_least", "_want"), F.col("_id") == F.col("_want")).select("_text", "root", "node", "_copies", "_nb", "_block")
    gathered = common.per_batch(texts, with_grams, "root binary, node binary, copies bigint, nb int, block int, i int, j int, grams binary").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = common.checkpointed(common.per_batch(gathered, verify, "a binary, b binary, w bigint, whole boolean"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("_node")).agg(F.sum("w").alias("_w"))
    linked = found.filter("b is not null")
    known = linked.filter("whole").select("a", "b")  # stars already
    classes = common.components(linked.filter("not whole").select("a", "b")).union(known.union(known.select("b", "b").distinct()))
    least = classes.join(nodes.select("node", "_least"), "node").groupBy("root").agg(F.min("_least").alias("_class"))
    classes = classes.join(least, "root").select(F.col("node").alias("_node"), "_class").join(counts, "_node")
    per_set = sets.select("_set", "_least", "_copies").join(classes, F.col("_set") == F.col("_node"), "left").select("_set", F.coalesce("_class", "_least").alias("class_id"), (F.col("_copies") - 1 + F.coalesce("_w", F.lit(0))).alias("n_links"))
    per_set = common.checkpointed(per_set)  # so that Spark splits the rows of a large group of copies
    out = signed.withColumn("_key", F.when(F.col("_id").isNotNull(), F.col("_set"))).join(per_set.withColumnRenamed("_set", "_s"), F.col("_key") == F.col("_s"), "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("class_id", F.col("_id")).cast(id_type).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("_grams").alias("n_grams"))


def keep_first(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose class has a smaller id: one document of each group stays. Rows that share an id stay
    together if one of their texts leads its class; rows with a null id stay."""
    gone = links(docs, n, threshold, id_col=id_col, text_col=text_col).groupBy(F.col(common.quoted(id_col)).alias("__sw_gone")).agg(F.min(F.col("class_id") < F.col(common.quoted(id_col))).alias("_all")).filter("_all").select("__sw_gone")
    return docs.join(gone, docs[common.quoted(id_col)] == F.col("__sw_gone"), "left_anti")
