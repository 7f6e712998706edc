"""Line dedup: two Bloom filters over line hashes, and an exact check of what they suspect."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bloom import MAX_BITS, SEGMENT, bits_for, holds, places, put, unpacked, whole

SPACE = " \t\n\x0b\x0c\r"


def keys(text: str, min_chars: int) -> list[bytes | None]:
    """Each line's key, None where it is too short to count: stripped, with A-Z in lower case."""
    out = []
    for line in text.split("\n"):
        line = line.strip(SPACE)
        out.append(line.encode("utf-8", "surrogatepass").lower() if len(line) >= min_chars else None)
    return out


def hashes_of(ids: list, texts: list, min_chars: int) -> np.ndarray:
    """Hashes of each document's distinct keys. A row without an id takes no part."""
    return np.array([xxhash.xxh3_64_intdigest(k) for i, t in zip(ids, texts, strict=True) if i is not None and t for k in {*keys(t, min_chars)} if k is not None], np.uint64)


def twice_seen(rows: DataFrame, bits: int, min_chars: int) -> bytes:
    """The filter of hashes seen twice or more. Each task fills its own pair; pairs meet as (a|b, c|d|(a&b))."""

    def fill(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h, n = np.unique(hashes_of(batch.column(0).to_pylist(), batch.column(1).to_pylist(), min_chars), return_counts=True)
            if len(h):
                at = places(h, bits)
                put(twice, at[:, (n > 1) | holds(once, at)])
                put(once, at)
        for s in range(0, bits // 8, SEGMENT // 8):
            a, b = once[s : s + SEGMENT // 8], twice[s : s + SEGMENT // 8]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([zlib.compress(a.tobytes(), 1)]), pa.array([zlib.compress(b.tobytes(), 1)])], ["_at", "_once", "_twice"])

    def meet(batches):
        met: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = (unpacked(x) for x in (a, b))
                if s in met:
                    met[s][1] |= b | (met[s][0] & a)
                    met[s][0] |= a
                else:
                    met[s] = [a.copy(), b.copy()]
        for s, (_, b) in met.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([zlib.compress(b.tobytes(), 1)])], ["_at", "_twice"])

    filled = common.per_batch(rows, fill, "_at bigint, _once binary, _twice binary").repartition("_at")
    return whole(common.per_batch(filled, meet, "_at bigint, _twice binary"), bits)


def dedup(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", into: str = "_lines", max_bits: int = MAX_BITS) -> DataFrame:
    """docs with a struct column `into`: kept (the text left), n_lines (before), n_dropped. A column of that name gives
    way; all others, whatever their names, go through.

    A key of min_chars code points or more that lies in two documents or more loses all its lines but those in the
    document with the least id. A null or empty text is one empty line. Rows that share an id are one document. A row
    with a null id keeps its lines and repeats nothing. Ties can't arise; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = common.keyed(docs, id_col, text_col)
    n = rows.agg(F.sum(F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = bits_for(int(n), max_bits)
    suspects_of = spark.sparkContext.broadcast(twice_seen(rows, bits, min_chars))
    id_type = rows.schema["_id"].dataType.simpleString()

    def probe(batches):
        bitmap = np.frombuffer(suspects_of.value, np.uint8)
        for batch in batches:
            at, found = [], []
            for i, (d, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = [k for k in {*keys(t, min_chars)} if k is not None] if d is not None and t else []
                if own:
                    hit = holds(bitmap, places(np.array([xxhash.xxh3_64_intdigest(k) for k in own], np.uint64), bits))
                    found += [k for k, x in zip(own, hit, strict=True) if x]
                    at += [i] * int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0).take(pa.array(at, pa.int64()))], ["_key", "_id"])

    suspects = common.written(common.per_batch(rows, probe, f"_key binary, _id {id_type}"), "line-suspects")
    repeats = suspects.groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last").select("_key", "_first")
    repeats = common.written(repeats, "line-repeats")  # both sides are plain tables then, so Spark splits the rows of a hot line
    drops = suspects.join(repeats, "_key").filter("_id > _first").groupBy(F.col("_id").alias("__sw_drop_id")).agg(F.collect_set("_key").alias("__sw_drops"))

    @F.arrow_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
    def without(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, lines, dropped = [], [], []
        for t, d in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
            t = t or ""
            all_lines, d = t.split("\n"), set(d or ())
            left = [x for x, k in zip(all_lines, keys(t, min_chars), strict=True) if k not in d] if d else all_lines
            kept.append("\n".join(left))
            lines.append(len(all_lines))
            dropped.append(len(all_lines) - len(left))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["kept", "n_lines", "n_dropped"])

    out = docs.join(drops, docs[common.quoted(id_col)] == F.col("__sw_drop_id"), "left")
    return out.select(*[docs[common.quoted(c)] for c in docs.columns if c != into], without(docs[common.quoted(text_col)].cast("string"), F.col("__sw_drops")).alias(into))
