"""Bloom filters of 64-bit hashes: filled by each task, met segment by segment, of a bounded size."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Filters have 8 to 16 bits a key up to this many bits (32 MB), which bounds what is broadcast. Beyond it they let more
#: pass in vain; whoever uses them checks what passes.
MAX_BITS, SEGMENT, PROBES = 1 << 28, 1 << 20, 3


def bits_for(n: int, most: int = MAX_BITS) -> int:
    return min(most, max(SEGMENT, 1 << (8 * n).bit_length()))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers of each hash."""
    step = common.mixed(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())


def segments(bitmap: np.ndarray):
    """(offset, compressed bytes) of each segment that isn't empty."""
    for s in range(0, len(bitmap), SEGMENT // 8):
        if (part := bitmap[s : s + SEGMENT // 8]).any():
            yield s, zlib.compress(part.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def whole(parts: DataFrame, bits: int) -> bytes:
    """The filter of rows (offset, compressed bytes), one for each segment: bits / 8 bytes at most."""
    out = np.zeros(bits // 8, np.uint8)
    for at, data in parts.collect():
        x = unpacked(data)
        out[at : at + len(x)] = x
    return out.tobytes()


def of(keys: DataFrame, most: int = MAX_BITS) -> tuple[bytes, int]:
    """(filter, bits) of keys' only column."""
    hashes = keys.select(F.xxhash64(keys.columns[0]).alias("_h"))
    bits = bits_for(hashes.count(), most)

    def fill(batches):
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            put(bitmap, places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
        for s, data in segments(bitmap):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([data])], ["_at", "_bits"])

    def meet(batches):
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                met[s] = met[s] | unpacked(data) if s in met else unpacked(data)
        for s, x in met.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1)])], ["_at", "_bits"])

    schema = "_at bigint, _bits binary"
    return whole(common.per_batch(common.per_batch(hashes, fill, schema).repartition("_at"), meet, schema), bits), bits


def possible(df: DataFrame, key: str, keys: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """df without most of the rows whose key isn't among keys' only column: what a join would drop needs no shuffle.
    Only hashes of keys go to Python."""
    bitmap, bits = of(keys, most)
    held = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf(T.BooleanType())
    def maybe(hashes: pa.Array) -> pa.Array:
        return pa.array(holds(np.frombuffer(held.value, np.uint8), places(hashes.to_numpy(zero_copy_only=False).view(np.uint64), bits)))

    return df.filter(maybe(F.xxhash64(key)))
