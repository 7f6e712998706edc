"""Fill-in-middle: cuts texts in prefix, middle and suffix and reorders them, whole batches at once.

Units are runs of ASCII letters and single other characters. A table gives each UTF-8 byte's class; where a unit starts
follows from adjacent bytes; running sums that start anew with each text number the units, and one searchsorted finds the
cuts of all rows. Texts are never decoded, and the outputs' bytes are copied by one Arrow take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .segments import LATER, LETTER
from .tokens import SLICE_BYTES

MARKERS = ("<P>", "<S>", "<M>")
FORMS = pa.array(["plain", "psm", "spm"])
_class = np.where(LATER, 2, np.where(LETTER, 1, 0)).astype(np.uint8)


def units(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, characters) that have started up to each byte, over all texts of a batch."""
    kind = _class[x]
    char = kind != 2
    letter = kind == 1
    start = char.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.cumsum(start, dtype=np.int32), np.cumsum(char, dtype=np.int32)


def reordered(texts: pa.Array, h: np.ndarray, plain_pct: int, spm_pct: int, markers: tuple[str, str, str]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts; h: four rows of hashes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    buffer = texts.buffers()[2].slice(first, size) if size else pa.py_buffer(b"")
    offsets = offsets - np.int32(first)
    started, chars = units(np.frombuffer(buffer, np.uint8), offsets)
    before = np.append(0, started)[offsets].astype(np.int64)
    n = np.diff(before)
    held = np.zeros(len(texts), bool)
    for m in markers:
        held |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
    plain = (n == 0) | held | (h[2] % 100 >= 100 - plain_pct)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    # The byte where unit k of a text starts; the end of the text for k = n.
    low, high = (np.searchsorted(started, before[:-1] + k + 1).astype(np.int32) for k in (np.minimum(one, two), np.maximum(one, two)))
    low, high = (np.where(plain, offsets[1:], np.minimum(k, offsets[1:])) for k in (low, high))
    seen = np.append(0, chars)
    form = np.where(plain, 0, np.where(h[3] % 100 < spm_pct, 2, 1))
    pieces = pa.Array.from_buffers(pa.string(), 3 * len(n), [None, pa.py_buffer(np.append(np.stack([offsets[:-1], low, high], 1).ravel(), offsets[-1]).astype(np.int32)), buffer])
    k = len(pieces)
    p, m, s = (3 * np.arange(len(n)) + i for i in range(3))
    mark = {name: np.full(len(n), k + i) for i, name in enumerate("PSM")}
    none = np.full(len(n), k + 3)
    order = np.stack([np.stack([p, none, none, none, none, none], 1), np.stack([mark["P"], p, mark["S"], s, mark["M"], m], 1), np.stack([mark["S"], s, mark["P"], p, mark["M"], m], 1)])
    taken = pa.concat_arrays([pieces, pa.array([*markers, ""])]).take(pa.array(order[form, np.arange(len(n))].ravel()))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    output = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(ends[::6].copy()), taken.buffers()[2]])
    count = lambda a, b: pa.array(np.where(plain, 0, seen[b] - seen[a]).astype(np.int64), mask=plain)
    return [pa.array(n), FORMS.take(pa.array(form)), count(offsets[:-1], low), count(low, high), output]


def transform(docs: DataFrame, seed: int = 1, plain_pct: int = 10, spm_pct: int = 20, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n (units), form, prefix_chars, middle_chars, output.

    The cuts are two numbers of units that the digest of `seed:id` gives, the lesser first; a further number leaves
    plain_pct of the texts plain, and one makes spm_pct of the others suffix first. A text that is empty or holds a marker
    is plain, with null lengths. A null text is empty, a null id hashes as no characters; repeated rows get equal rows;
    an empty table gives no rows. No row is shuffled.
    """
    rows = common.keyed(docs, id_col, text_col)
    id_type = rows.schema["_id"].dataType
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    rows = rows.select("_id", F.coalesce("_text", F.lit("")).alias("_text"), digest.alias("_digest"))
    rows = rows.select("_id", "_text", *(F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)))
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

    def kernel(batches):
        for batch in batches:
            ends, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy()), 0
            while at < len(ends):  # bounded slices, or one long text
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                part = batch.slice(at, upto - at)
                h = np.stack([part.column(2 + i).to_numpy() for i in range(4)])
                yield pa.RecordBatch.from_arrays([part.column(0), *reordered(part.column(1), h, plain_pct, spm_pct, markers)], names)
                at = upto

    return common.per_batch(rows, kernel, f"{common.quoted(id_col)} {id_type.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of. Only markers that transform wrote are in an output that isn't plain."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
