"""Text: JSON texts of rows, terms, token estimates, cutting, matching."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no meaning in a task, and in a target.
TASK_STOPWORDS = "a an and are as at be by for from how in is it of on or the this to what with".split()
TARGET_STOPWORDS = "a an and are as at by for from in of on or the to with".split()


def has_any(text: Column, needles: list[str]) -> Column:
    """Whether the text has one of the needles in it. One pattern of all, so that the text is made once for a row."""
    return text.rlike("|".join(map(re.escape, needles))) if needles else F.lit(False)


def quoted(x: Column) -> Column:
    """A JSON string of text without control characters or characters beyond ASCII."""
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def json_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON of already rendered values: keys in order, ', ' and ': ' between; null columns are left out."""
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_strings(values: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(values, quoted)), F.lit("]"))


def or_null(rendered: Column) -> Column:
    return F.coalesce(rendered, F.lit("null"))


def by_batch(kind: T.DataType, arrow: pa.DataType) -> Callable:
    """A function of one value as a function of a column, which Python sees in Arrow batches."""

    def wrap(f: Callable) -> Callable:
        def run(column: pa.Array) -> pa.Array:
            return pa.array([f(x) for x in column.to_pylist()], arrow)

        return F.arrow_udf(run, kind)

    return wrap


@by_batch(T.StringType(), pa.string())
def canonical_json(text):
    """Any JSON text in canonical form (sorted keys, ASCII); text that isn't JSON stays as it is."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=True, sort_keys=True)
    except (TypeError, ValueError):
        return text


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def terms(text: Column, pattern: str = r"[A-Za-z0-9_./:-]+", stopwords: list[str] = TASK_STOPWORDS) -> Column:
    """Distinct terms of two characters or more, longest first, then in order."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1)))
    kept = F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(stopwords))
    return F.array_sort(kept, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def target_terms(text: Column) -> Column:
    """Terms of a target; runs of CJK characters are terms too."""
    return terms(text, r"[A-Za-z0-9_./:-]+|[\x{4e00}-\x{9fff}]+", TARGET_STOPWORDS)


def index_terms(text: Column) -> Column:
    """Terms of a query over the facet index: split at white space, `/` and `_`; repeated terms count again."""
    return F.transform(F.filter(F.split(F.btrim(F.translate(text, "/_", "  ")), r"\s+"), lambda t: F.length(t) >= 2), F.lower)


def matched(words: Column, text: Column) -> Column:
    """Which of the terms the (lower-case) text has, in their order."""
    return F.filter(words, lambda t: F.contains(text, t))


def truncated(text: Column, limit: int) -> Column:
    limit = max(8, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("...")))


def ascii_like(text: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only; `%` and `_` of the pattern stay wild."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, upper, lower).like(pattern.translate(str.maketrans(upper, lower)))


#: Keys that say which source a row is from, and never leave with a public row.
IDENTITY_KEYS = ("source_id", "source_ids", "sources", "input_sources", "related_sources")


def without_identity(value):
    if isinstance(value, dict):
        return {k: without_identity(v) for k, v in value.items() if k not in IDENTITY_KEYS}
    return [without_identity(v) for v in value] if isinstance(value, list) else value


@by_batch(T.StringType(), pa.string())
def public_json(text):
    """JSON text without identity keys, at any depth; other text stays as it is."""
    if not text or text.strip()[:1] not in ("{", "["):
        return text
    try:
        return json.dumps(without_identity(json.loads(text)), ensure_ascii=True, sort_keys=True)
    except ValueError:
        return text


