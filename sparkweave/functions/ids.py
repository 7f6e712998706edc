"""Identifiers: content hashes with readable prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest(text: Column, length: int) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))


def safe_id(value: Column | str, most: int = 72) -> Column:
    """Letters, digits, `_`, `-` and `.` stay, the rest becomes `_`; outer `_` go; never empty; cut last."""
    clean = F.btrim(F.regexp_replace(_col(value), r"[^\p{L}\p{N}_.-]", "_"), F.lit("_"))
    return F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit("item")), F.lit(most))


def entity_id(kind: Column | str, value: Column | str) -> Column:
    kind, value = _col(kind), _col(value)
    return F.concat_ws(":", kind, safe_id(value), digest(F.concat_ws(":", kind, value), 12))


def edge_id(kind: Column | str, start: Column | str, end: Column | str, source_ref: Column | str) -> Column:
    """The kind is in the prefix alone, not in the digest."""
    return F.concat(F.lit("edge:"), F.lower(_col(kind)), F.lit(":"), digest(F.concat_ws("|", _col(start), _col(end), _col(source_ref)), 14))
