"""Primary keys of stored tables: counted in the pass that writes them, tested on what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RepeatedKey(ValueError):
    """A table's key is null or repeated."""


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """The key's values that several rows have, with their number n; null counts as one.

    Only 8 bytes a row are grouped (summed in each task first, so a hot value is one row a task). Hashes that several rows
    share are then met with the keys themselves, so equal hashes of different keys aren't reported."""
    at = F.xxhash64(F.col(key))
    twice = rows.select(at.alias("_h")).groupBy("_h").count().filter("count > 1").select("_h")
    suspects = rows.select(F.col(key), at.alias("_h")).join(twice, "_h", "left_semi")
    return suspects.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def check(rows: DataFrame, key: str, table: str, most: int = 5) -> None:
    """Raise RepeatedKey where a key is null, empty or repeated; the error names the table and some of the keys."""
    empty = rows.filter(F.col(key).isNull() | (F.col(key).cast("string") == "")).limit(1).count()
    if empty:
        raise RepeatedKey(f"{table}: a row has no {key}")
    found = repeated(rows, key).orderBy(F.desc("n"), F.asc(key)).limit(most).collect()
    if found:
        raise RepeatedKey(f"{table}: {key} repeats: " + ", ".join(f"{r[key]} ({r.n} rows)" for r in found))
