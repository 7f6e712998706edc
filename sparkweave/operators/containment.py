"""Which texts have a needle in them, for many needles and many texts: equi-joins on pieces, never a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece. Shorter needles are pieces themselves.
PIECE = 6


def pieces(text: Column, length: int | Column) -> Column:
    """Distinct substrings of a length."""
    last = F.length(text) - length + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(length) if isinstance(length, int) else length)))).otherwise(F.array().cast("array<string>"))


def counts(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle, n, level: the sum of n and the greatest level of the texts that contain it. needles(needle), not empty;
    texts(text, n, level), each text once.

    Needles of less than PIECE characters meet the texts' substrings of their length, summed before the join. A longer
    one meets only the texts that have its rarest piece, and those are held against the whole needle; a needle with a
    piece that no text has meets none. So the work follows the matches, not needles times texts. Needles and pieces pack so
    well in a shuffle that Spark would take them for small and build them on the driver; so joins are by merging.
    """
    short = needles.filter(F.length("needle") < PIECE).distinct()
    lengths = [r[0] for r in short.select(F.length("needle")).distinct().collect()]  # PIECE at most
    cut = texts.select(F.explode(F.flatten(F.array(*[pieces(F.col("text"), k) for k in lengths]))).alias("needle"), "n", "level") if lengths else None
    total = [F.sum("n").alias("n"), F.max("level").alias("level")]
    out = pairs(needles, texts).groupBy("needle").agg(*total)
    return out if cut is None else out.union(cut.join(short.hint("merge"), "needle", "left_semi").groupBy("needle").agg(*total))


def pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle, text, n, level of every needle of PIECE characters or more and every text that contains it."""
    long = needles.filter(F.length("needle") >= PIECE).distinct()
    have = texts.select(F.explode(pieces(F.col("text"), PIECE)).alias("piece"), "text", "n", "level")
    often = have.groupBy("piece").agg(F.count("*").alias("often"))
    asked = long.select("needle", F.explode(pieces(F.col("needle"), PIECE)).alias("piece")).join(often.hint("merge"), "piece", "left")
    rarest = asked.groupBy("needle").agg(F.min_by("piece", F.struct("often", "piece")).alias("piece"), F.min(F.col("often").isNotNull()).alias("all")).filter("all").select("needle", "piece")
    return have.join(rarest.hint("merge"), "piece").filter(F.contains("text", F.col("needle"))).select("needle", "text", "n", "level")
