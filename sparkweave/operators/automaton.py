"""Many targets against a relation in one pass: an automaton of all terms, and each task's best rows of each target.

The plan and the pass don't grow with the targets: a row costs its own characters and matches. Rows with the same matches
score alike for every target, so a task keeps, of each set of matches, the few rows with the least ids, and makes scores
only when it puts these out.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import text as tx

#: Pairs of a match set and a target that a task holds before it puts its best rows out.
HELD = 2_000_000
#: Entries of keys and their targets that are broadcast at most (some 100 bytes each); more are joined.
MAX_BROADCAST = 500_000
#: So few words, and keys that gain, are looked for before rows go to Python; most rows match none of a few.
FEW = 100
BEST = "target_no int, id string, score bigint, extra string"


def terms_of(target: str) -> list[str]:
    found = re.findall(r"[A-Za-z0-9_./:-]+|[一-鿿]+", target.lower())
    return sorted({t for t in found if len(t) >= 2 and t not in tx.TARGET_STOPWORDS}, key=lambda t: (-len(t), t))


@dataclass
class Patterns:
    """Distinct terms and whole targets; of each, the targets that have it as a term, and those that it is as a whole."""

    words: list[str]
    as_term: list[np.ndarray]
    as_whole: list[np.ndarray]
    n: int

    @classmethod
    def of(cls, targets: list[str]) -> Patterns:
        terms: dict[str, list[int]] = {}
        wholes: dict[str, list[int]] = {}
        for i, t in enumerate(targets):
            for w in terms_of(t):
                terms.setdefault(w, []).append(i)
            wholes.setdefault(t.lower(), []).append(i)
        words = sorted(terms.keys() | wholes.keys())
        lists = lambda table: [np.array(table.get(w, []), np.int64) for w in words]
        return cls(words, lists(terms), lists(wholes), len(targets))

    def scores(self, found: tuple[int, ...], gained: list[int], base: int) -> tuple[np.ndarray, np.ndarray]:
        """(targets, scores) of rows with these matches: 20 a matched term, 100 for the whole target, 10 for any term, and
        `base` for the targets in `gained`."""
        flat = lambda lists: np.concatenate([np.zeros(0, np.int64), *lists])
        hits = np.bincount(flat([self.as_term[w] for w in found]), minlength=self.n)
        whole = np.bincount(flat([self.as_whole[w] for w in found]), minlength=self.n)
        out = hits * 20 + whole * 100 + (hits > 0) * 10
        bonus = np.zeros(self.n, bool)
        bonus[gained] = True
        at = np.flatnonzero((out > 0) | bonus)
        return at, out[at] + bonus[at] * base


class Best:
    """The best `limit` rows of each target among those added, by score and then id."""

    def __init__(self, patterns: Patterns, limit: int) -> None:
        self.patterns, self.limit = patterns, limit
        self.sets: dict[tuple, list[tuple[str, str]]] = {}
        self.scored: list[tuple[tuple, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, found: tuple[int, ...], gained: tuple[int, ...], base: int, row: tuple[str, str]) -> None:
        key = (found, gained, base)
        rows = self.sets.get(key)
        if rows is None:
            rows = self.sets[key] = []
            targets, scores = self.patterns.scores(found, list(gained), base)
            self.scored.append((key, targets, scores))
            self.held += len(targets)
        rows.append(row)
        if len(rows) >= 8 * self.limit:
            self.sets[key] = heapq.nsmallest(self.limit, rows)

    def rows(self) -> pa.RecordBatch:
        """Of each target the first `limit` sets by score and least id hold its best rows: every set before a row's own has
        a row that goes before it."""
        kept = [heapq.nsmallest(self.limit, self.sets[key]) for key, _, _ in self.scored]
        names = sorted({r for rows in kept for r in rows})
        number = {r: i for i, r in enumerate(names)}
        ids = [np.array([number[r] for r in rows], np.int64) for rows in kept]
        target = np.concatenate([t for _, t, _ in self.scored])
        score = np.concatenate([s for _, _, s in self.scored])
        of = np.repeat(np.arange(len(kept)), [len(t) for _, t, _ in self.scored])
        least, size = np.array([x[0] for x in ids]), np.array([len(x) for x in ids])
        first, flat = np.cumsum(size) - size, np.concatenate(ids)

        def best(order: np.ndarray) -> np.ndarray:
            t = target[order]
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            place = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
            return order[place < self.limit]

        at = best(np.lexsort((least[of], -score, target)))
        n = size[of[at]]
        ends = np.cumsum(n)
        row = flat[np.arange(ends[-1]) + np.repeat(first[of[at]] - ends + n, n)]
        target, score = np.repeat(target[at], n), np.repeat(score[at], n)
        at = best(np.lexsort((row, -score, target)))
        picked = [names[i] for i in row[at].tolist()]
        self.sets, self.scored, self.held = {}, [], 0
        return pa.RecordBatch.from_arrays([pa.array(target[at], pa.int32()), pa.array([x[0] for x in picked], pa.string()), pa.array(score[at], pa.int64()), pa.array([x[1] for x in picked], pa.string())], ["target_no", "id", "score", "extra"])


def best_rows(rows: DataFrame, targets: list[str], limit: int, gains: DataFrame | None = None) -> DataFrame:
    """(target_no, id, score, extra): each task's best `limit` rows of each target; the best of all are among them.

    rows: id, text, extra, and where gains are given keys (array<string>) and base. gains: (key, target_no); a row with such
    a key gains its base for that target, and counts for it even without a match.
    """
    spark = rows.sparkSession
    held = {"patterns": Patterns.of(targets), "gains": None}
    gained, keys = F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>")
    if gains is not None:
        listed = gains.limit(MAX_BROADCAST + 1).collect()
        if len(listed) <= MAX_BROADCAST:
            held["gains"] = {}
            for key, target in listed:
                held["gains"].setdefault(key, []).append(target)
            keys = F.col("keys")
        else:
            of_key = gains.groupBy("key").agg(F.collect_list("target_no").alias("_t"))
            found = rows.select("id", F.explode("keys").alias("key")).join(of_key, "key").groupBy(F.col("id").alias("_id")).agg(F.array_distinct(F.flatten(F.collect_list("_t"))).alias("_gained"))
            rows, gained = rows.join(found, F.col("id") == F.col("_id"), "left"), F.col("_gained")
    base = F.col("base") if gains is not None else F.lit(0)
    words, known = held["patterns"].words, held["gains"] or {}
    if len(words) <= FEW and len(known) <= FEW:
        hit = F.arrays_overlap(keys, F.array(*map(F.lit, known))) if known else gained.isNotNull()
        rows = rows.filter(hit | tx.has_any(F.lower("text"), words))
    blob = spark.sparkContext.broadcast(held)

    def search(batches):
        import ahocorasick

        value = blob.value
        patterns = value["patterns"]
        if "automaton" not in value:
            value["automaton"] = ahocorasick.Automaton()
            for i, w in enumerate(patterns.words):
                value["automaton"].add_word(w, i)
            value["automaton"].make_automaton()
        find, of_key = value["automaton"].iter if patterns.words else (lambda text: ()), value["gains"] or {}
        best = Best(patterns, limit)
        for batch in batches:
            for i, text, extra, named, own, points in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                found = tuple(sorted({w for _, w in find(text)})) if text else ()
                own = tuple(sorted({t for k in named if k in of_key for t in of_key[k]})) if named else tuple(sorted(own or ()))
                if found or own:
                    best.add(found, own, points if own else 0, (i, extra or ""))
                    if best.held > HELD:
                        yield best.rows()
        if best.held:
            yield best.rows()

    return rows.select("id", F.lower("text").alias("text"), "extra", keys.alias("keys"), gained.alias("gained"), base.cast("int").alias("base")).mapInArrow(search, BEST)
