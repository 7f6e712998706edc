"""Context packs: rows scored against a task, chosen under a token budget."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.operators.model import PACK_EDGE_SCORES, Graph, chosen, score_or
from sparkweave.sources import shared

# Words that lead to a preset.
PRESET_WORDS = {
    "surface-splits": ["surface", "split", "fragment", "fragmentation", "entrypoint", "入口", "表面", "分裂"], "claim-lineage": ["claim", "lineage", "evidence", "authority", "verifier", "readiness", "權威", "證據"],
    "stale-sources": ["stale", "missing", "drift", "outdated", "freshness", "過期", "漂移", "缺失"], "code-to-authority": ["code", "symbol", "path", "file", "module", "source", "程式", "檔案", "符號"],
    "r19-context": ["r19", "alpha", "research", "candidate", "mining"], "operator-projection": ["operator", "dashboard", "governance", "cockpit", "runtime", "ops", "治理", "儀表板"],
}


def task_terms(task: str) -> list[str]:
    found = re.findall(r"[A-Za-z0-9_./:-]+", task.lower())
    return sorted({t for t in found if len(t) >= 2 and t not in tx.TASK_STOPWORDS}, key=lambda t: (-len(t), t))


def route(task: str, most: int = 3) -> list[tuple[str, int]]:
    """Presets for a task, best first: 10 points a word; claim lineage always, with a point if nothing came before it."""
    found = re.findall(r"[A-Za-z0-9_./:-]+|[一-鿿]+", task.lower())
    scored: list[tuple[str, int]] = []
    for preset, words in PRESET_WORDS.items():
        score = 10 * sum(w in task.lower() or w in found for w in words) + (preset == "claim-lineage" and not scored)
        if score or preset == "claim-lineage":
            scored.append((preset, score))
    return sorted(scored, key=lambda s: (-s[1], s[0]))[: max(1, most)]


def _q(c: str) -> Column:
    return tx.or_null(tx.quoted(F.col(c)))


def compact(graph: Graph) -> DataFrame:
    """(kind, id, base, row): every row as the canonical JSON of the columns that a pack shows, with its base score."""
    c = F.col
    status = F.coalesce("status", F.lit(""))
    bad = F.when(status.isin("missing", "error", "stale", "optional_unavailable"), 25).otherwise(0)
    source = tx.json_object({k: _q(k) for k in ("source_id", "role", "status", "path", "authority_effect", "head_commit")} | {k: tx.or_null(c(k).cast("string")) for k in ("required", "no_apply")} | {"quality": tx.json_object({"reasons": tx.json_strings(c("quality_reasons")), "score": c("quality_score").cast("string")})})
    entity = tx.json_object({k: _q(k) for k in ("entity_id", "entity_type", "value")} | {"source_ids": tx.json_strings(c("source_ids"))})
    edge = tx.json_object({k: _q(k) for k in ("edge_id", "edge_type", "from_entity", "to_entity", "source_id")})
    conflict = tx.json_object({k: _q(k) for k in ("conflict_id", "conflict_type", "severity", "source_id")} | {"detail": F.coalesce("detail", F.lit("null"))})
    none = F.lit(None).cast("string")
    parts = [
        graph.conflicts.select(F.lit("conflict").alias("kind"), c("source_id").alias("id"), chosen(c("severity"), {"error": 90, "warning": 60}, 30).alias("base"), conflict.alias("row"), none.alias("a"), none.alias("b")),
        graph.sources.select(F.lit("source"), "source_id", score_or(c("quality_score"), 50) + F.when(c("required"), 15).otherwise(0) + bad, source, none, none),
        graph.entities.select(F.lit("entity"), "entity_id", chosen(c("entity_type"), {"claim_id": 80, "surface_id": 80, "symbol_fqn": 70, "path": 70}, 45), entity, c("entity_id"), none),
        graph.edges.select(F.lit("edge"), "source_id", chosen(c("edge_type"), PACK_EDGE_SCORES, 40), edge, c("from_entity"), c("to_entity")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def candidates(graph: Graph, task: str) -> DataFrame:
    """kind, id, score, matched_terms, row, estimated_tokens (of the row as a pack's prompt prints it).

    A row is named by its source if it has one, else by its own id; so edges and conflicts go by their source's id.
    """
    words = task_terms(task)
    rows = compact(graph).withColumn("_lower", F.lower("row"))
    found = F.filter(F.array(*[F.when(F.contains("_lower", F.lit(w)), F.lit(w)) for w in words]), lambda x: x.isNotNull()) if words else F.array().cast("array<string>")
    rows = rows.withColumn("matched_terms", found)
    score = (F.col("base") + F.size("matched_terms") * 50 + F.when(F.size("matched_terms") > 0, 30).otherwise(0)).cast("long")
    rows = rows.withColumn("score", score)
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" id="), F.col("id"), F.lit(" score="), F.col("score").cast("string"), F.lit(" matched="), F.when(F.size("matched_terms") > 0, F.array_join("matched_terms", ",")).otherwise("none"), F.lit(" row="), F.col("row"))
    return rows.select("kind", "id", "score", "matched_terms", "row", tx.estimate_tokens(line).alias("estimated_tokens"), "a", "b")


def header_tokens(task: str, schema: str = "context_pack_v1") -> int:
    text = json.dumps({"task": task, "schema_version": schema, "authority_effect": "none", "no_apply": True}, ensure_ascii=True, sort_keys=True)
    return max(1, (len(text) + 3) // 4)


#: The order of a fold.
RANK = ("less", "estimated_tokens", "kind", "id", "row")


#: Candidates as a fold reads them; rows that a task gathers before it reduces them.
FOLD, GATHERED = "less long, estimated_tokens long, kind string, id string, row string, a string, b string", 50_000


def _changes(rows: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Which rows differ from the one before in any of the columns."""
    out = np.ones(rows.num_rows, bool)
    out[1:] = np.logical_or.reduce([pc.not_equal(rows[c].slice(1), rows[c].slice(0, rows.num_rows - 1)).to_numpy() for c in columns])
    return out


def _first(rows: pa.Table, most: int) -> pa.Table:
    """Of each number of tokens the first `most` rows by rank, each with a (kind, id) of its own."""
    if not rows.num_rows:
        return rows
    up = lambda *columns: [(c, "ascending") for c in columns]
    rows = rows.take(pc.sort_indices(rows, up("estimated_tokens", "kind", "id", "less", "row")))
    rows = rows.filter(pa.array(_changes(rows, ("estimated_tokens", "kind", "id"))))
    rows = rows.take(pc.sort_indices(rows, up("estimated_tokens", "less", "kind", "id", "row")))
    at, new = np.arange(rows.num_rows), _changes(rows, ("estimated_tokens",))
    return rows.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < most)).combine_chunks()


def firsts(rows: DataFrame, budget: int, most: int, min_score: int = 0) -> DataFrame:
    """The candidates that a fold of `most` rows can choose, as each task finds them among its own: what it holds and hands on
    doesn't grow with its rows, and nothing is shuffled or sorted as a whole.

    Of rows with the same kind, id and tokens only the one that comes first: where it doesn't fit, the others don't, and
    where it is chosen, they can't be. Of those with the same tokens only the first `most`: where one doesn't fit, those
    after it don't either, and each one that is passed over has a key that is chosen."""

    def reduced(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # Here and not in Spark, which would make each row's text once more to filter by it.
            held.append(batch.filter(pc.and_(pc.less_equal(batch["estimated_tokens"], budget), pc.less_equal(batch["less"], -min_score))))
            if sum(x.num_rows for x in held) >= GATHERED:
                held = _first(pa.Table.from_batches(held), most).to_batches()
        if held:
            yield from _first(pa.Table.from_batches(held), most).to_batches()

    return rows.select((-F.col("score")).alias("less"), "estimated_tokens", "kind", "id", "row", "a", "b").mapInArrow(reduced, FOLD)


@dataclass
class Fold:
    """Skip-and-continue choice over rows in their rank. It is carried from one run of rows to the next: tokens used, rows and
    keys chosen. A run is the next rows that fit and whose (kind, id) isn't chosen, `most` at most, so a fold holds no more
    than that many rows of at most `budget` tokens, takes at least the first row of each run, and ends with the first run
    that isn't full: no row after it can fit."""

    budget: int
    most: int
    used: int
    chosen: list[dict] = field(default_factory=list)
    runs: int = 0

    def over(self, rows: DataFrame) -> None:
        after: tuple | None = None
        while len(self.chosen) < self.most and self.used < self.budget:
            left = rows.filter(F.col("estimated_tokens") <= self.budget - self.used)
            if self.chosen:
                left = left.filter(~F.struct("kind", "id").isin(*{(x["kind"], x["id"]): F.struct(F.lit(x["kind"]).alias("kind"), F.lit(x["id"]).alias("id")) for x in self.chosen}.values()))
            if after:
                left = left.filter((F.col("less") >= after[0]) & (F.struct(*RANK) > F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(RANK, after, strict=True)))))
            run = [r.asDict() for r in left.orderBy(*RANK).limit(self.most).collect()]
            self.runs += 1
            keys = {(x["kind"], x["id"]) for x in self.chosen}
            for x in run:
                if len(self.chosen) < self.most and self.used + x["estimated_tokens"] <= self.budget and (x["kind"], x["id"]) not in keys:
                    keys.add((x["kind"], x["id"]))
                    self.chosen.append(x)
                    self.used += x["estimated_tokens"]
            if len(run) < self.most:
                break
            after = tuple(run[-1][c] for c in RANK)


def pack(graph: Graph, task: str, budget: int = 4000, most: int = 80, min_score: int = 0) -> DataFrame:
    """The rows of a context pack, in order: position, kind, id, score, estimated_tokens, row.

    Candidates are scored once, and those that can be chosen are written with the columns of their order. The choice is a fold in two passes, carried over
    runs of rows (see Fold). Between the passes edges at chosen entities gain 25 points, those already chosen too; the second
    pass goes over all candidates again with what is left of the budget.
    """
    budget, most = max(200, budget), max(1, most)
    fold = Fold(budget, most, header_tokens(task))
    spark = graph.sources.sparkSession
    rows = candidates(graph, task)
    path = shared.fresh(spark, "pack-candidates")
    firsts(rows, budget - fold.used, most, min_score).write.parquet(path)
    stored = spark.read.parquet(path)
    fold.over(stored)
    entities = [x["id"] for x in fold.chosen if x["kind"] == "entity"]
    if entities:
        for x in fold.chosen:
            if x["kind"] == "edge" and (x["a"] in entities or x["b"] in entities):
                x["less"] -= 25
        gaining = rows.filter((F.col("kind") == "edge") & (F.col("a").isin(entities) | F.col("b").isin(entities))).withColumn("score", F.col("score") + 25)
        fold.over(stored.union(shared.checkpointed(firsts(gaining, budget - fold.used, most, min_score))))
    shared.drop(spark, path)
    out = [(n, x["kind"], x["id"], -x["less"], x["estimated_tokens"], x["row"]) for n, x in enumerate(fold.chosen)]
    return spark.createDataFrame(out, "position long, kind string, id string, score long, estimated_tokens long, row string")


def greedy(rows: DataFrame, budget: int, order: list[Column], weight: str) -> DataFrame:
    """Skip-and-continue choice over an already bounded relation, inside Spark: an aggregate() over the ordered array.
    Returns the rows chosen with their position."""
    packed = rows.select(F.struct(*order, F.struct(*rows.columns).alias("row")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    row_type = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.schema.fields)}>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{row_type}>").alias("kept"))
    step = lambda acc, x: F.when(acc["used"] + x["row"][weight] <= budget, F.struct((acc["used"] + x["row"][weight]).cast("long").alias("used"), F.concat(acc["kept"], F.array(x["row"])).alias("kept"))).otherwise(acc)
    return packed.select(F.posexplode(F.aggregate("xs", start, step)["kept"]).alias("position", "row")).select("position", "row.*")


def coverage(graph: Graph, chosen_rows: DataFrame, task: str = "") -> DataFrame:
    """One row: the sources that the chosen rows are from and how many there are, the task's terms that they have and lack,
    their entity types and severities as counts in the order of their names."""
    from_json = F.regexp_extract_all("row", F.lit(r'"source_id": "([^"]*)"'), F.lit(1))
    listed = F.flatten(F.transform(F.regexp_extract_all("row", F.lit(r'"source_ids": \[([^\]]*)\]'), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit('"([^"]*)"'), F.lit(1))))
    words = F.array(*map(F.lit, task_terms(task))).cast("array<string>")
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list(tx.matched(words, F.lower("row"))))))
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.concat(from_json, listed), lambda x: x != "")))))
    seen = chosen_rows.agg(sources.alias("selected_source_ids"), found.alias("matched_terms"))
    total = graph.sources.agg(F.count_distinct("source_id").alias("source_count"))
    field = lambda kind, name: F.when(F.col("kind") == kind, F.coalesce(F.nullif(F.get_json_object("row", f"$.{name}"), F.lit("")), F.lit("unknown")))

    def counts(kind: str, name: str, out: str) -> DataFrame:
        n = chosen_rows.filter(F.col("kind") == kind).groupBy(field(kind, name).alias("k")).agg(F.count("*").alias("n"))
        return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(out))

    for part in (total, counts("entity", "entity_type", "selected_entity_type_counts"), counts("conflict", "severity", "selected_conflict_severity_counts")):
        seen = seen.withColumn("one", F.lit(1)).join(part.withColumn("one", F.lit(1)), "one").drop("one")
    n, have = F.size("selected_source_ids"), F.size("matched_terms")
    return seen.withColumns({
        "selected_source_count": n.cast("long"), "source_coverage_ratio": F.when(F.col("source_count") > 0, F.bround(n / F.col("source_count"), 6)).otherwise(0.0),
        "missing_terms": F.array_sort(F.array_except(words, F.col("matched_terms"))), "matched_term_ratio": F.when(F.size(words) > 0, F.bround(have / F.size(words), 6)).otherwise(1.0),
    })
