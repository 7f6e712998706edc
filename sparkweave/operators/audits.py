"""Audits of artifacts: token economics, identity leaks, contracts, a ledger of what can be used again."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.operators import gates
from sparkweave.operators.project import load
from sparkweave.sources import shared

# Defaults of the efficiency and context policies. None: the check is off.
EFFICIENCY_POLICY = {"require_report_ok": True, "max_missing_required": 0, "max_warnings": 0, "min_baseline_tokens": 1, "max_read_first_tokens": None, "max_gate_pass_tokens": None, "max_read_first_ratio": 0.5, "max_gate_pass_ratio": 1.0, "min_read_first_savings_percent": 50.0, "min_gate_pass_savings_percent": None, "require_artifact_roles": ["read_first", "baseline"]}
CONTEXT_POLICY = {"require_context_ok": True, "require_source_contract_ok": True, "max_missing_artifacts": 0, "max_skipped_artifacts": None, "max_truncated_artifacts": None, "max_selected_tokens": None, "max_prompt_tokens": None, "enforce_prompt_within_token_budget": True, "enforce_selected_within_content_budget": True, "require_schema_versions": []}
# What of an artifact may be shown.
PUBLIC_SECTIONS = ("rows", "operator_rows", "expansion_plan", "recommended_commands", "model_handoff", "next_reads", "artifact_read_plan", "read_first", "prompt_pack", "context_advantage_summary", "entrypoint_decision", "selected_model_input", "recommended_reader")
LEAKS_MOST, CONTENT_SHARE = 50, 0.65


def efficiency(artifacts: DataFrame) -> DataFrame:
    """One row of artifacts(path, roles, tokens, exists, required): tokens by role, ratios and savings against a baseline.

    The baseline is the first existing one by path, or else all available output. No baseline: null ratios.
    """
    role = lambda r: F.array_contains("roles", r)
    total = lambda r: F.coalesce(F.sum(F.when(role(r), F.col("tokens"))), F.lit(0)).cast("long")
    first = F.coalesce(F.min_by("tokens", F.when(role("baseline") & F.col("exists"), F.col("path"))), F.lit(0)).cast("long")
    out = artifacts.agg(total("read_first").alias("read_first"), total("read_next_if_gate_passes").alias("read_next"), total("available_output").alias("available"), first.alias("full"), F.count_if(F.col("required") & ~F.col("exists")).alias("missing_required"))
    c = F.col
    out = out.withColumn("baseline", F.when(c("full") > 0, c("full")).otherwise(c("available"))).withColumn("gate_pass", c("read_first") + c("read_next"))
    ratio = lambda a: F.when(c("baseline") > 0, F.bround(c(a) / c("baseline"), 6))
    saved = lambda a: F.when(c("baseline") > 0, F.bround(F.greatest(F.lit(0.0), (c("baseline") - c(a)) / c("baseline")) * 100, 3))
    out = out.withColumns({"read_first_ratio": ratio("read_first"), "gate_pass_ratio": ratio("gate_pass"), "read_first_savings": saved("read_first"), "gate_pass_savings": saved("gate_pass"), "warnings": (c("full") == 0).cast("int") + (c("read_first") == 0).cast("int")})
    return out.withColumn("status", F.when(c("missing_required") > 0, "fail").when(c("warnings") > 0, "warn").otherwise("pass"))


def efficiency_gate(spark: SparkSession, report: dict, roles: set[str], policy: gates.Policy) -> DataFrame:
    p, n = policy.values, lambda k: float(report.get(k) or 0)
    checks = policy.checks()
    if p["require_report_ok"]:
        checks.append(("report_ok", report.get("status") != "fail", str(report.get("status"))))
    for name, key, limit, most in (
        ("missing_required_within_limit", "missing_required", "max_missing_required", True), ("warnings_within_limit", "warnings", "max_warnings", True), ("baseline_tokens_minimum", "baseline", "min_baseline_tokens", False),
        ("read_first_tokens_within_limit", "read_first", "max_read_first_tokens", True), ("gate_pass_tokens_within_limit", "gate_pass", "max_gate_pass_tokens", True), ("read_first_ratio_within_limit", "read_first_ratio", "max_read_first_ratio", True),
        ("gate_pass_ratio_within_limit", "gate_pass_ratio", "max_gate_pass_ratio", True), ("read_first_savings_minimum", "read_first_savings", "min_read_first_savings_percent", False), ("gate_pass_savings_minimum", "gate_pass_savings", "min_gate_pass_savings_percent", False),
    ):
        if p[limit] is not None:
            checks.append((name, n(key) <= p[limit] if most else n(key) >= p[limit], str(report.get(key))))
    checks += [(f"required_artifact_role_present:{r}", r in roles, r) for r in p["require_artifact_roles"]]
    return gates._frame(spark, checks)


def context_gate(spark: SparkSession, context: dict, policy: gates.Policy) -> DataFrame:
    """Checks of a context bundle: its own verdicts, its counts, and its budgets (the content's share of the whole)."""
    p, n = policy.values, lambda k: int(context.get(k) or 0)
    checks = policy.checks()
    checks += [(k, context.get(k) is True, str(context.get(k))) for k in ("context_ok", "source_contract_ok") if p[f"require_{k}"]]
    for name, key, limit in (("missing_artifacts", "missing_artifact_count", "max_missing_artifacts"), ("skipped_artifacts", "skipped_artifact_count", "max_skipped_artifacts"), ("truncated_artifacts", "truncated_artifact_count", "max_truncated_artifacts"), ("selected_tokens", "selected_estimated_tokens", "max_selected_tokens"), ("prompt_tokens", "prompt_estimated_tokens", "max_prompt_tokens")):
        if p[limit] is not None:
            checks.append((f"{name}_within_limit", n(key) <= p[limit], str(n(key))))
    if p["enforce_prompt_within_token_budget"]:
        checks.append(("prompt_within_token_budget", n("prompt_estimated_tokens") <= n("token_budget"), str(n("prompt_estimated_tokens"))))
    if p["enforce_selected_within_content_budget"]:
        checks.append(("selected_within_content_budget", n("selected_estimated_tokens") <= int(max(1, n("token_budget") * CONTENT_SHARE)), str(n("selected_estimated_tokens"))))
    checks += [(f"required_schema_version_present:{v}", v in (context.get("schema_versions") or ()), v) for v in p["require_schema_versions"]]
    return gates._frame(spark, checks)


def leaks(value, path: str = "$"):
    """Paths of identity keys, depth first."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k in tx.IDENTITY_KEYS:
                yield f"{path}.{k}"
            yield from leaks(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaks(v, f"{path}[{i}]")


def identity_paths(df: DataFrame, json_col: str, most: int = LEAKS_MOST, sections: tuple[str, ...] | None = None) -> DataFrame:
    """df's other columns with pos, json_path: where identity is in each row's JSON, `most` paths a row; with sections,
    only in those of an object that has any of them."""
    others = [c for c in df.columns if c != json_col]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def run(batches):
        for pdf in batches:
            at, out = [], []
            for i, t in enumerate(pdf[json_col]):
                x = load(t)
                shown = {k: x[k] for k in sections or () if k in x} or x
                for n, path in zip(range(most), leaks(shown), strict=False):
                    at.append(i)
                    out.append((n, path))
            yield pd.concat([pdf[others].iloc[at].reset_index(drop=True), pd.DataFrame(out, columns=["pos", "json_path"])], axis=1)

    return df.select(*others, json_col).mapInPandas(run, f"{fields}, pos int, json_path string")


KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def is_a(value, kind) -> bool:
    """Whether a value is of a contract's type (or one of several). Booleans are no numbers."""
    if isinstance(kind, list):
        return any(is_a(value, k) for k in kind)
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, KINDS.get(kind, object))


def contract_checks(schema: dict, value, path: str = "$"):
    """(id, passed): types, constants, choices, required keys, known keys and those of nested objects."""
    if "type" in schema:
        yield f"{path}:type", is_a(value, schema["type"])
        if not is_a(value, schema["type"]):
            return
    if "const" in schema:
        yield f"{path}:const", value == schema["const"]
    if "enum" in schema:
        yield f"{path}:enum", value in schema["enum"]
    if isinstance(value, dict):
        yield from ((f"{path}.{k}:required", k in value) for k in schema.get("required") or ())
        known = schema.get("properties") or {}
        for k, sub in known.items():
            if k in value and isinstance(sub, dict):
                yield from contract_checks(sub, value[k], f"{path}.{k}")
        if schema.get("additionalProperties") is False:
            yield f"{path}:additionalProperties", not set(value) - set(known)


@dataclass(frozen=True)
class Check:
    """One check of a contract as data: of the value at a path, its type, its choice of constants (as JSON), one key that it
    must have, or all keys that it may have."""

    id: str
    at: list[str]
    what: str
    expected: list[str]
    types: list[str]


def flat(contract: dict, at: tuple[str, ...] = ()) -> Iterator[Check]:
    """The checks of `contract_checks`, in its order, without a value."""
    path, types = ".".join(("$", *at)), contract.get("type")
    types = [] if types is None else types if isinstance(types, list) else [types]
    types = [t if t in KINDS or t in ("integer", "number") else "any" for t in types]
    if types:
        yield Check(f"{path}:type", [*at], "type", [], types)
    if "const" in contract:
        yield Check(f"{path}:const", [*at], "choice", [json.dumps(contract["const"], ensure_ascii=False)], types)
    if "enum" in contract:
        yield Check(f"{path}:enum", [*at], "choice", [json.dumps(x, ensure_ascii=False) for x in contract["enum"]], types)
    if types and not {"object", "any"} & {*types}:
        return  # an object fails by its type, and nothing else has keys
    for k in contract.get("required") or ():
        yield Check(f"{path}.{k}:required", [*at], "required", [k], types)
    known = contract.get("properties") or {}
    for k, sub in known.items():
        if isinstance(sub, dict):
            yield from flat(sub, (*at, k))
    if contract.get("additionalProperties") is False:
        yield Check(f"{path}:additionalProperties", [*at], "known", [*known], types)


def types_of(value: Column) -> Column:
    """The names that contracts have for a VARIANT's type. Whole numbers are integers, unless they are written with a point
    (1.0 is stored as a decimal of fewer digits than a long has); beyond 38 digits they are stored as doubles, so numbers."""
    said = F.schema_of_variant(value)
    names = {"OBJECT": ["object"], "ARRAY": ["array"], "STRING": ["string"], "BOOLEAN": ["boolean"], "VOID": ["null"], "BIGINT": ["integer", "number"]}
    out = F
    for name, kinds in names.items():
        out = out.when(F.startswith(said, F.lit(name)), F.array(*map(F.lit, [*kinds, "any"])))
    whole = F.array(*map(F.lit, ["integer", "number", "any"]))
    return out.when(said.rlike(r"^DECIMAL[(](19|[23]\d),0[)]"), whole).otherwise(F.array(F.lit("number"), F.lit("any")))


def _fields(value: Column) -> Column:
    """An object's fields, or null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def validate(df: DataFrame, json_col: str, schemas: dict[str, dict]) -> DataFrame:
    """df's other columns with artifact_kind, check_count, errors: each row's JSON against the contract of its
    schema_version (schemas by kind, each with that constant); an unknown one is an error.

    Contracts are rows of checks, met by schema_version (a broadcast of what the caller wrote), and a check walks the parsed
    VARIANT, so the plan is one size for any number of contracts and no Python worker runs. Text that isn't one JSON object
    has no kind; so has one with a repeated key, or with NaN or an infinity, which VARIANT doesn't take."""
    spark, others = df.sparkSession, [c for c in df.columns if c != json_col]
    rows = [(s["properties"]["schema_version"]["const"], k, [astuple(c) for c in flat(s)]) for k, s in schemas.items()]
    contracts = spark.createDataFrame(rows, "_version string, _kind string, _checks array<struct<id string, at array<string>, what string, expected array<string>, types array<string>>>")
    parsed = df.select(F.struct(F.lit(0).alias(json_col), *(F.col(f"`{c}`") for c in others)).alias("_row"), F.try_parse_json(F.col(f"`{json_col}`")).alias("_v"))
    version = F.get(F.transform(F.array(F.get(F.map_values(F.map_filter(_fields(F.col("_v")), lambda k, _: k == "schema_version")), F.lit(0))), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), F.lit(0))
    met = parsed.withColumn("_version", version).join(F.broadcast(contracts), "_version", "left")

    def judged(c: Column) -> Column:
        """The check's id and whether it passed; null where it doesn't apply."""
        node = F.reduce(c["at"], F.col("_v"), lambda v, k: F.try_element_at(_fields(v), k))
        fits = (F.size(c["types"]) == 0) | F.arrays_overlap(c["types"], types_of(node))
        keys = F.map_keys(_fields(node))
        what = c["what"]
        passed = F.when(what == "type", fits).when((what == "choice") & fits, F.array_contains(c["expected"], F.to_json(node)))
        passed = passed.when(what == "required", F.array_contains(keys, c["expected"][0])).when(what == "known", F.size(F.array_except(keys, c["expected"])) == 0)
        return F.struct(c["id"].alias("id"), F.when(node.isNotNull(), passed).alias("passed"))

    done = F.filter(F.transform("_checks", judged), lambda x: x["passed"].isNotNull())
    errors = F.transform(F.filter("_done", lambda x: ~x["passed"]), lambda x: x["id"])
    unknown = F.col("_kind").isNull()
    out = met.withColumn("_done", F.when(~unknown, done))
    return out.select(*(F.col(f"_row.`{c}`") for c in others), F.coalesce("_kind", F.lit("")).alias("artifact_kind"), F.when(unknown, 1).otherwise(F.size("_done")).alias("check_count"), F.when(unknown, F.array(F.lit("artifact_kind_inferred"))).otherwise(errors).alias("errors"))


#: When an artifact of a kind can be used again, beside being ok: what it must have.
REUSABLE = {"handoff": ("$.decision.handoff_allowed", "$.model_handoff.model_prompt_source"), "ready": ("$.prompt_source",), "onboard": ("$.prompt_source",), "fingerprint": ("$.digest",)}


def ledger(df: DataFrame, path_col: str, json_col: str, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """Artifacts that can be used again, a row each: artifact_kind, memory_role, path, task, input_fingerprint_digest,
    model_prompt_source, estimated_token_savings_percent, reusable, reuse_key.

    kinds: (kind, role) by schema_version; others are passed over. Reusable: ok, with what its kind needs.
    """
    at = lambda p: F.get_json_object(json_col, p)
    kind = F.create_map(*[F.lit(x) for k, (a, _) in kinds.items() for x in (k, a)])
    role = F.create_map(*[F.lit(x) for k, (_, b) in kinds.items() for x in (k, b)])
    version = at("$.schema_version")
    prompt = F.coalesce(at("$.model_handoff.model_prompt_source"), at("$.prompt_source"), F.lit(""))
    digest = F.coalesce(at("$.input_fingerprint.digest"), at("$.input_freshness.current_digest"), at("$.digest"), F.lit(""))
    has = lambda p: ~F.coalesce(at(p), F.lit("")).isin("", "false", "null")
    able = F.lit(True)
    for name, needs in REUSABLE.items():
        wants = F.lit(True)
        for p in needs:
            wants = wants & has(p)
        able = F.when(kind[version] == name, wants).otherwise(able)
    ok = F.when(kind[version] == "onboard", at("$.model_input_ready")).otherwise(at("$.ok"))
    task = F.coalesce(at("$.task"), F.lit(""))
    q = lambda x: tx.quoted(x)
    key = F.sha2(tx.json_object({"fingerprint": q(digest), "prompt": q(prompt), "targets": F.coalesce(at("$.targets"), F.lit("[]")), "task": q(task)}), 256)
    savings = F.coalesce(at("$.model_handoff.token_economics.estimated_token_savings_percent").cast("double"), F.lit(0.0))
    out = df.select(kind[version].alias("artifact_kind"), role[version].alias("memory_role"), F.col(path_col).alias("path"), task.alias("task"), digest.alias("input_fingerprint_digest"), prompt.alias("model_prompt_source"), savings.alias("estimated_token_savings_percent"), (F.coalesce(ok == "true", F.lit(False)) & able).alias("reusable"), key.alias("reuse_key"))
    return out.filter("artifact_kind is not null")


def ledger_summary(rows: DataFrame, scanned: int) -> DataFrame:
    """One row: scanned, ignored, rows, reusable ones, tasks, distinct digests of inputs, status."""
    distinct = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    out = rows.agg(F.count("*").alias("memory_row_count"), F.count_if("reusable").alias("reusable_row_count"), distinct("task").alias("task_count"), distinct("input_fingerprint_digest").alias("input_fingerprint_digest_count"))
    return out.select(F.lit(scanned).cast("long").alias("scanned_json_count"), (F.lit(scanned) - F.col("memory_row_count")).cast("long").alias("ignored_json_count"), "*", F.when(F.col("memory_row_count") > 0, "pass").otherwise("warn").alias("status"))


def candidates(folders: list[str], files: list[str], most: int = 500) -> list[str]:
    """JSON artifacts to look into: named files first, then folders' files in order, each once, at most `most`."""
    found = [os.path.realpath(f) for f in files if os.path.isfile(f)]
    for d in folders:
        found += sorted(os.path.realpath(os.path.join(at, name)) for at, _, names in os.walk(d) for name in names if name.endswith(".json"))
    return list(dict.fromkeys(found))[: max(1, most)]


def advantage(integration: Column, savings: Column, errors: Column, warnings: Column) -> Column:
    """0 to 100: 0.4 of the integration score and 0.6 of the savings, rounded half to even, less 25 an error and 8 a warning."""
    base = F.bround(integration * F.lit(0.4) + F.least(F.lit(100.0), savings) * F.lit(0.6), 0).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(100), base - errors * 25 - warnings * 8))


def pretty(value: dict) -> str:
    """An artifact as it is written: ASCII, keys in order, two spaces, a line end."""
    return json.dumps(value, ensure_ascii=True, indent=2, sort_keys=True) + "\n"


def merkle(rows: DataFrame, line: Column, depth: int = 2) -> DataFrame:
    """(level, prefix, digest, rows): a tree of digests over rows, whatever their order and partitions.

    A row's leaf is the digest of its line; equal lines are counted, and no line's bucket depends on a key that many rows
    share. The buckets of level `depth` are the leaves' first 2 x depth digits, a bucket's digest is that of its leaves and
    their counts in order, and a node's that of its 256 children. Level 0 is the root. Two trees differ where their nodes do,
    so a comparison goes down only where digests differ. Rows per bucket are the rows divided by 256 ** depth.
    """
    level = rows.select(F.sha2(F.coalesce(line, F.lit("null")), 256).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    level = level.select(F.col("leaf").alias("prefix"), F.concat_ws(":", "leaf", F.col("n").cast("string")).alias("said"), "n")
    out = None
    for k in range(depth, -1, -1):
        inner = level.groupBy(F.left("prefix", F.lit(2 * k)).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("said")), "\n"), 256).alias("digest"), F.sum("n").alias("n"))
        inner = shared.checkpointed(inner) if k == depth else inner
        level = inner.select("prefix", F.concat_ws(":", "prefix", "digest").alias("said"), "n")
        nodes = inner.select(F.lit(k).alias("level"), "prefix", "digest", F.col("n").alias("rows"))
        out = nodes if out is None else out.union(nodes)
    return out


def merkle_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(prefix, rows_before, rows_after): buckets of the deepest level whose digests differ."""
    deepest = lambda df: df.join(df.agg(F.max("level").alias("_m")), F.col("level") == F.col("_m")).select("prefix", "digest", "rows")
    a, b = deepest(before).toDF("prefix", "_a", "rows_before"), deepest(after).toDF("prefix", "_b", "rows_after")
    return a.join(b, "prefix", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("prefix", F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after"))
