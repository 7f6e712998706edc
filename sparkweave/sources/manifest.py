"""Manifests: which sources there are, their checks, their composition, and their loading."""

from __future__ import annotations

import posixpath
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions import text as tx
from sparkweave.operators.project import load

MANIFEST = "source_id string, role string, required boolean, path string, verifier string, authority_effect string, no_apply boolean"
#: Keys of a payload that are listed with its source.
KEYS_MOST = 80


def checks(manifest: dict) -> list[tuple[str, bool]]:
    """(id, passed): of the whole manifest, and of each source."""
    sources = [s for s in manifest.get("sources") or [] if isinstance(s, dict)]
    seen = Counter(str(s.get("source_id") or "") for s in sources)
    boundary = manifest.get("authority_boundary")
    out = [("sources_present", bool(sources)), ("source_ids_unique", all(n == 1 for n in seen.values())), ("required_source_present", any(s.get("required") for s in sources))]
    if isinstance(boundary, dict):
        out += [("authority_effect_none", boundary.get("authority_effect") == "none"), ("no_apply_true", boundary.get("no_apply") is True)]
    for i, s in enumerate(sources):
        out += [(f"source_{i}_{k}", bool(str(s.get(k) or "").strip())) for k in ("source_id", "role", "path")]
    return out


def compose(manifests: list[tuple[str, dict]]) -> tuple[list[dict], list[str], list[str]]:
    """(sources by id, warnings, errors) of named manifests, in order.

    The same id with the same spec collapses; with another spec it is renamed after its manifest. An invalid manifest is
    an error and is skipped. Relative paths are read from the manifest's folder.
    """
    out: dict[str, dict] = {}
    warnings, errors = [], []
    for name, manifest in manifests:
        if not all(ok for _, ok in checks(manifest)):
            errors.append(name)
            continue
        folder, stem = posixpath.dirname(name), posixpath.basename(name).rpartition(".")[0] or posixpath.basename(name)
        for s in manifest["sources"]:
            path = s["path"] if posixpath.isabs(s["path"]) else posixpath.normpath(posixpath.join(folder, s["path"]))
            spec = {"role": s["role"], "required": bool(s.get("required")), "path": path, "verifier": s.get("verifier") or "", "authority_effect": s.get("authority_effect") or "none", "no_apply": s.get("no_apply", True)}
            key = s["source_id"]
            if key in out and out[key] != spec:
                base, n = f"{key}__from_{stem}", 1
                key = base
                while key in out and out[key] != spec:
                    n += 1
                    key = f"{base}_{n}"
                warnings.append(key)
            out[key] = spec
    return [{"source_id": k, **v} for k, v in sorted(out.items())], warnings, errors


def specs(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """(ordinal, ...) of a manifest's sources, in order."""
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    rows = [(i, *(s.get(n) if n not in ("required", "no_apply") else bool(s.get(n, n == "no_apply")) for n in names)) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, f"ordinal long, {MANIFEST}")


def payloads(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw, byte_size, sha256) of the JSON files under a folder, whole."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("raw"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def loaded(sources: DataFrame, files: DataFrame, head: str = "") -> DataFrame:
    """sources with raw, status, source_status, head_commit, stale_for, payload_keys. Status: missing without a file;
    stale if it names another head than `head`; else loaded, even if its JSON is bad. A payload's authority_effect and
    no_apply win over the manifest's."""
    fields = [("status", T.StringType(), pa.string()), ("head", T.StringType(), pa.string()), ("effect", T.StringType(), pa.string()), ("apply", T.BooleanType(), pa.bool_()), ("keys", T.ArrayType(T.StringType()), pa.list_(pa.string()))]

    @tx.by_batch(T.StructType([T.StructField(n, t) for n, t, _ in fields]), pa.struct([(n, a) for n, _, a in fields]))
    def look(raw):
        p = load(raw)
        summary = p.get("summary") if isinstance(p.get("summary"), dict) else {}
        git = p.get("git") if isinstance(p.get("git"), dict) else {}
        named = [p.get(k) for k in ("head_commit", "git_commit", "commit_sha", "commit")] + [git.get(k) for k in ("head_commit", "commit", "sha")]
        status = p.get("status") or p.get("verdict") or summary.get("status") or summary.get("verdict") or ""
        effect = p.get("authority_effect")
        return {"status": str(status), "head": next((x for x in named if isinstance(x, str) and x), ""), "effect": None if effect is None else str(effect), "apply": p.get("no_apply") if isinstance(p.get("no_apply"), bool) else None, "keys": sorted(map(str, p))[:KEYS_MOST]}

    rows = sources.join(files, "path", "left").withColumn("_p", look("raw"))
    stale = (F.lit(head) != "") & (F.col("_p.head") != "") & (F.col("_p.head") != head)
    status = F.when(F.col("sha256").isNull(), "missing").when(stale, "stale").otherwise("loaded")
    kept = [c for c in sources.columns if c not in ("authority_effect", "no_apply")]
    return rows.select(*kept, F.coalesce("_p.effect", "authority_effect").alias("authority_effect"), F.coalesce("_p.apply", "no_apply").alias("no_apply"), "raw", "byte_size", "sha256", status.alias("status"), F.col("_p.status").alias("source_status"), F.col("_p.head").alias("head_commit"), F.when(stale, head).otherwise("").alias("stale_for"), F.col("_p.keys").alias("payload_keys"))
