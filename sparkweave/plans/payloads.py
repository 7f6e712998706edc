"""Queries over JSON payloads and code trees that are made of the driver's tables, so that loading, projection and scans run
beside SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import audits, contracts, facets, graph, handoff, project, resolve
from sparkweave.operators.model import RANK_WEIGHTS
from sparkweave.plans import queries as base
from sparkweave.plans import testbed
from sparkweave.plans.testbed import _id
from sparkweave.sources import incremental, manifest, scan, shared, tree

query = base.query


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- sources and their payloads: a nation is a source ------------------------------------------------------------


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """ordinal, source_id, role, path, raw: claims are the nation's customers, with evidence, advice or neither."""
    c = F.col
    s = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = c("c_custkey").cast("string")
    seg = F.array(s("seg/", c("c_mktsegment")))
    none = F.array().cast("array<string>")
    claim = F.struct(c("c_custkey").alias("o"), F.struct(s("cust-", n).alias("claim_id"), c("c_mktsegment").alias("status"), F.when(c("c_custkey") % 3 == 0, seg).otherwise(none).alias("supporting_artifacts"), F.when(c("c_custkey") % 3 == 1, seg).otherwise(none).alias("advisory_sources")).alias("x"))
    claims = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(claim)), lambda x: x["x"]).alias("claims"))
    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).join(claims, c("n_nationkey") == c("c_nationkey"), "left")
    k, r, name = c("n_nationkey").cast("string"), c("n_regionkey").cast("string"), c("n_name")
    edge = lambda **f: F.struct(*[f.get(x, F.lit(None).cast("string")).alias(x) for x in ("from", "to", "source", "target", "relation", "type")])
    payload = F.struct(
        F.lit("ready").alias("status"), s("h", r).alias("head_commit"), "claims", F.array(F.struct(name.alias("surface_id"), F.when(c("n_regionkey") != 0, c("r_name")).alias("owner"), s("n/", name).alias("path"))).alias("surfaces"),
        F.array(F.struct(s("mod.", name).alias("fqn"), s("src/", k, ".py").alias("path"), name.alias("surface_id"))).alias("symbols"), F.array(F.struct(s("node-", k).alias("id"), s("src/", k, ".py").alias("path"))).alias("nodes"),
        F.array(edge(**{"from": s("node-", k), "to": s("lib/x", r, ".js"), "relation": F.lit("calls")}), edge(source=s("other.", k), target=s("plain ", k), type=F.lit("owner-of"))).alias("edges"),
    )
    return rows.select(c("n_nationkey").cast("long").alias("ordinal"), s("s", k).alias("source_id"), F.lit("claim").alias("role"), s("nations/", k, ".json").alias("path"), F.to_json(payload).alias("raw"))


def _projected(spark, d):
    return project.build(_payloads(spark, d).withColumn("status", F.lit("loaded")))


_NATIONS = """WITH n AS (SELECT 's' || n_nationkey AS sid, CAST(n_nationkey AS VARCHAR) AS k, CAST(n_regionkey AS VARCHAR) AS r, n_name AS name, r_name AS owner, n_regionkey <> 0 AS owned, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT n.sid, 'cust-' || c_custkey AS claim, 'seg/' || c_mktsegment AS seg, c_custkey % 3 AS m FROM customer JOIN n ON c_nationkey = n_nationkey),
ent AS (SELECT DISTINCT * FROM (SELECT 'artifact_id' AS t, sid AS v, sid FROM n UNION ALL SELECT 'path', 'nations/' || k || '.json', sid FROM n UNION ALL SELECT 'commit_sha', 'h' || r, sid FROM n UNION ALL SELECT 'claim_id', claim, sid FROM c
  UNION ALL SELECT 'artifact_id', seg, sid FROM c WHERE m < 2 UNION ALL SELECT 'surface_id', name, sid FROM n UNION ALL SELECT 'owner_id', owner, sid FROM n WHERE owned UNION ALL SELECT 'path', 'n/' || name, sid FROM n UNION ALL SELECT 'symbol_fqn', 'mod.' || name, sid FROM n
  UNION ALL SELECT 'path', 'src/' || k || '.py', sid FROM n UNION ALL SELECT 'path', 'lib/x' || r || '.js', sid FROM n UNION ALL SELECT 'symbol_fqn', 'other.' || k, sid FROM n UNION ALL SELECT 'artifact_id', 'plain ' || k, sid FROM n)),
raw AS (SELECT 'DERIVES_FROM' AS e, 'artifact_id' AS ft, sid AS fv, 'path' AS tt, 'nations/' || k || '.json' AS tv, sid, '' AS ev FROM n UNION ALL SELECT 'DECLARES', 'artifact_id', sid, 'commit_sha', 'h' || r, sid, '' FROM n UNION ALL SELECT 'DECLARES', 'artifact_id', sid, 'claim_id', claim, sid, '' FROM c
  UNION ALL SELECT 'DECLARES', 'artifact_id', sid, 'surface_id', name, sid, '' FROM n UNION ALL SELECT 'DECLARES', 'artifact_id', sid, 'path', 'n/' || name, sid, '' FROM n UNION ALL SELECT 'DECLARES', 'artifact_id', sid, 'path', 'src/' || k || '.py', sid, '' FROM n
  UNION ALL SELECT CASE m WHEN 0 THEN 'SUPPORTS' ELSE 'ADVISES' END, 'claim_id', claim, 'artifact_id', seg, sid, '' FROM c WHERE m < 2 UNION ALL SELECT 'OWNS', 'owner_id', owner, 'surface_id', name, sid, sid FROM n WHERE owned
  UNION ALL SELECT 'DERIVES_FROM', 'surface_id', name, 'path', 'n/' || name, sid, sid FROM n UNION ALL SELECT 'REFERENCES_SYMBOL', 'path', 'src/' || k || '.py', 'symbol_fqn', 'mod.' || name, sid, sid FROM n UNION ALL SELECT 'DERIVES_FROM', 'symbol_fqn', 'mod.' || name, 'surface_id', name, sid, sid FROM n
  UNION ALL SELECT 'REFERENCES_SYMBOL', 'path', 'src/' || k || '.py', 'path', 'lib/x' || r || '.js', sid, sid FROM n UNION ALL SELECT 'OWNS', 'symbol_fqn', 'other.' || k, 'artifact_id', 'plain ' || k, sid, sid FROM n)
"""


@query(_NATIONS + f"SELECT {_id('t', 'v')} AS entity_id, t AS entity_type, v AS value, v AS label, array_to_string(list_sort(list(sid)), ',') AS source_ids FROM ent GROUP BY t, v")
def project_entities(spark, d):
    return _projected(spark, d)[0].select("entity_id", "entity_type", "value", "label", F.array_join("source_ids", ",").alias("source_ids"))


@query(_NATIONS + f"""SELECT 'edge:' || lower(e) || ':' || left(sha256(f || '|' || t || '|' || sid || ev), 14) AS edge_id, e AS edge_type, f AS from_entity, t AS to_entity, sid AS source_id, ev AS evidence
FROM (SELECT e, {_id('ft', 'fv')} AS f, {_id('tt', 'tv')} AS t, sid, ev FROM raw)""")
def project_edges(spark, d):
    return _projected(spark, d)[1].select("edge_id", "edge_type", "from_entity", "to_entity", "source_id", "evidence")


@query(_NATIONS + f"""SELECT 'claim_without_evidence:' || claim AS conflict_id, 'claim_without_evidence' AS conflict_type, 'warning' AS severity, sid AS source_id, {_id("'claim_id'", 'claim')} AS entity_id, '{{"claim_id": "' || claim || '"}}' AS detail FROM c WHERE m = 2
UNION ALL SELECT 'surface_owner_missing:' || name, 'surface_owner_missing', 'warning', sid, {_id("'surface_id'", 'name')}, '{{"surface_id": "' || name || '"}}' FROM n WHERE NOT owned""")
def project_conflicts(spark, d):
    return _projected(spark, d)[2]


_KEPT: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def _kept(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The folder of a read model that was built of the nations' former payloads and then brought up to date, and what the
    update found; made once for a session and its tables. Formerly some nations had other customers, some were no sources yet,
    and some had a second source that has gone since."""
    at = spark.sparkContext.applicationId, d.rstrip("/")
    if at not in _KEPT:
        now, k, folder = _payloads(spark, d).withColumn("status", F.lit("loaded")), F.col("ordinal"), shared.fresh(spark, "kept")
        former = now.filter(k % 7 != 3).withColumn("raw", F.when(k % 5 == 1, F.regexp_replace("raw", "cust-", "gone-")).otherwise(F.col("raw")))
        gone = now.filter(k % 6 == 0).withColumn("source_id", F.concat(F.lit("x"), k.cast("string"))).withColumn("ordinal", k + 1000)
        incremental.update(former.union(gone), folder)
        _KEPT[at] = folder, incremental.update(now, folder)
    return _KEPT[at]


@query(_NATIONS + """SELECT sid AS source_id, CASE WHEN n_nationkey % 7 = 3 THEN 'new' WHEN n_nationkey % 5 = 1 AND sid IN (SELECT sid FROM c) THEN 'changed' ELSE 'unchanged' END AS change FROM n
UNION ALL SELECT 'x' || k, 'removed' FROM n WHERE n_nationkey % 6 = 0""")
def incremental_changes(spark, d):
    """What an update of the stored model found; only new and changed sources were projected, removed ones were emptied."""
    return _kept(spark, d)[1]


@query(base._S["project_entities"])
def incremental_entities(spark, d):
    """The entities of the updated model are those of a full build."""
    return incremental.entities(spark, _kept(spark, d)[0]).select("entity_id", "entity_type", "value", "label", F.array_join("source_ids", ",").alias("source_ids"))


@query(base._S["project_edges"])
def incremental_edges(spark, d):
    return incremental.edges(spark, _kept(spark, d)[0]).select("edge_id", "edge_type", "from_entity", "to_entity", "source_id", "evidence")


@query(_NATIONS + f"""SELECT entity_id, count(*) AS degree, CAST(sum({base.WEIGHT(RANK_WEIGHTS)}) AS BIGINT) AS weighted_degree
FROM (SELECT e AS edge_type, unnest([{_id('ft', 'fv')}, {_id('tt', 'tv')}]) AS entity_id FROM raw) GROUP BY entity_id""")
def incremental_degrees(spark, d):
    """Degrees summed over the sources' own, of which an update writes the touched sources' only."""
    return incremental.degrees(spark, _kept(spark, d)[0])


@query(_NATIONS + """SELECT sid AS source_id, 'status' AS key, 'ready' AS scalar, 'status' AS json_path FROM n UNION ALL SELECT sid, 'head_commit', 'h' || r, 'head_commit' FROM n
UNION ALL SELECT sid, 'surface_id', name, 'surfaces[0].surface_id' FROM n UNION ALL SELECT sid, 'surface_id', name, 'symbols[0].surface_id' FROM n UNION ALL SELECT sid, 'owner', owner, 'surfaces[0].owner' FROM n WHERE owned
UNION ALL SELECT sid, 'path', 'n/' || name, 'surfaces[0].path' FROM n UNION ALL SELECT sid, 'path', 'src/' || k || '.py', 'symbols[0].path' FROM n UNION ALL SELECT sid, 'path', 'src/' || k || '.py', 'nodes[0].path' FROM n
UNION ALL SELECT sid, 'fqn', 'mod.' || name, 'symbols[0].fqn' FROM n UNION ALL SELECT sid, 'id', 'node-' || k, 'nodes[0].id' FROM n UNION ALL SELECT sid, 'from', 'node-' || k, 'edges[0].from' FROM n UNION ALL SELECT sid, 'to', 'lib/x' || r || '.js', 'edges[0].to' FROM n
UNION ALL SELECT sid, 'relation', 'calls', 'edges[0].relation' FROM n UNION ALL SELECT sid, 'source', 'other.' || k, 'edges[1].source' FROM n UNION ALL SELECT sid, 'target', 'plain ' || k, 'edges[1].target' FROM n UNION ALL SELECT sid, 'type', 'owner-of', 'edges[1].type' FROM n""")
def json_walk_nested(spark, d):
    """Every scalar of nested payloads with its path, but for the claims' (as many as there are customers)."""
    rows = project.walk(_payloads(spark, d).select("source_id", "raw"), "raw").filter(~F.startswith("json_path", F.lit("claims")))
    return rows.select("source_id", "key", "scalar", "json_path")


@query("""SELECT 's' || n_nationkey AS source_id, CASE WHEN n_regionkey = 4 THEN 'missing' WHEN n_regionkey <> 1 THEN 'stale' ELSE 'loaded' END AS status, CASE WHEN n_regionkey = 4 THEN '' ELSE 'ready' END AS source_status, CASE WHEN n_regionkey = 4 THEN '' ELSE 'h' || n_regionkey END AS head_commit,
CASE WHEN n_regionkey NOT IN (1, 4) THEN 'h1' ELSE '' END AS stale_for, CASE WHEN n_regionkey = 4 THEN '' ELSE 'claims,edges,head_commit,nodes,status,surfaces,symbols' END AS keys, n_regionkey <> 4 AS hashed FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def source_load(spark, d):
    """Sources met with their files: those of one region have none, those of others another head."""
    rows = _payloads(spark, d).filter(F.size(F.from_json(F.get_json_object("raw", "$.claims"), "array<string>")) > 0)
    specs = rows.select("ordinal", "source_id", "role", F.lit(True).alias("required"), "path", F.lit("").alias("verifier"), F.lit("none").alias("authority_effect"), F.lit(True).alias("no_apply"))
    files = rows.filter(F.get_json_object("raw", "$.head_commit") != "h4").select("path", "raw", F.octet_length("raw").cast("long").alias("byte_size"), F.sha2("raw", 256).alias("sha256"))
    out = manifest.loaded(specs, files, "h1")
    return out.select("source_id", "status", F.coalesce("source_status", F.lit("")).alias("source_status"), F.coalesce("head_commit", F.lit("")).alias("head_commit"), F.coalesce("stale_for", F.lit("")).alias("stale_for"), F.coalesce(F.array_join("payload_keys", ","), F.lit("")).alias("keys"), F.col("sha256").isNotNull().alias("hashed"))


@query("""WITH m AS (SELECT n_regionkey AS r, 'src' || (n_nationkey % 4) AS id, n_nationkey AS k FROM nation), f AS (SELECT *, row_number() OVER (PARTITION BY r, id ORDER BY k) AS n FROM m), o AS (SELECT r, id, row_number() OVER (PARTITION BY id ORDER BY r) AS seen FROM f WHERE n = 1)
SELECT CASE WHEN seen = 1 THEN id ELSE id || '__from_m' || r END AS source_id, 'role' || r AS role, 'r' || r || '/' || id || '.json' AS path, seen > 1 AS renamed FROM o""")
def manifest_compose(spark, d):
    """A manifest a region: the same ids with other specs are renamed, repeats collapse. Manifests are small by nature."""
    ids: dict[int, dict[str, None]] = {}
    for r in _t(spark, d, "nation").select("n_regionkey", "n_nationkey").orderBy("n_regionkey", "n_nationkey").collect():
        ids.setdefault(r[0], {})[f"src{r[1] % 4}"] = None
    made = [(f"r{k}/m{k}.json", {"sources": [{"source_id": i, "role": f"role{k}", "path": f"{i}.json", "required": True} for i in names]}) for k, names in ids.items()]
    twice = [m for pair in zip(made, made, strict=True) for m in pair]
    sources, renamed, _ = manifest.compose([*twice, ("bad.json", {"sources": []})])
    return manifest.specs(spark, sources).select("source_id", "role", "path", F.col("source_id").isin(renamed).alias("renamed"))


# --- code trees ---------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """A file a nation in Python and one in TypeScript, a module a region in both, and one that isn't Python."""
    c = F.col
    k, r = c("n_nationkey").cast("string"), c("n_regionkey").cast("string")
    n, g = _t(spark, d, "nation"), _t(spark, d, "region").select(c("r_regionkey").cast("string").alias("g"))
    py = F.format_string("import os\nfrom src.r%s import Base\n\n\nclass N%s(Base):\n    def total(self):\n        return 1\n\n\nasync def load_%s():\n    pass\n", r, k, k)
    ts = F.format_string("import {a} from './lib%s'\n// class Hidden {}\nexport class V%s {}\nexport const f%s = (x) => x\nconst q = require('other')\n", r, k, k)
    parts = [
        n.select(F.concat(F.lit("src/n"), k, F.lit(".py")).alias("path"), py.alias("text")), n.select(F.concat(F.lit("web/v"), k, F.lit(".ts")), ts),
        g.select(F.concat(F.lit("src/r"), "g", F.lit(".py")), F.lit("class Base:\n    pass\n")), g.select(F.concat(F.lit("web/lib"), "g", F.lit(".ts")), F.lit("export async function go (x) {}\n")),
        g.filter("g = '0'").select(F.lit("tests/bad.py"), F.lit("def (\n")), g.filter("g = '0'").select(F.lit("README.md"), F.lit("# Read\n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("path", F.regexp_extract("path", r"([.][^./]*)$", 1).alias("suffix"), F.octet_length("text").cast("long").alias("byte_size"), F.sha2("text", 256).alias("sha256"), tree.surface(c("path")).alias("surface"), tree.owner(c("path")).alias("owner"), F.encode("text", "UTF-8").alias("content"))


_FILES = """WITH f AS (SELECT 'src/n' || n_nationkey || '.py' AS path, '.py' AS suffix, 'source_code' AS surface FROM nation UNION ALL SELECT 'web/v' || n_nationkey || '.ts', '.ts', 'repo_root' FROM nation UNION ALL SELECT 'src/r' || r_regionkey || '.py', '.py', 'source_code' FROM region
UNION ALL SELECT 'web/lib' || r_regionkey || '.ts', '.ts', 'repo_root' FROM region UNION ALL SELECT * FROM (VALUES ('tests/bad.py', '.py', 'test_suite'), ('README.md', '.md', 'documentation'))),
i AS (SELECT 'src/n' || n_nationkey || '.py' AS path, 1 AS line, 'os' AS target, CAST(NULL AS VARCHAR) AS resolved FROM nation UNION ALL SELECT 'src/n' || n_nationkey || '.py', 2, 'src.r' || n_regionkey, 'src/r' || n_regionkey || '.py' FROM nation
UNION ALL SELECT 'web/v' || n_nationkey || '.ts', 1, './lib' || n_regionkey, 'web/lib' || n_regionkey || '.ts' FROM nation UNION ALL SELECT 'web/v' || n_nationkey || '.ts', 5, 'other', NULL FROM nation),
s AS (SELECT 'src/n' || n_nationkey || '.py' AS path, unnest(['class', 'method', 'function']) AS kind, unnest(['N' || n_nationkey, 'N' || n_nationkey || '.total', 'load_' || n_nationkey]) AS name, unnest([5, 6, 10]) AS line FROM nation
UNION ALL SELECT 'web/v' || n_nationkey || '.ts', unnest(['class', 'arrow_function']), unnest(['V' || n_nationkey, 'f' || n_nationkey]), unnest([3, 4]) FROM nation UNION ALL SELECT 'src/r' || r_regionkey || '.py', 'class', 'Base', 1 FROM region UNION ALL SELECT 'web/lib' || r_regionkey || '.ts', 'function', 'go', 1 FROM region)
"""


@query(_FILES + "SELECT path, kind, name, line FROM s UNION ALL SELECT path, 'import', target, line FROM i UNION ALL SELECT 'tests/bad.py', 'failure', 'syntax_error', 0")
def code_symbols(spark, d):
    return tree.symbols(_tree(spark, d)).select("path", "kind", "name", "line")


@query(_FILES + "SELECT path, target, resolved FROM i")
def code_imports(spark, d):
    files = _tree(spark, d)
    return tree.imports(tree.symbols(files), files)


@query(_FILES + """, l AS (SELECT CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'typescript' END AS language, n, m FROM (SELECT path, 1 AS n, 0 AS m FROM s UNION ALL SELECT path, 0, 1 FROM i)) SELECT language, CAST(sum(n) AS BIGINT) AS symbols, CAST(sum(m) AS BIGINT) AS imports, CASE language WHEN 'python' THEN 'syntax_error=1' ELSE '' END AS parse_failures FROM l GROUP BY language""")
def code_languages(spark, d):
    files = _tree(spark, d)
    return scan.by_language(files, tree.symbols(files))


@query(_FILES + "SELECT 'surface' AS by, surface AS key, count(*) AS files FROM f GROUP BY surface UNION ALL SELECT 'suffix', suffix, count(*) FROM f GROUP BY suffix")
def file_rollups(spark, d):
    files = _tree(spark, d)
    return tree.rollup(files, "surface").select(F.lit("surface").alias("by"), F.col("surface").alias("key"), "files").union(tree.rollup(files, "suffix").select(F.lit("suffix"), "suffix", "files"))


@query(_FILES + "SELECT path AS artifact_id, path, surface AS surface_id, suffix, true AS text_like FROM f")
def file_inventory(spark, d):
    return scan.inventory_rows(_tree(spark, d)).drop("byte_size")


@query(_FILES + "SELECT path AS node_id, 'path' AS kind, surface AS surface_id, CASE suffix WHEN '.py' THEN 'python' ELSE 'typescript' END AS language FROM f WHERE suffix <> '.md' UNION ALL SELECT * FROM (VALUES ('os', 'symbol', '', ''), ('other', 'symbol', '', '')) t")
def dependency_nodes(spark, d):
    files = _tree(spark, d)
    return scan.dependencies(files, tree.symbols(files))[0]


@query(_FILES + "SELECT path AS \"from\", coalesce(resolved, target) AS \"to\", line, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'typescript' END AS language FROM i")
def dependency_edges(spark, d):
    files = _tree(spark, d)
    return scan.dependencies(files, tree.symbols(files))[1]


@query(_FILES + "SELECT surface AS surface_id, CASE surface WHEN 'source_code' THEN 'source_owner' WHEN 'repo_root' THEN 'repo_owner' WHEN 'test_suite' THEN 'test_owner' ELSE 'docs_owner' END AS owner, surface AS path, count(*) AS file_count FROM f GROUP BY surface")
def surface_map(spark, d):
    return scan.surfaces(_tree(spark, d))


@query(_FILES + "SELECT path, CASE WHEN path = 'README.md' THEN 'README' WHEN path LIKE 'src/%' THEN replace(left(path, -3)[5:], '/', '.') ELSE replace(left(path, -3), '/', '.') END AS module FROM f")
def module_names(spark, d):
    return _tree(spark, d).select("path", tree.module(F.col("path")).alias("module"))


# --- artifacts ----------------------------------------------------------------------------------------------------

_LEDGER = """WITH l AS (SELECT CASE event_type WHEN 'click' THEN 'handoff' WHEN 'view' THEN 'fingerprint' ELSE 'run' END AS artifact_kind, 'e' || event_id AS path, CASE WHEN event_type = 'view' THEN '' ELSE CAST(user_id AS VARCHAR) END AS task, CASE WHEN event_type = 'view' THEN 'd' || user_id % 5 ELSE '' END AS input_fingerprint_digest,
CASE WHEN event_type = 'click' AND value >= 10 THEN 'p' ELSE '' END AS model_prompt_source, CASE WHEN event_type = 'click' THEN CAST(event_id % 101 AS DOUBLE) + 0.5 ELSE 0.0 END AS savings, CASE event_type WHEN 'click' THEN value >= 10 WHEN 'view' THEN true ELSE event_id % 2 = 0 END AS reusable FROM events WHERE event_type IN ('click', 'view', 'purchase'))
"""
_KINDS = {"click": ("handoff", "model_handoff"), "view": ("fingerprint", "input_freshness_fingerprint"), "purchase": ("run", "workflow_context_capsule")}


def _ledger(spark, d):
    """Artifacts made of events: clicks are handoffs, views fingerprints, purchases runs, others none."""
    c = F.col
    text = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
    click = F.concat(F.lit(', "ok": true, "decision": {"handoff_allowed": true}, "model_handoff": {"model_prompt_source": "'), F.when(c("value") >= 10, "p").otherwise(""), F.lit('", "token_economics": {"estimated_token_savings_percent": '), (c("event_id") % 101).cast("string"), F.lit('.5}}, "task": '), text(c("user_id")))
    view = F.concat(F.lit(', "ok": true, "digest": "d'), (c("user_id") % 5).cast("string"), F.lit('"'))
    run = F.concat(F.when(c("event_id") % 2 == 0, ', "ok": true').otherwise(', "ok": false'), F.lit(', "task": '), text(c("user_id")))
    rest = F.when(c("event_type") == "click", click).when(c("event_type") == "view", view).otherwise(run)
    raw = F.concat(F.lit('{"schema_version": '), text(c("event_type")), rest, F.lit("}"))
    return audits.ledger(_t(spark, d, "events").select(F.concat(F.lit("e"), c("event_id").cast("string")).alias("path"), raw.alias("raw")), "path", "raw", _KINDS)


@query(_LEDGER + """SELECT artifact_kind, path, task, input_fingerprint_digest, model_prompt_source, savings AS estimated_token_savings_percent, reusable,
sha256('{"fingerprint": "' || input_fingerprint_digest || '", "prompt": "' || model_prompt_source || '", "targets": [], "task": "' || task || '"}') AS reuse_key FROM l""")
def memory_ledger(spark, d):
    return _ledger(spark, d).drop("memory_role")


@query(_LEDGER + "SELECT (SELECT count(*) FROM events) AS scanned_json_count, (SELECT count(*) FROM events) - count(*) AS ignored_json_count, count(*) AS memory_row_count, count(*) FILTER (reusable) AS reusable_row_count, count(DISTINCT nullif(task, '')) AS task_count, count(DISTINCT nullif(input_fingerprint_digest, '')) AS input_fingerprint_digest_count, 'pass' AS status FROM l")
def ledger_summary(spark, d):
    return audits.ledger_summary(_ledger(spark, d), _t(spark, d, "events").count())


@query(_LEDGER + "SELECT array_to_string(list(artifact_kind || '=' || n ORDER BY artifact_kind), ',') AS kinds FROM (SELECT artifact_kind, count(*) AS n FROM l GROUP BY artifact_kind)")
def ledger_kind_counts(spark, d):
    m = facets.counts(_ledger(spark, d), "artifact_kind")
    return m.select(F.array_join(F.transform(F.map_entries("artifact_kind_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("kinds"))


@query(_LEDGER + """SELECT 'urow:' || left(sha256('["memory","' || artifact_kind || '","' || path || '","' || task || '","' || model_prompt_source || '"]'), 16) AS row_id, 'memory' AS facet, coalesce(nullif(task, ''), artifact_kind) AS label, path AS value,
CAST(CASE WHEN reusable THEN 140 ELSE 60 END + round_even(savings, 0) AS BIGINT) AS score, artifact_kind FROM l""")
def memory_facets(spark, d):
    return facets.memory(_ledger(spark, d), None)


@query("""SELECT 'urow:' || left(sha256('["command","' || p_type || '"]'), 16) AS row_id, 'command' AS facet, p_type AS label, 'i' || n AS value, CAST(85 AS BIGINT) AS score FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)
UNION ALL SELECT 'urow:' || left(sha256('["command","unify-context"]'), 16), 'command', 'unify-context', 'u', 120
UNION ALL SELECT 'urow:' || left(sha256('["capability","' || p_brand || '"]'), 16), 'capability', p_brand, p_brand, CAST(CASE WHEN p_brand < 'Brand#3' THEN 130 ELSE 90 END AS BIGINT) FROM (SELECT DISTINCT p_brand FROM part)""")
def command_and_capability_facets(spark, d):
    part = _t(spark, d, "part")
    commands = part.groupBy(F.col("p_type").alias("command")).agg(F.concat(F.lit("i"), F.count("*").cast("string")).alias("intent")).union(spark.createDataFrame([("unify-context", "u")], "command string, intent string"))
    able = part.select(F.col("p_brand").alias("capability_id"), F.lit("").alias("capability_name"), F.when(F.col("p_brand") < "Brand#3", "native_available").otherwise("native_partial").alias("integration_status")).distinct()
    return facets.commands(commands, None).union(facets.capabilities(able, None))


_ALL_FACETS = base.G + base.FACET_SQL + ", " + _LEDGER.removeprefix("WITH ") + """, k1 AS (SELECT row_id, facet, label, value, entity_type, NULL AS artifact_kind, score FROM facets ORDER BY score DESC, facet, label LIMIT 50),
k2 AS (SELECT 'urow:' || left(sha256('["conflict","' || conflict_type || '","' || conflict_id || '"]'), 16) AS row_id, 'conflict' AS facet, conflict_type AS label, conflict_id AS value, 'conflict' AS entity_type, NULL AS artifact_kind, CAST(CASE severity WHEN 'error' THEN 300 WHEN 'warning' THEN 200 ELSE 100 END AS BIGINT) AS score FROM conflicts_ ORDER BY score DESC, value LIMIT 50),
k3 AS (SELECT 'urow:' || left(sha256('["memory","' || artifact_kind || '","' || path || '","' || task || '","' || model_prompt_source || '"]'), 16) AS row_id, 'memory' AS facet, coalesce(nullif(task, ''), artifact_kind) AS label, path AS value, NULL AS entity_type, artifact_kind,
  CAST(CASE WHEN reusable THEN 140 ELSE 60 END + round_even(savings, 0) AS BIGINT) AS score FROM l ORDER BY score DESC, artifact_kind, label, row_id LIMIT 50),
k4 AS (SELECT 'urow:' || left(sha256('["command","' || p_type || '"]'), 16) AS row_id, 'command' AS facet, p_type AS label, 'i' || n AS value, NULL AS entity_type, NULL AS artifact_kind, CAST(85 AS BIGINT) AS score FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)
  UNION ALL SELECT 'urow:' || left(sha256('["command","unify-context"]'), 16), 'command', 'unify-context', 'u', NULL, NULL, 120 ORDER BY score DESC, label LIMIT 50),
k5 AS (SELECT 'urow:' || left(sha256('["capability","' || p_brand || '"]'), 16) AS row_id, 'capability' AS facet, p_brand AS label, p_brand AS value, NULL AS entity_type, NULL AS artifact_kind, CAST(CASE WHEN p_brand < 'Brand#3' THEN 130 ELSE 90 END AS BIGINT) AS score FROM (SELECT DISTINCT p_brand FROM part) ORDER BY score DESC, value LIMIT 50),
k AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k5),
q AS (SELECT *, (SELECT count(*) FROM (SELECT unnest(['context', 'brand', 'handoff', 'claim', 'without']) AS w) WHERE contains(lower(concat_ws(' ', row_id, facet, label, value, entity_type, artifact_kind)), w)) AS query_match_score FROM k)
SELECT row_id, facet, label, value, score, query_match_score FROM q WHERE query_match_score > 0 ORDER BY score DESC, query_match_score DESC, facet, label, row_id LIMIT 50"""


@query(_ALL_FACETS)
def unified_index_all(spark, d):
    """Entities, conflicts, remembered artifacts, commands and capabilities in one index, filtered by a query's terms."""
    part = _t(spark, d, "part")
    commands = part.groupBy(F.col("p_type").alias("command")).agg(F.concat(F.lit("i"), F.count("*").cast("string")).alias("intent")).union(spark.createDataFrame([("unify-context", "u")], "command string, intent string"))
    able = part.select(F.col("p_brand").alias("capability_id"), F.lit("").alias("capability_name"), F.when(F.col("p_brand") < "Brand#3", "native_available").otherwise("native_partial").alias("integration_status")).distinct()
    more = (facets.memory(_ledger(spark, d), 50), facets.commands(commands, 50), facets.capabilities(able, 50))
    return graph.unified_index(testbed.graph(spark, d), "context/brand handoff claim_without", 50, more).select("row_id", "facet", "label", "value", "score", "query_match_score")


def _line(spark, d):
    rows = _t(spark, d, "lineitem")
    return rows, F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))


@query("""WITH leaves AS (SELECT sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus)) AS leaf, count(*) AS n FROM lineitem GROUP BY leaf),
two AS (SELECT left(leaf, 4) AS prefix, sha256(string_agg(leaf || ':' || n, chr(10) ORDER BY leaf || ':' || n)) AS digest, sum(n) AS n FROM leaves GROUP BY prefix),
one AS (SELECT left(prefix, 2) AS prefix, sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) AS digest, sum(n) AS n FROM two GROUP BY ALL),
root AS (SELECT '' AS prefix, sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) AS digest, sum(n) AS n FROM one)
SELECT 2 AS level, prefix, digest, CAST(n AS BIGINT) AS rows FROM two UNION ALL SELECT 1, prefix, digest, CAST(n AS BIGINT) FROM one UNION ALL SELECT 0, prefix, digest, CAST(n AS BIGINT) FROM root""")
def input_fingerprint(spark, d):
    """One digest of a whole input, with the tree below it that finds what has changed."""
    return audits.merkle(*_line(spark, d))


_TEXTS = "SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


def _conversations(spark, d):
    t = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    return t.select(F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("path"), "conv_id", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("content"))


@query(f"""WITH t AS ({_TEXTS}), x AS (SELECT 'r' || conv_id AS role, unnest(['artifact_path_present', 'artifact_exists', 'artifact_bytes_match', 'artifact_sha256_match', 'artifact_estimated_tokens_match']) AS id, unnest([true, conv_id % 11 <> 0, conv_id % 11 <> 0 AND conv_id % 7 <> 0, conv_id % 11 <> 0, conv_id % 11 <> 0]) AS passed FROM t) SELECT id || ':' || role AS id, role, passed FROM x""")
def handoff_artifacts(spark, d):
    """Recorded artifacts against what there is: some files are gone, some records tell other sizes."""
    now = handoff.measured(_conversations(spark, d))
    n = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    recorded = now.select(F.concat(F.lit("r"), n.cast("string")).alias("role"), "path", (F.col("bytes") + F.when(n % 7 == 0, 1).otherwise(0)).alias("bytes"), "sha256", "estimated_tokens")
    return handoff.artifact_checks(recorded, now.filter(n % 11 != 0))


@query(f"""WITH t AS ({_TEXTS}), k AS (SELECT conv_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END AS m FROM t), p AS (SELECT *, m // 3 AS q FROM k)
SELECT conv_id, CAST(q AS BIGINT) AS model_prompt_estimated_tokens, CAST(m AS BIGINT) AS machine_context_estimated_tokens, CASE WHEN m > 0 THEN round(q / m, 6) ELSE 0.0 END AS model_prompt_to_machine_context_ratio, CAST(greatest(0, m - q) AS BIGINT) AS estimated_token_savings, CASE WHEN m > 0 THEN round(greatest(0.0, (m - q) / m * 100), 3) ELSE 0.0 END AS estimated_token_savings_percent FROM p""")
def token_economics(spark, d):
    rows = handoff.measured(_conversations(spark, d)).select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("conv_id"), F.col("estimated_tokens").alias("m"))
    return rows.select("conv_id", *handoff.economics(F.floor(F.col("m") / 3).cast("long"), F.col("m")))


# --- columns and edges that other queries leave out ----------------------------------------------------------------


@query(base.G.replace("WITH s0", "WITH RECURSIVE s0") + """, both_ AS (SELECT from_entity AS a, to_entity AS b FROM edges_ UNION ALL SELECT to_entity, from_entity FROM edges_), walk(entity_id, depth) AS (SELECT entity_id, 0 FROM entities_ WHERE value = 'ASIA' UNION SELECT b, depth + 1 FROM walk JOIN both_ ON a = entity_id WHERE depth < 2),
near AS (SELECT DISTINCT entity_id FROM walk) SELECT edge_id, edge_type, from_entity, to_entity FROM edges_ WHERE from_entity IN (SELECT entity_id FROM near) AND to_entity IN (SELECT entity_id FROM near)""")
def trace_edges(spark, d):
    g = testbed.graph(spark, d)
    return graph.trace_edges(g, graph.trace(g, F.col("value") == "ASIA", 2)).select("edge_id", "edge_type", "from_entity", "to_entity")


@query(base.ADJUDICATE_SQL + "SELECT count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'warn') AS warn, count(*) FILTER (verdict = 'advisory_only') AS advisory_only, round(avg(confidence_score), 3) AS average_confidence FROM p")
def review_verdicts(spark, d):
    return resolve.review(resolve.adjudicate(spark, testbed.graph(spark, d), base.TARGETS)).select("supported", "warn", "advisory_only", "average_confidence")


@query(base.ADJUDICATE_SQL + "SELECT risk_flag, count(*) AS n FROM (SELECT unnest(flags) AS risk_flag FROM p) GROUP BY risk_flag")
def risk_flags(spark, d):
    return resolve.risk_flag_counts(resolve.adjudicate(spark, testbed.graph(spark, d), base.TARGETS))


@query(base._ARTIFACTS + "SELECT CASE WHEN base > 0 THEN round_even(rf / base, 6) END AS read_first_ratio, CASE WHEN base > 0 THEN round_even(greatest(0.0, (base - rf) / base * 100), 3) END AS read_first_savings FROM b")
def efficiency_ratios(spark, d):
    return audits.efficiency(base._artifacts(spark, d)).select(F.bround("read_first_ratio", 6).alias("read_first_ratio"), F.bround("read_first_savings", 3).alias("read_first_savings"))


@query("SELECT conv_id, turn, CASE WHEN length(t) <= 24 THEN t ELSE rtrim(left(t, 23), ' ') || '...' END AS short FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)")
def truncated_rows(spark, d):
    from sparkweave.functions import text as tx

    return _t(spark, d, "conversations").select("conv_id", "turn", tx.truncated(F.coalesce("text", F.lit("")), 24).alias("short"))


@query("""SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'manifest_compose' WHEN 1 THEN 'repo_scan' ELSE '' END AS artifact_kind,
CASE WHEN conv_id % 3 = 2 THEN 'artifact_kind_inferred' ELSE concat_ws(',', CASE WHEN conv_id % 4 = 0 THEN '$.authority_effect:const' END, CASE WHEN conv_id % 7 = 0 THEN '$.ok:type' END, CASE WHEN conv_id % 3 = 1 AND conv_id % 2 = 0 THEN '$.outputs:required' END, CASE WHEN conv_id % 5 = 0 THEN '$.summary:required' END) END AS errors
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def contract_registry(spark, d):
    """Artifacts of two kinds and an unknown one against the registry; some lack fields, some hold other types or constants."""
    n = F.col("conv_id")
    kind = F.when(n % 3 == 0, "manifest_compose").when(n % 3 == 1, "repo_scan").otherwise("unheard_of")
    some = F.create_map(F.lit("n"), F.lit(1))
    base_fields = [F.concat(F.lit('{"schema_version":"sparkweave_'), kind, F.lit('_v1","no_apply":true,"status":"pass","authority_effect":"')), F.when(n % 4 == 0, "all").otherwise("none"), F.lit('","ok":'), F.when(n % 7 == 0, '"yes"').otherwise("true")]
    more = [F.when(n % 5 != 0, F.concat(F.lit(',"summary":'), F.to_json(some))).otherwise(""), F.when((n % 3 == 1) & (n % 2 != 0), ',"outputs":{}').otherwise(""), F.lit("}")]
    rows = _t(spark, d, "conversations").select("conv_id").distinct().withColumn("json", F.concat(*base_fields, *more))
    out = audits.validate(rows, "json", contracts.registry())
    return out.select("conv_id", "artifact_kind", F.array_join(F.array_sort("errors"), ",").alias("errors"))
