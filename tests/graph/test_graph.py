"""Operators of the evidence graph on small relations, with the quirks that matter."""

import json

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import ids
from sparkweave.functions import text as tx
from sparkweave.operators import assess, gates, graph, pack, presets, project, resolve
from sparkweave.operators.model import Graph, score_or
from sparkweave.sources import tree

SOURCES = "source_id string, role string, status string, required boolean, path string, verifier string, authority_effect string, no_apply boolean, head_commit string, stale_for string"


@pytest.fixture(scope="module")
def g(spark):
    sources = assess.with_quality(spark.createDataFrame([
        ("truth", "current_truth", "loaded", True, "a.json", "v", "none", True, "h1", ""), ("old", "claim_evidence", "stale", False, "b.json", "", None, None, "h0", "h1"),
        ("gone", "advisory_graph", "missing", True, None, "v", "apply", False, None, None), ("off", "context", "optional_unavailable", False, None, None, "", True, None, None),
    ], SOURCES))
    e = spark.createDataFrame([("claim_id", "C1", ["old", "truth"]), ("surface_id", "Dashboard", ["truth"]), ("path", "src/a.py", []), ("artifact_id", "art", ["gone", "unknown"]), ("symbol_fqn", "m.f", ["off"])], "entity_type string, value string, source_ids array<string>")
    entities = e.select(ids.entity_id("entity_type", "value").alias("entity_id"), "entity_type", "value", F.col("value").alias("label"), "source_ids", F.lit("{}").alias("metadata"))
    key = {r.value: r.entity_id for r in entities.collect()}
    rows = [("SUPPORTS", "C1", "art", "truth"), ("OWNS", "Dashboard", "C1", "truth"), ("CONFLICTS_WITH", "C1", "src/a.py", "old"), ("DERIVES_FROM", "src/a.py", "m.f", "old")]
    edges = spark.createDataFrame([(k, key[a], key[b], s) for k, a, b, s in rows], "edge_type string, from_entity string, to_entity string, source_id string").select(ids.edge_id("edge_type", "from_entity", "to_entity", "source_id").alias("edge_id"), "*", F.lit("").alias("evidence"))
    return Graph(sources, entities, edges, assess.source_conflicts(sources))


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_ids(spark):
    assert one(spark, ids.safe_id, "__a b/c__") == "a_b_c" and one(spark, ids.safe_id, "///") == "item" and one(spark, ids.safe_id, "é-1.x") == "é-1.x"
    assert len(one(spark, ids.safe_id, "x" * 100)) == 72


def test_quality_loses_points_in_order(g):
    got = {r.source_id: (r.quality_score, r.quality_reasons) for r in g.sources.collect()}
    assert got == {"truth": (100, []), "old": (75, ["stale", "no_verifier"]), "gone": (0, ["missing", "required_not_loaded", "authority_boundary_violation"]), "off": (85, ["optional_unavailable", "no_verifier"])}


def test_a_score_of_zero_counts_as_full(g):
    ranked = {r.source_id: r for r in graph.source_rank(g, None).collect()}
    assert ranked["gone"].quality_score == 100 and ranked["gone"].risk_score == 2 * 50 + 5
    assert g.sources.select(score_or(F.col("quality_score"), 50).alias("q")).filter("q = 50").count() == 1


def test_conflicts(g):
    assert {r.conflict_id for r in g.conflicts.collect()} == {"source_missing:gone", "source_stale:old", "authority_advisory_mixed:gone"}
    assert all(json.loads(r.detail) for r in g.conflicts.collect())


def test_entity_rank(g):
    rows = {r.value: r for r in graph.entity_rank(g, None).collect()}
    assert (rows["C1"].degree, rows["C1"].weighted_degree, rows["C1"].source_score) == (3, 4, 88)  # 87.5 goes to even
    assert rows["C1"].score == 40 + 9 + 88 + 10 and rows["src/a.py"].source_score == 0 and rows["art"].source_score == 100
    assert [r.value for r in graph.entity_rank(g, 0).collect()] == ["C1"]


def test_trace(g):
    seed = F.col("value") == "Dashboard"
    value = {r.entity_id: r.value for r in g.entities.collect()}
    assert {value[r.entity_id]: r.depth for r in graph.trace(g, seed, 2).collect()} == {"Dashboard": 0, "C1": 1, "art": 2, "src/a.py": 2}
    assert graph.trace(g, seed, 0).count() == 1 and graph.trace(g, seed, 9).count() == 5 and graph.trace(g, seed, 2, 3).count() == 3 and graph.trace(g, F.lit(True), 1, 2).count() == 5


def test_presets_and_public_rows(spark, g):
    # the names of keys count as text: every source has a "stale_for"
    assert {(r.kind, r.id) for r in presets.stale_sources(g).collect()} == {("source", "truth"), ("source", "old"), ("source", "gone"), ("source", "off"), ("conflict", "source_missing:gone"), ("conflict", "source_stale:old")}
    assert {r.kind for r in presets.claim_lineage(g).collect()} == {"entity", "edge"} and presets.claim_lineage(g).count() == 4
    assert presets.sql_preset(spark, g, "claim-lineage").count() == 3
    assert [r.id for r in presets.sql_preset(spark, g, "search", search="DASHBOARD").collect() if r.kind == "entity"]
    with pytest.raises(ValueError):
        presets.sql_preset(spark, g, "nothing")
    for r in presets.public(presets.sql_preset(spark, g, "search", search="t")).collect():
        assert not any(f'"{k}"' in r.text for k in tx.IDENTITY_KEYS) and (r.kind != "source" or r.id is None)


def test_texts_are_json(g):
    for r in presets.search_index(g, assess.fusion(g)).collect():
        assert json.dumps(json.loads(r.text), sort_keys=True) == r.text


def test_diff_and_fingerprints(spark):
    a = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "x"), ("", 1, "")], "k string, n int, s string")
    b = spark.createDataFrame([("a", 1, None), ("b", 2, "y"), ("d", 4, None)], "k string, n int, s string")
    assert {(r.k, r.change, r.changed_fields) for r in graph.changes(a, b, "k", ["n", "s"]).collect()} == {("b", "changed", "s"), ("c", "removed", ""), ("d", "added", "")}
    f = [graph.fingerprints(x.filter("k <> ''"), ["n", "s"], "k") for x in (a, b)]
    assert {(r.k, r.change) for r in graph.compare_fingerprints(f[1], f[0], "k").collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "new")}


def test_adjudication(spark, g):
    rows = {r.target: r for r in resolve.adjudicate(spark, g, [" C1 ", "C1", "", "zzzz"]).collect()}
    assert set(rows) == {"C1", "zzzz"} and rows["zzzz"].verdict == "no_match" and rows["zzzz"].priority_score == 90 + 10 + 10
    assert "target_not_found" in rows["zzzz"].risk_flags and rows["C1"].authority_sources == 2
    review = resolve.review(resolve.adjudicate(spark, g, ["C1", "zzzz"])).first()
    assert review.no_match == 1 and review.target_count == 2
    assert resolve.review(resolve.adjudicate(spark, g, ["zzzz"])).first().status == "warn"


def test_terms(spark):
    assert one(spark, tx.terms, "The the DATA-set of a src/x.py, data") == ["data-set", "src/x.py", "data"]
    assert one(spark, tx.target_terms, "是 權威 of by be") == ["be", "權威"] and one(spark, tx.index_terms, "A/bb_BB c") == ["bb", "bb"]
    assert resolve.terms_of("the ab abc") == ["abc", "ab"] and pack.task_terms("How is it") == []


def plain_fold(items: list[dict], budget: int, most: int, used: int = 0, min_score: int = 0, passes: int = 2) -> list[int]:
    """Two passes of skip-and-continue choice. Between them, edges that touch a chosen entity gain 25 points. Returns the
    positions chosen, in order; a (kind, id) is chosen once."""
    chosen_keys: set[tuple[str, str]] = set()
    out: list[int] = []
    order = list(range(len(items)))
    rank = lambda i: (-items[i]["score"], items[i]["estimated_tokens"], items[i]["kind"], items[i]["id"], items[i]["row"])
    for second in (False, True)[:passes]:
        if second:
            ids = {items[i]["a"] for i in out if items[i]["kind"] == "entity"}
            for x in items:
                if x["kind"] == "edge" and (x["a"] in ids or x["b"] in ids):
                    x["score"] += 25
        order.sort(key=rank)
        for i in order:
            x = items[i]
            if (x["kind"], x["id"]) in chosen_keys or x["score"] < min_score:
                continue
            if len(out) >= most:
                break
            if used + x["estimated_tokens"] > budget:
                continue
            chosen_keys.add((x["kind"], x["id"]))
            out.append(i)
            used += x["estimated_tokens"]
    return out


def test_pack_keeps_its_budget(g):
    for budget in (200, 300, 600, 4000):
        rows = pack.pack(g, "dashboard claim evidence", budget, 80).collect()
        assert sum(r.estimated_tokens for r in rows) + pack.header_tokens("dashboard claim evidence") <= budget
        assert len({(r.kind, r.id) for r in rows}) == len(rows) and [r.position for r in rows] == list(range(len(rows)))
    assert len(pack.pack(g, "x", 4000, 2).collect()) == 2


def test_pack_chooses_as_a_fold_over_all_candidates(spark, g):
    many = spark.range(1500).select(F.concat(F.lit("no_lines:"), "id").alias("conflict_id"), F.lit("dashboard").alias("conflict_type"), F.lit("error").alias("severity"), F.lit("truth").alias("source_id"), F.lit("{}").alias("detail"))
    more = g.edges.limit(1).drop("edge_id", "from_entity", "to_entity").crossJoin(spark.range(1500).select(F.concat(F.lit("e"), "id").alias("edge_id"), F.lit("p").alias("from_entity"), F.concat(F.lit("q"), "id").alias("to_entity")))
    flooded = Graph(g.sources, g.entities, g.edges.unionByName(more), g.conflicts.unionByName(many.select(*g.conflicts.columns) if set(g.conflicts.columns) <= set(many.columns) else many, allowMissingColumns=True))
    task = "dashboard claim evidence"
    items = [r.asDict() for r in pack.candidates(flooded, task).collect()]
    for budget, most in ((200, 5), (300, 80), (700, 3), (1000, 20)):
        want = [dict(x) for x in items]
        want = [(want[i]["kind"], want[i]["id"], want[i]["score"], want[i]["row"]) for i in plain_fold(want, budget, most, pack.header_tokens(task))]
        got = [(r.kind, r.id, r.score, r.row) for r in pack.pack(flooded, task, budget, most).orderBy("position").collect()]
        assert got == want and len({k for k, *_ in got}) > 1


def test_greedy_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 9), (4, 1), (5, 2)], "i long, w long")
    assert [r.w for r in pack.greedy(df, 10, [F.col("i")], "w").collect()] == [5, 4, 1]


def test_route():
    assert [p for p, _ in pack.route("dashboard operator evidence authority")][:2] == ["claim-lineage", "operator-projection"]
    assert pack.route("nothing here") == [("claim-lineage", 1)]


def test_policies(spark):
    bad = gates.Policy.of({"authority_effect": "apply", "no_apply": False, "nonsense": 1, "min_sources": -1, "max_errors": True}, gates.QUALITY_POLICY)
    rows = {r.id: r.passed for r in gates.quality_gate(spark, {"source_count": 1, "entity_count": 1, "edge_count": 1}, set(), set(), set(), bad).collect()}
    assert [k for k, v in rows.items() if not v] == ["policy_authority_effect_none", "policy_no_apply_true", "policy_unknown_keys_absent", "policy_validation_errors_absent"]
    good = gates.Policy.of({}, gates.REVIEW_POLICY, require_targets=["a"])
    assert {r.id: r.passed for r in gates.review_gate(spark, {"blocked": 1}, {}, {"a"}, good).collect()} == {"policy_authority_effect_none": True, "policy_no_apply_true": True, "policy_unknown_keys_absent": True, "policy_validation_errors_absent": True, "blocked_within_limit": False, "no_match_within_limit": True, "advisory_only_within_limit": True, "priority_score_within_limit": True, "average_confidence_minimum": True, "required_target_reviewed:a": True}


def test_project_payloads(spark):
    claims = {"claims": [{"claim_id": "c1", "label": "L", "authority_sources": ["s"], "advisory_sources": ["t"]}, {"claim_id": "c2"}, 7]}
    imported = {"nodes": [{"id": "n1", "symbol_fqn": "m.f"}, {"id": "n2", "kind": "surface"}], "edges": [{"from": "n1", "to": "ui/x.py", "relation": "calls"}, {"source": "n2", "target": "n1", "type": "owner-of"}, {"from": "n1"}], "surfaces": {"s1": {"owner": "me", "path": "p"}}}
    rows = [(0, "one", "r", "loaded", "x.json", json.dumps(claims)), (1, "two", "r", "loaded", None, json.dumps(imported)), (2, "bad", "r", "loaded", "", "not json"), (3, "null", "r", "missing", "", None)]
    entities, edges, conflicts = project.build(spark.createDataFrame(rows, "ordinal long, source_id string, role string, status string, path string, raw string"))
    e = {r.entity_id: r for r in entities.collect()}
    found = {(x.edge_type, e[x.from_entity].value, e[x.to_entity].value) for x in edges.collect()}
    assert {("SUPPORTS", "c1", "s"), ("ADVISES", "c1", "t"), ("DECLARES", "one", "c1"), ("REFERENCES_SYMBOL", "m.f", "ui/x.py"), ("OWNS", "n2", "m.f"), ("OWNS", "me", "s1"), ("DERIVES_FROM", "s1", "p"), ("DERIVES_FROM", "one", "x.json")} <= found
    assert {r.conflict_id for r in conflicts.collect()} == {"claim_without_evidence:c2"} and {r.value for r in e.values()} >= {"bad", "null"}
    assert next(r.label for r in e.values() if r.value == "c1") == "c1"  # the walk sees it first


def test_walk_keeps_document_order():
    x = {"b": {"path": "p1"}, "a": [{"file": ["f1", "f2", None]}, True], "claim_id": 3}
    assert list(project.pairs(x)) == [("b.path", "path", "p1"), ("a[0].file", "file", "f1"), ("a[0].file", "file", "f2"), ("claim_id", "claim_id", "3")]
    assert len(list(project.pairs({"path": [str(i) for i in range(500)]}))) == 100


def test_tree(spark, tmp_path):
    for name, text in {"README.md": "x", "src/pkg/__init__.py": "", "src/pkg/mod.py": "import os\nfrom .util import f\nclass A:\n    def m(self): pass\n", "src/pkg/util.py": "def f(): pass\nasync def g(): pass\n", "src/app.ts": "import {x} from './lib/y'\nexport const h = () => 1\n", "src/lib/y.ts": "export class Y {}\n", "output/ignored.json": "{}", "src/bad.py": "def ("}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    inventory = tree.files(spark, str(tmp_path))
    assert [r.path for r in inventory.orderBy("path").collect()] == ["README.md", "src/app.ts", "src/bad.py", "src/lib/y.ts", "src/pkg/__init__.py", "src/pkg/mod.py", "src/pkg/util.py"]
    found = tree.symbols(inventory)
    assert {(r.kind, r.name) for r in found.collect()} >= {("class", "A"), ("method", "A.m"), ("function", "f"), ("function", "g"), ("arrow_function", "h"), ("class", "Y"), ("failure", "syntax_error")}
    assert {(r.target, r.resolved) for r in tree.imports(found, inventory).collect()} == {("os", None), (".util", "src/pkg/util.py"), ("./lib/y", "src/lib/y.ts")}
    assert {r.surface: r.files for r in tree.rollup(inventory, "surface").collect()} == {"source_code": 6, "documentation": 1}
    assert {r.m for r in inventory.select(tree.module(F.col("path")).alias("m")).collect()} >= {"pkg.mod", "pkg", "app"}


def test_audits(spark):
    from sparkweave.operators import audits

    rows = spark.createDataFrame([("a", ["read_first"], 10, True, True), ("b", ["baseline"], 100, True, False), ("c", ["available_output", "read_next_if_gate_passes"], 30, True, False), ("d", ["baseline"], 999, True, False)], "path string, roles array<string>, tokens long, exists boolean, required boolean")
    r = audits.efficiency(rows).first()
    assert (r.read_first, r.gate_pass, r.baseline, r.read_first_ratio, r.read_first_savings, r.status) == (10, 40, 100, 0.1, 90.0, "pass")
    assert audits.efficiency(rows.filter("path = 'c'")).first().status == "warn" and audits.efficiency(rows.filter("path = 'z'")).first().read_first_ratio is None
    gate = audits.efficiency_gate(spark, r.asDict(), {"read_first", "baseline"}, gates.Policy.of({"min_read_first_savings_percent": 95.0}, audits.EFFICIENCY_POLICY))
    assert [x.id for x in gate.collect() if not x.passed] == ["read_first_savings_minimum"]
    context = {"context_ok": True, "source_contract_ok": True, "token_budget": 100, "prompt_estimated_tokens": 90, "selected_estimated_tokens": 66}
    assert [x.id for x in audits.context_gate(spark, context, gates.Policy.of({}, audits.CONTEXT_POLICY)).collect() if not x.passed] == ["selected_within_content_budget"]
    assert audits.is_a(1, "integer") and not audits.is_a(True, "number") and audits.is_a(None, ["string", "null"])
    assert dict(audits.contract_checks({"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"y": {"enum": [1]}}}, {"y": 2, "z": 0})) == {"$:type": True, "$.x:required": False, "$.y:enum": False, "$:additionalProperties": False}
    assert list(audits.leaks({"a": [{"source_id": {"sources": 1}}]})) == ["$.a[0].source_id", "$.a[0].source_id.sources"]
    assert spark.range(1).select(audits.advantage(F.lit(100), F.lit(90.0), F.lit(0), F.lit(1)).alias("x")).first().x == 86


def test_prompts_and_working_sets(spark, g):
    from sparkweave.__main__ import parser
    from sparkweave.plans import prompts

    for budget in (80, 200, 4000):
        text, n, rows = prompts.pack_prompt(pack.pack(g, "dashboard claim zebra", 4000), "dashboard claim zebra", budget)
        assert (n <= budget or rows == 0) and "zebra" in text
    assert prompts.review_prompt(resolve.adjudicate(spark, g, ["C1", "zzzz"]), 1000)[1] == 2
    found = {k: [{"id": f"{k}{i}", "score": i} for i in range(9)] for k in ("entity", "source", "edge", "conflict")}
    assert prompts.target_prompt(found, "t", 10)[1] == {"entity": 1, "source": 1, "edge": 0, "conflict": 0} and prompts.target_prompt(found, "t", 9999)[1]["edge"] == 9
    index = graph.entity_facets(g, None)
    whole = prompts.working_set(index, 10, None, 3)
    assert whole["status"] == "pass" and [r["facet"] for r in whole["rows"]][:3] == ["claim", "surface", "symbol"] and len(whole["rows"]) == 5
    small = prompts.working_set(index, 10, 100, 3)
    assert small["warnings"] and len(small["rows"]) < 5 and (small["estimated_tokens"] <= 100 or len(small["rows"]) == 1)
    for step in prompts.task_plan("operator dashboard evidence", "model"):
        parser().parse_args(step["argv"])
