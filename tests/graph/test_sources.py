import json

from pyspark.sql import functions as F

from sparkweave.operators import assess, project
from sparkweave.operators.model import Graph
from sparkweave.plans import testbed
from sparkweave.sources import manifest, read_model
from sparkweave.streaming import fingerprints


def test_manifest_checks_and_composition():
    good = {"authority_boundary": {"authority_effect": "none", "no_apply": True}, "sources": [{"source_id": "a", "role": "r", "path": "a.json", "required": True}]}
    assert all(ok for _, ok in manifest.checks(good))
    twice = {"sources": good["sources"] * 2}
    assert dict(manifest.checks(twice))["source_ids_unique"] is False and not all(ok for _, ok in manifest.checks({"sources": [{"source_id": "x", "path": "p", "required": True}]}))
    other = {"sources": [{"source_id": "a", "role": "q", "path": "/abs/a.json", "required": True}]}
    sources, warnings, errors = manifest.compose([("m/one.json", good), ("m/again.json", good), ("n/two.json", other), ("bad.json", {})])
    assert [s["source_id"] for s in sources] == ["a", "a__from_two"] and warnings == ["a__from_two"] and errors == ["bad.json"] and sources[0]["path"] == "m/a.json"


def test_load_and_build(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"status": "ok", "head_commit": "h0", "claims": [{"claim_id": "c", "verifiers": ["v"]}]}))
    (tmp_path / "b.json").write_text("not json")
    specs = manifest.specs(spark, [{"source_id": s, "role": "claim", "path": str(tmp_path / f"{s}.json"), "required": True} for s in "abc"])
    rows = manifest.loaded(specs, manifest.payloads(spark, str(tmp_path)), "h1")
    assert {r.source_id: (r.status, r.source_status) for r in rows.collect()} == {"a": ("stale", "ok"), "b": ("loaded", ""), "c": ("missing", "")}
    sources = assess.with_quality(rows)
    entities, edges, conflicts = project.build(rows)
    graph = Graph(sources, entities, edges, conflicts.unionByName(assess.source_conflicts(sources)))
    assert {"c", "v", "a", "b"} <= {r.value for r in graph.entities.collect()} and {r.conflict_type for r in graph.conflicts.collect()} == {"source_missing", "source_stale"}


def test_read_model_round_trip(spark, tmp_path):
    g = testbed.graph(spark, "/root/testdata/sf0.001")
    read_model.write(g, str(tmp_path))
    back, index = read_model.read(spark, str(tmp_path))
    assert back.edges.count() == g.edges.count() and back.entities.filter("entity_type = 'surface_id'").count() == 25
    assert {r.kind for r in index.select("kind").distinct().collect()} == {"source", "entity", "edge", "conflict", "fusion"}


def test_stream_of_fingerprints(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.json").write_text("{}")
    fingerprints.upsert(spark, str(folder), table, state)
    (folder / "b.json").write_text("[]")
    fingerprints.upsert(spark, str(folder), table, state)
    fingerprints.upsert(spark, str(folder), table, state)
    got = fingerprints.current(spark, table).withColumn("name", F.regexp_extract("path", "[^/]*$", 0)).collect()
    assert sorted(r.name for r in got) == ["a.json", "b.json"]
