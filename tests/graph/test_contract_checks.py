"""Contracts over VARIANT against the checks of one value in Python."""

import json
import random

from pyspark.sql import functions as F

from sparkweave.operators import audits

CONTRACTS = {
    "a": {"type": "object", "required": ["x", "y"], "additionalProperties": False, "properties": {"schema_version": {"const": "a1"}, "x": {"type": "integer"}, "y": {"type": ["string", "null"], "enum": ["p", 'q"é\n', None, 3]}, "z": {
        "type": "object", "required": ["k"], "properties": {"k": {"type": "number", "const": 7}, "l": {"additionalProperties": False, "properties": {"m": {"type": "boolean"}}}, "odd key": {"type": "array"}}}}},
    "b": {"required": ["x"], "properties": {"schema_version": {"type": "string", "const": "b1"}, "x": {"type": "array", "required": ["never"], "properties": {"never": {"type": "string"}}}, "y": {"type": "unheard-of"}, "z": {"enum": [[1, 2], {"k": 1}]}}},
}


def made(rng, depth=0):
    scalars = [None, True, False, 0, 7, -3, 7.0, 1.5, 10**17, 10**19 + 1, 1e30, "", "p", 'q"é\n', "7", [], [1, 2], {}]
    if depth < 3 and rng.random() < 0.6:
        return {k: made(rng, depth + 1) for k in rng.sample(["x", "y", "z", "k", "l", "m", "odd key", "more"], rng.randrange(6))}
    return rng.choice(scalars)


def test_checks_are_those_of_each_value(spark):
    rng, texts = random.Random(5), [None, "", "[]", "7", "{", '{"schema_version": 1}', '{"schema_version": ["a1"]}', '{"schema_version": null}', '{"x": 1}', '{"schema_version": "c1"}', '"a1"']
    for _ in range(1500):
        value = made(rng)
        texts.append(json.dumps(({**value} if isinstance(value, dict) else {}) | {"schema_version": rng.choice(["a1", "a1", "b1", "c1"])}, ensure_ascii=rng.random() < 0.5))
    rows = spark.createDataFrame(list(enumerate(texts)), "`n.o` int, json string")
    versions, want = {"a1": "a", "b1": "b"}, {}
    for n, t in enumerate(texts):
        value = audits.load(t)
        version = value.get("schema_version")
        kind = versions.get(version) if isinstance(version, str) else None
        checks = [("artifact_kind_inferred", False)] if kind is None else list(audits.contract_checks(CONTRACTS[kind], value))
        want[n] = kind or "", len(checks), [i for i, ok in checks if not ok]
    got = {r["n.o"]: (r.artifact_kind, r.check_count, list(r.errors)) for r in audits.validate(rows, "json", CONTRACTS).collect()}
    assert len({tuple(e) for _, _, e in want.values()}) > 50
    assert {n: (texts[n], got[n], want[n]) for n in want if got[n] != want[n]} == {}


def test_plan_has_no_python_and_one_size(spark):
    rows = spark.createDataFrame([("{}",)], "json string")
    many = {f"k{i}": {"type": "object", "required": ["x"], "properties": {"schema_version": {"const": f"v{i}"}}} for i in range(300)}
    plans = [audits.validate(rows, "json", c)._jdf.queryExecution().optimizedPlan().toString() for c in (CONTRACTS, many)]
    assert "Python" not in plans[0] and "Pandas" not in plans[0] and abs(len(plans[0]) - len(plans[1])) < 2000


def test_repeated_keys_and_no_rows(spark):
    twice = spark.createDataFrame([('{"schema_version": "a1", "x": 1, "x": 2}',), ('{"schema_version": "a1", "x": NaN}',)], "json string")
    assert {tuple(r.errors) for r in audits.validate(twice, "json", CONTRACTS).collect()} == {("artifact_kind_inferred",)}
    assert audits.validate(twice.limit(0), "json", CONTRACTS).count() == 0
    assert audits.validate(twice.withColumn("_v", F.lit(1)), "json", CONTRACTS).columns == ["_v", "artifact_kind", "check_count", "errors"]
