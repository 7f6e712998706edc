import random

from pyspark.sql import functions as F

from sparkweave.operators import containment
from sparkweave.sources import script

CODE = """// class Commented {}
/* export function alsoCommented() {} */
export default class Shop extends Base { method() { return "class Quoted {}" } }

export async function load(url) { return fetch(`function inTemplate() {}`) }
const pick = async (a, b = {c: 1}) => a
  let one = x => x
var notArrow = (1 + 2)
const re = /class Pattern {}/; let two = function () {}
class $a_1 {}
import a, {b as c} from './a'
import type {T} from "types"
import 'side-effect'
import * as ns from
  '../ns/index'
const d = require('d'), e = other.require('no'), f = require(name)
export { x } from './re-export'
const later = import('./lazy')
"""


def test_scripts_are_read_as_tokens():
    assert list(script.symbols(CODE)) == [("class", "Shop", 3), ("function", "load", 5), ("arrow_function", "pick", 6), ("arrow_function", "one", 7), ("class", "$a_1", 10)]
    assert list(script.imports(CODE)) == [("./a", 11), ("types", 12), ("side-effect", 13), ("../ns/index", 14), ("d", 16)]
    long = "import {\n" + ",\n".join(f"name{i}" for i in range(200)) + "\n} from 'many'\n"
    assert list(script.imports(long)) == [("many", 1)] and list(script.symbols("")) == []
    assert list(script.imports("import")) == list(script.imports("import {a")) == list(script.symbols("const x = (")) == []


def test_containment_is_that_of_a_nested_loop(spark):
    rng = random.Random(9)
    word = lambda a, b: "".join(rng.choice("abc:") for _ in range(rng.randint(a, b)))
    texts = {word(0, 40): (rng.randint(1, 5), rng.randint(0, 3)) for _ in range(150)}
    needles = {word(1, 9) for _ in range(200)} | {"zzzzzzzz", "z"}
    got = containment.counts(spark.createDataFrame([(x,) for x in needles] * 2, "needle string"), spark.createDataFrame([(t, *v) for t, v in texts.items()], "text string, n long, level int"))
    want = {x: (sum(n for t, (n, _) in texts.items() if x in t), max(v for t, (_, v) in texts.items() if x in t)) for x in needles if any(x in t for t in texts)}
    assert {r.needle: (r.n, r.level) for r in got.collect()} == want
    none = spark.createDataFrame([], "text string, n long, level int")
    assert containment.counts(spark.createDataFrame([("abc",), ("abcdefgh",)], "needle string"), none).filter(F.col("n") > 0).count() == 0
