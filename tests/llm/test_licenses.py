"""License scans: spellings, layouts, holders, whole public texts, rows that mustn't share anything."""

from pathlib import Path

import pytest

from sparkweave.llm import licenses

COMMON = Path("/usr/share/common-licenses")
BSD = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause")
MIT = licenses.KNOWN[0][1]


def wrapped(text, width):
    out, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def scanned(spark, texts):
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    return [(r.license_id, r.notices) for r in licenses.scan(rows).orderBy("doc_id").collect()]


def test_layouts_of_one_license_are_one_text(spark):
    body = MIT.split("\n", 1)[1]
    texts = [
        *[f"Copyright (c) 2019, A. B.\nAll rights reserved.\n\n{wrapped(BSD, n)}" for n in range(40, 100, 7)],
        *[f"{title}\n\nCopyright 2020 Jane Doe\n{wrapped(body, 66)}" for title in ("MIT License", "The MIT License (MIT)", "")],
        wrapped(BSD, 70).replace("1.", "*").replace("2.", "*").replace("3.", "*"), wrapped(BSD, 70).replace("\n", "\r\n"),
    ]
    assert [x for x, _ in scanned(spark, texts)] == ["BSD-3-Clause"] * 9 + ["MIT"] * 3 + ["BSD-3-Clause"] * 2


def test_sentences_about_copyright_are_no_holders(spark):
    lines = ["copyright notice, this list of", "Copyright holders be liable", "copyright", "Copyright law", "(c) You must retain"]
    named = ["Copyright (c) 2020 Jane", "Copyright Jane Doe", "# copyright: 2019", "(C) 1999-2001 X", "All rights reserved."]
    rows = spark.createDataFrame([*enumerate(lines + named)], "i int, t string")
    got = [r.n for r in rows.select("i", licenses.F.size(licenses.lines_of(licenses.F.col("t"))).alias("n")).orderBy("i").collect()]
    assert got == [1] * len(lines) + [0] * len(named)


@pytest.mark.skipif(not COMMON.exists(), reason="no folder of public license texts")
def test_digests_are_those_of_the_public_texts(spark):
    names = {n: next(f for f in (n, n.removesuffix(".0"), "Artistic") if (COMMON / f).exists()) for n, _ in licenses.DIGESTS}
    as_comment = lambda t: "\r\n".join(f" // {x.upper()}" for x in t.splitlines())
    got = scanned(spark, [as_comment((COMMON / f).read_text()) for f in names.values()])
    assert [x for x, _ in got] == list(names)


def test_rows_share_nothing(spark):
    rows = spark.createDataFrame([(None, "Licensed under CC BY 4.0."), (None, "plain"), (1, "x\nSPDX-License-Identifier: MIT\nLicensed under CC BY 4.0."), (1, "y"), (2, None), (3, "MIT License")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.license_id or "", r.notices) for r in licenses.scan(rows).collect())
    assert got == [(False, "", ""), (False, "", ""), (False, "", ""), (False, "", "CC-BY-4.0,MIT"), (True, "", ""), (True, "CC-BY-4.0", "CC-BY-4.0")]


def test_versions_are_no_list_marks(spark):
    said = ["This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 7."]
    texts = [*said, *(f"{x}\nmore" for x in said), *(f"intro\n * {x} " for x in said), "1. Licensed under CC BY 4.0.", "a) Licensed under CC BY 3.0.", "version 2. Licensed under CC BY 4.0."]
    want = ["GPL-3.0", "GPL-2.0", ""] * 3 + ["CC-BY-4.0", "", ""]
    assert [n for _, n in scanned(spark, texts)] == want
    assert [x or "" for x, _ in scanned(spark, said)] == ["GPL-3.0", "GPL-2.0", ""]


def test_known_licenses_share_no_line(spark):
    rows = spark.createDataFrame([*licenses.KNOWN], "license string, text string")
    whole = rows.select("license", licenses.F.array_join(licenses.lines_of(licenses.F.col("text")), " ").alias("x"), licenses.digest_of(licenses.lines_of(licenses.F.col("text"))).alias("d"))
    for c in ("x", "d"):
        assert whole.groupBy(c).agg(licenses.F.count_distinct("license").alias("n")).filter("n > 1").count() == 0
    assert len({d for _, d in licenses.DIGESTS}) == len(licenses.DIGESTS)


def test_marks_go_at_starts_and_between_sentences(spark):
    same = [["(a) one thing", "a. one thing", "  * 12) one thing", "one thing"], ["conditions are met: 1. keep it", "conditions are met:\n1. keep it", "conditions are met: 1.\nkeep it"]]
    other = ["version 2", "version", "version 2.", "version 3.", "see v. 2.0", "see v. 3.0", "a", "b"]
    lists = [*same, *([x] for x in other)]
    rows = spark.createDataFrame([(k, x) for k, of in enumerate(lists) for x in of], "k int, t string")
    got = rows.groupBy("k").agg(licenses.F.collect_set(licenses.digest_of(licenses.lines_of(licenses.F.col("t")))).alias("d")).collect()
    assert all(len(r.d) == 1 for r in got)
    assert len({r.d[0] for r in got}) == len(lists) - 1  # "version 2" is "version 2."
