"""Groups of near copies that one task sees whole need no rounds of components."""

from sparkweave.llm import common, near_dup


def test_stars_are_components_without_a_round(spark):
    edges = [(3, 1), (1, 2), (9, 7), (4, 1), (5, 5), (9, 7)]
    got = common.components(spark.createDataFrame(edges, "a long, b long"), rounds=0).collect()
    assert sorted((r.node, r.root) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (9, 7)]


def _groups(spark, monkeypatch):
    texts = {10 * g + i: " ".join([*(f"w{g}-{k}" for k in range(120)), *(f"x{k}" for k in range(i))]) for g in range(3) for i in range(4)} | {99: "alone here"}
    seen, components = [], common.components
    monkeypatch.setattr(common, "components", lambda e, *a: (seen.append(e.count()), components(e, *a))[1])
    got = near_dup.links(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {k: (k // 10 * 10, 3) for k in texts if k < 99} | {99: (99, 0)}
    return seen


def test_groups_of_one_block_are_not_put_together_again(spark, monkeypatch):
    assert _groups(spark, monkeypatch)[1:] == [0]


def test_groups_of_several_blocks_are(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 1)
    assert _groups(spark, monkeypatch)[1] > 0
