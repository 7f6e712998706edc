"""HTML extraction against a plain tree walk by the same rules, with and without <article>."""

import random
from html.parser import HTMLParser

import pytest

from sparkweave.llm import common, html_text

BLOCKS = {"div", "section", "article", "p", "h1", "ul", "li", "table", "tr", "td", "body", "html"}


class Tree(HTMLParser):
    """(text, tag path, element numbers, block) of text nodes of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.nodes, self.block, self.n = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.block += tag in BLOCKS
        self.n += 1
        self.stack.append((tag, self.n))

    def handle_endtag(self, tag):
        assert self.stack.pop()[0] == tag
        self.block += tag in BLOCKS

    def handle_data(self, data):
        if data.strip():
            self.nodes.append((data, tuple(t for t, _ in self.stack), tuple(n for _, n in self.stack), self.block))


def plain(page):
    tree = Tree()
    tree.feed(page)
    tree.close()
    nodes = tree.nodes
    if not nodes:
        return ""
    on = {}
    for k, (_, path, _, _) in enumerate(nodes):
        on.setdefault(path, []).append(k)
    mean = lambda ks, f: sum(f(nodes[k][0]) for k in ks) / len(ks)
    length = [mean(on[n[1]], lambda t: len(t.strip())) for n in nodes]
    points = [mean(on[n[1]], lambda t: sum(c in ".,;:!?'\"()" for c in t)) for n in nodes]
    weights = [2.718281828459045 ** (-d * d / 2) for d in range(-2, 3)]
    at = lambda v, k: v[min(max(k, 0), len(v) - 1)]
    smoothed = lambda v: [sum(w * at(v, k + d) for w, d in zip(weights, range(-2, 3))) / sum(weights) for k in range(len(v))]
    value = [a * (1 + b) for a, b in zip(smoothed(length), smoothed(points))]
    ratio = [sum(value[j] for j in on[n[1]]) / len(on[n[1]]) for n in nodes]
    good = [r >= sum(ratio) / len(ratio) / 2 - 1e-9 for r in ratio]
    held = {}
    for n, g in zip(nodes, good):
        for e in n[2] if g else ():
            held[e] = held.get(e, 0) + len(n[0])
    whole = sum(len(n[0]) for n, g in zip(nodes, good) if g)
    tag_of = {e: t for n in nodes for t, e in zip(n[1], n[2])}
    articles = {e for e in held if tag_of[e] == "article"}
    if articles and 2 * sum(held[e] for e in articles) >= whole:
        above = [set(n[2][: n[2].index(e) + 1]) for e in articles for n in nodes if e in n[2]]
        root = max(set.intersection(*above))
    else:
        root = max(e for e in held if held[e] == whole and tag_of[e] in ("div", "section", "article", "td", "body", "html"))
    out = {}
    for t, path, elements, block in nodes:
        if root not in elements:
            continue
        k = elements.index(root)
        empty = next((i for i in range(k + 1, len(path)) if elements[i] not in held), None)
        if empty is not None and path[empty] in ("div", "section", "table", "article") and "article" not in path[:empty]:
            continue
        out.setdefault(block, []).append(t)
    return "\n".join(" ".join("".join(x).split()) for _, x in sorted(out.items()))


def random_page(rng, article):
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor,", "sit", "amet.", "a"]) for _ in range(n))
    prose = lambda: "".join(f"<p>{words(rng.randint(20, 60))}</p>" for _ in range(rng.randint(2, 6)))
    junk = lambda: rng.choice([f"<div>{words(3)}</div>", f"<div><ul><li>{words(2)}</li><li>{words(1)}</li></ul></div>", f"<section><h1>{words(2)}</h1></section>", f"<table><tr><td>{words(2)}</td></tr></table>"])
    main = f"<h1>{words(4)}</h1>" + prose() + rng.choice(["", f"<ul><li>{words(2)}</li><li>{words(3)}</li></ul>", junk()]) + prose()
    tag = "article" if article else "div"
    body = "".join(junk() for _ in range(rng.randint(0, 3))) + f"<{tag}>{main}</{tag}>" + "".join(junk() for _ in range(rng.randint(0, 3)))
    return f"<html><body>{body}</body></html>"


@pytest.mark.parametrize("article", [True, False])
def test_a_plain_walk_gives_the_same_text(article):
    rng = random.Random(5)
    for _ in range(150):
        page = random_page(rng, article)
        assert html_text.extract(page) == plain(page), page


@pytest.mark.parametrize("article", [True, False])
def test_the_ratios_choose_the_nodes(monkeypatch, article):
    """Text beside the main text goes because of its path's ratio, not because of a name."""
    text = "".join(f"<p>A long paragraph of the story, number {i}, which goes on and on, and then ends here.</p>" for i in range(6))
    main = f"<article><h1>Title</h1>{text}</article>" if article else f"<div><h1>Title</h1>{text}</div>"
    teaser = "<article>Popular now</article>" if article else "<div>Popular now: read our other stories</div>"
    page = f"<html><body>{teaser}{main}<table><tr><td>1</td><td>2</td></tr></table></body></html>"
    got = html_text.extract(page)
    assert got.startswith("Title\nA long") and "Popular" not in got and got.endswith("ends here.")
    monkeypatch.setattr(html_text, "fused", lambda found: ([x for x in found if x[0] != " "], [1.0 for x in found if x[0] != " "]))
    assert "Popular now" in html_text.extract(page)


def test_boxes_without_content_go_and_short_parts_of_the_text_stay():
    text = "".join(f"<p>A long paragraph of the story, number {i}, which goes on and on, and then ends here.</p>" for i in range(4))
    page = f"<body><div><h2>Short</h2>{text}<ul><li>one</li></ul><div>Read next</div><table><tr><td>7</td></tr></table>{text}</div></body>"
    lines = html_text.extract(page).split("\n")
    assert lines[0] == "Short" and "one" in lines and "Read next" not in lines and "7" not in lines and len(lines) == 10
    page = page.replace("<body><div>", "<body><article>").replace("</div></body>", "</article></body>")
    assert {"Read next", "7", "one"} <= {*html_text.extract(page).split("\n")}  # an article is kept whole


def test_columns_with_dots_and_clashes(spark):
    rows = spark.createDataFrame([(1, "<p>x</p>", "u", "old"), (2, None, None, None), (None, "", "u", "z")], "`page.id` long, html string, `a.b` string, _main string")
    got = html_text.main_text(rows)
    assert got.columns == ["page.id", "html", "a.b", "_main"]
    assert sorted((r[0] is None, r[2] or "", r[3]) for r in got.collect()) == [(False, "", ""), (False, "u", "x"), (True, "u", "")]


def test_articles_of_all_pages_are_whole(spark):
    for r in html_text.main_text(common.read(spark, "/root/testdata/sf0.01", "pages")).collect():
        inside = r.html.split("<article>")[1].split("</article>")[0]
        assert r._main == html_text.extract(f"<article>{inside}</article>")


STORY = [f"A long paragraph of the story, number {i}, which goes on and on, and then ends here." for i in range(5)]
PROSE = "".join(f"<p>{x}</p>" for x in STORY)


def lines_of(page):
    return html_text.extract(page).split("\n")


def test_titles_and_sections_within_an_article_stay():
    head = '<header class="entry-header"><h1 class="entry-title">The Title</h1><div id="page-header-sub">By line</div></header>'
    assert lines_of(f"<body><header class='site-header'>Site</header><article>{head}{PROSE}</article></body>") == ["The Title", "By line", *STORY]
    related = "<div class='related-work'><p>Related work, which is a section of the paper, and is as long as the others are.</p></div>"
    assert lines_of(f"<main>{PROSE}{related}{PROSE}</main>")[5].startswith("Related work")
    links = "<div class='related-posts'><ul><li>One</li><li>Two</li></ul></div>"
    assert lines_of(f"<main>{PROSE}{links}{PROSE}</main>") == STORY * 2
    assert lines_of(f"<body><div>{PROSE}</div>{related}</body>") == STORY  # outside an article the name decides


def test_reader_comments_go_with_and_without_marks():
    said = "<p>I read this and must say, with respect, that all of it is wrong, as any reader can see.</p>" * 2
    for box in (f"<div class='thread'>{said}</div>", f"<div><h3>2 Comments</h3>{said}</div>", f"<section><h2>Kommentare (2)</h2><div>{said}</div></section>", f"<h2>Comments:</h2>{said}<div>{said}</div>"):
        assert lines_of(f"<body><article><h1>T</h1>{PROSE}{box}</article></body>") == ["T", *STORY], box
        assert lines_of(f"<body><div><h1>T</h1>{PROSE}{box}</div></body>") == ["T", *STORY], box
    discussion = f"<h2>Comments on the method</h2>{PROSE}"
    assert len(lines_of(f"<article>{PROSE}{discussion}</article>")) == 11


def test_ratios_decide_within_one_article_too(monkeypatch):
    page = f"<article>{PROSE}<div class='search-results'><span>7 hits</span></div>{PROSE}</article>"
    assert lines_of(page) == STORY * 2
    monkeypatch.setattr(html_text, "WEAK", 1.0)
    monkeypatch.setattr(html_text, "fused", lambda found: ([x for x in found if x[0] != " "], [1.0 for x in found if x[0] != " "]))
    assert "7 hits" in lines_of(page)


@pytest.mark.parametrize("part", ["<div>x", "<a ", "<b>x", "<div>x<span>", "</p>y<div>", "<p>x", "<li>x<ul>", "<", "<div class='ad'>x", '<a href="'])
def test_time_grows_with_the_page(part):
    import time

    began = time.process_time()
    html_text.extract(part * 50_000)
    assert time.process_time() - began < 8  # some seconds even on a slow machine; quadratic steps would take minutes
