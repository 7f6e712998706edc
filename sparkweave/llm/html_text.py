"""HTML extraction by tag-path ratios.

Text length and punctuation are summed per root-to-leaf tag path; their means a text node are smoothed along the page,
multiplied, and averaged per path again. Paths that reach half of the page's average are content paths, and their nodes
the content. The main text is the innermost section that holds these nodes, without the boxes in it that hold none;
elements whose names mark menus, adverts, notices, forms or comments never take part. Within an article, names that an
article's own parts have too (related, search, ...) only lower the ratios of what they hold, and a header is its title.

Elements are numbered in page order and know their parents, paths are numbers, and what is asked of all elements around a
node is summed from the last element to the first: time and memory grow with the page, however deep it is.
"""

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'"<>]++)*+)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?'\"()…–—«»¿¡、。]")
# HTML's void elements, elements whose content is raw text, block elements, and what a new block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that are never content, and words of classes, ids and roles that mark such elements.
NOT_CONTENT = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas audio video map menu dialog fieldset label legend noembed noframes xmp".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "commenter commenters complementary consent contentinfo cookie cookies copyright dialog disqus footer footnav gdpr header login masthead menu "
    "menubar modal nav navbar navigation newsletter notice notification overlay pagination pager paywall popup privacy promo "
    "promoted promotion recommended recommendations related replies reply respond search share sharing sidebar signin signup "
    "skip social sponsor sponsored subscribe subscription tagcloud teaser thread threads toolbar topbar widget widgets".split()
)
#: Of these, the ones that an article's own parts have too: within one they make nodes count WEAK of their ratio.
WEAK_MARKS = frozenset("banner copyright dialog login notification popup privacy recommended recommendations related respond search skip teaser".split())
WEAK = 0.6
#: Headings of reader comments, which go on to the end of what holds the heading.
COMMENTS = re.compile(r"\s*(?:\d+\s+)?(?:(?:reader|user)\s+)?(?:comments?|replies|kommentare?|leserkommentare|commentaires?|comentarios?|leave a (?:reply|comment))\s*(?:\(\d+\))?\s*:?\s*", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article main section div body html td center".split())
#: Elements that part a page; without a content node such a one isn't part of the main text.
BOXES = frozenset("article main section div table center".split())


def marked(tag: str, attributes: str, inside_article: bool) -> int:
    """How an element is marked: 3 if its tag says that it isn't content or it is hidden, 2 if its class, id or role says so, 1
    if that is a weak mark within an article, or 0. An article's headers are its own."""
    if tag in NOT_CONTENT or tag == "header" and not inside_article:
        return 3
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    out = 0
    for name, *values in NAMED.findall(attributes):
        name, written = name.lower(), next(filter(None, values), "")
        value = written.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 3
        if name in ("class", "id", "role"):
            words = MARKS.intersection(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", written).lower()))
            if inside_article:
                words -= {"header", "masthead"}
            if words:
                out = max(out, 1 if inside_article and words <= WEAK_MARKS else 2)
    return out


class Page:
    """Text nodes in page order, (text, path, element, block), and the elements: by number from 1 (0 is the page), their tags,
    parents, marks, the outermost article or main around them, and the element around the block that they are in."""

    def __init__(self, page: str) -> None:
        self.found: list[tuple[str, int, int, int]] = []
        self.tags, self.parent, self.mark, self.top, self.outer, self.bad, self.path = [""], [0], [0], [0], [0], [False], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.cuts: dict[int, int] = {}  # element: the node from which on what it holds is comments
        self.read(page)

    def opened(self, tag: str, attributes: str, parent: int) -> int:
        e = len(self.tags)
        mark = marked(tag, attributes, bool(self.top[parent]))
        self.tags.append(tag)
        self.parent.append(parent)
        self.mark.append(mark)
        self.bad.append(self.bad[parent] or mark == 3)
        self.top.append(self.top[parent] or (e if tag in ("article", "main") else 0))
        self.outer.append(parent if tag in BLOCK else self.outer[parent])
        self.path.append(self.paths.setdefault((self.path[parent], tag), len(self.paths) + 1))
        return e

    def read(self, page: str) -> None:
        out, stack, open_tags, at, block = self.found, [0], {}, 0, 0
        tags = self.tags

        def text(upto: int) -> None:
            t, e = page[at:upto], stack[-1]
            if not t or self.bad[e]:
                return
            if not t.isspace():
                if tags[e] in HEADINGS and COMMENTS.fullmatch(t):
                    self.cuts.setdefault(self.parent[e], len(out))
                out.append((t, self.path[e], e, block))
            elif out and out[-1][3] == block:
                out.append((" ", 0, e, block))

        def cut(n: int) -> bool:
            """Closes elements from n on; says whether a block is among them."""
            closed = stack[n:]
            del stack[n:]
            for e in closed:
                open_tags[tags[e]] -= 1
            return any(tags[e] in BLOCK for e in closed)

        pos = 0
        while m := MARKUP.search(page, pos):
            text(m.start())
            at = pos = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if not open_tags.get(tag):
                    block += tag in BLOCK
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == tag:
                        block += cut(i)
                        break
                    if tags[stack[i]] in SECTIONS and tag not in SECTIONS and tag not in BLOCK:
                        break  # an inline end tag doesn't reach out of a section
                continue
            if tag == "br":
                if out and out[-1][3] == block and not self.bad[stack[-1]]:
                    out.append((" ", 0, stack[-1], block))
                continue
            if tag in BLOCK:
                block += 1
                closes = CLOSED_BY.get(tag, ())
                for i in range(len(stack) - 1, 0, -1):
                    inner = tags[stack[i]]
                    if inner == "p" or inner in closes:
                        cut(i)
                        break
                    if inner in BLOCK:
                        break
            if tag in VOID:
                continue
            e = self.opened(tag, m[3], stack[-1])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
                if not (self.bad[e] or tag == "title"):
                    stack.append(e)
                    text(end.start() if end else len(page))
                    stack.pop()
                at = pos = end.end() if end else len(page)
            elif not m[3].endswith("/") or tag in BLOCK:
                stack.append(e)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        text(len(page))

    def summed(self, at: dict[int, int]) -> list[int]:
        """For each element the sum over itself and all it holds."""
        out = [0] * len(self.tags)
        for e, n in at.items():
            out[e] += n
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def down(self, first: list) -> list:
        """For each element what is true of it or of an element around it."""
        for e in range(1, len(first)):
            first[e] = first[e] or first[self.parent[e]]
        return first

    def without(self, dropped: set[int]) -> None:
        """Leaves out what these elements hold."""
        if dropped:
            gone = self.down([e in dropped for e in range(len(self.tags))])
            self.found = [x for x in self.found if not gone[x[2]]]

    def without_comments(self) -> None:
        """Leaves out headed comments: from the heading on, what the element around the heading holds."""
        if self.cuts:
            from_node = [self.cuts.get(e, 1 << 62) for e in range(len(self.tags))]
            for e in range(1, len(from_node)):
                from_node[e] = min(from_node[e], from_node[self.parent[e]])
            self.found = [x for n, x in enumerate(self.found) if n < from_node[x[2]]]


def smooth(x: np.ndarray) -> np.ndarray:
    """A Gaussian of one node's width along the page."""
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    pad = np.pad(x, 2, mode="edge")
    return np.convolve(pad, kernel / kernel.sum(), mode="valid")


def fused(found: list) -> tuple[list, list[float]]:
    """Text nodes without spacers, and the ratio of each one's path: mean text length times mean punctuation (and one) of
    a path's nodes, each smoothed along the page, as a mean over the path's nodes."""
    length, points, count, total = {}, {}, {}, {}
    real = [x for x in found if x[0] != " "]
    for t, path, _, _ in real:
        length[path] = length.get(path, 0) + len(t.strip())
        points[path] = points.get(path, 0) + len(PUNCTUATION.findall(t))
        count[path] = count.get(path, 0) + 1
    by_length, by_points = (smooth(np.array([d[x[1]] / count[x[1]] for x in real], float)) for d in (length, points))
    for x, value in zip(real, (by_length * (1 + by_points)).tolist(), strict=True):
        total[x[1]] = total.get(x[1], 0) + value
    return real, [total[x[1]] / count[x[1]] for x in real]


def selected(page: Page) -> list[tuple]:
    """The content nodes: those whose ratio, lowered by weak marks around them, reaches half the page's mean."""
    real, ratio = fused(page.found)
    least = 0.5 * sum(ratio) / len(ratio)
    weak = page.down([m == 1 for m in page.mark]) if 1 in page.mark else None
    return [x for x, r in zip(real, ratio, strict=True) if (r * WEAK if weak and weak[x[2]] else r) >= least]


def wrappers(page: Page, named: set[int]) -> set[int]:
    """Named elements that hold most of the selected text, in blocks of their own, and all that articles hold: the page's
    layout and no part of it."""
    at: dict[int, int] = {}
    content = selected(page)
    for x in content:
        around = page.outer[x[2]]
        at[around] = at.get(around, 0) + len(x[0])
    held, total = page.summed(at), sum(len(x[0]) for x in content)
    out = {e for e in named if 2 * held[e] > total}
    if out:
        other = page.down([e in named and e not in out for e in range(len(page.tags))])
        inside: dict[int, int] = {}
        for x in page.found:
            if x[0] != " " and page.top[x[2]] and not other[x[2]]:
                inside[x[2]] = inside.get(x[2], 0) + 1
        n = page.summed(inside)
        out = {e for e in out if n[e] == n[0]}
    return out


def extract(text: str | None) -> str:
    """The main text of a page: blocks in page order, one to a line. A null or empty page has an empty one."""
    page = Page(text or "")
    page.without_comments()
    named = {e for e, m in enumerate(page.mark) if m == 2}
    if page.found and named:
        page.without(named - wrappers(page, named))
    if not page.found:
        return ""
    content = selected(page)
    at: dict[int, int] = {}
    for x in content:
        at[x[2]] = at.get(x[2], 0) + len(x[0])
    chars, total = page.summed(at), sum(at.values())
    page.without({e for e, m in enumerate(page.mark) if m == 1 and not chars[e]})
    tops = {page.top[x[2]] for x in content} - {0}
    if tops and 2 * sum(chars[e] for e in tops) >= total:  # the one article, or what holds all of them
        held = page.summed(dict.fromkeys(tops, 1))
        root = max((e for e in range(1, len(held)) if held[e] == len(tops)), default=0)
    else:  # the innermost section that holds all of it
        root = max((e for e in range(1, len(chars)) if chars[e] == total and page.tags[e] in SECTIONS), default=0)
    kept = _within(page, root, chars)
    blocks: dict[int, list[str]] = {}
    for t, _, e, block in page.found:
        if kept[e]:
            blocks.setdefault(block, []).append(t)
    lines = (" ".join(html.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def _within(page: Page, root: int, chars: list[int]) -> list[bool]:
    """Which elements are in the root and in no box of their own that holds no content node. What is within an article or
    main element that holds some is part of it."""
    kept, settled = [False] * len(page.tags), [False] * len(page.tags)
    kept[root], settled[root] = True, bool(page.top[root])
    for e in range(root + 1, len(page.tags)):
        parent, tag = page.parent[e], page.tags[e]
        if parent < root or not (kept[parent] or settled[parent]):
            continue
        kept[e], settled[e] = kept[parent], settled[parent]
        if not settled[e] and (not chars[e] or tag in ("article", "main")):
            settled[e] = True
            kept[e] = bool(chars[e]) or tag not in BOXES
    return kept


def main_text(pages: DataFrame, html_col: str = "html", into: str = "_main") -> DataFrame:
    """pages with a string column `into`: the main text of the whole html; a column of that name gives way, all others,
    whatever their names, go through. Null and empty pages, and pages without
    content, have an empty text; repeated rows are extracted like others; an empty table gives no rows. Each page is
    worked on where it lies: nothing is shuffled."""

    @F.arrow_udf(T.StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(x) for x in batch.to_pylist()], pa.string())

    return pages.select(*[pages[common.quoted(c)] for c in pages.columns if c != into], texts(pages[common.quoted(html_col)].cast("string")).alias(into))
