"""JavaScript and TypeScript, read as tokens: declarations and imports, none of them out of comments or strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

# The lexical grammar, as far as it matters here: what is passed over, then literals, names, and marks.
TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\#![^\n]*)
      | (?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
      | (?P<name>[^\W\d][\w$]*|\$[\w$]*)
      | (?P<number>\d[\w.]*)
      | (?P<mark>=>|.)""",
    re.X | re.S,
)
#: A pattern literal, where an operand may stand: after nothing, a mark that closes no operand, or one of these words.
PATTERN = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
BEFORE_OPERAND = frozenset("return typeof case do else in of void delete throw new await yield".split())
LEADING = frozenset(("export", "default", "async"))


def tokens(text: str) -> list[tuple[str, str, int, bool]]:
    """(kind, text, line, whether it is its line's first)."""
    out: list[tuple[str, str, int, bool]] = []
    at, line, fresh = 0, 1, True
    while at < len(text):
        operand = not out or out[-1][0] == "mark" and out[-1][1] not in ")]}" or out[-1][1] in BEFORE_OPERAND
        m = PATTERN.match(text, at) if text[at] == "/" and operand else None
        kind = "pattern" if m else None
        if m is None:
            m = TOKEN.match(text, at)
            kind = m.lastgroup
        if kind != "skip":
            out.append((kind, m[0], line, fresh))
            fresh = False
        lines = m[0].count("\n")
        line, fresh, at = line + lines, fresh or lines > 0 and kind == "skip", m.end()
    return out


def _closing(found: list, at: int) -> int:
    """Where the bracket that opens at `at` closes, or the end."""
    depth = 0
    for i in range(at, len(found)):
        if found[i][0] == "mark" and found[i][1] in "([{":
            depth += 1
        elif found[i][0] == "mark" and found[i][1] in ")]}":
            depth -= 1
            if not depth:
                return i
    return len(found)


def symbols(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, name, line) of classes, functions and arrow functions whose declaration begins a line."""
    found = tokens(text)
    word = lambda i: found[i][1] if i < len(found) else ""
    begins = False
    for i, (kind, x, line, first) in enumerate(found):
        begins = first or begins and i > 0 and found[i - 1][1] in LEADING
        if kind != "name" or not begins or i + 1 >= len(found) or found[i + 1][0] != "name":
            continue
        name = word(i + 1)
        if x == "class":
            yield "class", name, line
        elif x == "function" and word(i + 2) == "(":
            yield "function", name, line
        elif x in ("const", "let", "var") and word(i + 2) == "=":
            k = i + 3 + (word(i + 3) == "async" and word(i + 4) != "=>")
            end = _closing(found, k) if word(k) == "(" else k if k < len(found) and found[k][0] == "name" else None
            if end is not None and word(end + 1) == "=>":
                yield "arrow_function", name, line


def imports(text: str) -> Iterator[tuple[str, int]]:
    """(what is imported, line): static imports with and without names, and calls of require with one string."""
    found = tokens(text)
    for i, (kind, x, line, _) in enumerate(found):
        if kind != "name" or i and found[i - 1][1] == ".":
            continue
        if x == "require" and i + 3 < len(found) and found[i + 1][1] == "(" and found[i + 2][0] == "string" and found[i + 3][1] == ")":
            yield found[i + 2][1][1:-1], line
        elif x == "import":
            k = i + 1
            if k < len(found) and found[k][0] != "string":
                while k < len(found) and found[k][1] not in ("from", ";", "=", "(") and found[k][0] != "string":
                    k = _closing(found, k) + 1 if found[k][1] == "{" else k + 1
                if k + 1 < len(found) and found[k][1] == "from":
                    k += 1
                else:
                    continue
            if k < len(found) and found[k][0] == "string" and found[k][1][0] != "`":
                yield found[k][1][1:-1], line
