"""Substring dedup: shared k-mer seeds, chained with gap costs through a Fenwick tree and aligned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import bloom, common

#: Words of a seed; seeds that compete for the least hash (so two texts share a seed in any K + WINNOW - 1 equal words).
K, WINNOW = 6, 5
#: Cost of a word between two chained matches; words around a chain that are aligned too.
GAP_COST, AROUND = 0.1, 64
#: Words between seeds of two references that may be of one passage; seeds on either side of such a border that are paired.
NEAR, BORDER = 24, 3
#: Added to the places of paired seeds, so that they are told from runs of min_words, and of spaced seeds, which may have a
#: difference in them; no text has so many words.
PAIRED = 1 << 30
#: Words of either half of a spaced seed, and one in how many of these is a seed, by its hash.
HALF, SPACED = 3, 2
#: Bytes of a seed's hash that are kept beside the number of its part, of a place in a text, and of a step between ids.
HASH_BYTES, PLACE_BYTES, STEP_BYTES = 6, 4, 8
#: Characters of texts that are handled in one go, and of words that are hashed at once; base of a word's hash.
FLUSH, BLOCK, BASE = 3_000_000, 1 << 18, 0x9E3779B97F4A7C15
#: What str.split() parts words at; the last place stands for all characters beyond.
SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base ** 2 and so on, modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSE = powers(BLOCK, BASE), powers(BLOCK, pow(BASE, -1, 1 << 64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of texts one after another, words of each); words are runs without white space, in lower case.

    A word's hash is a polynomial of its characters, read from running sums over blocks of words."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    space = SPACE[np.minimum(flat, len(SPACE) - 1)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    ends_of_texts = np.cumsum(np.array([len(t) + 1 for t in low], np.int64))
    sizes = np.diff(np.searchsorted(start, ends_of_texts), prepend=0)
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, side="right")))
        a, b = start[at:to] - start[at], end[at:to] - start[at]
        n = int(b[-1])
        up, down = (POWERS, INVERSE) if n <= BLOCK else (powers(n, BASE), powers(n, pow(BASE, -1, 1 << 64)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((flat[start[at] : start[at] + n] + np.uint64(1)) * up[:n], out=sums[1:])
        out[at:to] = common.mixed((sums[b] - sums[a]) * down[a])
        at = to
    return out, sizes


def flushes(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, words of each text) of runs of texts of about FLUSH characters."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= FLUSH or i == len(texts) - 1:
            yield first, *word_hashes(texts[first : i + 1])
            first, size = i + 1, 0


def planes(x: np.ndarray, width: int, ends: np.ndarray) -> list[bytes]:
    """The low bytes of numbers, all lowest bytes of a section first: places in order compress well like that."""
    low = np.ascontiguousarray(np.asarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    ends = ends.tolist()
    return [low[:, i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def numbers(parts: list[bytes], width: int) -> np.ndarray:
    """What planes() was given, one after another."""
    out, at = np.zeros((sum(map(len, parts)) // width, 8), np.uint8), 0
    for part in parts:
        n = len(part) // width
        out[at : at + n, :width] = np.frombuffer(part, np.uint8).reshape(width, n).T
        at += n
    return out.view(np.int64).ravel()


def steps(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The differences of numbers, each section's first from 0, as unsigned ones that are small for small steps either way."""
    d = x.astype(np.int64)
    first = ends[:-1][np.diff(ends) > 0]
    d[1:] -= x[:-1]
    d[first] = x[first]
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def walked(d: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What steps() was given."""
    u = d.view(np.uint64)
    x = np.cumsum((u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64))
    before = np.append(0, x)[ends[:-1]]
    return x - np.repeat(before, np.diff(ends))


def ranked(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of each id among the different ones in order, these)."""
    rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64) - 1
    first = np.zeros(int(rank.max()) + 1 if len(rank) else 0, np.int64)
    first[rank] = np.arange(len(rank))
    return rank, ids.take(pa.array(first))


def part_of(ids: pa.Array, parts: int) -> np.ndarray:
    """The part that the rows of an id are in."""
    if pa.types.is_integer(ids.type):
        h = common.mixed(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    else:
        h = np.array([xxhash.xxh3_64_intdigest(str(v).encode("utf-8", "surrogatepass")) for v in ids.to_pylist()], np.uint64)
    return (h >> np.uint64(20)) % np.uint64(parts)


def parts_for(size: int) -> int:
    """Parts that the seeds of texts of so many bytes are dealt over: one for 2 MB, beyond 1,024 of these one for 8 MB, so that a
    part of any input fits a task (a megabyte has some 140,000 seeds) and a task's rows for the parts don't get too short."""
    return max(64, min(size >> 21, 1024), size >> 23)


def run_lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each run of equal numbers."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return first, np.diff(np.append(first, len(x)))


def seeds_of(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of the least k-mer in each run of WINNOW k-mers of a text; of equal ones in a run the first.

    flat: word hashes of texts one after another; sizes: words of each. A text of fewer k-mers has one run.
    """
    starts = np.cumsum(sizes) - sizes
    if len(flat) < K:
        return flat[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(flat)) - starts[text]
    h = np.append(common.shingles(flat, K), np.full(K - 1 + WINNOW, np.iinfo(np.uint64).max, np.uint64))
    n = np.maximum(sizes - K + 1, 0)[text]  # k-mers of a position's text
    real = inside < n
    runs = np.nonzero(real & (inside <= np.maximum(n - WINNOW, 0)))[0]
    width = np.minimum(n[runs], WINNOW)
    least, place = h[runs], runs.copy()
    for j in range(1, WINNOW):
        lower = (j < width) & (h[runs + j] < least)
        least, place = np.where(lower, h[runs + j], least), np.where(lower, runs + j, place)
    chosen = np.zeros(len(h), bool)
    chosen[place] = True
    at = np.nonzero(chosen)[0]
    return h[at], text[at], inside[at]


def tied_here(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of seeds in order of owner and position: (row that each is tied to, whether another owner has its hash).

    Of the owners of a hash the first keeps its rows (each is tied to itself); the n-th row of another is tied to the
    first one's n-th, over and over.
    """
    order = np.argsort(h, kind="stable")
    g, o, at = h[order], owner[order], np.arange(len(h))
    new = np.append(True, g[1:] != g[:-1])
    other = new | np.append(True, o[1:] != o[:-1])
    group, own = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(other, at, 0))
    size = np.bincount(group[own == group], minlength=len(h))[group]
    several = np.bincount(group[own != group], minlength=len(h))[group] > 0
    to, shared = np.empty_like(at), np.empty(len(h), bool)
    to[order], shared[order] = order[np.where(own == group, at, group + (at - own) % size)], several
    return to, shared


def doubts(py: np.ndarray, px: np.ndarray, ref: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """First and last start of runs of min_words that other texts may have, though no one reference of them is known.

    From the seeds of one text that other texts have too, each with its place in its reference (a number each; the text
    itself where it is the first). Seeds that are WINNOW apart at most may be of one run; it is known where a reference
    has all of it on one diagonal.
    """
    at = np.unique(py)
    gap = np.nonzero(np.diff(at) > WINNOW)[0] + 1
    lo = np.maximum(at[np.append(0, gap)] - WINNOW + 1, 0)
    hi = at[np.append(gap, len(at)) - 1] - max(0, min_words - K - WINNOW + 1)
    lo, hi = lo[hi >= lo], hi[hi >= lo]
    if not len(lo):
        return []
    free = np.zeros(hi.max() + 1, bool)
    for a, b in zip(lo, hi, strict=True):
        free[a : b + 1] = True
    order = np.lexsort((py, py - px, ref))
    y, d, r = py[order], (py - px)[order], ref[order]
    new = np.append(True, (r[1:] != r[:-1]) | (d[1:] != d[:-1]) | (y[1:] > y[:-1] + K))
    first = np.nonzero(new)[0]
    start, end = y[first], y[np.append(first[1:], len(y)) - 1] + K
    for a, b in zip(start[end - start >= min_words], end[end - start >= min_words], strict=True):
        free[a : b - min_words + 1] = False
    edge = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist(), strict=True))


def borders(py: np.ndarray, ref: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """First and last place of the seeds around each change of reference: where seeds of one text that other texts have come
    from several of them, NEAR words apart at most, a later text may have all of it with differences. A change between two
    runs of one reference that are passages by themselves is none."""
    order = np.argsort(py, kind="stable")
    y, r = py[order], ref[order]
    change = np.flatnonzero((r[1:] != r[:-1]) & (np.diff(y) <= NEAR))
    if not len(change):
        return []
    new = np.append(True, (r[1:] != r[:-1]) | (np.diff(y) > NEAR))
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    words = y[np.append(first[1:], len(y)) - 1] + K - y[first]
    short = np.minimum(words[run[change]], words[run[change + 1]]) < min_words
    lo, hi = y[np.maximum(change - BORDER + 1, 0)], y[np.minimum(change + BORDER, len(y) - 1)]
    return [(int(max(a, y[c] - NEAR)), int(min(b, y[c + 1] + NEAR))) for a, b, c in zip(lo[short], hi[short], change[short], strict=True)]


def pair_seeds(h: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of both seeds of each pair of seeds that lie in one of the windows lo to hi, BORDER + 1 apart at most.

    Places ascend, and those of another text are beyond any window, so all texts of a flush are handled at once."""
    start, end = np.searchsorted(place, lo), np.searchsorted(place, hi, side="right")
    reach = np.zeros(len(h) + 1, np.int64)  # the end of the windows that a seed is in
    np.maximum.at(reach, start, end)
    reach = np.maximum.accumulate(reach)
    keys, places = [], []
    for gap in range(1, BORDER + 2):
        a = np.flatnonzero(np.arange(len(h)) + gap < reach[:-1])
        both = common.mixed(h[a] * np.uint64(0xD6E8FEB86659FD93) + h[a + gap])
        keys += [common.mixed(both + np.uint64(1)), common.mixed(both + np.uint64(2))]
        places += [place[a], place[a + gap]]
    keys, places = np.concatenate(keys), np.concatenate(places)
    order = np.lexsort((keys, places))
    keys, places = keys[order], places[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (places[1:] != places[:-1]))[: len(keys)]
    return keys[new], places[new]


def spaced_seeds(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of HALF words, any one word and HALF words: of every SPACED such the one whose hash says so, in
    whatever text it is. Where each run of equal words is too short for a seed, these lie across the differences."""
    span = 2 * HALF + 1
    if len(flat) < span:
        return flat[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = common.shingles(flat, HALF)
    h = common.mixed(half[: -HALF - 1] * np.uint64(0xD6E8FEB86659FD93) + half[HALF + 1 :] + np.uint64(3))
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
    inside = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[text]
    at = np.flatnonzero((inside + span <= sizes[text]) & ((h >> np.uint64(17)) % np.uint64(SPACED) == 0))
    return h[at], text[at], inside[at]


def equal_runs(x: np.ndarray, y: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """A chain with matches only of words that are equal: a match from a spaced seed is parted at its difference."""
    out = []
    for px, py, n in chain.tolist():
        same = x[px : px + n] == y[py : py + n]
        if same.all():
            out.append((px, py, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        out += [(px + a, py + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return np.array(out, np.int64).reshape(-1, 3)


class Fenwick:
    """Maximum of (value, number) over a prefix."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def most(self, n: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while n > 0:
            if self.best[n] > out:
                out = self.best[n]
            n -= n & -n
        return out


def runs(px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Seeds on one diagonal that touch or overlap, as rows (x, y, words)."""
    order = np.lexsort((px, px - py))
    px, py = px[order], py[order]
    new = np.ones(len(px), bool)
    new[1:] = ((px - py)[1:] != (px - py)[:-1]) | (px[1:] > px[:-1] + K)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(px)) - 1
    return np.stack([px[first], py[first], px[last] + K - px[first]], axis=1)


def chains(px: np.ndarray, py: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of seeds, best first: each as rows (x, y, words), in order in both texts."""
    return chained(runs(px, py))


def chained(m: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of matches (x, y, words), best first, each in order in both texts.

    A match extends the best earlier one that ends before it in both texts, at GAP_COST a word between them. The cost
    is a sum of ends and starts, so the best is a prefix maximum over y: a Fenwick tree, filled as x advances.
    """
    if len(m) == 1:
        return [m]
    ends = np.unique(m[:, 1] + m[:, 2])
    tree, score, back = Fenwick(len(ends)), [0.0] * len(m), [-1] * len(m)
    events = sorted([(int(x), 1, i) for i, x in enumerate(m[:, 0])] + [(int(x), 0, i) for i, x in enumerate(m[:, 0] + m[:, 2])])
    starts = np.searchsorted(ends, m[:, 1], side="right").tolist()
    at = np.searchsorted(ends, m[:, 1] + m[:, 2]).tolist()
    begin, close, words = (m[:, 0] + m[:, 1]).tolist(), (m[:, 0] + m[:, 1] + 2 * m[:, 2]).tolist(), m[:, 2].tolist()
    for _, opens, i in events:
        if opens:
            value, j = tree.most(starts[i])
            gain = value - GAP_COST * begin[i]
            score[i], back[i] = (words[i] + gain, j) if gain > 0 else (words[i], -1)
        else:
            tree.put(at[i], (score[i] + GAP_COST * close[i], i))
    used, out = [False] * len(m), []
    for i in sorted(range(len(m)), key=lambda i: -score[i]):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = back[i]
        if own:
            out.append(m[own[::-1]])
    return out


def edit(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(matches, columns) of a least-cost alignment of two runs of words; equal words at both ends are matches at no cost."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    front = int(differ[0]) if len(differ) else n
    back = np.flatnonzero(a[len(a) - n + front :][::-1] != b[len(b) - n + front :][::-1])
    back = int(back[0]) if len(back) else n - front
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return front + back, front + back + len(b)
    one = 1 << 32  # an error; matches on the way are packed below it
    if len(a) * len(b) <= 200:
        state, row = [j * one for j in range(len(b) + 1)], b.tolist()
        for i, x in enumerate(a.tolist()):
            left, new = (i + 1) * one, [(i + 1) * one]
            for j, y in enumerate(row):
                left = min(left + one, state[j + 1] + one, state[j] + (-1 if x == y else one))
                new.append(left)
            state = new
    else:
        state = step = np.arange(len(b) + 1) * one
        for i, x in enumerate(a):
            diagonal = state[:-1] + np.where(b == x, -1, one)
            new = np.empty_like(state)
            new[0] = (i + 1) * one
            new[1:] = np.minimum(diagonal, state[1:] + one)
            state = np.minimum.accumulate(new - step) + step
    errors = -(-int(state[-1]) // one)
    matches = errors * one - int(state[-1])
    return front + back + matches, front + back + matches + errors


def extended(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, matches) that are gained beyond a chain's end: +1 a match, -2 a difference, until 8 below the best."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    run = np.cumsum(np.where(same, 1, -2))
    stop = np.nonzero(run < np.maximum.accumulate(np.maximum(run, 0)) - 8)[0]
    run = run[: stop[0]] if len(stop) else run
    if not len(run) or run.max() <= 0:
        return 0, 0
    best = int(run.argmax()) + 1
    return best, int(same[:best].sum())


def reaches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, matches) of all extensions that end with a match, none first."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    at = np.flatnonzero(same)
    return np.append(0, at + 1), np.arange(len(at) + 1)


def aligned(x: np.ndarray, y: np.ndarray, chain: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, int, int]]:
    """(x start, x end, y start, y end, matches, columns) of the passages of a chain, which counts from the starts of x and y.

    That is the whole chain, or else the longest stretches of its matches that reach the identity, as few as cover all
    such stretches: a gap that pulls the whole below the identity parts it, and no match of min_words is ever lost.
    """
    m = chain.tolist()
    if len(m) == 1:  # what it gains lies on its diagonal: there must be enough matches there at all
        sx, sy, n = m[0]
        before, after = min(sx, sy), min(len(x) - sx, len(y) - sy)
        if np.count_nonzero(x[sx - before : sx + after] == y[sy - before : sy + after]) < identity * min_words - 1e-9:
            return []
    matches, columns = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)  # up to and with each match
    got = cols = 0
    for i, (px, py, n) in enumerate(m):
        if i:
            ex, ey = m[i - 1][0] + m[i - 1][2], m[i - 1][1] + m[i - 1][2]
            more, wide = edit(x[ex:px], y[ey:py])
            got, cols = got + more, cols + wide
        got, cols = got + n, cols + n
        matches[i], columns[i] = got, cols

    def passage(i: int, j: int) -> tuple[int, int, int, int, int, int] | None:
        """Matches i to j with the words around them, if these don't pull them below the identity."""
        (sx, sy, n), (ex, ey, e) = m[i], m[j]
        ex, ey = ex + e, ey + e
        before, after = extended(x[:sx][::-1], y[:sy][::-1]), extended(x[ex:], y[ey:])
        for (left, a), (right, b) in ((before, after), (before, (0, 0)), ((0, 0), after), ((0, 0), (0, 0))):
            got, cols = int(matches[j] - matches[i]) + n + a + b, int(columns[j] - columns[i]) + n + left + right
            if ey + right - sy + left >= min_words and got >= identity * cols:
                return sx - left, ex + right, sy - left, ey + right, got, cols
        # Differences near its ends may stop a passage short of min_words: the shortest one that ends with matches.
        core, surplus = ey - sy, int(matches[j] - matches[i]) + n - identity * (int(columns[j] - columns[i]) + n)
        (left, a), (right, b) = reaches(x[:sx][::-1], y[:sy][::-1]), reaches(x[ex:], y[ey:])
        if core + left[-1] + right[-1] < min_words:
            return None
        total = core + left[:, None] + right
        fits = (total >= min_words) & (surplus + (a - identity * left)[:, None] + (b - identity * right) >= -1e-9)
        if not fits.any():
            return None
        k = int(np.where(fits, total, 1 << 30).argmin())
        k, r = divmod(k, len(right))
        more = int(left[k]) + int(right[r])
        return sx - int(left[k]), ex + int(right[r]), sy - int(left[k]), ey + int(right[r]), int(matches[j] - matches[i]) + n + int(a[k] + b[r]), int(columns[j] - columns[i]) + n + more

    if whole := passage(0, len(m) - 1):
        return [whole]
    above = matches - identity * columns
    ahead = np.maximum.accumulate(above[::-1])[::-1]
    start = above - (1 - identity) * chain[:, 2]
    # The last match up to which a stretch from each match reaches the identity.
    last = len(m) - 1 - np.searchsorted(ahead[::-1], start - 1e-9)
    out: list[tuple[int, int, tuple]] = []
    for i, j in enumerate(last.tolist()):
        if (not out or j > out[-1][1]) and (found := passage(i, j)):
            while len(out) > 1 and i <= out[-2][1]:
                out.pop()
            out.append((i, j, found))
    return [found for _, _, found in out]


def hopeful(chain: pa.Array, x: pa.Array, y: pa.Array, least: float, word: str = "<u4") -> np.ndarray:
    """Whether each chain of several matches, or of one with enough equal words on its diagonal, may be a passage; x and y are the
    words around it, null if unknown. All chains of one match are looked at together."""
    known = pc.and_(pc.is_valid(x), pc.is_valid(y)).to_numpy(zero_copy_only=False)
    sizes = [pc.fill_null(pc.binary_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64) // n for v, n in ((chain, 12), (x, np.dtype(word).itemsize), (y, np.dtype(word).itemsize))]
    one = np.flatnonzero((sizes[0] == 1) & known)
    out = np.ones(len(chain), bool)
    if len(one):
        begins = [(np.cumsum(n) - n)[one] for n in sizes]
        flat = [np.frombuffer(b"".join(pc.fill_null(v, b"").to_pylist()), t) for v, t in ((chain, "<i4"), (x, word), (y, word))]
        sx, sy = (flat[0][3 * begins[0] + k].astype(np.int64) for k in (0, 1))
        before = np.minimum(sx, sy)
        n = np.maximum(before + np.minimum(sizes[1][one] - sx, sizes[2][one] - sy), 0)
        ends = np.cumsum(n)
        inside = np.arange(n.sum()) + np.repeat(n - ends, n)
        same = flat[1][inside + np.repeat(begins[1] + sx - before, n)] == flat[2][inside + np.repeat(begins[2] + sy - before, n)]
        total = np.append(0, np.cumsum(same))
        out[one] = total[ends] - total[ends - n] >= least - 1e-9
    return out


def passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of a document that an earlier one has too: id, start and end (words), ref_<id>, ref_start,
    ref_end, n_words, identity (matches a column of the alignment).

    A seed ties a document to the least id that has the seed, never to all others, so a passage that thousands of
    documents share makes thousands of rows and not millions. Documents that a task reads together are tied to the least
    of them first and only that one goes on, so that a hot seed makes a row a flush in its task and not a row a document;
    the class of a passage is what its rows connect.
    Where the seeds of a run of min_words are of several references, its runs of min_words are tied in the same way in
    a second round, so each exact run that an earlier document has is in a row. Where the reference of seeds changes within a
    stretch, seeds from both sides of the border are tied in pairs, so that a fuzzy copy of a passage whose pieces occur in
    earlier documents is tied to the first that has the pieces together. Of the passages of two documents
    those that the others cover are left out. Spaced seeds tie copies whose differences leave no run of K words.
    Chains of one match are tested on a byte a word first, so that chance seeds, whose share grows with the documents, move few bytes.
    Seeds and ties move in rows of one part each (by hash, or by text), as many as the texts' size asks for; Spark deals the parts.
    Words are runs without white space, in lower case. Null, empty and short texts and rows with a null id have no
    passages; rows that share an id are one document, and don't repeat themselves; an empty table gives no rows.
    """
    rows = common.keyed(docs, id_col, text_col).filter("_id is not null and _text is not null")
    id_type, id_kind = rows.schema["_id"].dataType.simpleString(), to_arrow_type(rows.schema["_id"].dataType)

    numbered = pa.types.is_integer(id_kind)  # such ids move as steps from one to the next
    parts = parts_for(rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0)

    def spread(ids, h, row, pos):
        """Rows of one flush, texts in order of their ids: what its first owner of a hash has goes on to the hash's part, the
        others are tied to that owner here and go on as ties. Seeds of a part are one row, so that Spark moves and sorts
        few rows; a seed is shared where others here have it."""
        values, owner = ids.to_pylist(), np.zeros(len(ids), np.int64)
        for i in range(1, len(values)):
            owner[i] = owner[i - 1] + (values[i] != values[i - 1])
        to, shared = tied_here(h, owner[row])
        mine = to == np.arange(len(to))
        if not mine.all():
            done = np.flatnonzero(~mine)
            yield ties_of(ids, row[done], pos[done], row[to[done]], pos[to[done]], -1)
        part = ((h >> np.uint64(8 * HASH_BYTES)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        keep = np.flatnonzero(mine)
        keep = keep[np.argsort(part[keep], kind="stable")]
        h, row, pos, part, kept = h[keep], row[keep], pos[keep], part[keep], shared[keep]
        first, _ = run_lengths(part)
        run, size = run_lengths(part.astype(np.int64) << 32 | row)
        inside = np.searchsorted(run, np.append(first, len(row)))
        ends = np.append(first, len(row))
        yield batch_of_parts(part[first], (ids, row[run], inside, size), None, planes(h, HASH_BYTES, ends), planes(pos, PLACE_BYTES, ends), planes(kept, 1, ends))

    def batch_of_parts(part, y, x, h, p, q):
        """y, x: (ids, places among them, ends of the rows in these places, how often each is repeated)."""
        columns = [pa.array(part, pa.int32())]
        for side in (y, x):
            if side is None:
                columns += [pa.array([b""] * len(part), pa.binary()) if numbered else pa.array([[]] * len(part), pa.list_(id_kind)), pa.array([b""] * len(part), pa.binary())]
                continue
            ids, at, ends, size = side
            here = ids.take(pa.array(at))
            if numbered:
                columns.append(pa.array(planes(steps(here.cast(pa.int64()).to_numpy(), ends), STEP_BYTES, ends), pa.binary()))
            else:
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), here).cast(pa.list_(id_kind)))
            columns.append(pa.array(planes(size, PLACE_BYTES, ends), pa.binary()))
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.binary()) for v in (h, p, q))], ["_b", "_y", "_ny", "_x", "_nx", "_h", "_p", "_q"])

    def ties_of(ids, y, py, x, px, sign):
        """Ties of texts y to texts x (places among ids), a row for each part of texts; sign -1: still on its way to the ties."""
        part = part_of(ids, parts).astype(np.int64)[y]
        order = np.lexsort((x, y, part))
        y, py, x, px, part = y[order], py[order], x[order], px[order], part[order]
        first, _ = run_lengths(part)
        ends, sides = np.append(first, len(part)), []
        for v in (y, x):
            run, size = run_lengths(part << 32 | v)
            sides.append((ids, v[run], np.searchsorted(run, ends), size))
        return batch_of_parts(part[first] if sign > 0 else -1 - part[first], *sides, [b""] * len(first), planes(py, PLACE_BYTES, ends), planes(px, PLACE_BYTES, ends))

    def whole_parts(batches):
        """(part, its rows) of each part, in order of the parts."""
        held = []
        for batch in batches:
            b = batch.column(0).to_numpy()
            for i, k in zip(*(v.tolist() for v in run_lengths(b)), strict=True):
                if held and held[-1][0] != b[i]:
                    yield held[0][0], [r for _, r in held]
                    held = []
                held.append((int(b[i]), batch.slice(i, k)))
        if held:
            yield held[0][0], [r for _, r in held]

    def column(rows, k):
        return [v for r in rows for v in r.column(k).to_pylist()]

    def ids_in(rows, k):
        if numbered:
            packed = column(rows, k)
            ends = np.cumsum([0, *(len(v) // STEP_BYTES for v in packed)])
            return pa.array(walked(numbers(packed, STEP_BYTES), ends)).cast(id_kind)
        return pa.concat_arrays([r.column(k).flatten() for r in rows])

    def ties_in(rows) -> tuple:
        """(y, py, x, px, ids) of the ties in rows of parts; y and x are places among the ids, which are in order."""
        ys, xs = ids_in(rows, 1), ids_in(rows, 3)
        rank, ids = ranked(pa.concat_arrays([ys, xs]))
        y, x = np.repeat(rank[: len(ys)], numbers(column(rows, 2), PLACE_BYTES)), np.repeat(rank[len(ys) :], numbers(column(rows, 4), PLACE_BYTES))
        return y, numbers(column(rows, 6), PLACE_BYTES), x, numbers(column(rows, 7), PLACE_BYTES), ids

    def seed(batches):
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            for first, hashes, sizes in flushes(batch.column(1).to_pylist()):
                ids = batch.column(0).slice(first, len(sizes))
                (h, row, pos), (more, more_row, more_pos) = seeds_of(hashes, sizes), spaced_seeds(hashes, sizes)
                h, row, pos = np.append(h, more), np.append(row, more_row), np.append(pos, more_pos + PAIRED)
                if len(h):
                    order = np.lexsort((pos, row))
                    yield from spread(ids, h[order], row[order], pos[order])

    def tie(batches):
        """Each seed with a seed of its hash's first id, where several ids have it, here or in a flush; the n-th place in a
        text goes with the n-th place in the first one, over and over. Seeds tied before pass."""
        for part, rows in whole_parts(batches):
            if part < 0:
                for r in rows:
                    yield r.set_column(0, "_b", pa.array(-1 - r.column(0).to_numpy(), pa.int32()))
                continue
            h, shared = numbers(column(rows, 5), HASH_BYTES), np.frombuffer(b"".join(column(rows, 7)), bool)
            order = np.argsort(h)
            g = h[order]
            again = np.append(g[1:] == g[:-1], False)
            again[1:] |= again[:-1]
            keep = order[again | shared[order]]  # the hashes of one seed alone are done with
            if not len(keep):
                continue
            rank, ids = ranked(ids_in(rows, 1))
            owner = np.repeat(rank, numbers(column(rows, 2), PLACE_BYTES))[keep]
            h, p, shared = h[keep], numbers(column(rows, 6), PLACE_BYTES)[keep], shared[keep]
            order = np.lexsort((p, owner, h))
            h, owner, p, shared = h[order], owner[order], p[order], shared[order]
            n, at = len(h), np.arange(len(h))
            new = np.append(True, h[1:] != h[:-1])
            other = new | np.append(True, owner[1:] != owner[:-1])
            group, own = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(other, at, 0))
            size = np.bincount(group[own == group], minlength=n)[group]
            several = np.bincount(group[(own != group) | shared], minlength=n)[group] > 0
            to = np.where(own == group, at, group + (at - own) % size)
            i = np.flatnonzero(several)
            if len(i):
                yield ties_of(ids, owner[i], p[i], owner[to[i]], p[to[i]], 1)

    def doubt(batches):
        """The runs of each text that a second round must tie."""
        for _, rows in whole_parts(batches):
            y, py, x, px, ids = ties_in(rows)
            plain = py < PAIRED  # spaced seeds may have a difference in them: no run is known by them
            y, py, x, px = y[plain], py[plain], x[plain], px[plain]
            order, out = np.lexsort((py, x, y)), []
            y, py, x, px = y[order], py[order], x[order], px[order]
            for a, n in zip(*(v.tolist() for v in run_lengths(y)), strict=True):
                mine = slice(a, a + n)
                out.extend((y[a], lo, hi) for lo, hi in doubts(py[mine], px[mine], x[mine], min_words))
                out.extend((y[a], -1 - lo, hi) for lo, hi in borders(py[mine], x[mine], min_words))
            if out:
                at, lo, hi = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["_id", "_lo", "_hi"])

    def long_seed(batches):
        """All runs of min_words that start in the wanted windows, and the paired seeds of windows at borders."""
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            wanted = batch.column(2).to_pylist()
            for low, hashes, sizes in flushes(batch.column(1).to_pylist()):
                ids, ends = batch.column(0).slice(low, len(sizes)), np.cumsum(sizes).tolist()
                flat, row, start, whole, windows = [], [], [], [], []
                for i, end in enumerate(ends):
                    w = hashes[end - sizes[i] : end]
                    if at_borders := [(i << 32 | -1 - x["_lo"], i << 32 | x["_hi"]) for x in wanted[low + i] if x["_lo"] < 0]:
                        whole.append((i, w))
                        windows += at_borders
                    for x in sorted((x for x in wanted[low + i] if x["_lo"] >= 0), key=lambda x: x["_lo"]):
                        part = w[x["_lo"] : x["_hi"] + min_words]
                        if len(part) >= min_words:
                            flat.append(part)
                            row.append(i)
                            start.append(x["_lo"])
                if whole:
                    texts_at = np.array([i for i, _ in whole])
                    h, of, pos = seeds_of(np.concatenate([w for _, w in whole]), np.array([len(w) for _, w in whole], np.int64))
                    lo, hi = np.array(windows, np.int64).T
                    h, place = pair_seeds(h, texts_at[of] << 32 | pos, lo, hi)
                    if len(h):
                        yield from spread(ids, h, place >> 32, (place & 0xFFFFFFFF) + PAIRED)
                if flat:
                    n = np.array([len(part) for part in flat])
                    h, inside = common.shingles(np.concatenate(flat), min_words), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    keep = np.nonzero(inside <= np.repeat(n, n) - min_words)[0]  # the others go over a window's end
                    yield from spread(ids, h[keep], np.repeat(row, n)[keep], (np.repeat(start, n) + inside)[keep])

    def chain(batches):
        """The chains of each pair of texts, with the windows of both that are aligned: on a grid of 64 words. Most pairs have one
        match; all of these are handled at once."""
        inner = np.array(sorted({*range(0, min_words - K + 1, K), max(0, min_words - K)}))  # short seeds that make up a long one
        for _, rows in whole_parts(batches):
            y, py, x, px, ids = ties_in(rows)
            long = np.repeat(np.array(column(rows, 8)), [len(p) // PLACE_BYTES for p in column(rows, 6)]) & (py < PAIRED)
            seeds = np.stack([y, x, py & PAIRED - 1, px & PAIRED - 1])
            whole = seeds[:, long][:, :, None] + np.array([[0], [0], [1], [1]])[:, :, None] * inner
            seeds = np.concatenate([seeds[:, ~long], whole.reshape(4, -1)], axis=1)
            y, x, py, px = seeds[:, seeds[1] < seeds[0]]
            order = np.lexsort((px, px - py, x, y))
            y, x, py, px = y[order], x[order], py[order], px[order]
            if not len(y):
                continue
            pair = np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1]))
            first = np.flatnonzero(pair | np.append(True, ((px - py)[1:] != (px - py)[:-1]) | (px[1:] > px[:-1] + K)))
            m = np.stack([px[first], py[first], px[np.append(first[1:], len(y)) - 1] + K - px[first]], axis=1)
            start, n = run_lengths(np.cumsum(pair)[first])
            one, at, chain_of = start[n == 1], [], []
            for i, k in zip(start[n > 1].tolist(), n[n > 1].tolist(), strict=True):
                for c in chained(m[i : i + k]):
                    at.append(i)
                    chain_of.append(c)
            at, matches = np.append(one, np.array(at, np.int64)), np.concatenate([m[one], *chain_of])
            ends = np.cumsum(np.append(np.ones(len(one), np.int64), np.array([len(c) for c in chain_of], np.int64)))
            head, tail = matches[ends - np.diff(ends, prepend=0)], matches[ends - 1]
            low = np.maximum(head[:, :2] - AROUND, 0) // 64 * 64
            high = -(-(tail[:, :2] + tail[:, 2:] + AROUND) // 64) * 64
            matches[:, :2] -= np.repeat(low, np.diff(ends, prepend=0), axis=0)
            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, 12 * ends).astype(np.int32)), pa.py_buffer(matches.astype("<i4").tobytes())])
            windows = [pa.array(v, pa.int32()) for v in (low[:, 0], high[:, 0], low[:, 1], high[:, 1])]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[first][at])), ids.take(pa.array(y[first][at])), *windows, packed], ["_x", "_y", "_x0", "_x1", "_y0", "_y1", "_chain"])

    def short(batches):
        """A byte of each word's hash: enough to tell texts that differ."""
        for batch in batches:
            for first, hashes, sizes in flushes(batch.column(1).to_pylist()):
                packed, ends = (hashes >> np.uint64(32)).astype(np.uint8).tobytes(), np.append(0, np.cumsum(sizes)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), pa.array([packed[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["_id", "_bytes"])

    def likely(batches):
        """The chains that may be passages, as far as a byte a word tells: equal words are never taken for different ones."""
        for batch in batches:
            yield batch.filter(pa.array(hopeful(*(batch.column(k) for k in (6, 7, 8)), identity * min_words, "u1"))).select(range(7))

    def cut(batches):
        """The wanted windows of each text, as 32-bit word hashes."""
        for batch in batches:
            wanted = batch.column(2)
            for first, hashes, sizes in flushes(batch.column(1).to_pylist()):
                mine = wanted.slice(first, len(sizes))
                at = np.repeat(np.arange(len(sizes)), pc.list_value_length(mine).to_numpy(zero_copy_only=False))
                lo, hi = (v.to_numpy(zero_copy_only=False) for v in mine.flatten().flatten())
                words, ends = (hashes >> np.uint64(32)).astype("<u4"), np.cumsum(sizes)[at]
                begin = ends - sizes[at]
                got = [words[i:j].tobytes() for i, j in zip(np.minimum(begin + lo, ends).tolist(), np.minimum(begin + hi, ends).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + first)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(got, pa.binary())], ["_id", "_lo", "_hi", "_words"])

    def align(batches):
        for batch in batches:
            at, out, batch = [], [], batch.filter(pa.array(hopeful(*(batch.column(k) for k in (4, 5, 6)), identity * min_words)))
            for i, (x0, y0, c, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True)):
                c, x, y = np.frombuffer(c, "<i4").reshape(-1, 3), np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                if c[-1, 0] + c[-1, 2] > len(x) or c[-1, 1] + c[-1, 2] > len(y):
                    continue  # the window of another row with this id
                if not len(c := equal_runs(x, y, c)):
                    continue
                for xs, xe, ys, ye, matches, columns in aligned(x, y, c, min_words, identity):
                    at.append(i)
                    out.append((y0 + ys, y0 + ye, x0 + xs, x0 + xe, ye - ys, matches / columns))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(take), *(pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)), batch.column(0).take(take), *(pa.array([o[k] for o in out], pa.int64()) for k in (2, 3, 4)), pa.array([o[5] for o in out], pa.float64())], [id_col, "start", "end", f"ref_{id_col}", "ref_start", "ref_end", "n_words", "identity"])

    def needed(batches):
        """In order of (text, reference, start): as few passages as cover the same words (many overlap in periodic text)."""
        key, kept, schema = None, [], None
        for batch in batches:
            schema, out = batch.schema, []
            for row in batch.to_pylist():
                if (now := (row[id_col], row[f"ref_{id_col}"])) != key:
                    out, key, kept = out + kept, now, []
                if kept and row["end"] <= kept[-1]["end"]:
                    continue
                while len(kept) > 1 and row["start"] <= kept[-2]["end"]:
                    kept.pop()
                kept.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema)

    id_list = "binary" if numbered else f"array<{id_type}>"
    seeds = f"_b int, _y {id_list}, _ny binary, _x {id_list}, _nx binary, _h binary, _p binary, _q binary"
    spots, col = f"_x {id_type}, _y {id_type}, _x0 int, _x1 int, _y0 int, _y1 int, _chain binary", F.col
    parted = lambda df: df.repartition("_b").sortWithinPartitions("_b")
    with common.shuffles_dropped(docs.sparkSession):
        ties = common.written(common.per_batch(parted(common.per_batch(rows, seed, seeds)), tie, seeds), "ties", "zstd")
        loose = common.per_batch(parted(ties), doubt, f"_id {id_type}, _lo int, _hi int")
        loose = common.checkpointed(loose.groupBy(col("_id").alias("_w")).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_windows")))
        again = bloom.possible(rows, "_id", loose.select("_w")).join(loose, col("_id") == col("_w")).select("_id", "_text", "_windows")
        second = common.written(common.per_batch(parted(common.per_batch(again, long_seed, seeds)), tie, seeds), "ties", "zstd")
        both_rounds = ties.withColumn("_long", F.lit(False)).union(second.withColumn("_long", F.lit(True)))
        found = common.written(common.per_batch(parted(both_rounds), chain, spots), "chains", "zstd")
        common.dropped(ties, second)
        # Most chains are chance: a byte a word turns them away before any window of words moves. An id of several texts has no bytes.
        in_chains = found.select(F.explode(F.array("_x", "_y")).alias("_w")).distinct()
        whole = common.per_batch(bloom.possible(rows, "_id", in_chains), short, f"_id {id_type}, _bytes binary").groupBy("_id").agg(F.min("_bytes").alias("_a"), F.max("_bytes").alias("_z"))
        whole = whole.select("_id", F.when(col("_a") == col("_z"), col("_a")).alias("_bytes"))
        near = lambda s: F.substring("_bytes", col(f"_{s}0") + 1, col(f"_{s}1") - col(f"_{s}0")).alias(f"_bytes{s}")
        shown = found.join(whole, col("_x") == col("_id")).select(*found.columns, near("x"))
        shown = shown.join(whole, col("_y") == col("_id")).select(*shown.columns, near("y"))
        every, found = found, common.written(common.per_batch(shown, likely, spots), "chains", "zstd")
        common.dropped(every)
        x_side = found.select(col("_x").alias("_id"), col("_x0").alias("_lo"), col("_x1").alias("_hi"))
        y_side = found.select(col("_y").alias("_id"), col("_y0").alias("_lo"), col("_y1").alias("_hi"))
        wanted = x_side.union(y_side).distinct().groupBy(col("_id").alias("_w")).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_windows"))  # of one text, on a grid of 64 words
        wanted = common.checkpointed(wanted)
        of_chains = bloom.possible(rows, "_id", wanted.select("_w"))  # most texts have no chain and needn't move
        windows = common.written(common.per_batch(of_chains.join(wanted, col("_id") == col("_w")).select("_id", "_text", "_windows"), cut, f"_id {id_type}, _lo int, _hi int, _words binary").dropDuplicates(["_id", "_lo", "_hi"]), "windows")
    side = lambda s: windows.select(col("_id").alias(f"_i{s}"), col("_lo").alias(f"_l{s}"), col("_hi").alias(f"_h{s}"), col("_words").alias(f"_words{s}"))
    both = found.join(side("x"), (col("_x") == col("_ix")) & (col("_x0") == col("_lx")) & (col("_x1") == col("_hx"))).join(side("y"), (col("_y") == col("_iy")) & (col("_y0") == col("_ly")) & (col("_y1") == col("_hy")))
    schema = f"`{id_col}` {id_type}, start bigint, end bigint, `ref_{id_col}` {id_type}, ref_start bigint, ref_end bigint, n_words bigint, identity double"
    pair = [col(f"`{id_col}`"), col(f"`ref_{id_col}`")]
    out = common.per_batch(both.select("_x", "_y", "_x0", "_y0", "_chain", "_wordsx", "_wordsy"), align, schema)
    return common.per_batch(out.repartition(*pair).sortWithinPartitions(*pair, "start", F.desc("end"), F.desc("identity"), "ref_start", "ref_end"), needed, schema)
