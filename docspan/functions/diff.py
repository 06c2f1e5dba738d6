"""How much of two texts is the same, in a time that is not quadratic in their length.

Texts are laid side by side at anchors: lines that occur once in either, of which the longest run that rises on
both sides is taken.  Between two anchors the same is done with words, and then with shorter pieces; only what is small
by then goes to a quadratic comparison, which gives what difflib gives.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

#: Texts up to this length are compared whole, as difflib does by default.
SHORT = 2000
#: Product of lengths up to which what lies between anchors is compared letter by letter; the second one holds
#: where no further anchors are to be found.
GAP, LAST_GAP = 1 << 16, 1 << 20
GRAM = 16
#: Characters that texts may have beside what they begin or end with alike, for their longest string to be searched for.
FEW = 64
#: How texts are cut for anchors, the coarsest first: lines, words, pieces that end with one of some characters.
CUTS = (re.compile(r"[^\n]*\n|[^\n]+"), re.compile(r"\s+|\S+"), re.compile(r"[^aeio0369=/]*[aeio0369=/]|[^aeio0369=/]+"))


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first place, whose second places rise too."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        n = bisect_left(ends, b)
        if n == len(ends):
            ends.append(b)
            at.append(k)
        else:
            ends[n], at[n] = b, k
        before.append(at[n - 1] if n else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal pieces that occur once on both sides; if there are none, of pieces that occur equally often on
    both sides, the first with the first and so on."""
    in_a, in_b = Counter(a), Counter(b)
    once = {p for p, n in in_a.items() if n == 1 and in_b.get(p) == 1}
    if once:
        where = {p: k for k, p in enumerate(b) if p in once}
        return rising([(k, where[p]) for k, p in enumerate(a) if p in once])
    often = {p for p, n in in_a.items() if in_b.get(p) == n}
    places: dict[str, list[int]] = {}
    for k, p in enumerate(b):
        if p in often:
            places.setdefault(p, []).append(k)
    given = {p: iter(ks) for p, ks in places.items()}
    return rising([(k, next(given[p])) for k, p in enumerate(a) if p in often])


def _between(a: list[str], b: list[str]) -> Iterator[tuple[str, str, int]]:
    """What lies before each anchor on both sides, and the anchor's length; at last what lies behind all."""
    i = j = 0
    for p, q in anchors(a, b):
        yield "".join(a[i:p]), "".join(b[j:q]), len(a[p])
        i, j = p + 1, q + 1
    yield "".join(a[i:]), "".join(b[j:]), 0


def common_start(x: str, y: str) -> int:
    """How many characters both begin with."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    return lo


def _by_grams(x: str, y: str) -> Iterator[tuple[str, str, int]]:
    """As `_between`, with strings of GRAM characters that occur once on both sides."""
    places = []
    for t in (x, y):
        once: dict[str, int] = {}
        for k in range(len(t) - GRAM + 1):
            gram = t[k : k + GRAM]
            once[gram] = -1 if gram in once else k
        places.append(once)
    i = j = 0
    for p, q in rising([(k, places[1][g]) for g, k in places[0].items() if k >= 0 and places[1].get(g, -1) >= 0]):
        if p >= i and q >= j:
            yield x[i:p], y[j:q], GRAM
            i, j = p + GRAM, q + GRAM
    yield x[i:], y[j:], 0


def same_chars(x: str, y: str, autojunk: bool = False) -> int:
    """Characters in the matching blocks of difflib's SequenceMatcher.  Its blocks are found by fewer steps: where texts begin and
    end alike but for a few characters by searching for what is longer than that, else by going only through
    those places of x whose character counts (with autojunk the rare ones of y)."""
    count = Counter(y)
    if autojunk and len(y) >= 200:
        most = len(y) // 100 + 1
        count = {c: n for c, n in count.items() if n <= most}
    at = [i for i, c in enumerate(x) if c in count]
    where: dict[str, list[int]] = {c: [] for c in {x[i] for i in at}}
    for j, c in enumerate(y):
        if c in where:
            where[c].append(j)
    whole = len(count) == 0 or not autojunk or len(y) < 200
    total, todo = 0, [(0, len(x), 0, len(y))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        got = _by_ends(x[alo:ahi], y[blo:bhi]) if whole and len(count) else None
        if got:
            i, j, k = got[0] + alo, got[1] + blo, got[2]
        else:
            i, j, k = _longest(at, where, x, alo, ahi, blo, bhi)
            back = common_start(x[alo:i][::-1], y[blo:j][::-1]) if i > alo and j > blo else 0
            i, j, k = i - back, j - back, k + back
            k += common_start(x[i + k : ahi], y[j + k : bhi])
        if k:
            total += k
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + k < ahi and j + k < bhi:
                todo.append((i + k, ahi, j + k, bhi))
    return total


def _longest(at: list[int], where: dict[str, list[int]], x: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest run of characters that count, the first in x and of those the first in y."""
    best, runs, last = (alo, blo, 0), {}, -2
    for i in at[bisect_left(at, alo) : bisect_left(at, ahi)]:
        before, runs = (runs if i == last + 1 else {}), {}
        last = i
        for j in where[x[i]]:
            if j < blo:
                continue
            if j >= bhi:
                break
            k = runs[j] = before.get(j - 1, 0) + 1
            if k > best[2]:
                best = i - k + 1, j - k + 1, k
    return best


def _by_ends(x: str, y: str) -> tuple[int, int, int] | None:
    """The longest string that x and y share, the first in x and of those the first in y; none if they differ by much."""
    k = max(common_start(x, y), common_start(x[::-1], y[::-1]))
    if not k or len(x) - k > FEW:
        return None
    for i in range(len(x) - k + 1):
        while i + k < len(x) and x[i : i + k + 1] in y:
            k += 1
    for i in range(len(x) - k + 1):
        j = y.find(x[i : i + k])
        if j >= 0:
            return i, j, k
    return None


def matched(x: str, y: str, level: int = 0) -> int:
    """Characters of x and y that are laid upon each other."""
    if not x or not y:
        return 0
    if x == y:
        return len(x)
    if len(x) * len(y) <= (LAST_GAP if level > len(CUTS) else GAP):
        return same_chars(x, y)
    if level > len(CUTS):  # nothing to hold on to: what both begin and end with
        start = common_start(x, y)
        x, y = x[start:], y[start:]
        return start + common_start(x[::-1], y[::-1])
    gaps = _by_grams(x, y) if level == len(CUTS) else _between(*(CUTS[level].findall(t) for t in (x, y)))
    return sum(matched(p, q, level + 1) + n for p, q, n in gaps)


def ratio(x: str | None, y: str | None) -> float:
    """Twice the matched characters by all; 1 if both are empty or null, 0 if one is.  Short texts have difflib's
    own ratio; of longer ones it is at most what the best alignment gives."""
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if max(len(x), len(y)) <= SHORT:
        return 2.0 * same_chars(x, y, autojunk=True) / (len(x) + len(y))
    return 2.0 * matched(x, y) / (len(x) + len(y))
