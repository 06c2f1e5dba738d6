"""Similarity of long texts: difflib's ratio where anchors are sure, and never more than the best alignment."""

import difflib
import random
import time

import pytest

from docspan.functions import diff


def own_lines(rng, n, letters, width=24):
    return ["".join(rng.choice(letters) for _ in range(width)) for _ in range(n)]


def longest_common(x, y):
    before = [0] * (len(y) + 1)
    for a in x:
        row = [0]
        for j, b in enumerate(y):
            row.append(before[j] + 1 if a == b else max(before[j + 1], row[j]))
        before = row
    return before[-1]


@pytest.mark.parametrize("seed", range(6))
def test_sure_anchors_give_difflibs_ratio(seed):
    """Changed lines are of other letters than the rest, so that only whole lines agree."""
    rng = random.Random(seed)
    a = own_lines(rng, 130, "abcdefgh")
    b, k = [], 0
    while k < len(a):
        change = rng.random()
        b += own_lines(rng, 1, "TUVWXYZ") if change < 0.1 else [a[k]] if change < 0.8 else [a[k], *own_lines(rng, 1, "TUVWXYZ")] if change < 0.9 else []
        k += 1
    x, y = "\n".join(a) + "\n", "\n".join(b) + "\n"
    assert min(len(x), len(y)) > diff.SHORT
    assert diff.ratio(x, y) == difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


@pytest.mark.parametrize("seed", range(4))
def test_never_more_than_the_best_alignment(seed):
    rng = random.Random(seed)
    for letters in ("ab", "abc \n", "abcdefghijklmnop  \n"):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(300, 900)))
        y = "".join(c if rng.random() < 0.9 else rng.choice(letters) for c in x)[rng.randrange(20) :]
        got = diff.matched(x, y)
        best = longest_common(x, y)
        assert got <= best
        if letters == "abcdefghijklmnop  \n":  # with few letters there is little to hold on to
            assert got >= 0.7 * best, (letters, got, best)


def test_short_texts_have_difflibs_ratio():
    rng = random.Random(1)
    for _ in range(40):
        x, y = ("".join(rng.choice("ab \n") for _ in range(rng.randrange(300))) for _ in range(2))
        want = 1.0 if not x and not y else 0.0 if not x or not y else difflib.SequenceMatcher(None, x, y).ratio()
        assert diff.ratio(x, y) == want
    assert diff.ratio(None, "") == 1.0 and diff.ratio(None, "x") == 0.0


def test_rising_runs():
    assert diff.rising([]) == [] and diff.rising([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]


def test_a_megabyte_in_little_time():
    rng = random.Random(2)
    names = own_lines(rng, 3000, "abcdefghij", 6)
    a = [" ".join(rng.choice(names) for _ in range(11)) for _ in range(14_000)]
    b = [line if rng.random() < 0.95 else " ".join(rng.choice(names) for _ in range(11)) for line in a]
    x, y = "\n".join(a), "\n".join(b)
    assert len(x) > 1_000_000
    start = time.process_time()
    assert 0.93 < diff.ratio(x, y) < 0.99
    assert time.process_time() - start < 2  # about 0.6 s on a machine that does nothing else
    assert diff.ratio(" ".join(a), " ".join(b)) > 0.93  # one line
    assert diff.ratio("x" * (1 << 20), "x" * (1 << 20) + "y") > 0.999


def test_fewer_steps_than_difflib_give_its_blocks(monkeypatch):
    """Long texts that differ by little are done by search alone; all have the characters that difflib matches."""
    rng = random.Random(3)
    for k in range(400):
        letters = rng.choice(["ab", "abcdefgh \n", "abcdefghijklmnopqrstuvwxyz .,ABCDEFGHIJ0123"])
        x = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 199, 200, 900])))
        y = list(x)
        for _ in range(rng.choice([0, 1, 3, 20])):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.choice([0, 1, 4])] = rng.choice(letters) * rng.choice([0, 1, 3])
        y = "".join(y)
        for junk in (False, True):
            blocks = difflib.SequenceMatcher(None, x, y, autojunk=junk).get_matching_blocks()
            assert diff.same_chars(x, y, junk) == sum(b.size for b in blocks), (k, junk)

    def few(at, where, x, alo, ahi, blo, bhi):
        assert ahi - alo <= 3, "went through all places"
        return alo, blo, 0

    monkeypatch.setattr(diff, "_longest", few)
    assert diff.same_chars("2.1 " + "re on the it is " * 15, "## " + "re on the it is " * 15) == 241
