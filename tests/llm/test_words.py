import random
import re

import numpy as np

from docspan.llm.words import in_chunks, shingle_sets, word_hashes


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


TEXTS = [None, "", " ", "a", "A b", "x y z", "É é", "one\ttwo\x0bthree\x0cfour\rfive\nsix", "y" * 9000 + " z", " lead", "tail "]


def test_words_are_those_of_the_pattern():
    h, n = word_hashes(TEXTS)
    want = [w for t in TEXTS for w in plain(t)]
    assert n.tolist() == [len(plain(t)) for t in TEXTS]
    assert len(h) == len(want)
    known = {}
    for w, x in zip(want, h.tolist(), strict=True):
        assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_shingles_match_a_plain_version():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcde") for _ in range(rng.randrange(30))) for _ in range(200)]
    for k in (1, 4, 5):
        sets = list(shingle_sets(texts, k))
        seen = {}
        for t, s in zip(texts, sets, strict=True):
            w = plain(t)
            grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
            assert len(s) == len(grams)
            assert (np.diff(s.astype(object)) > 0).all()
            assert seen.setdefault(frozenset(grams), s.tobytes()) == s.tobytes()


def test_chunks_cover_all_texts():
    texts = ["ab"] * 10 + ["x" * 100] + [None] * 3
    for limit in (1, 5, 1000):
        cuts = list(in_chunks(texts, limit))
        assert [i for lo, hi in cuts for i in range(lo, hi)] == list(range(len(texts)))
    assert list(in_chunks([])) == []
