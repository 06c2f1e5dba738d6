import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspan.llm import jaccard
from docspan.llm.components import connected
from docspan.llm.jaccard import Rule, jaccard_components, keep_one, tile_keys
from tests.llm.fixtures import no_documents, odd_documents


def brute(rows, k, share):
    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= share * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("clashing", [False, True])
def test_components_match_brute_force(spark, clashing):
    df = odd_documents(spark, clashing)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [tuple(r) for r in jaccard_components(df, Rule(4, 85)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 4, 85), key=key)


def chains(seed):
    """Groups in which each text is near the next but not near all, beside texts that share passages."""
    rng = random.Random(seed)
    rows, n = [], 0
    passage = [f"p{i}" for i in range(40)]
    for g in range(6):
        text = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.choice([8, 20, 90, 200]))]
        for _ in range(14):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(max(1, len(text) // 60)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
    for _ in range(30):
        rows.append((n, " ".join([f"q{rng.randrange(10**6)}" for _ in range(10)] + passage)))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [60, 85])
def test_chains_and_shared_passages(spark, share, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)  # so that tiles take several blocks
    rows = chains(share)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_components(df, Rule(4, share)).collect())
    assert got == sorted(brute(rows, 4, share))


def test_linked_sets_share_a_tile():
    rng = np.random.default_rng(3)
    rule = Rule(5, 80)
    for _ in range(400):
        n = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, n // 6)))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, n // 8))), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if rule.linked(both, len(a), len(b)) and not np.array_equal(a, b):
            keys, owner = tile_keys([a, b], rule)
            assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_one_of_each_group_stays(spark):
    df = odd_documents(spark, clashing=True)
    kept = keep_one(df, Rule(5, 80))
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and not {2, 3} & set(ids)
    assert {4, 5, 6} <= set(ids)  # nothing in them to compare
    assert ids.count(None) == 1
    assert {7, 8} & set(ids) and not {7, 8} <= set(ids)


def test_nothing_in_nothing_out(spark):
    assert jaccard_components(no_documents(spark)).collect() == []
    assert keep_one(no_documents(spark)).collect() == []


def test_long_paths_are_one_component(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 500), (9, 9)], "a long, b long")
    got = dict(connected(links).select("node", "label").collect())
    assert got == {**dict.fromkeys(range(n + 1), 0), 500: 500, 501: 500}
    assert links.filter(F.lit(False)).count() == 0


def test_spared_keys_lose_no_link(spark):
    """Each text of a group has passages that all others have too, so that its most frequent keys go."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for g in range(40):
        text = [f"g{g}w{i}" for i in range(170)]
        for _ in range(3):
            near = list(text)
            for _ in range(rng.choice([1, 2, 3, 4])):
                near[rng.randrange(len(near))] = f"new{rng.randrange(10**6)}"
            at = rng.randrange(len(near))
            rows.append((len(rows), " ".join(near[:at] + common + near[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_components(df, Rule(5, 80)).collect())
    assert got == sorted(brute(rows, 5, 80))
    # rows in tiles don't grow with the square of the texts that share the passage
    tiles = jaccard._tiles(df, Rule(5, 80), "text").groupBy("key").count()
    assert tiles.agg(F.max("count")).first()[0] <= 3
