"""Removal of repeated strings against dictionaries of all windows, and the suffix parts against plain sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspan.llm import repeats
from tests.llm.fixtures import no_documents, odd_documents


def plain(rows):
    """Result rows of (doc_id, text), from a dictionary of all windows."""
    last = 1 << 63
    data = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for (given, _), (i, b) in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, np.int8)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = 1
        spans = int((np.diff(gone, prepend=np.int8(0)) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((given, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(df, **kwargs):
    return sorted(map(tuple, repeats.removals(df, **kwargs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def passages(seed=3, docs=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(2, 7)))
    shared = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(rng.randrange(1, 5))]
        rows.append((rng.randrange(40), "".join(parts)))
    rows += [(50 + k, "x" * n) for k, n in enumerate((49, 50, 51, 120, 700))]  # one character
    rows += [(60, "ab" * 400), (61, "ba" * 90), (62, "\0" * 60 + "nul"), (63, "\0" * 70)]
    return rows


@pytest.mark.parametrize("hot", [0, 1, repeats.HOT])
def test_passages_equal_the_plain_form(spark, hot):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    assert sum(r[2] for r in want) > 2000
    assert removed(df, hot=hot) == want


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_documents(spark, clashing):
    df = odd_documents(spark, clashing).withColumn("key", F.lit(1)).withColumn("text_hash", F.lit(2)).withColumn("given", F.lit("x"))
    assert removed(df) == plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_long_texts_in_pieces(spark):
    """Windows over the borders of pieces, which are smaller than the text."""
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2 * repeats.PIECE + 500))
    border = long[repeats.PIECE - 90 : repeats.PIECE + 80]
    df = spark.createDataFrame([(2, long), (1, border), (3, "-" * 30 + long[-400:])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.spans) for r in repeats.removals(df).collect()}
    assert got == {1: (0, []), 2: (170, [repeats.PIECE - 90, repeats.PIECE + 80]), 3: (400, [30, 430])}


def test_nothing(spark):
    assert removed(no_documents(spark)) == []
    assert removed(spark.createDataFrame([(1, None), (2, ""), (None, "short")], "doc_id long, text string")) == plain([(1, None), (2, ""), (None, "short")])


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_and_common_prefixes(seed):
    rng = random.Random(seed)
    strings = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(20)} | {"ab" * 40, "b" * 70, "b" * 71})
    data = np.array([c for s in strings for c in [*(ord(x) + 1 for x in s), 0]], np.int16)
    order = repeats.suffix_order(data)
    apart = [int(c) or k - len(data) for k, c in enumerate(data)]  # an earlier separator is less
    assert order.tolist() == sorted(range(len(data)), key=lambda i: apart[i:])
    lcp = np.zeros(len(data), int)
    group = repeats.bounded_prefixes(data, order, 7, lcp)
    want = [0]
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while n < 7 and data[a + n] == data[b + n] > 0:
            n += 1
        want.append(n)
    assert lcp.tolist() == want
    assert [g >= 0 for g in group] == [n == 7 or m == 7 for n, m in zip(want, [*want[1:], 0], strict=True)]


def test_least_owner_of_each_window():
    strings = [b"abcdefgh", b"xcdefgy", b"zzzzzzzz"]
    string, starts, least = repeats.least_owners(strings, np.array([5, 3, 4]), 4)
    got = [least[(string == k) & starts].tolist() for k in range(3)]
    assert got == [[5, 5, 3, 3, 5], [3, 3, 3, 3], [4, 4, 4, 4, 4]]


def test_the_only_run_of_a_gram_is_not_transformed(monkeypatch):
    import pyarrow as pa

    seen = []
    real = repeats.least_owners
    monkeypatch.setattr(repeats, "least_owners", lambda strings, owners, *a: seen.append(list(strings)) or real(strings, owners, *a))
    x, y, z = (bytes([c]) * 20 + b"0123456789" * 4 for c in b"xyz")
    runs = [(0, 1, 10, x, 3, 9), (0, 2, 11, y, 5, 5), (0, 2, 12, y[1:] + b"?", 4, 4), (1, 7, 13, z, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*runs)], ["bucket", "gram", "run", "bytes", "least", "most"])
    got = [r for b in repeats._owners(iter([batch])) for r in b.to_pylist()]
    assert seen == [[y, y[1:] + b"?"]]
    assert [(r["gram"], r["run"], r["least"], np.frombuffer(r["spans"], np.int32).tolist()) for r in got] == [(1, 10, 3, []), (2, 11, 5, [1, 11])]
