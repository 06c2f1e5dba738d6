"""Hard negatives against products and sorting in plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from docspan.llm import negatives
from docspan.llm.negatives import Mining

VECTORS = "vec_id long, embedding array<double>, label int, score long, row string, q int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, rule=Mining()):
    kept = []
    for vec_id, x, label in rows:
        if x is not None and label is not None and all(c is not None and np.isfinite(c) for c in x):
            kept.append((vec_id, [int(np.floor(256 * c)) for c in x], label))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (vec_id, x, label) in enumerate(kept):
        if vec_id is None or vec_id % 5:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=False)), last(i), i, lab) for b, (i, y, lab) in enumerate(kept) if b != a]
        scored.sort(key=lambda s: s[:2])
        for p in [s for s in scored if s[3] == label][: rule.positives]:
            fit = [s for s in scored if s[3] != label and rule.low * -p[0] <= 100 * -s[0] <= rule.high * -p[0]]
            out += [(vec_id, p[2], k + 1, n[2], -p[0], -n[0]) for k, n in enumerate(fit[: rule.negatives])]
    return sorted(out, key=str)


def mined(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, x, lab, 7, "r", 1) for i, x, lab in rows], VECTORS).repartition(3)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 5 == 0, **kwargs).select(*COLUMNS).collect()), key=str)


def odd_rows(n=160, dims=19):
    rng = random.Random(8)
    rows = [(k, [rng.uniform(0, 1) for _ in range(dims)], rng.randrange(3) if k % 3 else 1) for k in range(n)]
    rows += [rows[20], rows[20], (25, rows[3][1], 1), (31, rows[30][1], 2), (32, rows[30][1], 2)]  # repeated rows, one id twice, ties
    rows += [(40, None, 1), (41, [0.1] * dims, None), (45, [None] + [0.2] * (dims - 1), 1), (46, [float("nan")] * dims, 1), (47, [float("inf")] * dims, 0)]
    rows += [(None, [0.5] * dims, 1), (None, [0.4] * dims, 2), (50, [], 1), (55, [0.9] * 4, 2), (60, [-1.0] * dims, 0), (-5, [0.6] * dims, 2)]
    return rows


def test_scores_are_inner_products():
    rng = np.random.default_rng(3)
    for low, high, dims in ((-150, 150, 64), (0, 2, 7), (-1, 1, 9), (-(1 << 30), 1 << 30, 12), (0, 1, 1)):
        x, y = rng.integers(low, high, (5, dims)), rng.integers(low, high, (300, dims))
        assert (negatives.scores(negatives.subset_sums(x), negatives.planes(y)) == y @ x.T).all()
    assert negatives.scores(negatives.subset_sums(np.zeros((2, 0), int)), negatives.planes(np.zeros((3, 0), int))).shape == (3, 2)


def test_rows_equal_the_plain_form(spark):
    rows = odd_rows()
    want = plain(rows)
    assert len(want) > 200 and mined(spark, rows) == want


def test_other_rules_and_small_blocks(spark, monkeypatch):
    rows, rule = odd_rows(90), Mining(positives=2, negatives=4, low=80, high=99)
    monkeypatch.setattr(negatives, "BLOCK", 17)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    assert mined(spark, rows, rule=rule) == plain(rows, rule)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, [1.0], 1)]) == []  # no other row
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1)]) == []  # no other label
