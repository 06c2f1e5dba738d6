"""Operators that cut their rows into bands, against plain loops; and rounding against Python's."""

import datetime as dt
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from docspan.functions.text import half_even
from docspan.operators import metrics, validation


@pytest.mark.parametrize("band", [20, 60, 1000, 86_400])
def test_alerts_over_bands(spark, band):
    rng = random.Random(band)
    start, rows = dt.datetime(2024, 1, 1), []
    for key in ("a", "b", None):
        at = 0
        for _ in range(300):
            at += rng.choice([1, 5, 19, 20, 21, 45])
            rows.append((key, start + dt.timedelta(seconds=at), rng.choice([True] * 12 + [False, None])))
    want = []
    for key in ("a", "b", None):
        run = []
        for k, ts, on in [*rows, (key, None, False)]:
            if k != key:
                continue
            if run and (not on or (ts - run[-1]).total_seconds() > 20):
                if (run[-1] - run[0]).total_seconds() >= 60:
                    want.append((key, run[0], run[0] + dt.timedelta(seconds=60), run[-1], len(run)))
                run = []
            if on:
                run.append(ts)
    df = spark.createDataFrame(rows, "k string, ts timestamp, up boolean").repartition(5)
    got = metrics.alert_intervals(df, ["k"], F.col("up"), hold=60, every=20, band=band)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 10
    assert metrics.alert_intervals(df.limit(0), ["k"], F.col("up"), hold=60).count() == 0


@pytest.mark.parametrize("band", [7, 64])
def test_overlaps_equal_comparing_all(spark, band):
    rng = random.Random(band)
    rows = [(p, None if p == 3 else p % 2, i, rng.randrange(-20, 200), rng.randrange(-20, 150), rng.randrange(0, 40), rng.randrange(0, 60)) for p in range(4) for i in range(70)]
    rows += [(0, 0, 100, 5, 5, 10, 10), (0, 0, 101, 5, 5, 10, 10), (0, 0, 102, 15, 5, 10, 10), (0, 0, 103, None, 5, 10, 10)]  # equal, touching, without a place
    want = set()
    for p, q, i, x, y, w, h in rows:
        for p2, _, i2, x2, y2, w2, h2 in rows:
            if p == p2 and i < i2 and None not in (x, x2) and min(w, h, w2, h2) > 0:
                wide, tall = min(x + w, x2 + w2) - max(x, x2), min(y + h, y2 + h2) - max(y, y2)
                if wide > 0 and tall > 0 and round(wide * tall / min(w * h, w2 * h2), 6) > 0.1:
                    want.add((p, q, i, i2))
    df = spark.createDataFrame(rows, "page int, part int, i int, x int, y int, w int, h int").repartition(3)
    got = validation.word_overlaps(df, ["page", "part"], ["i"], band=band)
    assert got.columns == ["page", "part", "a_i", "b_i", "ratio"]
    pairs = [tuple(r)[:4] for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 100
    counts = {(r.page, r.part): (r.overlap_count, r.code) for r in validation.overlap_counts(df, ["page", "part"], ["i"]).collect()}
    assert counts == {k: (sum(w[:2] == k for w in want), "WORD_BOXES_OVERLAP") for k in {w[:2] for w in want}}


def test_rounding_is_pythons(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 0.00005, 0.00015, 2.675, 1.00005, 0.12345, -0.12345, 0.5, 1e15, 4.5e15, 1e300, -1e300, 5e-324, 123456789.00005]
    values += [k / 32 for k in range(-3000, 3000)]  # ties
    values += [(k + 0.5) / 10_000 for k in range(-20_000, 20_000)]  # look like ties
    values += [rng.uniform(-10, 10) for _ in range(60_000)] + [rng.uniform(-1e9, 1e9) for _ in range(20_000)]
    values += [v for v in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(20_000)) if v == v]
    for digits in (4, 2):
        got = spark.createDataFrame([(v,) for v in values], "v double").select(half_even(F.col("v"), digits)).collect()
        wrong = [(v, r[0], round(v, digits)) for v, r in zip(values, got, strict=True) if repr(r[0]) != repr(round(v, digits))]
        assert not wrong, wrong[:5]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(half_even(F.col("v"))).collect()
    assert odd[0][0] != odd[0][0] and odd[1][0] == float("inf") and odd[2][0] is None


def test_findings_as_coded_rows(spark):
    words = spark.createDataFrame([(1, "a", 0, 0, 1, 1, 0.9), (2, None, 0, 0, 1, 1, 0.9), (3, "c", 0, None, 1, 1, 0.9), (4, "d", 0, 0, 1, 1, None)], "i int, word string, x int, y int, w int, h int, confidence double")
    assert sorted(map(tuple, validation.word_format_warnings(words, ["i"]).collect())) == [(i, "INVALID_WORD_BOX_FORMAT", "high") for i in (2, 3, 4)]
    results = spark.createDataFrame([(1, '{"sections":[]}'), (2, '{"sections":null}'), (3, '{"a":1}'), (4, "text"), (5, None), (6, "[]")], "i int, content string")
    assert {r.i for r in validation.structured_warnings(results, ["i"]).collect()} == {3, 4, 5, 6}
    items = spark.createDataFrame([(1, 0, 0, 1, 1, 0.4), (1, 0, 0, 1, 1, 0.9), (2, 0, 0, 1, 1, 0.9)], "p int, x int, y int, w int, h int, confidence double")
    assert [tuple(r) for r in validation.ratio_warnings(validation.validation_summary(items, ["p"], (0, 0, 10, 10)), ["p"]).collect()] == [(1, "HIGH_LOW_CONFIDENCE_RATIO", "high")]


@pytest.mark.parametrize(("pairs", "made"), [(1 << 18, 1 << 16), (50, 40)])
def test_overlaps_of_rows_equal_those_of_their_boxes(spark, monkeypatch, pairs, made):
    """Rows of words are counted without a row a word; with small limits, in many steps."""
    from docspan.operators import geometry

    rng = random.Random(pairs)
    rows = [(p, None if p == 3 else 1, i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 3, 70, 90]))), x := rng.randrange(0, 30), y := rng.randrange(0, 200), x + rng.randrange(0, 600), y + rng.randrange(0, 80)) for p in range(4) for i in range(12)]
    rows += [(4, 1, i, "a b c d " * 40, 0, 791, 100, 792) for i in range(20)] + [(4, 1, 20, "a", 0, None, 5, 9), (4, 1, 21, None, 0, 0, 5, 9)]
    df = spark.createDataFrame(rows, "p int, q int, i int, content string, x1 int, y1 int, x2 int, y2 int")
    words = geometry.word_boxes_equal(df, ["p", "q", "i"])
    boxes = words.select("p", "q", "i", "word_no", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    monkeypatch.setattr(validation, "PAIRS", pairs)
    monkeypatch.setattr(validation, "ROWS", made)
    want = {(r.p, r.q): r["count"] for r in validation.word_overlaps(boxes, ["p", "q"], ["i", "word_no"]).groupBy("p", "q").count().collect()}
    lines = geometry.word_rows_equal(df, ["p", "q", "i"])
    for got in (validation.row_overlap_counts(lines, ["p", "q"], ["i"]), validation.overlap_counts(boxes, ["p", "q"], ["i", "word_no"])):
        assert {(r.p, r.q): r.overlap_count for r in got.collect()} == want and len(want) == 5
    # limits in force where the work is done
    parts = [b for b in validation._made_boxes(_one_row(), 1, 1)]
    assert sum(b.num_rows for b in parts) == 500 and len(parts) == (1 if made > 500 else 13)
    ends = [b.column("x").to_pylist() for b in parts]
    assert all(a[-1] < b[0] for a, b in zip(ends, ends[1:]))


def _one_row():
    import pyarrow as pa

    values = {"p": 1, "i": 1, "x": 3, "step": 2, "wide": 10, "right": 1003, "n": 900, "y": 0, "h": 5, "top": 0, "band": 0}
    return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in values.items()})


def test_ratio_that_is_over_the_threshold_once_rounded(spark):
    for threshold in (0.0, 0.1, 0.25, 1 / 3):
        least = validation.least_ratio(threshold)
        near = [(least,), (math.nextafter(least, 0.0),), (math.nextafter(least, 1.0),)]
        assert [r[0] > threshold for r in spark.createDataFrame(near, "r double").select(F.round("r", 6)).collect()] == [True, False, True]
