"""Streams with state by key, over several batches: results against the batch forms, and state that goes."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from docspan.operators import sequences
from docspan.streaming import streams

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
EPOCH = int(START.timestamp() * 1000)


def log(seed=3, n=400, users=7):
    rng = random.Random(seed)
    ms = 0
    rows = []
    for i in range(n):
        ms += rng.choice([1, 500, 4000, 60_000])
        rows.append((i, rng.choice([*range(users), None]), EPOCH + ms, START + dt.timedelta(milliseconds=ms)))
    return rows


@pytest.fixture
def arriving(spark, tmp_path):
    """A source that reads one file a batch, and a way of adding files to it."""
    schema = "id int, user int, ms long, ts timestamp"
    folder = str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def source():
        return streams.read_folder(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)

    return add, source


def state_rows(spark, folder):
    return spark.read.format("statestore").option("stateVarName", "held").load(f"{folder}/checkpoint").count()


def test_limiter_over_batches(spark, tmp_path, arriving):
    add, source = arriving
    rows, folder = log(), str(tmp_path / "out")
    want = {r.id: (r.admitted, r.in_window) for r in sequences.admitted_requests(spark.createDataFrame(rows, "id int, user int, ms long, ts timestamp"), "user", seconds=90, limit=3).collect()}
    for k in range(0, 400, 100):  # each run goes on from the state of the last
        add(rows[k : k + 100])
        got = streams.caught_up(streams.admitted(source(), "user", seconds=90, limit=3), folder)
    assert {r.id: (r.admitted, r.in_window) for r in got.collect()} == want
    held = state_rows(spark, folder)
    assert 0 < held <= 8 * 3
    add([(1000, 99, EPOCH + 10**9, START + dt.timedelta(milliseconds=10**9))])
    streams.caught_up(streams.admitted(source(), "user", seconds=90, limit=3), folder)
    assert state_rows(spark, folder) == 1  # of the last row alone: the others' windows have passed


def test_first_within(spark, tmp_path, arriving):
    add, source = arriving
    rows = [(i, user, EPOCH + 1000 * at, START + dt.timedelta(seconds=at)) for i, (user, at) in enumerate([(1, 0), (1, 5), (1, 10), (2, 11)])]
    for r in rows:
        add([r])
    got = streams.caught_up(streams.first_within(source(), "user", seconds=10), str(tmp_path / "out"))
    assert sorted(r.id for r in got.collect()) == [0, 2, 3] and got.columns == ["id", "user", "ms", "ts"]


def test_expired_entries(spark, tmp_path, arriving):
    add, source = arriving
    rows, folder, span = log(5), str(tmp_path / "out"), 120_000
    for k in range(0, 400, 130):
        add(rows[k : k + 130])
        got = streams.caught_up(streams.expired(source(), "user", seconds=120), folder)
    end = max(r[2] for r in rows)
    want = set()
    for user in {r[1] for r in rows}:
        times = [r[2] for r in rows if r[1] == user]
        want |= {(user, a, a + span) for a, b in zip(times, [*times[1:], None], strict=True) if (b - a >= span if b is not None else a + span <= end)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
    add([(1000, 99, EPOCH + 10**9, START + dt.timedelta(milliseconds=10**9))])
    got = streams.caught_up(streams.expired(source(), "user", seconds=120), folder)
    last = {user: max(r[2] for r in rows if r[1] == user) for user in {r[1] for r in rows}}
    assert {(r.user, r.last_ms) for r in got.collect()} == {w[:2] for w in want} | set(last.items())
    assert state_rows(spark, folder) == 1 and glob.glob(f"{folder}/rows/*.parquet")
    assert got.filter(F.col("expired_ms") - F.col("last_ms") != span).count() == 0


def test_drain_gives_up_after_retries(spark, tmp_path):
    """A service that takes odd jobs at once, job 4 at the third try and others never; one batch fails half-way and is
    run again."""
    schema = "job_id int, priority int, enqueued_at timestamp"
    source, folder = str(tmp_path / "in"), str(tmp_path / "drain")
    asked: list[int] = []
    broken = [True]

    def submit(jobs):
        ids = sorted(r.job_id for r in jobs.collect())
        if broken[0] and 3 in ids:
            broken[0] = False
            raise RuntimeError("the service went away")
        asked.extend(ids)
        return spark.createDataFrame([(i, i % 2 == 1 or (i == 4 and asked.count(4) >= 3)) for i in ids], "job_id int, ok boolean")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_folder(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
        writer = streams.drain_with_retries(stream, submit, folder, most=3).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c"))
        writer.start().awaitTermination()

    jobs = [(i, 0, START + dt.timedelta(seconds=i)) for i in range(1, 6)]
    run(jobs[:2])
    with pytest.raises(Exception, match="went away"):
        run(jobs[2:])
    for _ in range(10):  # ticks
        run([(None, None, None)])
    got = {r.job_id: (r.status, r.retry_count) for r in streams.outcomes(spark, folder).collect()}
    assert got == {1: ("PROCESSING", 0), 3: ("PROCESSING", 0), 5: ("PROCESSING", 0), 4: ("PROCESSING", 2), 2: ("FAILED", 6)}
    assert {i: asked.count(i) for i in range(1, 6)} == {1: 1, 2: 6, 3: 1, 4: 3, 5: 1}
