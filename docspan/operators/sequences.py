"""Operators with state from row to row, which no window can express: each key's rows go, in order,
through a small replay.  Rows arrive in Arrow batches of one key, so a key's history isn't held."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = object()


def replay(df: DataFrame, key: str, order: list[str], make: Callable[[], Callable], inputs: list[str], outputs: str) -> DataFrame:
    """df with new columns (DDL): make() gives a key's replay, which is called with the input values of
    each row in turn and returns the output values."""
    src = df.schema
    names = [f.name for f in src.fields]
    new = [c.split()[0] for c in outputs.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.fields), outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = _END, None
        for t in batches:
            keys = t.column(names.index(key)).to_pylist()
            values = [t.column(names.index(c)).to_pylist() for c in inputs]
            out = []
            for k, *row in zip(keys, *values, strict=True):
                if last is _END or k != last:
                    last, step = k, make()
                out.append(step(*row))
            cols = list(zip(*out, strict=True)) or [()] * len(new)
            yield pa.RecordBatch.from_arrays([*t.columns, *(pa.array(c) for c in cols)], [*names, *new])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def admitted_requests(requests: DataFrame, key: str, ms: str = "ms", seconds: int = 60, limit: int = 100) -> DataFrame:
    """A limiter in which only admitted requests fill the window: `admitted`, `in_window`."""

    def make() -> Callable:
        held: deque[int] = deque()

        def step(at: int) -> tuple[bool, int]:
            while held and held[0] <= at - seconds * 1000:
                held.popleft()
            ok = len(held) < limit
            if ok:
                held.append(at)
            return ok, len(held)

        return step

    return replay(requests, key, [ms], make, [ms], "admitted boolean, in_window bigint")


def circuit_breaker(calls: DataFrame, key: str, order: list[str], ms: str = "ms", failed: str = "failed", threshold: int = 5, timeout_ms: int = 30_000, successes: int = 3) -> DataFrame:
    """Replays a breaker: `executed` and the `state` after each call.  It opens at so many failures,
    lets a call through once the timeout is over, closes after successes in a row and reopens at a
    failure."""

    def make() -> Callable:
        state, failures, good, since = "CLOSED", 0, 0, 0

        def step(at: int, bad: bool) -> tuple[bool, str]:
            nonlocal state, failures, good, since
            if state == "OPEN":
                if at - since <= timeout_ms:
                    return False, state
                state, good = "HALF_OPEN", 0
            if bad:
                failures, since = failures + 1, at
                if state == "HALF_OPEN" or failures >= threshold:
                    state = "OPEN"
            else:
                failures = 0
                if state == "HALF_OPEN":
                    good += 1
                    state = "CLOSED" if good >= successes else state
            return True, state

        return step

    return replay(calls, key, order, make, [ms, failed], "executed boolean, state string")


def lru_cache(accesses: DataFrame, key: str, order: list[str], entry: str, size: str, ms: str = "ms", max_bytes: int = 1 << 20, ttl_ms: int = 3_600_000, sweep_every: int = 10) -> DataFrame:
    """Replays a cache bounded in bytes: `hit`, `entries` and `bytes` after each access.  Hits move an
    entry to the end; a miss stores it, the oldest going until it fits; every so many misses all
    that is out of date goes."""

    def make() -> Callable:
        held: OrderedDict = OrderedDict()
        used, misses = 0, 0

        def step(name, wide, at) -> tuple[bool, int, int]:  # noqa: ANN001
            nonlocal used, misses
            if name in held and at - held[name][1] <= ttl_ms:
                held.move_to_end(name)
                return True, len(held), used
            if name in held:
                used -= held.pop(name)[0]
            misses += 1
            if misses % sweep_every == 0:
                for old in [k for k, (_, t) in held.items() if at - t > ttl_ms]:
                    used -= held.pop(old)[0]
            if wide <= max_bytes:
                while held and used + wide > max_bytes:
                    used -= held.popitem(last=False)[1][0]
                held[name] = (wide, at)
                used += wide
            return False, len(held), used

        return step

    return replay(accesses, key, order, make, [entry, size, ms], "hit boolean, entries bigint, bytes bigint")


def merge_chunks(chunks: DataFrame, key: str, order: str, text: str = "text", recent: int = 120) -> DataFrame:
    """Lines of a key's chunks in order, without those that equal (apart from case and white space) one
    of the last `recent` kept: (key, line_no, line)."""
    lines = chunks.select(key, order, F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0b\f]", -1)).alias("at", "raw"))
    lines = lines.select(key, order, "at", F.regexp_replace(F.regexp_replace("raw", r"^\s+", ""), r"\s+$", "").alias("line")).filter("line <> ''")
    lines = lines.withColumn("norm", F.lower(F.regexp_replace("line", r"\s+", " ")))

    def make() -> Callable:
        window: deque[str] = deque()
        seen: dict[str, int] = {}
        kept = 0

        def step(norm: str) -> tuple[bool, int]:
            nonlocal kept
            if norm in seen:
                return False, -1
            window.append(norm)
            seen[norm] = 1
            if len(window) > recent:
                seen.pop(window.popleft(), None)
            kept += 1
            return True, kept - 1

        return step

    return replay(lines, key, [order, "at"], make, ["norm"], "kept boolean, line_no bigint").filter("kept").select(key, "line_no", "line")


