"""Streaming forms: windows over a log, duplicates within a time, limits by key, a drained queue.

Sources are folders of files; `available` runs what is there and ends, for tests and catch-up runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rates(events: DataFrame, keys: list[str], ts: str = "ts", window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)
    rows = events.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rows.select(*keys, F.col("w.start").alias("window_start"), "n", "mean")


def error_ratios(events: DataFrame, flag: Column, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(ts, late).groupBy(F.window(F.col(ts), window).alias("w")).agg(F.count("*").alias("n"), F.count_if(flag).alias("errors"))
    return rows.select(F.col("w.start").alias("window_start"), "n", "errors", (F.col("errors") / F.col("n") * 100).alias("error_percent"))


def first_seen(docs: DataFrame, key: str = "hash", ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """The first of equal keys within ttl; state older than that goes."""
    return docs.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


class _Held(StatefulProcessor):
    """Keeps of each key the times that count, and lets go of them by an event-time timer: a time-to-live of
    state would count processing time, and a catch-up run would never see it pass."""

    def __init__(self, time: str, span_ms: int):
        self.time, self.span = time, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long")

    def times(self) -> list[int]:
        return [at for (at,) in self.held.get()] if self.held.exists() else []

    def keep(self, times: list[int]) -> None:
        """Holds these times until the last of them is `span` old."""
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if times:
            self.held.put([(int(t),) for t in times])
            self.handle.registerTimer(int(times[-1]) + self.span)
        else:
            self.held.clear()

    def in_order(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """A key's rows of one batch, which the trigger bounds."""
        return pd.concat(rows).sort_values(self.time, kind="stable")

    def close(self) -> None:
        pass


class _Limiter(_Held):
    def __init__(self, time: str, span_ms: int, limit: int):
        super().__init__(time, span_ms)
        self.limit = limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held, good, full = self.times(), [], []
        batch = self.in_order(rows)
        for at in batch[self.time].tolist():
            held = [t for t in held if t > at - self.span]
            good.append(len(held) < self.limit)
            if good[-1]:
                held.append(at)
            full.append(len(held))
        self.keep(held)
        yield batch.assign(admitted=good, in_window=full)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.held.clear()
        yield pd.DataFrame()


class _Expiry(_Held):
    def rows(self, key: tuple, last: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"state_key": pd.Series([key[0]] * len(last), dtype=object), "last_ms": last, "expired_ms": [t + self.span for t in last]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        times = self.times() + self.in_order(rows)[self.time].tolist()
        times.sort()
        self.keep(times[-1:])
        yield self.rows(key, [a for a, b in zip(times, times[1:], strict=False) if b - a >= self.span])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        gone = self.times()
        self.held.clear()
        yield self.rows(key, gone)


def _named(key: str) -> Column:
    """The key as a string that is never null: pandas would make other numbers of whole ones beside a null."""
    return F.to_json(F.struct(F.col(key).alias("key")))


def admitted(requests: DataFrame, key: str, ms: str = "ms", ts: str = "ts", seconds: int = 60, limit: int = 100, late: str = "0 seconds") -> DataFrame:
    """requests with `admitted` and `in_window`, how many of the key's admitted ones then are in the window.  A key's
    admitted requests of the last seconds are its state, at most limit of them; it goes when the watermark of ts,
    the time that ms has in milliseconds, has passed the last one's window.  Rows without a key have a key of their own; rows later
    than `late` are dropped by Spark."""
    schema = StructType([*requests.schema.fields, *StructType.fromDDL("state_key string, admitted boolean, in_window long").fields])
    rows = requests.withColumn("state_key", _named(key)).withWatermark(ts, late).groupBy("state_key")
    return rows.transformWithStateInPandas(_Limiter(ms, seconds * 1000, limit), schema, "append", "eventTime").drop("state_key")


def first_within(rows: DataFrame, key: str, ms: str = "ms", ts: str = "ts", seconds: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """Rows whose key was not let through in the last seconds: a key that is set once lives so long, and repetitions
    don't lengthen its life."""
    return admitted(rows, key, ms, ts, seconds, 1, late).filter("admitted").drop("admitted", "in_window")


def expired(puts: DataFrame, key: str, ms: str = "ms", ts: str = "ts", seconds: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """(key, last_ms, expired_ms): entries that were not put again for so many seconds after last_ms, as soon as the next
    put or the watermark of ts shows it.  A put just as the time is over comes too late."""
    rows = puts.select(_named(key).alias("state_key"), ms, ts).withWatermark(ts, late).groupBy("state_key")
    gone = rows.transformWithStateInPandas(_Expiry(ms, seconds * 1000), "state_key string, last_ms long, expired_ms long", "append", "eventTime")
    kind = puts.schema[key].dataType.simpleString()
    return gone.select(F.from_json("state_key", f"key {kind}")["key"].alias(key), "last_ms", "expired_ms")


def drain(queue: DataFrame, submit, every: str = "10 seconds", most: int = 10) -> DataStreamWriter:
    """Hands each batch's next jobs, at most `most`, to submit(DataFrame)."""
    from docspan.operators.jobs import dequeue

    return queue.writeStream.foreachBatch(lambda batch, _: submit(dequeue(batch, most))).trigger(processingTime=every)


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that was written to its end, or None."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    return spark.read.parquet(path) if there else None


def drain_with_retries(queue: DataFrame, submit: Callable[[DataFrame], DataFrame], folder: str, every: str = "10 seconds", most: int = 10, retries: int = 5) -> DataStreamWriter:
    """Hands jobs (job_id, priority, enqueued_at) to submit, `most` a batch, which answers with (job_id, ok); a job
    that isn't taken waits again, and after more than `retries` failures it is given up.  Rows without a job_id are
    ticks, which start a batch when no new job does (a `rate` source beside the queue, for instance).

    What a batch took, how each job of it ended (`outcomes`) and what waits after it are tables of folder by the batch's
    number, each written once: a batch that is run again after a failure takes the same jobs, asks for none whose
    outcome is known, and leaves the same tables.
    """
    from docspan.operators.jobs import dequeue

    def tick(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = lambda table, n: f"{folder}/{table}/batch={n}"

        def once(table: str, make: Callable[[], DataFrame]) -> DataFrame:
            known = _written(spark, at(table, number))
            if known is None:
                make().write.mode("overwrite").parquet(at(table, number))
            return spark.read.parquet(at(table, number))

        fresh = batch.filter("job_id is not null").withColumn("retry_count", F.lit(0))
        earlier = next((t for n in range(number - 1, -1, -1) if (t := _written(spark, at("waiting", n))) is not None), None)
        pending = fresh if earlier is None else fresh.unionByName(earlier)
        taken = once("taken", lambda: dequeue(pending, most).drop("score"))

        def answered() -> DataFrame:
            told = submit(taken).select("job_id", "ok")
            rows = taken.join(told, "job_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
            count = F.when(F.col("ok"), F.col("retry_count")).otherwise(F.col("retry_count") + 1)
            status = F.when(F.col("ok"), "PROCESSING").when(count > retries, "FAILED").otherwise("QUEUED")
            return rows.withColumns({"retry_count": count, "status": status}).drop("ok")

        ended = once("outcomes", answered)
        once("waiting", lambda: pending.join(taken.select("job_id"), "job_id", "left_anti").unionByName(ended.filter("status = 'QUEUED'").drop("status")))

    return queue.writeStream.foreachBatch(tick).trigger(processingTime=every)


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The last outcome of each job that `drain_with_retries` took: (job_id, status, retry_count, batch)."""
    rows = spark.read.parquet(f"{folder}/outcomes")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "retry_count", "batch"), "batch").alias("o")).select("job_id", "o.*")


def available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now; its result as a table in memory."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Inside, streams are started with the state store that state by key needs."""
    name, was = "spark.sql.streaming.stateStore.providerClass", None
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def caught_up(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what its source holds now, writing files into folder; what came out of it, this time and
    earlier ones.  Run again it goes on from there."""
    spark = stream.sparkSession
    with keyed_state(spark):
        q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def write_metrics(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
