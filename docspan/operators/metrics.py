"""Service metrics over an event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper edges of the histograms.
DURATION_EDGES = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)
SIZE_EDGES = (1e2, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8)
PAGE_EDGES = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)
CONFIDENCE_EDGES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
SLOW_MS = 30_000


def performance_stats(ops: DataFrame, keys: Sequence[str], value: str = "value", order: Sequence[str] = ("ts",), slow: float = SLOW_MS, history: int = 1000, recent: int = 100) -> DataFrame:
    """Counts, mean, mean of the last `recent`, and percentiles of the last `history`, for each key.
    A percentile p of n values is the one at n * p, rounded down, from 0, in ascending order."""
    totals = ops.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col(value) > slow).alias("slow"), F.round(F.avg(value), 6).alias("mean"))
    # the filter on the rank lets Spark drop all but the latest of each key before the shuffle
    latest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    last = ops.select(*keys, F.col(value).alias("__v"), F.row_number().over(latest).alias("__back")).filter(F.col("__back") <= max(history, recent))
    near = F.array_sort(F.collect_list(F.when(F.col("__back") <= history, F.col("__v"))))
    last = last.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.round(F.avg(F.when(F.col("__back") <= recent, F.col("__v"))), 6).alias("mean_recent"), near.alias("near"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] or [F.lit(True)]
    out = totals.join(last, same)
    at = lambda p: F.get("near", F.floor(F.size("near") * F.lit(p)).cast("int"))
    return out.select(*keys, "total", "slow", F.round(F.col("slow") / F.col("total") * 100, 6).alias("slow_percent"), "mean", "mean_recent", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def moving_average(ops: DataFrame, keys: Sequence[str], value: str = "value", order: Sequence[str] = ("ts",), rows: int = 100) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), Window.currentRow)
    return ops.withColumn("moving_average", F.round(F.avg(value).over(w), 9))


def slow_pages(ops: DataFrame, value: str = "value", size: str = "size_bytes", threshold: float = SLOW_MS) -> DataFrame:
    over = F.col(value) - threshold
    return ops.filter(over > 0).withColumns({"exceeded_by": F.round(over, 6), "exceeded_percent": F.round(over / threshold * 100, 1), "size_kb": F.round(F.col(size) / 1024.0, 2), "size_mb": F.round(F.col(size) / 1048576.0, 2)})


def histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Cumulative counts: values up to each edge, the last edge being infinite (as null).  Each value
    first goes to its own bucket, so rows are not multiplied."""
    first = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        first = F.when(F.col(value) <= edges[i], i).otherwise(first)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, first.alias("__b")).agg(F.count("*").alias("__n"))
    upto = F.explode(F.sequence(F.col("__b"), F.lit(len(edges)))).alias("bucket")
    rows = counts.select(*keys, upto, "__n").groupBy(*keys, "bucket").agg(F.sum("__n").alias("n"))
    # buckets below all values
    frame = counts.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))))
    edge = F.element_at(F.array(*(F.lit(float(e)) for e in edges), F.lit(None).cast("double")), F.col("bucket") + 1)
    return frame.join(rows, [*keys, "bucket"], "left").select(*keys, "bucket", edge.alias("le"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """The quantile by interpolation inside its bucket; beyond the last edge, that edge; null without values."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    total = F.max("n").over(Window.partitionBy(*keys))
    rows = buckets.withColumns({"total": total, "below": F.coalesce(F.lag("n").over(w), F.lit(0)), "from": F.coalesce(F.lag("le").over(w), F.lit(0.0))})
    rank = F.col("total") * q
    hit = rows.filter((F.col("n") >= rank) & (F.col("total") > 0)).withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    inside = F.col("from") + (F.col("le") - F.col("from")) * ((rank - F.col("below")) / (F.col("n") - F.col("below")))
    return hit.select(*keys, F.round(F.when(F.col("le").isNull(), F.col("from")).when(F.col("n") == F.col("below"), F.col("le")).otherwise(inside), 6).alias("value"))


def rate(events: DataFrame, keys: Sequence[str], ts: str = "ts", window: str = "5 minutes", seconds: int = 300) -> DataFrame:
    rows = events.groupBy(*keys, F.window(F.col(ts), window).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("w.start").alias("window_start"), "n", F.round(F.col("n") / seconds, 9).alias("per_second"))


def ratio(events: DataFrame, flag: Column, ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    rows = events.groupBy(F.window(F.col(ts), window).alias("w")).agg(F.count("*").alias("n"), F.count_if(flag).alias("errors"))
    return rows.select(F.col("w.start").alias("window_start"), "n", "errors", F.round(F.col("errors") / F.col("n") * 100, 6).alias("error_percent"))


def mean_duration(events: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return events.groupBy(*keys).agg(F.round(F.sum(value) / F.count(value), 6).alias("mean"))


def alert_intervals(samples: DataFrame, keys: Sequence[str], condition: Column, hold: int, ts: str = "ts", every: int = 60, band: int = 86_400) -> DataFrame:
    """Times during which condition held for `hold` seconds on end.  samples come every `every` seconds
    at most; a longer gap, or a sample without the condition, ends an interval.  condition fires
    once `hold` has passed.

    Runs are formed within bands of time (`band` seconds, `every` at least), so that no task has a key's whole
    log.  A run that begins a band goes on from the one that ended the band before; only such runs, two a band at
    most, are read in the order of a key's bands.
    """
    band = max(band, every)
    rows = samples.withColumns({"__on": F.coalesce(condition, F.lit(False)), "__at": F.unix_timestamp(ts)}).withColumn("__band", F.floor(F.col("__at") / band))
    w = Window.partitionBy(*keys, "__band").orderBy(ts)
    before, after = F.lag("__on").over(w), F.lead("__on").over(w)
    rows = rows.withColumns({"__fresh": F.when(F.col("__on") & F.coalesce(before, F.lit(False)) & (F.col("__at") - F.lag("__at").over(w) <= every), 0).otherwise(1), "__head": before.isNull(), "__tail": after.isNull()})
    rows = rows.withColumn("__run", F.sum("__fresh").over(w)).filter("__on")
    runs = rows.groupBy(*keys, "__band", "__run").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count("*").alias("n_samples"), F.bool_or("__head").alias("__head"), F.bool_or("__tail").alias("__tail"))
    edge = F.col("__head") | F.col("__tail")
    scan = Window.partitionBy(*keys).orderBy("__band", "first", "__run")
    goes_on = F.col("__head") & F.coalesce(F.lag("__tail").over(scan), F.lit(False)) & (F.lag("__band").over(scan) == F.col("__band") - 1) & (F.col("first") - F.lag("last").over(scan) <= every)
    joined = runs.filter(edge).withColumn("__chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(scan))
    joined = joined.groupBy(*keys, "__chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_samples").alias("n_samples"))
    out = joined.drop("__chain").unionByName(runs.filter(~edge).select(*keys, "first", "last", "n_samples"))
    held = out.filter(F.col("last") - F.col("first") >= hold)
    return held.select(*keys, F.timestamp_seconds("first").alias("since"), F.timestamp_seconds(F.col("first") + hold).alias("fires_at"), F.timestamp_seconds("last").alias("until"), "n_samples")


def sliding_counts(requests: DataFrame, key: str, ts: str = "ts", seconds: int = 60, limit: int = 100) -> DataFrame:
    """requests with how many of their key came within the last `seconds`, themselves and those
    refused included, and whether that is within limit.  A request that is exactly `seconds` old is
    no longer counted; times count in milliseconds."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__ms").rangeBetween(-(seconds * 1000 - 1), Window.currentRow)
    rows = requests.withColumn("__ms", ms).withColumn("in_window", F.count("*").over(w))
    return rows.withColumn("allowed", F.col("in_window") <= limit).drop("__ms")
