"""The job table: listing, batches, queue, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUEUE_CAPACITY = 50


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("id") == job_id).limit(1)


def list_jobs(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, equal times by id; limits outside 1 to 100 and negative offsets mean the default."""
    limit = limit if 1 <= limit <= 100 else 50
    return jobs.orderBy(F.desc("created_at"), "id").offset(max(0, offset)).limit(limit)


def batch_files(jobs: DataFrame, batch_id: str | None = None, status: str | None = None) -> DataFrame:
    """Files of a batch (or of all) in order of creation: `file_no` from 1."""
    rows = jobs if batch_id is None else jobs.filter(F.col("batch_id") == batch_id)
    rows = rows if status is None else rows.filter(F.col("status") == status)
    return rows.withColumn("file_no", F.row_number().over(Window.partitionBy("batch_id").orderBy("created_at", "id")))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("batch_id", "status").agg(F.count("*").alias("n"))


def batch_rollup(jobs: DataFrame) -> DataFrame:
    """State and progress of each batch; statuses other than the three named count as uploaded."""
    n = lambda s: F.count_if(F.col("status") == s)
    rows = jobs.groupBy("batch_id").agg(F.count("*").alias("total"), n("COMPLETED").alias("completed"), n("FAILED").alias("failed"), n("PROCESSING").alias("processing"))
    done = F.col("completed") + F.col("failed")
    state = F.when(done < F.col("total"), "PROCESSING").when(F.col("failed") == F.col("total"), "FAILED").when(F.col("failed") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
    progress = F.format_string("%.1f%%", F.round(done / F.col("total") * 100, 1))
    return rows.select("batch_id", "total", "completed", "failed", "processing", (F.col("total") - done - F.col("processing")).alias("uploaded"), progress.alias("progress"), state.alias("state"))


def system_stats(jobs: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return jobs.agg(F.count("*").alias("total_jobs"), n("COMPLETED").alias("completed"), n("FAILED").alias("failed"), n("PROCESSING").alias("processing"))


def submit_summary(results: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    return results.groupBy("batch_id").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def sync_status(jobs: DataFrame, workflows: DataFrame) -> DataFrame:
    """jobs with the status that the workflow has, where that one has ended."""
    ended = workflows.filter(F.col("workflow_status").isin("COMPLETED", "FAILED")).select(F.col("id"), "workflow_status")
    return jobs.join(ended, "id", "left").withColumn("status", F.coalesce("workflow_status", "status")).drop("workflow_status")


def queue_score(priority: Column, enqueued: Column, intended: bool = False) -> Column:
    """Lowest first.  A priority adds a million seconds, so that urgent jobs wait longer, as the rule
    in force has it; `intended` takes them off instead."""
    step = priority.cast("long") * 1_000_000
    at = F.unix_timestamp(enqueued)
    return at - step if intended else at + step


def queue_positions(queue: DataFrame, intended: bool = False, band: int = 3600) -> DataFrame:
    """queue with `score` and `position` from 1.  Scores fall into bands; the bands' counts are summed up
    in order, and jobs are numbered inside their band, so no task sorts the whole queue."""
    # the running sum over bands is one task's, with a row for each band
    rows = queue.withColumn("score", queue_score(F.col("priority"), F.col("enqueued_at"), intended)).withColumn("__band", F.floor(F.col("score") / band))
    counts = rows.groupBy("__band").agg(F.count("*").alias("__n"))
    before = counts.select("__band", (F.sum("__n").over(Window.orderBy("__band")) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__band").orderBy("score", "job_id"))
    return rows.join(before, "__band").withColumn("position", (F.col("__before") + nth).cast("long")).drop("__band", "__before")


def dequeue(queue: DataFrame, n: int = 1, intended: bool = False) -> DataFrame:
    """The next n jobs: a top-k, no sort of the whole queue."""
    return queue.withColumn("score", queue_score(F.col("priority"), F.col("enqueued_at"), intended)).orderBy("score", "job_id").limit(n)


def queue_estimate(queue: DataFrame) -> DataFrame:
    """Length, jobs in hand, mean time of what is done (30 s if nothing is), wait and throughput."""
    spent = F.unix_millis("completed_at") - F.unix_millis("started_at")
    done = F.col("status") == "COMPLETED"
    rows = queue.agg(F.count_if(F.col("status") == "QUEUED").alias("queue_length"), F.count_if(F.col("status") == "PROCESSING").alias("processing"), F.count_if(done).alias("completed"), F.sum(F.when(done, spent)).alias("ms"))
    mean = F.when(F.col("completed") > 0, F.expr("ms div completed")).otherwise(30_000)
    rows = rows.withColumn("avg_ms", mean)
    per_hour = F.when(F.col("avg_ms") > 0, F.round(3_600_000 / F.col("avg_ms"), 6)).otherwise(0.0)
    return rows.select("queue_length", "processing", "completed", "avg_ms", (F.col("queue_length") * F.col("avg_ms") / 1000).alias("wait_s"), per_hour.alias("per_hour"))


def queue_full(queue: DataFrame, capacity: int = QUEUE_CAPACITY) -> DataFrame:
    return queue.agg((F.count_if(F.col("status") == "QUEUED") >= capacity).alias("full"))


def missing_jobs(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queued ids that no job has: they fail."""
    return queue.join(jobs.select(F.col("id").alias("job_id")).distinct(), "job_id", "left_anti").withColumn("status", F.lit("FAILED"))


def concurrency(spans: DataFrame, start: str, end: str, keys: list[str], slots: int = 5, band: int = 3_600_000) -> DataFrame:
    """For each span its holders at its start, itself included, and whether a slot was free: a running
    count of starts and ends (an end comes before a start at the same time).  Time is cut into bands; what
    the bands before have left open is summed up over them, so no task holds a key's whole log."""
    up = spans.select(*keys, "id", F.col(start).alias("at"), F.lit(1).alias("step"))
    down = spans.select(*keys, "id", F.col(end).alias("at"), F.lit(-1).alias("step"))
    steps = up.unionByName(down).withColumn("__band", F.floor(F.col("at") / band))
    left = steps.groupBy(*keys, "__band").agg(F.sum("step").alias("__step"))
    so_far = F.sum("__step").over(Window.partitionBy(*keys).orderBy("__band")) - F.col("__step")
    left = left.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__band").alias("__of"), so_far.alias("__open"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__band") == F.col("__of")]
    w = Window.partitionBy(*keys, "__band").orderBy("at", "step", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = steps.withColumn("__in", F.sum("step").over(w)).filter("step = 1").join(left, same)
    rows = rows.withColumn("holders", F.col("__open") + F.col("__in"))
    return rows.select(*keys, "id", "at", F.col("holders").cast("int").alias("holders"), (F.col("holders") <= slots).alias("admitted"))


def first_of_content(docs: DataFrame, content_hash: Column, id_col: str = "doc_id") -> DataFrame:
    """(hash, first_id, n) of each content."""
    return docs.select(content_hash.alias("hash"), id_col).groupBy("hash").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))


def dedup_lookup(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming (with `hash`) with the known job of equal content; a failed one counts as unknown.
    known: hash, known_id, status."""
    alive = known.filter(F.col("status") != "FAILED").select("hash", "known_id")
    return incoming.join(alive, "hash", "left").withColumn("is_new", F.col("known_id").isNull())


def cache_stats(entries: DataFrame) -> DataFrame:
    """Entries by the prefix of their key."""
    return entries.groupBy(F.substring_index("key", ":", 1).alias("prefix")).agg(F.count("*").alias("n"))


def health_rollup(checks: DataFrame) -> DataFrame:
    """One row a report: a sick database makes it unhealthy, any other sick component degraded."""
    bad = F.col("status") != "healthy"
    rank = F.max(F.when(bad & (F.col("component") == "database"), 2).when(bad, 1).otherwise(0))
    return checks.groupBy("report").agg(rank.alias("rank"), F.count_if(bad).alias("n_bad")).select("report", F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("rank") + 1).alias("status"), "n_bad")
