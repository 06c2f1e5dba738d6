"""The driver's tables in the roles of the engine's: adapters of our own choice, kept out of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: customer = batch, order status = job status, every 17th failed."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 17 == 0, "FAILED").when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("UPLOADED")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"), F.when(status == "FAILED", F.lit("failed")).alias("error"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queued jobs: priority from the order's, started an hour after and ended after a time that
    follows from the price."""
    o = table(spark, sf_dir, "orders")
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("QUEUED")
    at = F.col("o_orderdate").cast("timestamp")
    begun = at + F.expr("interval 1 hour")
    return o.select(F.col("o_orderkey").alias("job_id"), priority.alias("priority"), at.alias("enqueued_at"), begun.alias("started_at"), F.timestamp_millis(F.unix_millis(begun) + F.floor("o_totalprice").cast("long")).alias("completed_at"), status.alias("status"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as jobs of pages: a turn is a page; a page of the role `system` failed."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("page"), F.col("text").alias("markdown"), (F.lit(0.5) + F.col("turn") % 5 / 10.0).alias("confidence"), F.when(F.col("role") == "system", F.lit("unreadable")).alias("error"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream that reads what is there."""
    schema = table(spark, sf_dir, "events").schema
    at = F.col("ts").cast("timestamp")
    # as a pattern, since a stream's plain path has to be a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumns({"ts": at, "ms": F.unix_millis(at)})


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening tags of web pages as layout regions, in page order: raw type = tag, with a score and a
    box that follow from the position; every 7th has no score."""
    p = table(spark, sf_dir, "pages").filter("html is not null")
    tags = p.select("page_id", F.posexplode(F.expr(r"regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)")).alias("index", "raw_type"))
    score = F.when(F.col("index") % 7 != 0, F.col("index") % 10 / 10.0)
    return tags.select("page_id", "index", "raw_type", score.alias("score"), F.coalesce(score, F.lit(1.0)).alias("confidence"))


def region_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents for the regions: the tag's name, with an error for every 11th and none for every 5th."""
    r = regions(spark, sf_dir).filter("index % 5 <> 4")
    return r.select("page_id", F.concat(F.lit("region_"), F.col("index").cast("string")).alias("region_id"), F.upper("raw_type").alias("content"), (F.col("index") % 4 / 4.0).alias("confidence"), F.when(F.col("index") % 11 == 10, F.lit("no text")).otherwise(F.lit("")).alias("error"))
