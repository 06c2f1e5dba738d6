"""Shards of a corpus in seeded random order by a two-pass external shuffle.

Pass one scatters records by a seeded hash into buckets of about `bucket_bytes`; pass two puts
each bucket through a Fisher-Yates shuffle (Spark's `shuffle`) and numbers its records.  A table of
bucket sizes, counted beforehand, gives each bucket its first slot, so slots run through a shard
without any task seeing more than one bucket.

Each bucket has a partition of its own, whose number is the bucket's (`repartitionById`).  `shuffle`
draws from a generator seeded by its seed and the partition's number, so a bucket's order follows from
seed, shard and bucket alone, whatever the session's partition counts and however often a task is run.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.llm.common import small, stored

#: Text bytes that a bucket holds on average; a task needs a few times that much memory.
BUCKET_BYTES = 16 << 20
SEED = 20_240_229


def home_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """Shard 0..shards-1 by the highest of one hash a shard (rendezvous hashing): with one more
    shard, a key either stays or goes to the new one."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s, F.lit(seed)).alias("draw"), s.alias("shard")))
    return F.array_max(drawn)["shard"].cast("int")


def shard(docs: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with shard (int), slot (long, from 0 without gaps in each
    shard, in random order) and grown_shard (the shard if there were one more).

    Law `key`: the id and the number of shards alone decide the shard.  Null ids are one id, so
    share a shard.  Buckets are drawn by all columns of a row, so equal ids and equal texts spread; rows
    equal in all columns share a bucket, in which any order of them is the same.  A null text is empty;
    a very long one makes its bucket larger by its size.  Columns of docs named shard, slot or grown_shard
    are replaced; others can have any names.  An empty table gives an empty result.
    """
    src = docs.drop("shard", "slot", "grown_shard")
    kept = src.columns
    named = lambda c: F.col(f"`{c}`")
    size = F.octet_length(F.coalesce(named(text_col), F.lit(""))) + F.lit(64)
    total = src.select(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    plain = [named(f.name) for f in src.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    home = home_shard(named(id_col), shards, seed)
    place = F.pmod(F.xxhash64(F.lit(seed + 1), *plain), F.lit(buckets)).cast("int")
    first = src.select(home.alias("shard"), (home * buckets + place).alias("at")).groupBy("shard", "at").agg(F.count("*").alias("n"))
    first = first.select("at", (F.sum("n").over(Window.partitionBy("shard").orderBy("at")) - F.col("n")).alias("first"))
    first = small(stored(first, "buckets"))

    record = F.struct(F.xxhash64(F.lit(seed + 2), *plain).alias("draw"), *(named(c).alias(f"c{i}") for i, c in enumerate(kept)))
    dealt = src.select((home * buckets + place).alias("at"), record.alias("record")).repartitionById(shards * buckets, F.col("at"))
    # a fixed order first, so that the seed alone decides
    order = lambda x, y: F.when(x["draw"] < y["draw"], -1).when(x["draw"] > y["draw"], 1).otherwise(0)
    mixed = dealt.groupBy("at").agg(F.shuffle(F.array_sort(F.collect_list("record"), order), seed).alias("records"))
    rows = mixed.select("at", F.posexplode("records").alias("nth", "record")).join(first, "at")
    return rows.select(
        *(F.col(f"record.c{i}").alias(c) for i, c in enumerate(kept)),
        F.floor(F.col("at") / buckets).cast("int").alias("shard"),
        (F.col("first") + F.col("nth")).cast("long").alias("slot"),
        home_shard(F.col(f"record.c{kept.index(id_col)}"), shards + 1, seed).alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder a shard, as Parquet; within a shard, `slot` is the order to read in."""
    sharded.write.partitionBy("shard").parquet(path)
