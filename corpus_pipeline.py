"""Documents to training shards: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspan.llm import decontaminate, jaccard, mixing, quality, sharding
from docspan.llm.common import packed, stored, table, unpacked


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and blank texts are scored like others; repeated rows score alike; very long texts are read
    whole; columns of docs stay, whatever their names; an empty table stays empty."""
    return quality.drop_rejected(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one document stays, the smallest
    doc_id, null being larger than all.

    Null and wordless texts have nothing to compare, so all of them stay; of repeated rows one stays; very
    long texts are read whole; columns of docs stay, whatever their names; an empty table stays empty."""
    return jaccard.keep_one(docs, jaccard.Rule(words=5, share=80))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and blank texts hold none; very long texts are searched whole; repeated rows stay or go together;
    columns of docs stay, whatever their names; an empty table stays empty."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times.

    Null and wordless texts have one copy; a null source is a source, the last; repeated rows are documents
    of their own; columns of docs stay, whatever their names; an empty table stays empty."""
    return unpacked(mixing.repeat(mixing.mix(packed(docs, "doc_id", "text", "source"))))


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards in random order: the columns of documents with shard and slot.

    Null ids share a shard; null texts are empty; repeated rows have a slot each; columns of docs named
    shard or slot are replaced, others stay, whatever their names; an empty table stays empty."""
    return sharding.shard(docs, 8).drop("grown_shard")


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", make_shards),
]

#: Training, tilts and seeded hashes are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
