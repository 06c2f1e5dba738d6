"""What the corpus operators share: reading tables, tables in the shared folder, sorted runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it was counted and has no more rows than this (rows of fixed width).
BROADCAST_ROWS = 200_000

#: Spark's setting by which a query's shuffle files go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Settings under which tables are stored: Python workers get batches of few rows and bytes, since what a
#: batch takes there, and off the heap beside it, comes on top of the executor's heap.
STORING = {
    CLEANUP: "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without that
    setting a folder in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, lost executors
    cost nothing, and the planner knows its size.  The folder is `scratch/<application>` in
    spark.checkpoint.dir and may be deleted once the application has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    was = {k: spark.conf.get(k, None) for k in STORING}
    for k, v in STORING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _OPEN:
        _OPEN[-1].append(path)
    return out


#: Paths of the tables stored in each scratch block that is open, the innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block go when it ends, but for those given to `keep`.  What is read from
    them must have been stored by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def keep(df: DataFrame) -> DataFrame:
    """df, a stored table, outlasts the innermost scratch block and belongs to the one around it."""
    if _OPEN and df._scratch in _OPEN[-1]:
        _OPEN[-1].remove(df._scratch)
        if len(_OPEN) > 1:
            _OPEN[-2].append(df._scratch)
    return df


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one column, __row, beside those of its columns that an operator reads, so that columns
    which the operator adds clash with none of docs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *(F.col(f"`{c}`") for c in columns))


def unpacked(df: DataFrame, *columns: str) -> DataFrame:
    """The columns that `packed` put away, and these of df."""
    return df.select(*(F.col("__row").getField(f.name).alias(f.name) for f in df.schema["__row"].dataType.fields), *columns)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else unchanged.  It counts df, so
    pass a stored table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys, from batches in the order of these keys.  Only
    the rows of one group and one batch are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k) for k in keys]
        change = None
        for c in cols:
            differs = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
            change = differs if change is None else pc.or_(change, differs)
        cuts = [0, *(i + 1 for i in pc.indices_nonzero(change).to_pylist()), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[lo].as_py() for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
