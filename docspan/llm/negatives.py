"""Hard negatives by exact scores of integer vectors, looked up instead of multiplied.

Components are whole numbers (`floor(scale * x)`).  A candidate is kept as bit planes: for each bit of the
two's complement and each group of eight dimensions one byte, with a bit a dimension.  For an anchor the
sums of all 256 subsets of each group's components are tabulated; a candidate's byte is then the index of
the sum that this plane and group add, and the planes are added up shifted by their place, the highest
one negatively (the method of the Four Russians).  So a score is exact: (dimensions / 8) look-ups a plane.

Anchors are a stated query set and meet all rows, in blocks: block of anchors x block of candidates is one
group of bounded size.  A first pass scores an anchor's own label for its positives, a second one the other
labels for its negatives, so that each pair is scored once.  A block's best few of an anchor leave a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspan.llm.common import keep, scratch, stored

#: Rows of a block of candidates and of a block of anchors.
BLOCK, ANCHORS = 16_384, 1024
#: Anchors that are scored at a time, so that their tables stay in a core's cache.
AT_ONCE = 32
#: Pairs that are scored at a time.
PAIRS = 1 << 18


@dataclass(frozen=True)
class Mining:
    """positives: an anchor's first so many rows of its label.  negatives: for each of these the first so many
    rows of other labels with low * positive <= 100 * negative <= high * positive."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers x (rows, dimensions): (planes, groups, rows) bytes.  The last plane holds
    the signs; dimensions are filled up with zeros to a multiple of eight."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))
    bits = max(int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length(), 1) + 1
    out = np.empty((bits, x.shape[1] // 8, len(x)), np.uint8)
    for b in range(bits):
        out[b] = np.packbits((x >> b) & 1 == 1, axis=1, bitorder="little").T
    return out


def subset_sums(x: np.ndarray) -> np.ndarray:
    """For whole numbers x (anchors, dimensions) the sums of all subsets of each eight dimensions:
    (groups, 256, anchors)."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 8))).T.reshape(-1, 8, len(x))
    out = np.zeros((len(x), 256, x.shape[2]), np.int64)
    for d in range(8):
        out[:, 1 << d : 2 << d] = out[:, : 1 << d] + x[:, d : d + 1]
    return out


def scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) of candidates' planes with anchors' tables."""
    groups = min(len(tables), bits.shape[1])  # missing dimensions are zeros
    # sums that fit 32 bits for all planes and groups are added there
    small = int(np.abs(tables).max(initial=0)) * max(groups, 1) << bits.shape[0] < 1 << 31
    tables = tables.astype(np.int32) if small else tables
    total = np.zeros((bits.shape[2], tables.shape[2]), tables.dtype)
    for b, plane in enumerate(bits):
        part = np.zeros_like(total)
        for g in range(groups):
            part += tables[g].take(plane[g], axis=0)
        part <<= b
        if b == len(bits) - 1:
            total -= part
        else:
            total += part
    return total


def whole_numbers(embedding: Column | str, scale: int = 256) -> Column:
    """floor(scale * component) of each component."""
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column as rows; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id (a null id, the largest number, last)."""
    own = np.arange(len(score))
    if len(score) > k:
        own = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return own[np.lexsort((ids[own], -score[own]))][:k]


_FOUND = "row long, vec_id long, other long, score long, positive long, positive_score long, nth int"


def _search(rule: Mining, second: bool):
    """For a block of anchors and one of candidates: the best of the anchor's label, or with second for
    each of its positives the best of other labels within the limits."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            label, rows = right["c_label"].to_numpy(), right["c_row"].to_numpy()
            ids = right["c_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            bits = planes(_matrix(right["c_q"]))
            anchor_label, anchor_row = left["label"].to_numpy(), left["row"].to_numpy()
            anchor_id, anchor_q = left["vec_id"].to_pylist(), _matrix(left["q"])
            given = left["positives"].to_pylist() if second else None
            for own_label in np.unique(anchor_label):
                other = np.flatnonzero((label == own_label) != second)
                anchors = np.flatnonzero(anchor_label == own_label)
                for lo in range(0, len(anchors), AT_ONCE):
                    some = anchors[lo : lo + AT_ONCE]
                    tables = subset_sums(anchor_q[some])
                    for at in range(0, len(other), PAIRS // AT_ONCE):
                        part = other[at : at + PAIRS // AT_ONCE]
                        got = scores(tables, bits[:, :, part]).T.astype(np.int64)
                        for a, score in zip(some.tolist(), got, strict=True):
                            if not second:
                                apart = rows[part] != anchor_row[a]
                                sure, score = part[apart], score[apart]
                                best = _first(score, ids[sure], rule.positives)
                                found += [(anchor_row[a], anchor_id[a], sure[i], score[i], None, None, None) for i in best]
                                continue
                            hundred = 100 * score
                            for p in given[a]:
                                fit = np.flatnonzero((hundred >= rule.low * p["score"]) & (hundred <= rule.high * p["score"]))
                                best = fit[_first(score[fit], ids[part[fit]], rule.negatives)]
                                found += [(anchor_row[a], anchor_id[a], part[i], score[i], p["other"], p["score"], p["nth"]) for i in best]
        ids_back = right["c_id"].to_pylist() if found else []
        cols = list(zip(*found, strict=True)) if found else [[]] * 7
        made = {
            "row": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "other": pa.array([ids_back[i] for i in cols[2]], pa.int64()),
            "score": pa.array(cols[3], pa.int64()), "positive": pa.array(cols[4], pa.int64()), "positive_score": pa.array(cols[5], pa.int64()), "nth": pa.array(cols[6], pa.int32()),
        }
        return pa.table(made)

    return run


def mine(vectors: DataFrame, anchor: Column, rule: Mining = Mining(), scale: int = 256, embedding: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and
    each of its positives the first negatives.  vectors: vec_id, embedding and label; anchor: the condition
    that makes a row an anchor.

    Rows with a null label or vector, or with a null or non-finite component, take no part.  A null vec_id
    is larger than all; an anchor of null vec_id is one like others.  Rows of the same vec_id, repeated rows
    too, are rows of their own: only the anchor's own row is not among its candidates.  Ties go to the
    smaller vec_id.  A shorter vector is filled up with zeros, an empty one scores 0; numbers are exact as
    long as scores fit a long.  Very long vectors need a table of 32 numbers a dimension for each of 32
    anchors.  Other columns of vectors are not read, whatever their names; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.col(f"`{embedding}`")
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), (label if isinstance(label, Column) else F.col(label)).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.when(sound, whole_numbers(x, scale)).alias("q"),
    ).filter("label IS NOT NULL AND q IS NOT NULL")
    with scratch(spark):
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        total, anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
        over, down = max(-(-total // BLOCK), 1), max(-(-anchors // ANCHORS), 1)
        # blocks by a hash of the row's number are of near equal size
        spread = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
        renamed = [F.col(c).alias(to) for c, to in (("row", "c_row"), ("vec_id", "c_id"), ("label", "c_label"), ("q", "c_q"))]
        candidates = rows.select(*renamed, spread(over, 1).alias("c_over"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("c_down"))
        queries = rows.filter("anchor").select("row", "vec_id", "label", "q", spread(down, 2).alias("down"))
        tasks = max(min(over * down, 4 * spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions")))

        def met(asking: DataFrame, second: bool) -> DataFrame:
            asking = asking.withColumn("over", F.explode(F.sequence(F.lit(0), F.lit(over - 1))))
            left = asking.repartition(tasks, "over", "down").groupBy("over", "down")
            return left.cogroup(candidates.repartition(tasks, "c_over", "c_down").groupBy("c_over", "c_down")).applyInArrow(_search(rule, second), _FOUND)

        order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("other").asc_nulls_last())
        positives = met(queries, False).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rule.positives)
        chosen = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", "other", "score"))).alias("positives"))
        asking = stored(queries.join(chosen, "row"), "anchors")
        order = Window.partitionBy("row", "nth").orderBy(F.desc("score"), F.col("other").asc_nulls_last())
        found = met(asking, True).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rule.negatives)
        done = found.select(F.col("vec_id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return keep(stored(done, "negatives"))
