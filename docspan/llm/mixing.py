"""Mixing sources to target weights by entropy balancing.

Each source has a target of words.  Among all rates r in (0, cap) that meet it, entropy balancing
takes those nearest to the even rate, which is an exponential tilt of the odds:
r / (cap - r) = exp(lambda * size / mean size of the source), a document's words being the
constrained quantity.  lambda is the root of the dual's gradient; Newton steps find it for all
sources at once, gradient and curvature being sums that Spark forms.  Rates depend on source and
size only, so the sums run over counts of (source, size).

Rates become whole copies: sizes are rounded from the largest down, each making up for the rest so far
and leaving no more than the smaller ones can take, and a seeded hash picks the documents of one size
that get a copy more.  So a source misses its target by half of its smallest document, unless that and
the other small ones can't fill what whole copies of the large ones leave.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspan.llm.common import BROADCAST_ROWS, stored
from docspan.llm.words import WORD

#: Cells into which the documents of one source and size are dealt, so that none is large.
CELLS = 256
SEED = 77_003


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none over cap times its size; what is over goes to the others by
    weight, again and again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - math.fsum(cap * sizes[i] for i in range(len(sizes)) if i not in open_)
        unit = left / math.fsum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
        open_ -= over
    return out


def solve_tilts(counts: DataFrame, sources: dict[int, tuple[int, int, float]], cap: float, steps: int = 80) -> dict[int, float]:
    """lambda by source.  counts: (sid, size, n); sources: sid -> (words, documents with words,
    target).  A source at its cap has no finite tilt and gets infinity, one without words 0."""
    lam = {s: math.inf if t >= cap * words * (1 - 1e-9) else 0.0 for s, (words, _, t) in sources.items() if words}
    open_ = {s for s, x in lam.items() if x == 0.0}
    low, high = dict.fromkeys(open_, -math.inf), dict.fromkeys(open_, math.inf)
    spark = counts.sparkSession
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(s, lam[s], sources[s][0] / sources[s][1]) for s in sorted(open_)], "__sid int, lam double, mean double")
        c = F.col("size") / F.col("mean")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("lam") * c))
        sums = counts.filter("size > 0").join(F.broadcast(now), "__sid").groupBy("__sid", "mean")
        sums = sums.agg(F.sum(F.col("n") * cap * p * c).alias("g"), F.sum(F.col("n") * cap * p * (1 - p) * c * c).alias("h"))
        for sid, mean, g, h in sums.collect():
            goal = sources[sid][2] / mean
            off = g - goal
            if abs(off) <= 1e-7 * goal:
                open_.discard(sid)
                continue
            (high if off > 0 else low)[sid] = lam[sid]
            step = lam[sid] - off / h if h > 0 else math.nan
            if not low[sid] < step < high[sid]:  # outside of what is known: halve it, or double while one side is open
                at = lam[sid]
                step = (low[sid] + high[sid]) / 2 if math.isfinite(low[sid] + high[sid]) else at + math.copysign(max(1.0, abs(at)), -off)
            lam[sid] = step
    # sums of doubles depend on their order in the last digits; reruns must not
    return {s: 0.0 for s in sources} | {s: x if math.isinf(x) else float(f"{x:.9g}") for s, x in lam.items()}


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns of docs, with size (its words), source_size (words of its source),
    target (words wanted of its source), rate and copies (0 to cap).

    Sources, ordered by code point with null last, get the weights in turn.  A null or wordless text
    has size 0 and one copy.  Very long texts count whole.  Repeated rows count as documents of their own.  An empty table gives
    an empty result; columns of docs with the names above are replaced.  Names and sizes of the
    sources, one row each, are gathered on the driver, which has to name a target for each.
    """
    src = docs.drop("size", "source_size", "target", "rate", "copies")
    kept = src.columns
    draw = F.xxhash64(F.lit(seed), id_col, text_col)
    tagged = src.withColumns({"size": F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long"), "__source": F.col(source_col).cast("string"), "__draw": draw, "__cell": F.pmod(draw, F.lit(CELLS)).cast("int")})
    cells = stored(tagged.groupBy("__source", "size", "__cell").agg(F.count("*").alias("n")), "cells")

    found = cells.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs")).collect()
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    total = share * sum(r.words for r in found)
    targets = water_fill([r.words for r in found], [weights[i % len(weights)] for i in range(len(found))], total, cap)
    named = [(r[0], i, r.words, float(t)) for i, (r, t) in enumerate(zip(found, targets, strict=True))]
    spark = docs.sparkSession
    sources = spark.createDataFrame(named, "__source string, __sid int, source_size long, target double")
    sources = F.broadcast(sources) if len(named) <= BROADCAST_ROWS else sources
    numbered = lambda df: df.join(sources.withColumnRenamed("__source", "__name"), F.col("__source").eqNullSafe(F.col("__name"))).drop("__name")

    cells = numbered(cells).select("__sid", "size", "__cell", "n")
    counts = stored(cells.groupBy("__sid", "size").agg(F.sum("n").alias("n")), "counts")
    facts = {i: (r.words, r.docs, t) for i, (r, t) in enumerate(zip(found, targets, strict=True))}
    tilts = solve_tilts(counts, facts, cap)
    means = {i: r.words / max(r.docs, 1) for i, r in enumerate(found)}

    def rounded(batch: pd.DataFrame) -> pd.DataFrame:
        """Copies of each size of one source, from the largest down."""
        batch = batch.sort_values("size", ascending=False)
        sid = int(batch["__sid"].iloc[0])
        size, n = batch["size"].to_numpy(), batch["n"].to_numpy()
        rate = _rates(size, tilts[sid], means[sid], cap)
        copies = whole_copies(size, n, rate, facts[sid][2], cap)
        return pd.DataFrame({"__sid": batch["__sid"], "size": size, "n_size": n, "rate": rate, "k": copies})

    # a source has a row for each size its documents have, so its rows are few whatever the corpus
    per_size = stored(counts.groupBy("__sid").applyInPandas(rounded, "__sid int, size long, n_size long, rate double, k long"), "copies")
    upto = Window.partitionBy("__sid", "size").orderBy("__cell")  # CELLS rows at most
    dealt = cells.join(per_size, ["__sid", "size"]).withColumn("upto", F.sum("n").over(upto))
    dealt = dealt.withColumn("k_cell", F.expr("(k * upto) div n_size - (k * (upto - n)) div n_size"))
    dealt = dealt.select("__sid", "size", "__cell", "rate", F.expr("k_cell div n").alias("__base"), F.expr("k_cell % n").alias("__more"))
    in_cell = Window.partitionBy("__sid", "size", "__cell").orderBy("__draw", id_col)
    out = numbered(tagged).join(dealt, ["__sid", "size", "__cell"]).withColumn("__nth", F.row_number().over(in_cell))
    copies = F.col("__base") + (F.col("__nth") <= F.col("__more")).cast("long")
    return out.select(*(F.col(f"`{c}`") for c in kept), "size", "source_size", "target", "rate", copies.cast("int").alias("copies"))


def whole_copies(size: np.ndarray, n: np.ndarray, rate: np.ndarray, target: float, cap: int) -> np.ndarray:
    """Copies of all n documents of each size, sizes in descending order, so that their words come near the
    target.  Documents of size 0 have one copy each."""
    words = size * n
    room = cap * (words.sum() - np.cumsum(words)).astype(float)  # what the smaller sizes can take
    later = (rate * words).sum() - np.cumsum(rate * words)  # and are meant to
    out, left = np.zeros(len(size), np.int64), target
    for i in range(len(size)):
        if size[i] == 0:
            out[i] = n[i]
            continue
        k = math.floor((left - later[i]) / size[i] + 0.5)
        least, most = math.ceil((left - room[i]) / size[i]), math.floor(left / size[i])
        if least <= most:
            k = min(max(k, least), most)
        else:  # too few leave more than the smaller sizes can take, one more takes too much
            k = most if left - most * size[i] - room[i] < (most + 1) * size[i] - left else most + 1
        out[i] = min(max(k, 0), cap * n[i])
        left -= float(out[i] * size[i])
    return _closer(size, n, out, left, cap) if abs(left) > 0.5 else out


#: Most sizes of a source for which two moves at a time are tried; with more, one move nearly always does.
FEW_SIZES = 200


def _closer(size: np.ndarray, n: np.ndarray, out: np.ndarray, left: float, cap: int) -> np.ndarray:
    """out after moves (a copy more of one size, less of another, or both; two such at a time where sizes are
    few), as long as they bring the words nearer to the target, of which `left` are missing."""
    some = np.flatnonzero(size > 0)
    worth = np.append(size[some], 0)  # by place in some, -1 being none
    spot = np.append(np.arange(len(some)), -1)
    while True:
        more, less = np.meshgrid(np.append(-1, spot[:-1]), np.append(-1, spot[:-1]), indexing="ij") if len(some) <= FEW_SIZES else (np.concatenate([spot, np.full(len(some), -1)]), np.concatenate([np.full(len(some) + 1, -1), spot[:-1]]))
        more, less = more.ravel(), less.ravel()
        room, held = np.append(out[some] < cap * n[some], True), np.append(out[some] > 0, True)
        may = room[more] & held[less]
        more, less = more[may], less[may]
        net = (worth[more] - worth[less]).astype(float)
        order = np.argsort(net, kind="stable")
        more, less, net = more[order], less[order], net[order]
        at = np.clip(np.searchsorted(net, left - net), 1, len(net) - 1) if len(net) > 1 else np.zeros(len(net), np.int64)
        other = np.where(np.abs(left - net - net[at - 1]) < np.abs(left - net - net[at]), at - 1, at)
        off = np.abs(left - net - net[other])
        for i in np.argsort(off, kind="stable")[:200]:
            if off[i] >= abs(left) - 1e-9:
                return out
            new = out.copy()
            for j in (i, other[i]):
                if more[j] >= 0:
                    new[some[more[j]]] += 1
                if less[j] >= 0:
                    new[some[less[j]]] -= 1
            if (new >= 0).all() and (new <= cap * n).all():
                out, left = new, left - net[i] - net[other[i]]
                break
        else:
            return out


def _rates(size: np.ndarray, lam: float, mean: float, cap: int) -> np.ndarray:
    if math.isinf(lam):
        return np.where(size > 0, float(cap), 1.0)
    with np.errstate(over="ignore"):
        return np.where(size > 0, cap / (1.0 + np.exp(-lam * size / max(mean, 1e-9))), 1.0)


def repeat(mixed: DataFrame) -> DataFrame:
    """One row a copy, of the rows that mix gives; documents with no copy go.  A column named __copy is
    dropped; an empty table gives an empty result."""
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("__copy")
