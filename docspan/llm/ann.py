"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the neighbour graph is cut into parts of equal size with few edges between
them, and a small classifier learns to tell a vector's part.  The classifier then places every row
of the table, and for each query gives the parts' probabilities; the query is compared with all rows of
the most probable ones.  How much probability they must hold together is measured on sample queries
against brute force, so queries that the classifier is sure of search few parts and others more.

Parts follow the table: about PART_ROWS rows each, up to MOST parts.  A larger table has a second level:
each part is cut again, by a graph and a classifier of its own, fitted by Spark on a bounded sample of it.

For the search, parts are packed into a fixed number of blocks, or a large one dealt to several; a task has some of the
queries that want parts of one block, lets the block's rows pass by them, and keeps a query's best k of all of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspan.llm.common import stored

#: Vectors, expected, on which the index is fitted.
SAMPLE = 8192
#: Rows that a part should hold, and most parts that one level has.
PART_ROWS, MOST = 512, 128
#: Into how many blocks leaves are packed, about, whatever the table's size: what a query brings back grows with them.
#: Least rows that a block has room for, and how many queries, about, meet a block's rows in one task.
BLOCKS, BLOCK, QUERIES = 16, 512, 4096
SEED = 9_176


def cut_graph(near: np.ndarray, parts: int, x: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Part of each of the sample's vectors: equal parts by halving along the direction of most
    spread, then moves towards the part in which most neighbours are, while there is room."""
    n = len(near)
    part = np.zeros(n, np.int64)
    for _ in range(parts.bit_length() - 1):
        new = np.zeros(n, np.int64)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ axis, kind="stable")]
            new[order[: len(order) // 2]] = 2 * p
            new[order[len(order) // 2 :]] = 2 * p + 1
        part = new
    most = int(np.ceil(1.05 * n / parts))
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            to = int(votes[i].argmax())
            if size[to] < most:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < n // 200 + 1:
            break
    return part


@dataclass
class Router:
    """One hidden layer; the last gives a score for each part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 15, batch: int = 256, seed: int = SEED) -> Router:
        """target: for each row the share of its neighbours in each part."""
        rng = np.random.default_rng(seed)
        d, k = x.shape[1], target.shape[1]
        params = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, k)), np.zeros(k)]
        m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                a = x[rows]
                h = np.maximum(a @ params[0] + params[1], 0)
                z = h @ params[2] + params[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                err = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                back = (err @ params[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((a.T @ back, back.sum(axis=0), h.T @ err, err.sum(axis=0))):
                    m1[i] = 0.9 * m1[i] + 0.1 * g
                    m2[i] = 0.999 * m2[i] + 0.001 * g * g
                    params[i] = params[i] - 0.002 * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
        return cls(*params)


@dataclass
class Level:
    """A cut into parts: the router, how vectors are scaled for it, and the probability to search."""

    parts: int
    router: Router | None = None
    scale: float = 1.0
    mass: float = 1.0

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Probability of each part, a row for each vector."""
        if self.router is None:
            return np.ones((len(x), 1))
        z = self.router.scores(x / self.scale)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.chances(x).argmax(axis=1)


def parts_for(rows: int, sample: int) -> int:
    """Parts of a level: a power of two, such that they hold PART_ROWS rows or MOST is reached; two at least
    where the sample has enough vectors for that."""
    parts = 1
    while parts < MOST and parts * 64 <= sample and (parts == 1 or parts * PART_ROWS < rows):
        parts *= 2
    return parts


def fit(x: np.ndarray, rows: int, k: int, recall: float) -> Level:
    """The level for a table of so many rows, of which x are a sample.  mass: what the parts searched must hold
    so that sample queries reach recall."""
    parts = parts_for(rows, len(x))
    if parts == 1 or len(x) < 4 * k:
        return Level(1)
    scale = float(np.median(np.maximum(np.linalg.norm(x, axis=1), 1e-30)))
    unit = x / scale
    near = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 256):  # in strips, to keep memory small
        sims = unit[lo : lo + 256] @ unit.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -np.inf
        near[lo : lo + 256] = np.argpartition(sims, len(x) - k, axis=1)[:, len(x) - k :]
    part = cut_graph(near[:, : min(k, 10)], parts, unit)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), part[near].ravel()), 1 / k)
    half = len(x) // 2  # how much to search is measured on vectors that the classifier hasn't seen
    trial = Level(parts, Router.fit(unit[:half], target[:half]), scale)
    placed = trial.place(x)
    chance = trial.chances(x[half:])
    order = np.argsort(-chance, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(chance, order, axis=1), axis=1) - np.take_along_axis(chance, order, axis=1)
    need = np.empty_like(before)
    np.put_along_axis(need, order, before, axis=1)
    wanted = np.take_along_axis(need, placed[near[half:]], axis=1)  # a neighbour is found if more than this is searched
    return Level(parts, Router.fit(unit, target), scale, min(1.0, float(np.quantile(wanted, recall, method="higher")) + 1e-9))


def chosen(chance: np.ndarray, mass: float, sizes: np.ndarray, enough: int) -> np.ndarray:
    """Which parts each query searches: the most probable until they hold mass, and enough rows."""
    order = np.argsort(-chance, axis=1, kind="stable")
    p = np.take_along_axis(chance, order, axis=1)
    go = (np.cumsum(p, axis=1) - p < mass) | (np.cumsum(sizes[order], axis=1) - sizes[order] < enough)
    out = np.empty_like(go)
    np.put_along_axis(out, order, go, axis=1)
    return out & (sizes > 0)


def _vectors(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, in double precision, each by the same order of additions."""
    return (a * b).sum(axis=1)


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score): for each query the k best candidates, ties to smaller ids, its own
    id left out.  Equal vectors are compared once, by their smallest ids."""
    order = np.lexsort((c_ids, *c.T[::-1]))
    c, c_ids = c[order], c_ids[order]
    fresh = np.ones(len(c), bool)
    fresh[1:] = (c[1:] != c[:-1]).any(axis=1)
    group = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    # a query needs k others at most, so k + 1 of equal vectors
    keep = np.arange(len(c)) - starts[group] <= k
    members, owner = c_ids[keep], group[keep]
    first = np.searchsorted(owner, np.arange(len(starts)))
    count = np.diff(np.append(first, len(owner)))
    distinct = c[starts]
    out_q, out_c, out_s = [], [], []
    top = min(k + 1, len(distinct))
    for lo in range(0, len(q), 512):
        sims = q[lo : lo + 512] @ distinct.T
        floor = np.partition(sims, len(distinct) - top, axis=1)[:, len(distinct) - top]
        slack = 1e-12 * (1 + np.abs(floor))  # products of a matrix round in another order
        at_q, at_c = np.nonzero(sims >= (floor - slack)[:, None])
        score = exact(q[lo + at_q], distinct[at_c])
        n = count[at_c]
        row, s = np.repeat(at_q, n), np.repeat(score, n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at_c], n)
        ids = members[pos]
        other = ids != q_ids[lo + row]
        row, s, ids = row[other], s[other], ids[other]
        order = np.lexsort((ids, -s, row))
        row, s, ids = row[order], s[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        use = place < k
        out_q.append(q_ids[lo + row[use]])
        out_c.append(ids[use])
        out_s.append(s[use])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows that can be searched: an id, and a vector of the most frequent length
    without nulls and non-finite values that isn't zero."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter("id is not null and x is not null").filter(fine)
    sizes = src.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return src.filter(F.size("x") == (sizes[0] if sizes else 0))


def search(vectors: DataFrame, is_query: str = "id % 20 = 0", k: int = 20, recall: float = 0.95, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors for which is_query holds, the k rows
    of largest inner product found in the parts searched, ties to smaller ids, never its own id.

    Rows without an id or with a vector that is null, zero, of another length or not finite take no
    part.  Rows of one id count once, with the first vector by its values.  Where the parts searched hold
    fewer than k rows, more are searched.  An empty table gives an empty result.  Other columns, whatever
    their names, are not read.
    """
    spark = vectors.sparkSession
    src = usable(vectors, id_col, vec_col)
    rows = src.count()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed, levels = _placed(src, rows, k, recall, sample)
    found = _met(placed, levels, is_query, rows, k)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _draw(salt: int):
    return (F.xxhash64(F.lit(SEED + salt), "id") / float(1 << 63) + 1) / 2


def _placed(src: DataFrame, rows: int, k: int, recall: float, sample: int) -> tuple[DataFrame, list[Level]]:
    """(id, x, leaf) of all rows, stored, and the levels: the first, and where there is a second, one for each
    of its parts.  Parts of the last level, one after another, are the leaves."""
    got = src.filter(_draw(0) < sample / rows).select("id", "x").collect()
    got.sort(key=lambda r: r[0])
    x = np.array([r[1] for r in got], np.float64).reshape(len(got), -1)
    two = rows > MOST * PART_ROWS * 2
    goal = recall**0.5 if two else recall
    top = fit(x, rows, k, goal) if len(got) else Level(1)
    levels = [top]
    sent = src.sparkSession.sparkContext.broadcast(levels)
    names, schema = ["id", "x", "leaf"], "id long, x array<double>, leaf int"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(sent.value[0].place(_vectors(t.column(1))).astype(np.int32))], names)

    placed = stored(src.groupBy("id").agg(F.min("x").alias("x")).mapInArrow(place, schema), "placed")
    if not two or top.parts == 1:
        return placed, levels
    held = placed.groupBy("leaf").agg(F.count("*").alias("n"))  # MOST rows at most

    def cut(t: pa.Table) -> pa.Table:
        x = _vectors(t.column("x").combine_chunks())[np.argsort(t.column("id").to_numpy())]
        return pa.table({"leaf": pa.array([t.column("leaf")[0].as_py()], pa.int32()), "level": pa.array([pickle.dumps(fit(x, t.column("n")[0].as_py(), k, goal))], pa.binary())})

    some = placed.join(F.broadcast(held), "leaf").filter(_draw(1) < sample / F.col("n"))
    fitted = {r[0]: pickle.loads(r[1]) for r in some.groupBy("leaf").applyInArrow(cut, "leaf int, level binary").collect()}
    levels += [fitted.get(i, Level(1)) for i in range(top.parts)]
    sent = src.sparkSession.sparkContext.broadcast(levels)
    first = np.cumsum([0, *(level.parts for level in levels[1:])])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            part, x = t.column(2).to_numpy(), _vectors(t.column(1))
            leaf = np.zeros(len(part), np.int32)
            for p in np.unique(part):
                leaf[part == p] = first[p] + sent.value[p + 1].place(x[part == p])
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(leaf)], names)

    return stored(placed.mapInArrow(again, schema), "placed"), levels


def wanted(levels: list[Level], x: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
    """Which leaves each query searches."""
    if len(levels) == 1:
        return chosen(levels[0].chances(x), levels[0].mass, sizes, enough)
    first = np.cumsum([0, *(level.parts for level in levels[1:])])
    go = chosen(levels[0].chances(x), levels[0].mass, np.add.reduceat(sizes, first[:-1]), enough)
    out = np.zeros((len(x), len(sizes)), bool)
    for p in np.flatnonzero(go.any(axis=0)):
        some = np.flatnonzero(go[:, p])
        at = slice(first[p], first[p + 1])
        out[some, at] = chosen(levels[p + 1].chances(x[some]), levels[p + 1].mass, sizes[at], enough)
    return out


def _met(placed: DataFrame, levels: list[Level], is_query: str, rows: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): a query's best k of each block in which it searches leaves."""
    spark = placed.sparkSession
    leaves = sum(level.parts for level in levels[1:]) or levels[0].parts
    held = {r[0]: r[1] for r in placed.groupBy("leaf").count().collect()}  # MOST * MOST rows at most
    sizes = np.array([held.get(i, 0) for i in range(leaves)])
    most = max(BLOCK, -(-rows // BLOCKS))
    first, split, block, room = np.zeros(leaves, np.int64), np.ones(leaves, np.int64), -1, 0
    for i, n in enumerate(sizes.tolist()):
        if n > most:
            first[i], split[i] = block + 1, -(-n // most)
            block, room = block + split[i], 0
        else:
            if n > room:
                block, room = block + 1, most
            first[i], room = max(block, 0), room - n
    sent = spark.sparkContext.broadcast((levels, sizes, first, split))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, sizes, first, split = sent.value
        for t in batches:
            for lo in range(0, t.num_rows, 512):
                ids, xs = t.column(0).slice(lo, 512), t.column(1).slice(lo, 512)
                at, leaf = np.nonzero(wanted(levels, _vectors(xs), sizes, k + 1))
                n = split[leaf]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, leaf = np.repeat(at, n), np.repeat(leaf, n)
                to = first[leaf] + within
                order = np.lexsort((leaf, to, at))
                at, leaf, to = at[order], leaf[order], to[order]
                cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (to[1:] != to[:-1])])) if len(at) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)), pa.int32()), pa.array(leaf.astype(np.int32)))
                pick = pa.array(at[cut])
                yield pa.RecordBatch.from_arrays([ids.take(pick), xs.take(pick), pa.array(to[cut].astype(np.int32)), lists], ["id", "x", "block", "leaves"])

    queries = stored(placed.filter(is_query).select("id", "x").mapInArrow(route, "id long, x array<double>, block int, leaves array<int>"), "queries")
    asked = queries.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq"))
    blocks = F.broadcast(spark.createDataFrame([(i, int(first[i]), int(split[i])) for i in range(leaves)], "leaf int, first int, split int"))
    turns = F.broadcast(asked)  # a row for each block
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
    cand = placed.join(blocks, "leaf").select("leaf", (F.col("first") + deal(1, "split")).alias("block"), "id", "x")
    cand = cand.join(turns, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), "leaf", "id", "x")
    ask = queries.join(turns, "block").select("block", deal(2, "nq").alias("q"), F.lit(None).cast("int").alias("leaf"), "id", "x", "leaves")
    rows = ask.unionByName(cand, allowMissingColumns=True).repartition("block", "q").sortWithinPartitions("block", "q", F.asc_nulls_first("leaf"))
    return rows.mapInArrow(lambda batches: _meet(batches, k), "query_id long, vec_id long, score double")


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of block and q, of which the queries come first (their leaf is null), then the candidates by leaf:
    each query's best k of its block.  Held are the queries, the best so far and a batch of candidates."""
    at, asked, held = None, [], None
    for t in batches:
        block, q = t.column(0).to_numpy(), t.column(1).to_numpy()
        query = t.column(2).is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (q[1:] != q[:-1]) | (query[1:] != query[:-1]), True]) if len(q) else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = t.slice(lo, hi - lo)
            if (block[lo], q[lo]) != at:
                if held:
                    yield held.found()
                at, asked, held = (block[lo], q[lo]), [], None
            if query[lo]:
                asked.append(part)
            elif held or asked:
                held = held or _Asked(pa.Table.from_batches(asked), k)
                held.meet(part.column(2).to_numpy(), part.column(3).to_numpy(), _vectors(part.column(4)))
    if held:
        yield held.found()


class _Asked:
    """Queries of a block, with the leaves each wants, and their best so far."""

    def __init__(self, rows: pa.Table, k: int):
        self.k, self.ids, self.x = k, rows.column("id").to_numpy(), _vectors(rows.column("x").combine_chunks())
        lists = rows.column("leaves").combine_chunks()
        owner, leaf = np.repeat(np.arange(len(self.ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        by = np.argsort(leaf, kind="stable")
        self.owner, self.leaf = owner[by], leaf[by]
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def meet(self, leaf: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        got = [self.best]
        for one in np.unique(leaf):
            mine, here = self.owner[np.searchsorted(self.leaf, one) : np.searchsorted(self.leaf, one, "right")], leaf == one
            if len(mine):
                got.append(best(self.x[mine], self.ids[mine], x[here], ids[here], self.k))
        self.best = top_k(*(np.concatenate(z) for z in zip(*got, strict=True)), self.k)

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(z) for z in self.best], ["query_id", "vec_id", "score"])


def top_k(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k largest scores, ties to smaller ids."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    use = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[use], c[use], s[use]
