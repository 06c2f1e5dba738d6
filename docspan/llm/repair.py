"""Repair of conversations whose turns were lost, repeated, emptied, cut off or given to the wrong speaker.

A sound conversation is a system turn, or none, and then pairs of user and assistant; or it is empty.  By the
initials of its roles that is `(s?(ua)+)?`, which four states accept: nothing yet, after s, after u, after a.
Rows may be kept, given to another speaker or deleted, and empty turns inserted, each at a cost; of the cheapest
repairs that one is taken whose edits, written as initials in order, come first in ASCII.

The search is Hirschberg's: from the front the costs of reaching each of the four states, from the back the
costs of ending well from each, and where they meet in the middle the state is chosen that is best for the
whole; then both halves are done in the same way, so that only vectors of four are held.  Beside its cost each
state of the front carries the order of its cheapest edits among the four.  No such string is the beginning of
another (all end with an edit of the same row), so the order of strings so far stays the order of wholes, and of
equally good crossings the least is known without writing any string.

Rows are numbered in order over the whole table and cut into blocks.  A conversation inside a block is repaired
there.  What a block holds of a longer one is summed up as a 4 x 4 matrix of costs and orders; such matrices are
joined in a tree with a bounded number of children, crossings are chosen from its top down by the same search, and
then each block repairs its own rows between the two states that it was given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from docspan.llm.common import keep, scratch, stored

#: Rows of a block, and binary logarithm of the children of a node.
BLOCK, FAN = 4096, 10
#: Costs of giving a turn to another speaker, of deleting and of inserting one, and of what stays cut off.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; a row's code: 0 s, 1 u, 2 a, 3 another role,
# plus GONE if it has to go, plus CUT if it is cut off
S, U, A = 1, 2, 3
GONE, CUT = 4, 8
_AFTER = {(0, S): S, (0, U): U, (S, U): U, (A, U): U, (U, A): A}
_INSERTED = {0: U, S: U, U: A, A: U}
#: What it costs to end in each state, in insertions.
_ENDS = (0, 2, 1, 0)

#: Four (cost, order), None for a state that can't be reached.
Vector = tuple
#: From each of the four states a vector.
Step = tuple


def _row_step(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) to the least (cost, edits) that takes in a row of this code."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    role, gone, cut = code & 3, bool(code & GONE), CUT_OFF if code & CUT else 0
    for before in range(4):
        at = before
        for inserted in range(3):
            ways = [(at, DELETE, "D")]
            if not gone:
                ways += [(_AFTER.get((at, (S, U, A, None)[role])), cut, "K")]
                ways += [(_AFTER.get((at, to)), REROLE + cut, "R") for to in (U, A)]
            for after, cost, edit in ways:
                if after is not None:
                    best[before, after] = min(best.get((before, after), (1 << 60, "")), (cost + inserted * INSERT, "I" * inserted + edit))
            at = _INSERTED[at]
    return best


_EDITS = [_row_step(code) for code in range(16)]
_STEPS: list[Step] = [tuple(tuple(e.get((p, q)) for q in range(4)) for p in range(4)) for e in _EDITS]
START: Vector = ((0, 0), None, None, None)


def _advance(front: Vector, step: Step) -> Vector:
    """front after one more step; orders are renumbered from 0."""
    best: list = [None] * 4
    for p, at in enumerate(front):
        if at is not None:
            for q, taken in enumerate(step[p]):
                if taken is not None:
                    new = (at[0] + taken[0], at[1], taken[1])
                    if best[q] is None or new < best[q]:
                        best[q] = new
    order = {q: k for k, q in enumerate(sorted((q for q in range(4) if best[q]), key=lambda q: best[q][1:]))}
    return tuple(b and (b[0], order[q]) for q, b in enumerate(best))


def _retreat(back: tuple, step: Step) -> tuple:
    """Costs of ending well before a step, from those after it."""
    return tuple(min((t[0] + back[q] for q, t in enumerate(ways) if t is not None and back[q] is not None), default=None) for ways in step)


@lru_cache(1 << 14)
def _advance_row(front: Vector, code: int) -> tuple[int, Vector]:
    out = _advance(front, _STEPS[code])
    least = min(x[0] for x in out if x)
    return least, tuple(x and (x[0] - least, x[1]) for x in out)


@lru_cache(1 << 14)
def _retreat_row(back: tuple, code: int) -> tuple[int, tuple]:
    out = _retreat(back, _STEPS[code])
    least = min(x for x in out if x is not None)
    return least, tuple(None if x is None else x - least for x in out)


class Rows:
    """Steps that are rows, by their codes; vectors repeat, so each step is looked up."""

    def __init__(self, codes: bytes):
        self.codes = codes

    def __len__(self) -> int:
        return len(self.codes)

    def forth(self, front: Vector, lo: int, hi: int) -> Vector:
        total = 0
        for code in self.codes[lo:hi]:
            cost, front = _advance_row(front, code)
            total += cost
        return tuple(x and (x[0] + total, x[1]) for x in front)

    def back(self, ends: tuple, lo: int, hi: int) -> tuple:
        total = 0
        for code in reversed(self.codes[lo:hi]):
            cost, ends = _retreat_row(ends, code)
            total += cost
        return tuple(None if x is None else x + total for x in ends)


class Nodes:
    """Steps that are parts of a conversation, by their matrices."""

    def __init__(self, steps: list[Step]):
        self.steps = steps

    def __len__(self) -> int:
        return len(self.steps)

    def forth(self, front: Vector, lo: int, hi: int) -> Vector:
        for step in self.steps[lo:hi]:
            front = _advance(front, step)
        return front

    def back(self, ends: tuple, lo: int, hi: int) -> tuple:
        for step in reversed(self.steps[lo:hi]):
            ends = _retreat(ends, step)
        return ends


def only(state: int, value: object) -> tuple:
    return tuple(value if s == state else None for s in range(4))


def meeting(front: Vector, back: tuple) -> int:
    """The state in which the cheapest whole crosses, the one of least edits if there are several."""
    return min((f[0] + b, f[1], s) for s, (f, b) in enumerate(zip(front, back, strict=True)) if f is not None and b is not None)[2]


def crossings(steps: Rows | Nodes, first: int, last: int) -> list[int]:
    """The states before, between and after steps on the least of the cheapest ways from first to last."""
    states = [first] * len(steps) + [last]

    def between(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        mid = (lo + hi) // 2
        front = steps.forth(only(states[lo], (0, 0)), lo, mid)
        states[mid] = meeting(front, steps.back(only(states[hi], 0), mid, hi))
        between(lo, mid)
        between(mid, hi)

    between(0, len(steps))
    return states


def ending(front: Vector) -> int:
    """The state in which the rows of a whole conversation end best; what is inserted then comes on top."""
    return meeting(front, tuple(INSERT * n for n in _ENDS))


def summed_up(steps: Rows | Nodes) -> Step:
    """What steps do together."""
    return tuple(steps.forth(only(p, (0, 0)), 0, len(steps)) for p in range(4))


def edits(codes: bytes, first: int = 0, last: int | None = None) -> tuple[list[str], int]:
    """Edits of each row of these codes (the insertions before it, then its own), and their cost; with last
    None it is a conversation's end, whose insertions are an item of their own at the end."""
    rows = Rows(codes)
    to = ending(rows.forth(only(first, (0, 0)), 0, len(rows))) if last is None else last
    states = crossings(rows, first, to)
    taken = [_EDITS[code][p, q] for code, p, q in zip(codes, states, states[1:], strict=False)]
    cost, out = sum(c for c, _ in taken), [e for _, e in taken]
    return (out, cost) if last is not None else (out + ["I" * _ENDS[to]], cost + INSERT * _ENDS[to])


def repaired_roles(audit: list[str], codes: bytes, first: int) -> list[list[str | None]]:
    """For each item of `edits` and each edit in it the role that it leaves, by initial; None: deleted."""
    at, out = first, []
    for k, item in enumerate(audit):
        roles: list[str | None] = []
        for e in item:
            if e == "D":
                roles.append(None)
                continue
            at = S if e == "K" and codes[k] & 3 == 0 else _INSERTED[at]
            roles.append("nsua"[at])
        out.append(roles)
    return out


class Repaired(NamedTuple):
    """turns: the edits in order as rows (conv_id, place, nth, edit, turn, role, text), where place numbers the
    given rows through the table, nth orders a place's edits, and deleted rows have edit D.  report: a row a
    conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""

    turns: DataFrame
    report: DataFrame


_PIECE = "at long, block long, codes binary, blank long, duplicate long, truncated long, illegal long, open boolean, head boolean, tail boolean, costs array<long>, orders array<long>"
_NUMBERS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]
_SOUND = {"su", "ua", "au"}


def _flat(step: Step) -> tuple[list[int], list[int]]:
    cells = [c for row in step for c in row]
    return [-1 if c is None else c[0] for c in cells], [0 if c is None else c[1] for c in cells]


def _step(costs: list[int], orders: list[int]) -> Step:
    return tuple(tuple(None if costs[4 * p + q] < 0 else (costs[4 * p + q], orders[4 * p + q]) for q in range(4)) for p in range(4))


def _pieces(kind: pa.DataType, size: int) -> Callable[[pa.Table], pa.Table]:
    """A block's rows, with the row before and the row after it, and marks of first occurrences: what it holds of
    each conversation."""

    def run(group: pa.Table) -> pa.Table:
        first = set(group.filter(pc.equal(group["what"], 2))["place"].to_pylist())
        rows = group.filter(pc.less(group["what"], 2)).sort_by("place")
        out: dict[str, list] = {n.split()[0]: [] for n in _PIECE.split(", ")}
        names = rows["conv_id"].combine_chunks()
        conv = pc.dictionary_encode(names, null_encoding="encode").indices.to_numpy() if rows.num_rows else np.zeros(0, int)
        own = np.flatnonzero(rows["what"].to_numpy() == 0)
        place, initial = rows["place"].to_numpy(), rows["initial"].to_pylist()
        blank, ended = rows["blank"].to_numpy(zero_copy_only=False), rows["ended"].to_numpy(zero_copy_only=False)
        cuts = [own[0], *(own[1:][conv[own[1:]] != conv[own[1:] - 1]]), own[-1] + 1] if len(own) else []
        heads = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            repeated = np.array([p not in first for p in place[lo:hi].tolist()]) & ~blank[lo:hi]
            cut = ~blank[lo:hi] & ~repeated & ~ended[lo:hi]
            codes = np.array([{"s": 0, "u": 1, "a": 2}.get(c, 3) for c in initial[lo:hi]], np.uint8)
            codes |= (GONE * (blank[lo:hi] | repeated) + CUT * cut).astype(np.uint8)
            head, tail = lo == 0 or conv[lo - 1] != conv[lo], hi == len(conv) or conv[hi] != conv[hi - 1]
            pairs = range(lo + bool(head), hi)
            given = ([], []) if head and tail else _flat(summed_up(Rows(codes.tobytes())))
            heads.append(int(lo))
            for name, value in (
                ("at", place[lo]), ("block", place[lo] // size), ("codes", codes.tobytes()), ("blank", blank[lo:hi].sum()), ("duplicate", repeated.sum()), ("truncated", cut.sum()),
                ("illegal", sum(initial[i - 1] + initial[i] not in _SOUND for i in pairs)), ("open", not (head and tail)), ("head", bool(head)), ("tail", bool(tail)), ("costs", given[0]), ("orders", given[1]),
            ):
                out[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.binary(), *(k for _, k in _NUMBERS), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        made = {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)}
        return pa.table({"conv_id": names.take(pa.array(heads, pa.int64())).cast(kind), **made})

    return run


def _nodes(group: pa.Table) -> Nodes:
    return Nodes([_step(*x) for x in zip(group["costs"].to_pylist(), group["orders"].to_pylist(), strict=True)])


def _joined(key: tuple, group: pa.Table) -> pa.Table:
    """A node's children as one step."""
    group = group.sort_by("no")
    costs, orders = _flat(summed_up(_nodes(group)))
    return pa.table({"conv_id": group["conv_id"].slice(0, 1), "no": pa.array([key[1].as_py()], pa.int64()), "costs": pa.array([costs], pa.list_(pa.int64())), "orders": pa.array([orders], pa.list_(pa.int64()))})


def _handed_down(group: pa.Table) -> pa.Table:
    """The states between a node's children, from those before and after it; from null the state is chosen at the end."""
    group = group.sort_by("no")
    nodes = _nodes(group)
    first, last = group["before"][0].as_py(), group["after"][0].as_py()
    if last is None:
        last = ending(nodes.forth(only(first, (0, 0)), 0, len(nodes)))
    states = crossings(nodes, first, last)
    return pa.table({"conv_id": group["conv_id"], "no": group["no"], "before": pa.array(states[:-1], pa.int64()), "after": pa.array(states[1:], pa.int64())})


def _between_blocks(parts: DataFrame, fan: int) -> DataFrame:
    """(conv_id, block, before, after): the states between which each block has its part of a long conversation."""
    kind = parts.schema["conv_id"]
    schema = lambda rest: StructType([kind, *StructType.fromDDL(rest).fields])
    levels = [parts.select("conv_id", F.col("block").alias("no"), "costs", "orders")]
    above = lambda df: df.groupBy("conv_id", F.shiftright("no", fan).alias("above"))
    while levels[-1].groupBy("conv_id").count().filter("count > 1").limit(1).count():
        levels.append(stored(above(levels[-1]).applyInArrow(_joined, schema("no long, costs array<long>, orders array<long>")), "nodes"))
    # above the top: from nothing to whatever ends best
    states = levels[-1].select("conv_id", F.shiftright("no", fan).alias("no"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("after"))
    for level in reversed(levels):
        given = states.select(F.col("conv_id").alias("c"), F.col("no").alias("n"), "before", "after")
        level = level.join(given, F.col("conv_id").eqNullSafe(F.col("c")) & (F.shiftright("no", fan) == F.col("n"))).drop("c", "n")
        states = stored(above(level).applyInArrow(_handed_down, schema("no long, before long, after long")), "states")
    return states.withColumnRenamed("no", "block")


def _solved(kind: pa.DataType):
    """Each piece's edits as rows, its audit and cost on the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which: list[int] = []
            place, nth, edit, to, audit, price = ([] for _ in range(6))
            for k, (at, codes, tail, before, after) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "codes", "tail", "before", "after")), strict=True)):
                items, cost = edits(codes, before or 0, None if tail else after)
                roles = repaired_roles(items, codes, before or 0)
                written = "".join(items)
                flat = [(at + min(i, len(codes) - 1), n + 3 * (i == len(codes)), e, r) for i, item in enumerate(items) for n, (e, r) in enumerate(zip(item, roles[i], strict=True))]
                for i, (p, n, e, r) in enumerate(flat):
                    which.append(k)
                    place.append(p)
                    nth.append(n)
                    edit.append(e)
                    to.append(r)
                    audit.append(None if i else written)
                    price.append(None if i else cost)
            made = [batch.column("conv_id").take(pa.array(which, pa.int64())).cast(kind), pa.array(place, pa.int64()), pa.array(nth, pa.int32()), pa.array(edit, pa.string()), pa.array(to, pa.string()), pa.array(audit, pa.string()), pa.array(price, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["conv_id", "place", "nth", "edit", "to", "audit", "cost"])

    return run


def repair(conversations: DataFrame, size: int = BLOCK, fan: int = FAN) -> Repaired:
    """conversations: conv_id, turn, role, text, one row a turn.  size: rows of a block, fan: binary logarithm of the
    children of a node.

    Null roles and texts are one space; a null conv_id is a conversation of its own; rows of null turn come first.
    Rows of the same turn are taken by role, then the first 64 characters of the text, then a hash of it; equal rows
    are repetitions.  A row is blank (nothing but white space), a duplicate (role and text seen earlier), or truncated
    (its last visible character is none of .!?), the first of these that holds.  Blank rows and duplicates must go.
    Very long texts are only read by Spark, not by Python.  A conversation of any length is searched in blocks;
    its audit is one string.  Other columns aren't read, whatever their names; an empty table gives
    empty tables.
    """
    spark = conversations.sparkSession
    kind = conversations.schema["conv_id"]
    arrow_kind = to_arrow_type(kind.dataType)
    schema = lambda rest: StructType([StructField("conv_id", kind.dataType), *StructType.fromDDL(rest).fields])
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"))
    with scratch(spark):
        order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.xxhash64("text"), "salt"]
        # the salt parts equal rows, so that any number of them can be cut into ranges
        ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
        ranged = stored(ranged.withColumn("pos", F.monotonically_increasing_id()), "ranged")
        # places without gaps: a row a partition goes to the driver
        sizes = sorted(map(tuple, ranged.groupBy(F.shiftright("pos", 33).alias("part")).count().collect()))
        starts = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
        offset = F.broadcast(spark.createDataFrame(list(starts.items()), "part long, start long"))
        numbered = ranged.withColumn("part", F.shiftright("pos", 33)).join(offset, "part")
        placed = numbered.select("conv_id", "turn", "role", "text", (F.col("start") + F.col("pos").bitwiseAND((1 << 33) - 1)).alias("place"))

        visible = F.rtrim("text", F.lit(SPACE))
        block = F.floor(F.col("place") / size).cast("long")
        slim = placed.select("conv_id", "place", F.substring("role", 1, 1).alias("initial"), (visible == "").alias("blank"), F.right(visible, F.lit(1)).isin(".", "!", "?").alias("ended"))
        inside = F.col("place") % size
        goes_to = F.array_compact(
            F.array(
                F.struct(block.alias("block"), F.lit(0).alias("what")),
                F.when(inside == size - 1, F.struct((block + 1).alias("block"), F.lit(1).alias("what"))),
                F.when((inside == 0) & (F.col("place") > 0), F.struct((block - 1).alias("block"), F.lit(1).alias("what"))),
            )
        )
        slim = slim.select("*", F.inline(goes_to))
        first = placed.groupBy("conv_id", "role", F.md5("text").alias("t")).agg(F.min("place").alias("place")).select("place", block.alias("block"), F.lit(2).alias("what"))
        # a block that has only a neighbour's row gives no piece
        pieces = slim.unionByName(first, allowMissingColumns=True).groupBy("block").applyInArrow(_pieces(arrow_kind, size), schema(_PIECE))
        pieces = stored(pieces, "pieces")
        parts = pieces.filter("open")
        if parts.limit(1).count():
            states = _between_blocks(parts, fan).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before", "after")
            given = pieces.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
        else:
            given = pieces.withColumns({"before": F.lit(None).cast("long"), "after": F.lit(None).cast("long")})
        given = given.select("conv_id", "at", "codes", "tail", "before", "after")
        made = stored(given.mapInArrow(_solved(arrow_kind), schema("place long, nth int, edit string, to string, audit string, cost long")), "edits")

        role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.when(F.col("to") == "u", "user").when(F.col("to") == "a", "assistant").otherwise(F.col("role")))
        text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
        turn = F.when(F.col("edit") != "I", F.col("turn"))
        turns = made.join(placed.drop("conv_id"), "place").select("conv_id", "place", "nth", "edit", turn.alias("turn"), role.alias("role"), text.alias("text"))

        wide = lambda c: c.cast("decimal(38,0)")
        gaps = placed.groupBy("conv_id").agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))).alias("gaps"))
        counted = pieces.groupBy("conv_id").agg(*(F.sum(n).alias(n) for n, _ in _NUMBERS))
        strings = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "audit"))), lambda x: x["audit"]), "")
        audits = made.filter("audit IS NOT NULL").groupBy("conv_id").agg(F.sum("cost").alias("cost"), strings.alias("audit"))
        sides = gaps.unionByName(counted, allowMissingColumns=True).unionByName(audits, allowMissingColumns=True)
        report = sides.groupBy("conv_id").agg(F.coalesce(F.expr("try_cast(max(gaps) AS long)"), F.lit(0).cast("long")).alias("gaps"), *(F.max(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")))
        return Repaired(keep(stored(turns, "repaired")), keep(stored(report, "report")))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns that `repair` gives: `role:text` of those that stay, joined by line
    feeds.  A hash of this kind is taken in order, so a conversation's rows pass through one task; they are read as
    they come, and only a batch and the hash are held."""
    kind = turns.schema["conv_id"]
    arrow_kind = to_arrow_type(kind.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashed, ids, found = None, None, [], []
        for batch in batches:
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if hashed is None or conv != last:
                    if hashed is not None:
                        ids.append(last)
                        found.append(hashed.hexdigest())
                    last, hashed, apart = conv, hashlib.sha256(), b""
                if line is not None:
                    hashed.update(apart + line.encode())
                    apart = b"\n"
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_kind), pa.array(found, pa.string())], names=["conv_id", "repaired_sha256"])
                ids, found = [], []
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], arrow_kind), pa.array([hashed.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text")).alias("line")
    in_order = turns.select("conv_id", "place", "nth", line).repartition("conv_id").sortWithinPartitions("conv_id", "place", "nth").select("conv_id", "line")
    return in_order.mapInArrow(run, StructType([StructField("conv_id", kind.dataType), *StructType.fromDDL("repaired_sha256 string").fields]))


def damage(conversations: DataFrame) -> DataFrame:
    """Faults for trying a repair, by the CRC-32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2
    takes its .!? away, 3 repeats it, 4 gives it to the user.  Nulls are one space, but a null turn stays one; rows of one
    turn share its fault; an empty table stays empty; other columns go."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies")).drop("col")


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """Report and digest of each conversation after `damage` and `repair`; one that lost all its rows has zeros, an
    empty audit and the hash of nothing."""
    done = repair(damage(conversations))
    ids = conversations.select("conv_id").distinct()
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    sides = ids.unionByName(done.report, allowMissingColumns=True).unionByName(digests(done.turns), allowMissingColumns=True)
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return sides.groupBy("conv_id").agg(*(F.coalesce(F.max(c), nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in columns))
