"""Conversation repair against trying all edits, in one block and in many, and against plain reading of rows."""

import hashlib
import random
import re
from functools import lru_cache

import pytest

from docspan.llm import repair

CONVERSATIONS = "conv_id long, turn long, role string, text string, place long, edit string, block int"
SPACE = " \t\n\x0b\f\r"


def tried(rows):
    """rows: (initial, gone, cut).  Cost and edits of the least cheapest repair, by trying all edits of each row."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def rest(k, state, inserted):
        ways = []
        if inserted < 2:  # two insertions reach any state
            to = "a" if state == "u" else "u"
            cost, edits = rest(k, to, inserted + 1)
            ways.append((cost + 3, "I" + edits))
        if k == len(rows):
            return min([*ways, (0, "")] if state in ("", "a") else ways, default=(1 << 40, ""))
        initial, gone, cut = rows[k]
        cost, edits = rest(k + 1, state, 0)
        ways.append((cost + 4, "D" + edits))
        if not gone:
            for edit, symbol, price in (("K", initial, 0), ("R", "u", 3), ("R", "a", 3)):
                if (state, symbol) in after:
                    cost, edits = rest(k + 1, after[state, symbol], 0)
                    ways.append((cost + price + 3 * cut, edit + edits))
        return min(ways)

    return rest(0, "", 0)


def read_plainly(rows):
    """The report and hash of each conversation, from rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = tried(tuple((r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(own, faults, strict=True)))
        lines, left, state = [], list(own), ""
        for e in audit:
            role, text = ("", "") if e == "I" else left.pop(0)[1:]
            if e != "D":
                state = "s" if e == "K" and role[:1] == "s" else "a" if state == "u" else "u"
                lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, **kwargs):
    df = spark.createDataFrame([(*r, 1, "e", 2) for r in rows], CONVERSATIONS).repartition(3)
    done = repair.repair(df, **kwargs)
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(done.turns).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes[r.conv_id]) for r in done.report.collect()}


def odd_conversations(convs=25, longest=12, seed=5):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "summary", "ask"]
    texts = ["Yes.", "No!", "Why?", "because", "", " \t", None, "Yes. \n", "été?", ".", "x" * 3000 + "."]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(1, longest)):
            row = (conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])  # repeated rows
    return rows


@pytest.mark.parametrize("seed", range(8))
def test_edits_are_the_least_cheapest(seed):
    rng = random.Random(seed)
    codes = [*range(4), *(4 + c for c in range(4)), *(8 + c for c in range(4))]
    for _ in range(60):
        own = bytes(rng.choice(codes) for _ in range(rng.randrange(14)))
        cost, audit = tried(tuple(("suax"[c & 3], bool(c & 4), bool(c & 8)) for c in own))
        items, price = repair.edits(own)
        assert (price, "".join(items)) == (cost, audit)
        roles = [r for item in repair.repaired_roles(items, own, 0) for r in item if r]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(roles))


def test_parts_joined_are_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        own = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 9, 10]) for _ in range(rng.randrange(2, 50)))
        cuts = [0, *sorted(rng.sample(range(1, len(own)), min(len(own) - 1, 4))), len(own)]
        parts = [own[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        nodes = repair.Nodes([repair.summed_up(repair.Rows(p)) for p in parts])
        states = repair.crossings(nodes, 0, repair.ending(nodes.forth(repair.START, 0, len(parts))))
        done = [repair.edits(p, states[k], states[k + 1] if k + 1 < len(parts) else None) for k, p in enumerate(parts)]
        items, cost = repair.edits(own)
        assert ("".join("".join(i) for i, _ in done), sum(c for _, c in done)) == ("".join(items), cost)


@pytest.mark.parametrize("kwargs", [{}, {"size": 7, "fan": 1}, {"size": 16, "fan": 10}])
def test_conversations_equal_plain_reading(spark, kwargs):
    rows = odd_conversations() + [(99, t, ["user", "assistant"][t % 3 == 0], f"text {t}" + ".?"[t % 2] * (t % 4 > 0)) for t in range(130)]
    assert found(spark, rows, **kwargs) == read_plainly(rows)


def test_many_equal_rows_of_one_conversation(spark):
    rows = [(1, None, "user", "Again.")] * 60 + [(1, 5, "assistant", "Once.")]
    assert found(spark, rows, size=8) == read_plainly(rows)


def test_turns_are_the_repaired_texts(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Hello again"), (2, 0, "assistant", "Only this.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = repair.repair(df).turns.orderBy("conv_id", "place", "nth")
    kept = [(r.conv_id, r.edit, r.role, r.text) for r in turns.collect()]
    assert kept == [(1, "K", "user", "Hello."), (1, "R", "assistant", "Hello again"), (2, "I", "user", ""), (2, "K", "assistant", "Only this.")]
    assert repair.repair(df.limit(0)).turns.count() == 0 and repair.repair(df.limit(0)).report.count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in (None, 3, 40) for t in (None, *range(30))]
    df = spark.createDataFrame([(*r, 1, "e", 2) for r in rows], CONVERSATIONS)
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f:
            want += [(c, t, "user" if f == 4 else role, "" if f == 1 else "One Two Three" if f == 2 else text)] * (2 if f == 3 else 1)
    assert sorted(map(tuple, repair.damage(df).collect()), key=str) == sorted(want, key=str)


def test_every_conversation_has_a_row(spark):
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi."), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.conversation_repair(df).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert set(got) == {gone, None} and got[gone].audit == "" and got[gone].cost == 0 and got[gone].repaired_sha256 == nothing
    assert got[None].audit == "D" and got[None].blank == 1 and repair.conversation_repair(df.limit(0)).count() == 0
