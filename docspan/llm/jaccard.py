"""N-gram Jaccard self-join of texts: size-banded tiles, bitmap bounds, exact intersection.

1. A text becomes the sorted set of hashes of its word n-grams.  Texts with equal sets form one
   node; only one of them goes on.
2. Sizes fall into bands such that linked sets are in one band or in neighbours.  In each band a
   link allows at most `budget` shingles that only one side has.  The hash space is cut into more
   parts than that, so linked sets agree in a part that holds shingles.  A part's content is the
   tile key: nodes with the same key share a tile.  No cap is set on tiles.  Keys are packed by block
   to find those that several rows have; only these become rows.  A set that holds shingles in more
   parts than budget + 1 leaves as many of its most frequent keys as there are more: every link
   of it agrees in so many keys that the rarest of them stays on both sides (all go by one order).
3. A tile's hub is the node that shares most tiles, so near copies of one text tend to have the same
   hub in all of their tiles.  Each node is compared with its tiles' hubs: the bits in which two bitmaps
   differ bound the overlap from above, and what gets through is decided on the sorted arrays.
4. What a tile still holds in several groups is compared, block by block, on bitmaps: nodes outside of
   the hub's group with all others.  Of the pairs that get through, a block names as many as would join
   its groups, and these are decided on the arrays.
5. Tiles of which a named pair turns out to be no link are gone through once more with the arrays at
   hand, every pair of different groups that the bitmaps let through being decided there.
6. Links become components.

So every pair of nodes at or over the threshold is either linked by an exact check or joined by a
chain of exact links; nothing is sampled or capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspan.llm.common import keep, scratch, small, sorted_runs, stored
from docspan.llm.components import connected
from docspan.llm.words import CHUNK_BYTES, mix, shingle_sets, text_slices

#: Nodes of a tile that one task compares with as many others at a time.
BLOCK = 4096
#: Rows of one tile, or partners of one hub, that go to one task.
DEAL = 2048
#: Keys that a task packs at a time, and characters of text, about, whose keys meet in one block.
PACKED, BLOCK_CHARS = 1 << 18, 12 << 20


@dataclass(frozen=True)
class Rule:
    """`words` a shingle; linked if `of` * intersection >= `share` * union."""

    words: int = 5
    share: int = 80
    of: int = 100
    edges: list[int] = field(default_factory=lambda: [1], compare=False)

    def band(self, n: np.ndarray) -> np.ndarray:
        """Number of the band of each size."""
        while self.edges[-1] <= int(n.max(initial=0)):
            self.edges.append(self.edges[-1] * self.of // self.share + 1)
        return np.searchsorted(self.edges, n, side="right") - 1

    def budget(self, band: int) -> int:
        """Most shingles that only one of two linked sets has, the smaller being in this band."""
        while len(self.edges) < band + 2:
            self.edges.append(self.edges[-1] * self.of // self.share + 1)
        top = self.edges[band + 1] - 1
        return (top + top * self.of // self.share) * (self.of - self.share) // (self.of + self.share)

    def parts(self, band: int) -> int:
        spare = self.budget(band)
        return spare + 1 + math.ceil(spare / 8)

    def bits(self, band: int) -> int:
        """Length of a bitmap: eight times the budget, in whole 64-bit words, so that few pairs just
        under the threshold get through."""
        return 64 * max(1, math.ceil(8 * self.budget(band) / 64))

    def linked(self, both: int, n: int, m: int) -> bool:
        return self.of * both >= self.share * (n + m - both)


def _known_by(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(id, row): what a row is found again by, its id (0 for null) and a hash of its text."""
    key = F.col(f"`{id_col}`").cast("long")
    return F.coalesce(key, F.lit(0)), F.xxhash64(key.isNull(), f"`{text_col}`")


def shingle_rows(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, id, row, n_shingles, node, band, own, below): the set's size, digest (null if it is empty),
    band, and bitmaps for its own band and the one below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(3), CHUNK_BYTES // 8):
                sets = list(shingle_sets(texts, rule.words))
                n = np.array([len(s) for s in sets], np.int64)
                empty = n == 0
                node = np.array([_digest(s) for s in sets], np.int64)
                band = rule.band(n)
                own = [bitmap(s, rule.bits(b)) if len(s) else None for s, b in zip(sets, band.tolist(), strict=True)]
                below = [bitmap(s, rule.bits(b - 1)) if b > 0 and len(s) else None for s, b in zip(sets, band.tolist(), strict=True)]
                cols = [*(batch.column(c).slice(lo, hi - lo) for c in range(3)), pa.array(n), pa.array(node, mask=empty), pa.array(band.astype(np.int32)), pa.array(own, pa.binary()), pa.array(below, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "id", "row", "n_shingles", "node", "band", "own", "below"])

    known, row = _known_by(id_col, text_col)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), known.alias("id"), row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(run, "doc_id long, id long, row long, n_shingles long, node long, band int, own binary, below binary")


def _digest(s: np.ndarray) -> np.int64:
    total = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0]


def tile_keys(sets: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Tile keys of the sets, and for each key the number of its set.  A set takes part in its own
    band and in the one below."""
    return spare_keys(sets, rule)[:2]


def spare_keys(sets: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What tile_keys returns, and how many keys each set can do without in its own band and in the one
    below.  A key's last bit is that of its band."""
    spare = np.zeros((len(sets), 2), np.int32)
    n = np.array([len(s) for s in sets], np.int64)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), spare
    flat = np.concatenate(sets)
    own = rule.band(n)
    keys, owners = [], []
    for step in (0, 1):
        band = own - step
        tables = range(max(int(band.max()), 0) + 1)
        budget = np.array([rule.budget(b) for b in tables])[np.maximum(band, 0)]
        parts = np.array([rule.parts(b) for b in tables])[np.maximum(band, 0)]
        parts[band < 0] = 0
        parts[(budget == 0) | (n == 0)] = 0  # without a budget only equal sets are linked
        use = np.repeat(parts > 0, n)
        if not use.any():
            continue
        x = flat[use]
        doc = np.repeat(np.arange(len(sets)), n)[use]
        seed = mix((band + 1).astype(np.uint64))
        part = (mix(x ^ seed[doc]) >> np.uint64(20)) % parts[doc].astype(np.uint64)
        base = np.cumsum(parts) - parts
        slot = base[doc] + part.astype(np.int64)
        content = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(content, slot, mix(x + np.uint64(0x632BE59BD9B4E019)))
        held = np.bincount(slot, minlength=len(content)) > 0
        owner = np.repeat(np.arange(len(sets)), parts)
        full = np.add.reduceat(held, base[parts > 0]) if parts.any() else np.zeros(0)
        short = np.zeros(len(sets), bool)
        short[parts > 0] = full <= budget[parts > 0]  # too few parts hold shingles: empty ones count as well
        # two linked sets agree in as many keys of either as it has more than the budget
        spare[parts > 0, step] = np.maximum(full - budget[parts > 0] - 1, 0)
        part_no = np.arange(len(content)) - base[owner]
        key = mix(content + mix(part_no.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ seed[owner]))
        key = key & ~np.uint64(1) | band[owner].astype(np.uint64) & np.uint64(1)
        keep = held | short[owner]
        keys.append(key[keep])
        owners.append(owner[keep])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), spare
    return np.concatenate(keys), np.concatenate(owners), spare


def bitmap(s: np.ndarray, bits: int) -> bytes:
    """Bit i is the parity of the shingles that fall on it."""
    at = (mix(s ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(17)) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _arrays(docs: DataFrame, wanted: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the nodes wanted (node, id, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1), CHUNK_BYTES // 8):
                sets = [s.tobytes() for s in shingle_sets(texts, rule.words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["node", "shingles"])

    known, row = _known_by(id_col, text_col)
    src = docs.select(known.alias("id"), row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = src.join(small(stored(wanted.select("node", "id", "row"), "wanted")), ["id", "row"]).select("node", "text")
    # repeated rows have the same id and text; one of them is enough
    return stored(found.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "sets")


def _spread(tiles: DataFrame, count: str = "size") -> DataFrame:
    """tiles, one row a tile, once for each task that the tile's rows are dealt to."""
    return tiles.withColumn("deal", F.explode(F.sequence(F.lit(0), _deals(count) - 1)))


def _deals(count: str = "size") -> Column:
    return F.ceil(F.col(count) / DEAL).cast("int")


def _dealt(node: str = "node", count: str = "size") -> Column:
    return F.pmod(F.xxhash64(node), _deals(count)).cast("int")


def _met(docs: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """Rows of two kinds: (uid, node, band, spare) for each text with words, spare being what it can do without
    in its own band and in the one below; and (uid, key, size) for each of its keys that size rows have,
    size being over 1."""
    chars = docs.agg(F.coalesce(F.sum(F.length(f"`{text_col}`")), F.lit(0))).first()[0]
    blocks = int(chars // BLOCK_CHARS + 1)
    names = ["block", "uid", "node", "band", "spare", "blob"]

    def packed(first: int, node: list, band: list, spare: list, key: list, owner: list) -> Iterator[pa.RecordBatch]:
        """The texts, and a blob for each block: last halves of keys byte by byte, in order, and whose they are."""
        node, band, spare, key, owner = (np.concatenate(x) for x in (node, band, spare, key, owner))
        k = len(node)
        uid = first + np.arange(k)
        yield pa.RecordBatch.from_arrays([pa.array((uid % blocks).astype(np.int32)), pa.array(uid), pa.array(node), pa.array(band.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * 2, pa.int32()), pa.array(spare.ravel())), pa.nulls(k, pa.binary())], names)
        half, block = key.astype(np.uint32), ((key >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)
        order = np.lexsort((half, block))
        asked, at = np.unique(block[order], return_index=True)
        blobs = [half[x].view(np.uint8).reshape(-1, 4).T.tobytes() + owner[x].astype(np.uint16).tobytes() for x in np.split(order, at[1:])] if len(key) else []
        for i in range(0, len(blobs), 500):
            m = len(blobs[i : i + 500])
            yield pa.RecordBatch.from_arrays([pa.array(asked[i : i + 500]), pa.array(np.full(m, first)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int32())), pa.array(blobs[i : i + 500], pa.binary())], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held, keys, rows = [], 0, 0
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0), CHUNK_BYTES // 8):
                sets = [s for s in shingle_sets(texts, rule.words) if len(s)]
                if not sets:
                    continue
                if rows + len(sets) > 1 << 16 or keys > PACKED:
                    yield from packed(first, *zip(*held, strict=True))
                    first, held, keys, rows = first + (1 << 16), [], 0, 0
                key, owner, spare = spare_keys(sets, rule)
                held.append((np.array([_digest(s) for s in sets], np.int64), rule.band(np.array([len(s) for s in sets], np.int64)), spare, key, owner + rows))
                keys, rows = keys + len(key), rows + len(sets)
        if held:
            yield from packed(first, *zip(*held, strict=True))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["block"]):
            text = pc.is_valid(t.column("node"))
            for b in t.filter(text).to_batches():
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[1:5]), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], out)
            blobs = t.filter(pc.invert(text))
            half, uid = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for first, blob in zip(blobs.column("uid").to_pylist(), blobs.column("blob"), strict=True):
                x = np.frombuffer(blob.as_buffer(), np.uint8)
                k = len(x) // 6
                half.append(np.ascontiguousarray(x[: 4 * k].reshape(4, k).T).view(np.uint32).ravel())
                uid.append(first + x[4 * k :].view(np.uint16).astype(np.int64))
            half, uid = np.concatenate(half), np.concatenate(uid)
            order = np.argsort(half, kind="stable")
            start = np.flatnonzero(np.append(True, half[order[1:]] != half[order[:-1]])) if len(half) else np.zeros(0, np.int64)
            size = np.repeat(*[np.diff(np.append(start, len(half)))] * 2)
            order, size = order[size > 1], size[size > 1]
            key = (t.column("block")[0].as_py() << 32) + half[order].astype(np.int64)
            for i in range(0, len(order), 50_000):
                m = len(order[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(uid[order[i : i + 50_000]]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int32())), pa.array(key[i : i + 50_000]), pa.array(size[i : i + 50_000])], out)

    out = ["uid", "node", "band", "spare", "key", "size"]
    sent = docs.select(f"`{text_col}`").mapInArrow(pack, "block int, uid long, node long, band int, spare array<int>, blob binary")
    sent = sent.repartition(max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block").sortWithinPartitions("block")
    return stored(sent.mapInArrow(meet, "uid long, node long, band int, spare array<int>, key long, size long"), "met")


def _tiles(docs: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """(key, deal, node, size, pull) of tiles with several nodes.  size: the nodes that the tile has; pull: how
    many tiles the node shares, large ones counting more.  A key's last bit is that of its tile's band."""
    with scratch(docs.sparkSession):
        return keep(_formed(docs, rule, text_col))


def _formed(docs: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    met = _met(docs, rule, text_col)
    # of texts with the same set one goes on
    ones = met.filter("node is not null").groupBy("node").agg(F.min(F.struct("uid", "band", "spare")).alias("one")).select("node", "one.*")
    below = F.col("key").bitwiseXOR(F.col("band")).bitwiseAND(F.lit(1))
    ones = met.filter("key is not null").select("uid", "key", "size").join(ones, "uid").withColumn("below", below)
    order = Window.partitionBy("uid", "below").orderBy(F.desc("size"), F.desc("key"))
    rare = ones.withColumn("place", F.row_number().over(order)).filter(F.col("place") > F.get("spare", F.col("below").cast("int")))
    # keys of other bands that happen to be the same are told apart
    band = F.col("band") - F.col("below")
    key = F.shiftleft(F.xxhash64("key", band), 1).bitwiseOR(band % 2)
    rare = stored(rare.select(key.alias("key"), "node"), "rare")
    facts = rare.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key", "size")
    several = rare.join(facts, "key").select("key", "node", "size")
    tiles = stored(several.repartition("node").groupBy("node", "key", "size").agg(F.lit(1).alias("one")).drop("one"), "tiles")
    pull = tiles.groupBy("node").agg(F.sum((F.log2("size") * 1000).cast("long")).alias("pull"))
    return stored(tiles.join(pull, "node").select("key", _dealt().alias("deal"), "node", "size", "pull"), "tiles")


def _beside_hubs(pairs: DataFrame, table: DataFrame, columns: list[str], judge: Callable[[tuple, tuple], bool]) -> DataFrame:
    """(a, b, ok) for the pairs (a, b): judge is given the columns of a and of b in table (by node).  A
    hub's columns are sent once to each task that has partners of it, before these."""
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, ()
        for t in batches:
            a, b = t.column(0).to_pylist(), t.column(1).to_pylist()
            values = list(zip(*(t.column(3 + i).to_pylist() for i in range(k)), strict=True))
            ok = []
            for x, y, v in zip(a, b, values, strict=True):
                if y is None:
                    now, hub = x, v
                ok.append(y is not None and x == now and judge(hub, v))
            keep = pa.array([y is not None for y in b], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep), pa.array(ok, pa.bool_()).filter(keep)], ["a", "b", "ok"])
            del values, v
            pa.default_memory_pool().release_unused()

    counts = pairs.groupBy("a").agg(F.count("*").alias("size"))
    many = small(stored(counts.filter(F.col("size") > DEAL), "many"))
    info = table.select("node", *columns)
    asked = pairs.join(many, "a", "left").select("a", "b", F.when(F.col("size").isNull(), 0).otherwise(_dealt("b")).alias("deal"))
    asked = asked.join(info.withColumnRenamed("node", "b"), "b").select("a", "b", "deal", *columns)
    hubs = _spread(counts).join(info.withColumnRenamed("node", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "deal", *columns)
    rows = asked.unionByName(hubs).repartition("a", "deal").sortWithinPartitions("a", "deal", F.asc_nulls_first("b"))
    return rows.mapInArrow(run, "a long, b long, ok boolean")


def _may_link(rule: Rule, x: tuple, y: tuple) -> bool:
    """Whether sizes and bitmaps leave room for enough overlap.  Of each: (n, band, own, below)."""
    if x[0] > y[0]:
        x, y = y, x
    (n, band, own, _), (m, other, same, below) = x, y
    if rule.of * n < rule.share * m or not 0 <= other - band <= 1:
        return False
    differ = (int.from_bytes(own, "little") ^ int.from_bytes(same if other == band else below, "little")).bit_count()
    return rule.linked((n + m - differ) // 2, n, m)


def _linked(rule: Rule, x: tuple, y: tuple) -> bool:
    a, b = np.frombuffer(x[0], np.uint64), np.frombuffer(y[0], np.uint64)
    return rule.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))


def _exact(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(a, b, ok): whether the pairs are links, as far as the bitmaps let them through."""
    with scratch(docs.sparkSession):
        return keep(_decided(pairs, nodes, docs, rule, id_col, text_col))


def _decided(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    close = stored(_beside_hubs(pairs, nodes, ["n", "band", "own", "below"], lambda x, y: _may_link(rule, x, y)).filter("ok").select("a", "b"), "close")
    ends = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    sets = _arrays(docs, nodes.join(ends, "node", "left_semi"), rule, id_col, text_col)
    return stored(_beside_hubs(close, sets, ["shingles"], lambda x, y: _linked(rule, x, y)), "tested")


def _rest(tiles: DataFrame, hubs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, left, right, side, loose, node, label): what tiles hold of several groups, dealt to blocks.
    side: 0 to be compared with rows of side 1, 2 with those and others of side 2.  loose: not of the hub's
    group.  The hub itself is left out, all its pairs being decided.  Of tiles with the same nodes, one."""
    named = hubs.join(labels.withColumnRenamed("node", "hub"), "hub", "left").select("key", "size", "hub", F.coalesce("label", "hub").alias("main"))
    rows = tiles.join(labels, "node", "left").select("key", "deal", "node", F.coalesce("label", "node").alias("label"))
    rows = rows.join(_spread(named), ["key", "deal"]).filter("node <> hub")
    rows = stored(rows.select("key", "deal", "node", "label", "size", (F.col("label") != F.col("main")).alias("loose")), "rest")
    facts = rows.groupBy("key", "size").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.count_if("loose").alias("r"), F.bit_xor(F.xxhash64("node")).alias("sign"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("more"))
    facts = stored(facts.filter("least < most"), "facts")
    one = facts.groupBy("sign", "more", "n").agg(F.min("key").alias("key")).select("key")
    facts = facts.join(one, "key", "left_semi").select("key", "size", F.ceil(F.col("r") / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rights"))
    rows = rows.drop("size").join(_spread(facts).drop("size"), ["key", "deal"])
    whole = (F.col("lefts") == 1) & (F.col("rights") == 1)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    right = F.transform(every("lefts"), lambda x: F.struct(x.alias("left"), spot("rights").alias("right"), F.lit(1).alias("side")))
    left = F.transform(every("rights"), lambda x: F.struct(spot("lefts").alias("left"), x.alias("right"), F.lit(0).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("right"), F.when(F.col("loose"), 2).otherwise(1).alias("side")))
    places = F.when(whole, alone).when(F.col("loose"), F.concat(left, right)).otherwise(right)
    return rows.select("key", F.explode(places).alias("at"), "loose", "node", "label").select("key", "at.left", "at.right", "at.side", "loose", "node", "label")


def _compare(rest: DataFrame, rule: Rule, exact: bool) -> DataFrame:
    """(key, a, b): pairs of nodes of one block in different groups that the bitmaps let through, as many as
    join its groups; exact: that the arrays say are links.  rest: as _rest gives it, with n, bits (see
    _with_bits) and, if exact, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["key", "left", "right"]):
            node, label, n, side = (t.column(c).to_numpy() for c in ("node", "label", "n", "side"))
            loose = t.column("loose").to_numpy().astype(bool)
            arrays = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")] if exact else None
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
            group = np.unique(label, return_inverse=True)[1]
            right = np.flatnonzero(side > 0)
            a, b = [], []
            for i in np.flatnonzero((side == 0) | (side == 2)):
                # of two loose nodes the smaller is compared with the larger
                other = right[(group[right] != group[i]) & (~loose[right] | (node[right] > node[i]))]
                if not len(other):
                    continue
                differ = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
                both = (n[other] + n[i] - differ) // 2
                fits = (rule.of * both >= rule.share * (n[other] + n[i] - both)) & (rule.of * np.minimum(n[other], n[i]) >= rule.share * np.maximum(n[other], n[i]))
                for j in other[fits]:
                    if group[j] == group[i] or arrays is not None and not _linked(rule, (arrays[i],), (arrays[j],)):
                        continue
                    group[group == group[j]] = group[i]
                    a.append(node[i])
                    b.append(node[j])
            if a:
                x, y = np.array(a, np.int64), np.array(b, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t.column("key")[0].as_py())), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["key", "a", "b"])

    cell = ["key", "left", "right"]
    return rest.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "key long, a long, b long")


def _with_bits(rest: DataFrame, nodes: DataFrame) -> DataFrame:
    """rest with n and, of each node's two bitmaps, the one for its tile's band."""
    ours = F.col("key").bitwiseAND(F.lit(1)) == F.col("band") % 2
    return rest.join(nodes.select("node", "n", "band", "own", "below"), "node").withColumn("bits", F.when(ours, F.col("own")).otherwise(F.col("below"))).drop("band", "own", "below")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after each group took the smallest label of those that the links (a, b) tie
    it to.  This is one step, not the whole component: enough to leave out comparisons."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti")
    known = labels.unionByName(ends.withColumn("label", F.col("node")))
    name = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ties = links.join(name("a"), "a").join(name("b"), "b").filter("la <> lb").select("la", "lb")
    ties = ties.union(ties.select("lb", "la")).groupBy(F.col("la").alias("label")).agg(F.min("lb").alias("least"))
    return known.join(ties, "label", "left").select("node", F.least("label", F.coalesce("least", "label")).alias("label"))


def linked_nodes(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, labels): rows as shingle_rows gives them; labels (node, label), the component of each
    linked node, in which every pair over the threshold is linked or joined by a chain of links."""
    with scratch(docs.sparkSession):
        rows = keep(stored(shingle_rows(docs, rule, id_col, text_col), "shingled"))
        return rows, keep(_components(docs, rows, rule, id_col, text_col))


def _components(docs: DataFrame, rows: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    tiles = _tiles(docs, rule, text_col)
    inside = rows.join(tiles.select("node").distinct(), "node", "left_semi").select("node", "id", "row", F.col("n_shingles").alias("n"), "band", "own", "below")
    nodes = stored(inside.dropDuplicates(["node"]), "inside")

    hubs = tiles.groupBy("key", "size").agg(F.max(F.struct("pull", "node")).alias("h")).select("key", "size", F.col("h.node").alias("hub"), F.col("h.pull").alias("pull"))
    hubs = stored(hubs, "hubs")
    # a node's strongest hub first; the others only matter where that leaves them in different groups
    star = tiles.select("key", "deal", "node").join(_spread(hubs).drop("size"), ["key", "deal"]).filter("node <> hub")
    main = stored(star.groupBy("node").agg(F.max(F.struct("pull", "hub")).alias("m")).select(F.col("m.hub").alias("a"), F.col("node").alias("b")), "main")
    tested = _exact(main, nodes, docs, rule, id_col, text_col)
    links = tested.filter("ok").select("a", "b")
    labels = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    labels = stored(_joined(labels, links), "groups")
    # hubs take their group with them to their tiles, where only nodes of other groups go on
    grouped = hubs.join(labels.withColumnRenamed("node", "hub"), "hub", "left").select("key", "size", "hub", F.coalesce("label", "hub").alias("label"))
    other = tiles.select("key", "deal", "node").join(_spread(grouped).drop("size"), ["key", "deal"]).filter("node <> hub")
    other = other.join(labels, ["node", "label"], "left_anti").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct().join(main, ["a", "b"], "left_anti")
    tested = _exact(stored(other, "other"), nodes, docs, rule, id_col, text_col)
    more = tested.filter("ok").select("a", "b")
    links = links.unionByName(more)
    labels = stored(_joined(labels, more), "groups")

    with scratch(docs.sparkSession):
        named = keep(stored(_compare(_with_bits(_rest(tiles, hubs, labels), nodes), rule, exact=False), "named"))
    tested = _exact(stored(named.select("a", "b").distinct(), "pairs"), nodes, docs, rule, id_col, text_col)
    links = links.unionByName(tested.filter("ok").select("a", "b"))

    # tiles of which a named pair is no link: those that the bitmaps alone let through count as well
    again = stored(named.join(tested.filter("ok"), ["a", "b"], "left_anti").select("key").distinct(), "again")
    if again.limit(1).count():
        labels = stored(_joined(labels, tested.filter("ok").select("a", "b")), "groups")
        rest = stored(_rest(tiles.join(_spread(again.join(hubs, "key")).select("key", "deal"), ["key", "deal"], "left_semi"), hubs, labels), "rest")
        sets = _arrays(docs, nodes.join(rest.select("node").distinct(), "node", "left_semi"), rule, id_col, text_col)
        found = _compare(_with_bits(rest, nodes).join(sets, "node"), rule, exact=True)
        links = links.unionByName(stored(found.select("a", "b"), "found"))
    return connected(links)


def jaccard_components(docs: DataFrame, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles (set size) and component_id, the smallest doc_id
    reachable by links, itself included.

    Null and wordless texts have an empty set and are linked with nothing.  Equal texts are linked.
    Very long texts are read whole.  Repeated rows and repeated ids each keep their row.  A null doc_id
    counts as larger than all others; a component of null ids only has a null id.  An empty table gives
    an empty result.  Other columns, whatever their names, are not read.
    """
    rule = rule or Rule()
    rows, labels = linked_nodes(docs, rule, id_col, text_col)
    heads = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    heads = heads.join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    heads = stored(heads, "heads")
    ids = heads.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = heads.join(ids, "label").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, of which each is the first of its component, by doc_id (null
    last) and then by a hash of the text.

    Rows with an empty set (null and wordless texts) all stay.  Of repeated rows (equal id and text) one
    stays.  Very long texts are read whole.  An empty table gives an empty result.  Columns can have any
    names but __id and __row.
    """
    with scratch(docs.sparkSession):
        return _first_of_each(docs, rule or Rule(), id_col, text_col)


def _first_of_each(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    rows, labels = linked_nodes(docs, rule, id_col, text_col)
    heads = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "row")).alias("head"))
    heads = heads.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("head").alias("head"))
    name = [F.col("id").alias("__id"), F.col("row").alias("__row")]
    kept = keep(stored(heads.select("head.id", "head.row").select(*name).distinct(), "kept"))
    known, row = _known_by(id_col, text_col)
    tagged = docs.withColumns({"__id": known, "__row": row})
    words = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    both = ["__id", "__row"]
    stay = tagged.filter(words).join(small(kept), both, "left_semi")
    # rows with equal id and text are known by the same; few are, so only these are regrouped
    again = small(keep(stored(rows.groupBy("id", "row").count().filter("count > 1").select(*name), "again")))
    once = stay.join(again, both, "left_anti").unionByName(stay.join(again, both, "left_semi").dropDuplicates(both))
    return once.unionByName(tagged.filter(~words)).select(*(F.col(f"`{c}`") for c in docs.columns))
