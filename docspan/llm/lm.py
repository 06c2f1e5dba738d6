"""Language-model scores from a log-frequency Bloom filter of token pairs.

Texts are cut into tokens once; a chunk of texts is kept as its distinct tokens and each position's place
among them, and all later steps read that, not the text.  Counts of tokens and token pairs over the training documents are
exact and summed by Spark.  The filter holds each pair once for every level of its count (level j from
2^(j-1) occurrences on), so a reader finds the level by probing one level after another until one is
missing.  Pairs seen `min_count` times at least go in.  The number of probes follows the vocabulary, so
that pairs which the filter makes up add less than a hundredth of mu to any context.  The filter is built
in segments by Spark tasks; their number follows the pairs, so every level of every count is held at every
size.  Segments stay in the shared folder; a chunk asks for each of its distinct pairs once, in the task
of the pair's segment, which answers with the level.  Questions go in ROUNDS turns, so that their shuffle holds
a part of them at a time.

With e(n) the least count of n's level, p(w | v) = (e(v, w) + mu * p(w)) / (S(v) + mu) and
p(w) = (e(w) + 1) / (E + V + 1), where S(v) is the sum of e(v, w) over all w and E that of e(w).  So the
probabilities that follow a context sum to one over the V tokens and one unknown token.  S(v) is
c(v) less what its pairs lose by their levels; a pair's hash begins with its context's, which tells
whose loss it is.  Workers are sent counts and S of the most frequent tokens; those of the others are asked for
with the pairs, and answered from the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import keep, scratch, sorted_runs, stored
from docspan.llm.words import mix, text_slices, word_hashes

SEGMENT_BITS = 1 << 21
#: Probes at least, and bits at least for each level of an n-gram.
PROBES = 6
BITS_PER_ITEM = 10
UPPER = np.uint64(0xFFFF_FFFF_0000_0000)
END = np.uint64(0xE2D0_0000_0000_0001)
BEGIN = np.uint64(0xB361_0000_0000_0001)
#: The most frequent tokens, whose exact counts workers are sent.
HEAD = 100_000
#: Bytes of text, about, that make a chunk, and that are cut at a time.
CHUNK_BYTES = 2 << 20
CUT_BYTES = 512 << 10
#: Training positions, about, whose pairs one task sums at a time.
PART = 1 << 20
#: Segments that one task answers for, and the bytes of text, about, whose pairs it is asked.
BLOCK = 16
ASKED_BYTES = 64 << 20
#: Turns in which blocks are asked.
ROUNDS = 2
#: The bits of a pair that the filter knows: what agrees in these is far rarer than pairs that it makes up.
ASKED = np.uint64(0xFFFF_FFFF_FFFF_FF00)


def in_training(id_col: str, parts: int = 7, held_out: int = 2) -> Column:
    """Whether the id's crc32, as text, leaves another remainder than held_out.  A null id's does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts != held_out, F.lit(True))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The upper half is v's."""
    return v & UPPER | mix(mix(v + np.uint64(0x9E3779B97F4A7C15)) ^ w) >> np.uint64(32)


def unmix(x: np.ndarray) -> np.ndarray:
    """The values of which `mix` made x."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(0x319642B2D24D8EC3)
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(0x96DE1B173F119089)
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def range_of(g: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of hashes each one is in.  Ranges grow with the hash, and n * k ranges are
    n ranges cut into k each."""
    return (g >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]), len(x))


def planes(x: np.ndarray) -> bytes:
    """Numbers of eight or fewer bytes: first all lowest bytes, then the next, since high bytes of small or sorted
    numbers compress."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(blob: bytes, width: int) -> np.ndarray:
    """The numbers, of width bytes, of which `planes` made blob."""
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(f"u{width}").ravel()


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (words and an end for each text), what precedes each, and tokens by text."""
    h, n = word_hashes(texts)
    ends = np.cumsum(n)
    return np.insert(h, ends, END), np.insert(h, ends - n, BEGIN), n + 1


def level(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)); 0 for 0."""
    return np.frexp(count.astype(np.float64))[1]


def estimate(levels: np.ndarray) -> np.ndarray:
    """Least count of a level; 0 for level 0."""
    return np.where(levels > 0, np.exp2(np.maximum(levels, 1) - 1.0), 0.0)


def least(count: Column) -> Column:
    """Least count of count's level."""
    return F.pow(F.lit(2.0), F.length(F.bin(count)) - 1).cast("long")


def probes_for(vocabulary: int, mu: float) -> int:
    """So many that made-up pairs, one for 2^probes probes, are less than mu / 100 of a context's."""
    return max(PROBES, math.ceil(math.log2(max(1.0, 100 * vocabulary / max(mu, 1.0)))))


@dataclass
class Filter:
    segments: int
    bits: np.ndarray | None  # bytes of all segments in turn, unless they are too large for that
    filled: DataFrame | None = None  # then (segment, bits), stored
    probes: int = PROBES

    @staticmethod
    def steps(g: np.ndarray, lev: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of a level begin, and how far they are apart."""
        at = mix(g + np.uint64(lev * 0xD1B54A32D192ED03 % (1 << 64)))
        return at.astype(np.uint32), (at >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    @staticmethod
    def place(at: np.ndarray, apart: np.ndarray, probe: int) -> np.ndarray:
        """Bit of one probe inside a segment."""
        return at + apart * np.uint32(probe) & np.uint32(SEGMENT_BITS - 1)

    def levels(self, h: np.ndarray) -> np.ndarray:
        g = mix(h) & ASKED
        return probe_levels(self.bits, range_of(g, self.segments), g, self.probes)


def probe_levels(bits: np.ndarray, segment: np.ndarray, g: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Level of each mixed hash (bits ASKED): how many levels in turn have all their bits.  segment: by its place in bits."""
    out = np.zeros(len(g), np.int64)
    base = segment.astype(np.int64) * (SEGMENT_BITS // 8)
    live, lev = np.arange(len(g)), 0
    while len(live):
        lev += 1
        at, apart = Filter.steps(g[live], lev)
        for probe in range(probes):
            bit = Filter.place(at, apart, probe)
            hit = bits[base[live] + (bit >> np.uint32(3))] >> (bit & np.uint32(7)).astype(np.uint8) & 1 == 1
            if not hit.all():
                live, at, apart = live[hit], at[hit], apart[hit]
            if not len(live):
                break
        out[live] = lev
    return out


def fill_segment(g: np.ndarray, levels: np.ndarray, probes: int) -> bytes:
    """Bits of one segment that holds these mixed hashes at their levels."""
    bits, g = np.zeros(SEGMENT_BITS, bool), g & ASKED
    for j in range(1, int(levels.max(initial=0)) + 1):
        g, levels = g[levels >= j], levels[levels >= j]
        at, apart = Filter.steps(g, j)
        for probe in range(probes):
            bits[Filter.place(at, apart, probe)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def dealt(g: np.ndarray, c: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Mixed hashes, in order, and their counts by part."""
    part = range_of(g, parts)
    cuts = runs(part)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[lo]), planes(g[lo:hi]), c[lo:hi].astype(np.min_scalar_type(int(c[lo:hi].max()))).tobytes()


def summed(counts: DataFrame, parts: int, min_count: int = 1) -> DataFrame:
    """counts: (part, g, c) as `dealt` cuts them.  Stored, for each part: its mixed hashes in order, the levels of their sums,
    how many levels these are, and by upper half of the hashes what sums lose by their levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["part"]):
            gs, cs = t.column("g").to_pylist(), t.column("c").to_pylist()
            g = np.concatenate([unplaned(x, 8) for x in gs])
            c = np.concatenate([np.frombuffer(y, f"u{len(y) * 8 // len(x)}").astype(np.int64) for x, y in zip(gs, cs, strict=True)])
            order = np.argsort(g)
            g, c = g[order], c[order]
            first = runs(g)[:-1]
            g, c = g[first], np.add.reduceat(c, first)
            lev = np.where(c >= min_count, level(c), 0)
            lost = c - estimate(lev).astype(np.int64)
            half, of = np.unique(unmix(g[lost > 0]) >> np.uint64(32), return_inverse=True)
            by_half = np.bincount(of, lost[lost > 0], minlength=len(half)).astype(np.int64)
            row = [[int(t.column("part")[0].as_py())], [planes(g[lev > 0])], [lev[lev > 0].astype(np.uint8).tobytes()], [int(lev.sum())], [half.astype(np.int64).tobytes()], [by_half.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

    names, kinds = ["part", "g", "levels", "items", "halves", "lost"], [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    own = counts.repartition(max(parts, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part").sortWithinPartitions("part")
    return stored(own.mapInArrow(run, "part int, g binary, levels binary, items long, halves binary, lost binary"), "pairs")


def fill_filter(pairs: DataFrame, parts: int, probes: int = PROBES) -> Filter:
    """pairs: as `summed` stored them.  Each part is a number of whole segments, which are stored."""
    items = pairs.agg(F.coalesce(F.sum("items"), F.lit(0))).first()[0]
    # half of the bits are set at 3 bits for 2 probes
    each = max(1, -(-items * max(BITS_PER_ITEM, probes * 3 // 2) // (SEGMENT_BITS * parts)))
    segments = parts * each

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for part, g, levels in zip(*(x.to_pylist() for x in t.columns), strict=True):
                g, levels = unplaned(g, 8), np.frombuffer(levels, np.uint8)
                own = range(part * each, (part + 1) * each)
                cuts = np.searchsorted(range_of(g, segments), [*own, own.stop])
                for s, lo, hi in zip(own, cuts[:-1], cuts[1:], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([fill_segment(g[lo:hi], levels[lo:hi], probes)], pa.binary())], ["segment", "bits"])

    filled = stored(pairs.select("part", "g", "levels").mapInArrow(fill, "segment int, bits binary"), "segments")
    return Filter(segments, None, filled, probes)


def build_filter(counts: DataFrame, max_bytes: int, probes: int = PROBES) -> Filter:
    """Filter of a table of n-grams' hashes and counts (h, c).  Its bits are with it if they have max_bytes at most."""
    parts = max(1, -(-counts.count() // PART))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            g, c = mix(t.column(0).to_numpy().view(np.uint64)), t.column(1).to_numpy()
            order = np.argsort(g)
            yield _counts_batch(list(dealt(g[order], c[order], parts)))

    held = fill_filter(summed(counts.select("h", "c").mapInArrow(pack, COUNTS), parts), parts, probes)
    if held.segments * SEGMENT_BITS // 8 > max_bytes:
        return held
    whole = np.zeros(held.segments * SEGMENT_BITS // 8, np.uint8)
    for row in held.filled.toLocalIterator():
        lo = row.segment * SEGMENT_BITS // 8
        whole[lo : lo + SEGMENT_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return Filter(held.segments, whole, None, probes)


COUNTS = "part int, g binary, c binary"


def _counts_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    part, g, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(g, pa.binary()), pa.array(c, pa.binary())], ["part", "g", "c"])


def _places(sent: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in sent, which is sorted; -1 if it isn't there."""
    if not len(sent):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sent, h), len(sent) - 1)
    return np.where(sent[at] == h, at, -1)


@dataclass
class Chunk:
    """Texts of a chunk: tokens of each, its distinct tokens in order, and the place among them of each position's."""

    size: np.ndarray
    tokens: np.ndarray
    at: np.ndarray

    @staticmethod
    def read(size: list[int], tokens: bytes, places: bytes) -> Chunk:
        size = np.array(size, np.int64)
        return Chunk(size, unplaned(tokens, 8), unplaned(places, len(places) // int(size.sum())))

    def pairs(self) -> np.ndarray:
        """Each position's pair, mixed."""
        w = self.tokens[self.at]
        before = np.append(BEGIN, w[:-1])
        before[np.cumsum(self.size) - self.size] = BEGIN
        return mix(pair_hash(before, w))


CHUNKS = "key long, doc_id array<long>, train array<boolean>, n array<long>, chars long, tokens binary, places binary"


def tokenised(src: DataFrame) -> DataFrame:
    """src: (doc_id, text, train).  Stored, its rows in chunks, which have keys of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        ids, train, sizes, tokens, chars = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            one, at = np.unique(np.concatenate(tokens), return_inverse=True)
            row = [[key], [ids], [train], [np.concatenate(sizes)], [chars], [planes(one)], [planes(at.astype(np.min_scalar_type(len(one))))]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

        for t in batches:
            for lo, hi, texts in text_slices(t.column(1), CUT_BYTES):
                w, _, n = sequences(texts)
                ids += t.column(0)[lo:hi].to_pylist()
                train += t.column(2)[lo:hi].to_pylist()
                sizes.append(n)
                tokens.append(w)
                chars += sum(map(len, texts))
                if chars >= CHUNK_BYTES:
                    yield chunk()
                    key += 1
                    ids, train, sizes, tokens, chars = [], [], [], [], 0
        if ids:
            yield chunk()

    names = ["key", "doc_id", "train", "n", "chars", "tokens", "places"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
    # stored, so that keys, which depend on the task, stay what they are
    return stored(src.mapInArrow(run, CHUNKS), "chunks")


def counted(chunks: DataFrame, parts: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """Of the training rows of chunks: pairs, as `summed` stores them, and tokens (h, c)."""

    def learned(t: pa.RecordBatch) -> Iterator[tuple[Chunk, np.ndarray]]:
        """A batch's chunks that have training positions, and where these are."""
        for size, tokens, places, train in zip(*(x.to_pylist() for x in t.columns), strict=True):
            chunk = Chunk.read(size, tokens, places)
            mine = np.repeat(np.array([bool(x) for x in train]), chunk.size)
            if mine.any():
                yield chunk, mine

    def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for chunk, mine in learned(t):
                c = np.bincount(chunk.at[mine], minlength=len(chunk.tokens))
                h, c = chunk.tokens[c > 0].view(np.int64), c[c > 0]
                for i in range(0, len(h), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000]), pa.array(c[i : i + 50_000])], ["h", "c"])

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for chunk, mine in learned(t):
                g = np.sort(chunk.pairs()[mine])
                cuts = runs(g)
                yield _counts_batch(list(dealt(g[cuts[:-1]], np.diff(cuts), parts)))

    read = chunks.select("n", "tokens", "places", "train")
    return summed(read.mapInArrow(pair_counts, COUNTS), parts, min_count), read.mapInArrow(token_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def losses(pairs: DataFrame) -> DataFrame:
    """(half, lost) of pairs, as `summed` stored them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for halves, lost in zip(*(x.to_pylist() for x in t.columns), strict=True):
                for i in range(0, len(halves), 8 * 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x[i : i + 8 * 50_000], np.int64)) for x in (halves, lost)], ["half", "lost"])

    return pairs.select("halves", "lost").mapInArrow(run, "half long, lost long").groupBy("half").agg(F.sum("lost").alias("lost"))


def score(docs: DataFrame, training: Column, mu: float = 32.0, min_count: int = 1, max_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training tells the rows to learn from.  A null text is empty: its end is its only token.
    Repeated rows count each time.  Without training rows, N and V are 0 and no token is known.  Very
    long texts are read whole, each as a chunk of its own.  An empty table gives an empty result; other
    columns are not read.  max_bytes: of the filter, that one task holds at a time (BLOCK segments at most).
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), training.alias("train"))
    begin = int(BEGIN.view(np.int64))
    with scratch(spark):  # tables go when no later step reads them
        chunks = tokenised(src)
        learn = F.expr("aggregate(zip_with(train, n, (t, k) -> if(t, k, 0L)), 0L, (a, b) -> a + b)")
        chars, n, begun = chunks.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("chars"), learn, F.size(F.filter("train", lambda t: t))))).first()
        parts = max(1, -(-n // PART))
        with scratch(spark):
            with scratch(spark):
                pairs, found = counted(chunks, parts, min_count)
                starts = spark.createDataFrame([(begin, begun)], "h long, c long").filter("c > 0")
                found = found.unionByName(starts).withColumn("half", F.shiftrightunsigned("h", 32))
                # levels lose less than half of a count, so what is more belongs to another token with the same half
                own = F.when(F.col("lost") * 2 < F.col("c") if min_count == 1 else F.col("lost") <= F.col("c"), F.col("lost")).otherwise(0)
                contexts = keep(stored(found.join(losses(pairs), "half", "left").select("h", "c", (F.col("c") - own).alias("s")), "tokens"))
                v, e = contexts.filter(F.col("h") != begin).agg(F.count("*"), F.coalesce(F.sum(least(F.col("c"))), F.lit(0))).first()
                held = fill_filter(pairs, parts, probes_for(v, mu))
                keep(held.filled)
            head = contexts.orderBy((F.col("h") != begin), F.desc("c"), "h").limit(HEAD + 1).toPandas()
            order = np.argsort(head["h"].to_numpy().view(np.uint64))
            known = tuple(head[x].to_numpy()[order] for x in ("h", "c", "s"))
            sent = spark.sparkContext.broadcast((known[0].view(np.uint64), *known[1:]))
            answers = [keep(x) for x in answered(chunks, contexts, held, sent, max(1, min(BLOCK, max_bytes * 8 // SEGMENT_BITS)), chars)]
        out = keep(joined(chunks, answers, sent, mu, float(n + v + 1), float(e + v + 1)))
    return out.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def answered(chunks: DataFrame, contexts: DataFrame, held: Filter, sent: Broadcast, size: int, chars: int) -> list[DataFrame]:
    """For each round, stored: (key, block, levels, counts) of a chunk's distinct pairs and of its tokens that were not sent, in
    order of their mixed hashes.  size: segments of a block."""
    segments, probes = held.segments, held.probes
    blocks = -(-segments // size)
    rounds, deals = min(ROUNDS, blocks), max(1, -(-chars // (blocks * ASKED_BYTES)))
    names = ["key", "block", "deal", "segment", "blob", "tokens"]
    block_of = lambda g: (range_of(g, segments) // np.uint64(size)).astype(np.int32)

    def questions(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head_h, _, _ = sent.value
            for t in batches:
                for key, n, tokens, places in zip(*(x.to_pylist() for x in t.columns), strict=True):
                    chunk = Chunk.read(n, tokens, places)
                    g = np.sort(chunk.pairs())
                    g = g[runs(g)[:-1]]
                    h = np.sort(mix(chunk.tokens[_places(head_h, chunk.tokens) < 0]))
                    of, one = block_of(g), block_of(h)
                    asked = np.union1d(of, one)
                    asked = asked[asked % rounds == turn]
                    two, rare = (np.searchsorted(x, [asked, asked + 1]).T.tolist() for x in (of, one))
                    k, deal = len(asked), (key // (1 << 40) * 31 + key % (1 << 40)) % deals
                    # without the lowest plane, see ASKED
                    columns = [np.full(k, key), asked, np.full(k, deal), pa.nulls(k, pa.int32()), [planes(g[lo:hi])[hi - lo :] for lo, hi in two], [planes(h[lo:hi]) for lo, hi in rare]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) if len(x) else pa.array([], kind) for x, kind in zip(columns, kinds, strict=True)], names)

        return run

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens' mixed hashes, counts and sums by block."""
        for t in batches:
            h, c, s = (x.to_numpy() for x in t.columns)
            g = mix(h.view(np.uint64))
            order = np.argsort(g)
            rows = np.stack([g[order].view(np.int64), c[order], s[order]])
            block = block_of(g[order])
            cuts = runs(block)
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array([rows[:, lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["block", "tokens"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of block, its tokens (key -2) and its bits (-1) first."""
        now, last, bits, parts, own = None, 0, None, [], None
        for t in batches:
            out = []
            for key, block, segment, blob, tokens in zip(*(t.column(x).to_pylist() for x in ("key", "block", "segment", "blob", "tokens")), strict=True):
                if block != now or key < 0 <= last:
                    now, bits, parts, own = block, np.zeros(size * SEGMENT_BITS // 8, np.uint8), [np.zeros((3, 0), np.int64)], None
                last = key
                if key == -2:
                    parts.append(np.frombuffer(tokens, np.int64).reshape(3, -1))
                elif key == -1:
                    lo = segment % size * SEGMENT_BITS // 8
                    bits[lo : lo + SEGMENT_BITS // 8] = np.frombuffer(blob, np.uint8)
                else:
                    if own is None:
                        own = np.concatenate(parts, axis=1)
                        own = own[:, np.argsort(own[0].view(np.uint64))]
                    h = unplaned(tokens, 8)
                    at = _places(own[0].view(np.uint64), h)
                    counts = np.where(at >= 0, own[1:, at], 0) if own.shape[1] else np.zeros((2, len(h)), np.int64)
                    g = unplaned(bytes(len(blob) // 7) + blob, 8)
                    levels = probe_levels(bits, range_of(g, segments) % np.uint64(size), g, probes).astype(np.uint8)
                    out.append((key, block, levels.tobytes(), planes(counts.ravel())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["key", "block", "levels", "counts"])

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    bits = held.filled.select(F.lit(-1).cast("long").alias("key"), F.floor(F.col("segment") / size).cast("int").alias("block"), "segment", F.col("bits").alias("blob"))
    words = contexts.select("h", "c", "s").mapInArrow(table, "block int, tokens binary").withColumn("key", F.lit(-2).cast("long"))
    fixed = bits.unionByName(words, allowMissingColumns=True).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    out = []
    for turn in range(rounds):
        asked = chunks.select("key", "n", "tokens", "places").mapInArrow(questions(turn), "key long, block int, deal long, segment int, blob binary, tokens binary")
        rows = asked.unionByName(fixed.filter(F.col("block") % rounds == turn))
        # blocks are dealt by a hash, so more tasks than blocks keep most of them apart
        rows = rows.repartition(max(4 * -(-blocks // rounds) * deals, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block", "deal")
        out.append(stored(rows.sortWithinPartitions("block", "deal", "key").mapInArrow(answer, "key long, block int, levels binary, counts binary"), "answers"))
    return out


def joined(chunks: DataFrame, answers: list[DataFrame], sent: Broadcast, mu: float, whole: float, flat: float) -> DataFrame:
    """Stored, scores of the texts of chunks from what was answered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_h, head_c, head_s = sent.value
        for t in sorted_runs(batches, ["key"]):
            # the chunk, then its answers by block
            row, rest = t.slice(0, 1).to_pylist()[0], t.slice(1)
            chunk = Chunk.read(row["n"], row["tokens"], row["places"])
            levels = np.frombuffer(b"".join(rest.column("levels").to_pylist()), np.uint8)
            counts = np.concatenate([np.zeros((2, 0), np.int64), *(unplaned(x, 8).view(np.int64).reshape(2, -1) for x in rest.column("counts").to_pylist())], axis=1)
            # exact counts and sums of the chunk's distinct tokens, begin last
            h = np.append(chunk.tokens, BEGIN)
            place = _places(head_h, h)
            c, s = (np.where(place >= 0, x[place], 0) if len(x) else np.zeros(len(h), np.int64) for x in (head_c, head_s))
            rare = np.flatnonzero(place[:-1] < 0)
            rare = rare[np.argsort(mix(h[rare]))]
            c[rare], s[rare] = counts
            g = chunk.pairs()
            order = np.argsort(g)
            both = np.empty(len(g))
            both[order] = np.repeat(estimate(levels), np.diff(runs(g[order])))
            cw = estimate(level(c))[chunk.at]
            sv = np.append(s[-1], s[chunk.at[:-1]]).astype(np.float64)
            sv[np.cumsum(chunk.size) - chunk.size] = s[-1]
            likely = np.log10((np.minimum(both, np.minimum(cw, sv)) + mu * (cw + 1.0) / flat) / (sv + mu))
            text = np.repeat(np.arange(len(chunk.size)), chunk.size)
            known, base, score = (np.bincount(text, x, minlength=len(chunk.size)) for x in ((c > 0)[chunk.at], np.log10((c + 1.0) / whole)[chunk.at], likely))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_id"], pa.int64()), pa.array(row["train"], pa.bool_()), pa.array(chunk.size), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
                ["doc_id", "train", "n", "known", "base", "score"],
            )

    rows = chunks.drop("chars").withColumn("block", F.lit(-1))
    for some in answers:
        rows = rows.unionByName(some, allowMissingColumns=True)
    rows = rows.repartition("key").sortWithinPartitions("key", "block")
    return stored(rows.mapInArrow(run, "doc_id long, train boolean, n long, known long, base double, score double"), "scored")
