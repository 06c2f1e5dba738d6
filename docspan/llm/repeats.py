"""Removal of long byte strings that an earlier document holds too, by Burrows-Wheeler transforms.

Texts are UTF-8 bytes.  A window is a string of LENGTH bytes; a byte goes if a window over it also starts in a
document with a smaller doc_id.  To find equal windows without comparing all text with all text, each window is
sent where its least gram goes: among the grams of GRAM bytes inside a window the one of least hash is the same
wherever the window stands, and neighbouring windows mostly share it, so a run of them is sent as one string.

1. Equal texts are folded: one of least doc_id stands for all.
2. Least grams of all texts are counted by hash; those that only one text has need no comparison.
3. Runs of windows over shared grams are cut out of the texts, and equal runs folded with their least doc_id.
4. Runs of the same gram meet in a bucket of bounded size; a gram's only run has nothing to meet.  The others' suffixes are sorted and transformed; intervals of
   suffixes with a common prefix are expanded backward breadth-first, one character a round, so that common
   prefixes come out by increasing length, and it stops at LENGTH.  What is then still one interval are equal
   windows, and the least doc_id of each is known.
5. Every run of a text takes its windows' least doc_ids from there; a window goes if that is smaller than its own.

A gram that stands in very many surroundings (a hot one) would make a bucket too large, so its windows are sent
as runs of a single window each, by the window's own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import keep, scratch, sorted_runs, stored
from docspan.llm.words import mix

#: Bytes of a string that may not recur, and of the grams by which they find each other.
LENGTH, GRAM = 50, 24
#: Most windows of a run; a longer one is cut.
LONGEST = 256
#: Surroundings (of 65,536 told apart) beyond which a gram is hot.
HOT = 2048
#: Least grams and bytes of runs that a bucket should hold.
GRAMS, BYTES = 5 << 19, 1 << 20
#: Bytes of text that are hashed at a time.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(257, 513, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_MASK = (1 << 64) - 1
#: The part of a gram's hash that names it, and the rest, for its surroundings.
_NAME = np.uint64(_MASK ^ 0xFFFF)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes, by where they start: polynomials of doubled lengths, put together."""
    out, done = None, 0
    part, size = _BYTE[data], 1
    while True:
        if k & size:
            if out is None:
                out = part
            else:
                n = max(len(data) - done - size + 1, 0)
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + n]
            done += size
        if done == k:
            return mix(out[: max(len(data) - k + 1, 0)])
        n = max(len(data) - 2 * size + 1, 0)
        part = part[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size : size + n]
        size *= 2


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` numbers in a row."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Windows:
    """All windows of some texts (parts of long ones) put together: name of the least gram, place in `raw`, number
    of the text and place in it."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        self.raw = b"".join(p[2] for p in parts)
        self.data = np.frombuffer(self.raw, np.uint8)
        size = np.array([len(p[2]) for p in parts], np.int64)
        base, count = np.cumsum(size) - size, size - LENGTH + 1
        self.place = np.arange(count.sum()) + np.repeat(base - (np.cumsum(count) - count), count)
        self.text = np.repeat(np.array([p[0] for p in parts], np.int64), count)
        self.at = self.place + np.repeat(np.array([p[1] for p in parts], np.int64) - base, count)
        self.names = (least_of(gram_hashes(self.data, GRAM), LENGTH - GRAM + 1) & _NAME)[self.place]
        #: where windows don't follow on each other
        self.breaks = np.r_[True, self.place[1:] != self.place[:-1] + 1]

    def own_hashes(self) -> np.ndarray:
        return gram_hashes(self.data, LENGTH)[self.place]

    def runs(self, names: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (first, last) of each run over one name, LONGEST windows at most."""
        new = np.r_[True, names[1:] != names[:-1]] | breaks
        start = np.flatnonzero(new)
        since = np.arange(len(names)) - np.repeat(start, np.diff(np.r_[start, len(names)]))
        start = np.flatnonzero(new | (since % LONGEST == 0))
        return start, np.r_[start[1:], len(names)] - 1

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each run."""
        up, down = _powers(len(self.data))
        total = np.r_[np.uint64(0), np.cumsum(_BYTE[self.data] * up, dtype=np.uint64)]
        lo, hi = self.place[first], self.place[last] + LENGTH
        return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


@lru_cache(1)
def _all_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        each = np.full(n, base, np.uint64)
        each[0] = 1
        out.append(np.cumprod(each, dtype=np.uint64))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _all_powers(max(2 * PIECE, 1 << n.bit_length()))
    return up[:n], down[:n]


def windows(texts: Iterable[bytes]) -> Iterator[Windows]:
    """Windows of texts, about PIECE bytes at a time; parts of a long text overlap, so that each of its windows is
    in one of them."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, raw in enumerate(texts):
        for at in range(0, len(raw) - LENGTH + 1, PIECE):
            part = raw[at : at + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE:
                yield Windows(held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield Windows(held)


# ---------------------------------------------------------------- suffixes of a bucket


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Order of the suffixes of data: characters over 0, and separators 0, of which the last character is one and an
    earlier one counts as less.  As many characters as fit a number beside the suffix's position are sorted at once,
    then their number is doubled: only what isn't in order yet is sorted again."""
    n = len(data)
    places = max(n - 1, 1).bit_length()
    seen = np.flatnonzero(np.bincount(data, minlength=1)[1:]) + 1
    small = np.zeros(int(data.max(initial=0)) + 1, np.uint64)
    small[seen] = np.arange(1, len(seen) + 1)
    bits = len(seen).bit_length()
    size = max((64 - places) // max(bits, 1), 1)
    key, text, alive = np.zeros(n, np.uint64), small[data], np.ones(n, bool)
    for k in range(size):
        key <<= np.uint64(bits)
        if k < n:
            alive[n - k :] = False
            alive[: n - k] &= text[k:] > 0
            key[: n - k] |= np.where(alive[: n - k], text[k:], 0)
    key = np.sort((key << np.uint64(places)) | np.arange(n, dtype=np.uint64))
    order = (key & np.uint64((1 << places) - 1)).astype(np.int32)
    key >>= np.uint64(places)
    # a suffix's rank is the place of the first one that equals it so far; those that ended differ by their separators
    new = np.r_[True, key[1:] != key[:-1]][:n] | ~alive[order]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places whose suffix isn't alone
    while len(open_):
        own = order[open_]
        group = np.cumsum(new[open_])
        ahead = rank[own + size]  # equal ones go on for as long
        room = (len(open_) - 1).bit_length()
        if int(group[-1]).bit_length() + places + room <= 63:
            key = np.sort((group << (places + room)) | (ahead.astype(np.int64) << room) | np.arange(len(open_)))
            own, key = own[key & ((1 << room) - 1)], key >> room
        else:
            key = (group << 32) | ahead
            by = np.argsort(key)
            own, key = own[by], key[by]
        order[open_] = own
        new[open_] = np.r_[True, key[1:] != key[:-1]]
        rank[own] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        begins = new[open_]
        open_ = open_[~(begins & np.r_[begins[1:], True])]
        size *= 2
    return order


def bounded_prefixes(data: np.ndarray, order: np.ndarray, stop: int, lcp: np.ndarray | None = None) -> np.ndarray:
    """For each place in order the number of the interval of suffixes that have their first `stop` characters in
    common, -1 for suffixes that have them alone or are shorter.  lcp, if given, takes for each place how many
    characters its suffix has in common with the one before it, separators apart, at most `stop`.

    Round by round the intervals of suffixes with a common prefix w of l characters are extended backward, by each
    character c that stands before them in the transform: the suffixes that begin with c and go on with those of
    one interval are the interval of cw.  Places at which intervals part in round l have l characters in common."""
    n = len(data)
    if lcp is not None:
        lcp[:], lcp[:1] = stop, 0
    transform = data[order - 1]  # the character before each suffix
    # where c stands before the suffix at place i, the suffix longer by c comes at the place that i has when
    # all places are sorted by c: so this order says which place each longer suffix extends
    extends = np.argsort(transform, kind="stable").astype(np.int32)
    first = data[order]
    places = np.arange(n, dtype=np.int32)
    interval = np.zeros(n, np.int32)  # by place, in the last round; at first all have the empty prefix in common
    for length in range(stop):
        # of the suffixes that had `length` characters in common with others, those still with others by one more
        shorter = interval[extends]
        whole = (shorter >= 0) & (first > 0)
        alone = (shorter[1:] != shorter[:-1]) | (first[1:] != first[:-1]) | ~whole[1:]
        if lcp is not None:
            own = interval[places]
            lcp[places[1:][alone & (own[1:] == own[:-1])]] = length
        new = np.r_[True, alone][: len(places)]
        many = ~(new & np.r_[alone, True][: len(places)])
        number = np.cumsum(new, dtype=np.int32)
        interval[places] = np.where(many, number, -1)
        places, extends, first = places[many], extends[many], first[many]
        if not len(places):
            break
    group = np.full(n, -1, np.int32)
    group[places] = interval[places]
    return group


def least_owners(strings: list[bytes], owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """strings: distinct ones.  For each byte of each, in order and with a separator behind each string, the number of
    the string, whether a window starts there, and the least owner of a string that holds this window."""
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int16) + np.int16(1)
    data[ends - 1] = 0
    order = suffix_order(data)
    group = bounded_prefixes(data, order, length)
    string = np.repeat(np.arange(len(strings)), sizes + 1)
    starts = np.arange(len(data)) <= np.repeat(ends - 1 - length, sizes + 1)
    least = owners[string]
    places = np.flatnonzero(group >= 0)
    if len(places):
        start = np.flatnonzero(np.r_[True, group[places][1:] != group[places][:-1]])
        lowest = np.minimum.reduceat(least[order[places]], start)
        least[order[places]] = np.repeat(lowest, np.diff(np.r_[start, len(places)]))
    return string, starts, least


# ---------------------------------------------------------------- what Spark's tasks do


def _texts(column: pa.Array) -> Iterator[bytes]:
    """A column's values one after another."""
    return (v.as_buffer().to_pybytes() for v in column)


def _grams(buckets: int):
    """Least grams of texts, packed: a row for some texts and a bucket, with the texts' keys, how many grams each has,
    and for each gram its name and 16 bits of a hash of its run's surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for w in windows(_texts(batch.column("text"))):
                first, last = w.runs(w.names, w.breaks)
                own = w.own_hashes()
                around = mix(own[first] ^ (own[last] * np.uint64(3)))
                words, which = w.names[first] | (around & np.uint64(0xFFFF)), w.text[first]
                bucket = (mix(words >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((words, which, bucket))
                which, words, bucket = which[by], words[by], bucket[by]
                new = np.r_[True, (words[1:] != words[:-1]) | (which[1:] != which[:-1])]
                which, words, bucket = which[new], words[new], bucket[new]
                cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
                out: list[list] = [[], [], [], []]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    texts, counts = np.unique(which[lo:hi], return_counts=True)
                    for column, value in zip(out, (bucket[lo], keys[texts].tobytes(), counts.astype(np.uint32).tobytes(), words[lo:hi].tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "keys", "counts", "grams"])

    return run


def _shared(hot: int):
    """Of the grams of a bucket those that several texts have, by text; in the lowest bit, whether it is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_runs(batches, ["bucket"]):
            keys = np.frombuffer(b"".join(group["keys"].to_pylist()), np.int64)
            counts = np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint32)
            words = np.frombuffer(b"".join(group["grams"].to_pylist()), np.uint64)
            texts = np.repeat(keys, counts)
            by = np.argsort(words, kind="stable")
            words, texts = words[by], texts[by]
            name = words & _NAME
            start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            size = np.diff(np.r_[start, len(name)])
            several = np.minimum.reduceat(texts, start) != np.maximum.reduceat(texts, start)
            around = np.add.reduceat(np.r_[True, words[1:] != words[:-1]].astype(np.int64), start)
            mark = name | np.repeat(around > hot, size).astype(np.uint64)
            on = np.repeat(several, size)
            mark, texts = mark[on], texts[on]
            by = np.argsort(texts, kind="stable")
            mark, texts = mark[by], texts[by]
            cuts = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]]) if len(texts) else np.zeros(0, int)
            for at in range(0, len(cuts), 10_000):
                some = cuts[at : at + 10_000]
                stop = [*some[1:], cuts[at + 10_000] if at + 10_000 < len(cuts) else len(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(texts[some]), pa.array([mark[lo:hi].tobytes() for lo, hi in zip(some, stop, strict=True)], pa.binary())], names=["key", "grams"])

    return run


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is one of a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of texts whose windows have shared grams, with the hot ones of these.  Whether a gram is shared or hot
    is known of the gram, whichever text's list it is read from."""
    for batch in batches:
        marks = np.unique(np.frombuffer(b"".join(x for packed in batch.column("grams").to_pylist() for x in packed), np.uint64))
        hot = marks[marks & np.uint64(1) == 1] & _NAME
        marks = np.unique(marks & _NAME)
        keys, ids = batch.column("key"), batch.column("doc_id")
        for w in windows(_texts(batch.column("text"))):
            on = np.flatnonzero(_among(w.names, marks))
            new = np.r_[True, (on[1:] != on[:-1] + 1) | w.breaks[on[1:]]][: len(on)]
            first, last = on[new], on[np.r_[new[1:], True][: len(on)]]
            lo, hi = w.place[first].tolist(), (w.place[last] + LENGTH).tolist()
            found = [b""] * len(first)
            if len(hot):
                found = [hot[_among(hot, np.unique(w.names[a : b + 1]))].tobytes() for a, b in zip(first, last, strict=True)]
            texts = pa.array(w.text[first])
            yield pa.RecordBatch.from_arrays(
                [keys.take(texts), ids.take(texts), pa.array(w.at[first]), pa.array([w.raw[a:b] for a, b in zip(lo, hi, strict=True)], pa.binary()), pa.array(found, pa.binary())],
                names=["key", "doc_id", "start", "bytes", "hot"],
            )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[Windows, np.ndarray, np.ndarray, np.ndarray]]:
    """Fragments' windows, and of their runs the gram (of a single window over a hot gram, its own hash), the first
    and the last window."""
    hot = np.unique(np.frombuffer(b"".join(batch.column("hot").to_pylist()), np.uint64))
    for w in windows(_texts(batch.column("bytes"))):
        names, breaks = w.names, w.breaks
        if len(hot):
            single = _among(names, hot)
            names = np.where(single, w.own_hashes(), names)
            breaks = breaks | single | np.r_[False, single[:-1]]
        first, last = w.runs(names, breaks)
        yield w, names[first], first, last


def _distinct_runs(buckets: int):
    """Runs of fragments; equal ones that are read together are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for w, gram, first, last in _runs(batch):
                hashed, owner = w.hashes(first, last), ids[w.text[first]]
                by = np.lexsort((gram, hashed))
                start = np.flatnonzero(np.r_[True, (hashed[by][1:] != hashed[by][:-1]) | (gram[by][1:] != gram[by][:-1])])
                least, most = np.minimum.reduceat(owner[by], start), np.maximum.reduceat(owner[by], start)
                one = by[start]
                strings = [w.raw[a:b] for a, b in zip(w.place[first[one]].tolist(), (w.place[last[one]] + LENGTH).tolist(), strict=True)]
                bucket = (mix(gram[one] + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
                made = [pa.array(bucket), pa.array(gram[one].view(np.int64)), pa.array(hashed[one].view(np.int64)), pa.array(strings, pa.binary()), pa.array(least), pa.array(most)]
                yield pa.RecordBatch.from_arrays(made, names=["bucket", "gram", "run", "bytes", "least", "most"])

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of a bucket its least doc_id, and the windows of it that a still smaller one has, as pairs of
    (from, to); runs of one document only, without such windows, have no row."""
    for group in sorted_runs(batches, ["bucket"]):
        strings, least, most = group["bytes"].to_pylist(), group["least"].to_numpy(), group["most"].to_numpy()
        # equal windows are in runs of one gram, so a gram's only run shares none with others
        _, which, runs = np.unique(group["gram"].to_numpy(), return_inverse=True, return_counts=True)
        met = np.flatnonzero(runs[which] > 1)
        of, spans = np.zeros(0, np.int64), np.zeros((0, 2), np.int32)
        if len(met):
            string, starts, owner = least_owners([strings[i] for i in met.tolist()], least[met])
            edge = np.diff((starts & (owner < least[met][string])).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            begin = np.searchsorted(string, string[lo])
            of, spans = met[string[lo]], np.stack([lo - begin, hi - begin], axis=1).astype(np.int32)
        cuts = np.searchsorted(of, np.arange(len(strings) + 1))
        some = np.flatnonzero((most > least) | (cuts[1:] > cuts[:-1]))
        rows = group.select(["gram", "run", "least"]).take(pa.array(some)).combine_chunks()
        size = pa.array([len(strings[i]) for i in some.tolist()], pa.int64())
        packed = pa.array([spans[cuts[i] : cuts[i + 1]].tobytes() for i in some.tolist()], pa.binary())
        for part in rows.append_column("size", size).append_column("spans", packed).to_batches():
            yield part


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, gram, first, last in _runs(batch):
            texts = pa.array(w.text[first])
            at = pc.add(batch.column("start").take(texts), pa.array(w.at[first]))
            made = [pa.array(gram.view(np.int64)), pa.array(w.hashes(first, last).view(np.int64)), batch.column("key").take(texts), batch.column("doc_id").take(texts), at]
            yield pa.RecordBatch.from_arrays(made, names=["gram", "run", "key", "doc_id", "at"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a text loses: given are places, sizes and spans of runs; null if nothing."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            raw = text.as_buffer().to_pybytes()
            spans = found.as_py() or []
            lo = np.concatenate([np.frombuffer(s["spans"], np.int32)[0::2].astype(np.int64) + s["at"] for s in spans] or [np.zeros(0, np.int64)])
            hi = np.concatenate([np.frombuffer(s["spans"], np.int32)[1::2].astype(np.int64) + s["at"] for s in spans] or [np.zeros(0, np.int64)]) + LENGTH - 1
            by = np.argsort(lo, kind="stable")
            lo, hi = lo[by], np.maximum.accumulate(hi[by]) if len(hi) else hi
            new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]]) if len(lo) else np.zeros(0, np.int64)
            start, stop = lo[new], hi[np.r_[new[1:], len(lo)] - 1] if len(lo) else hi
            kept, at = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            for column, value in zip(out, (int((stop - start).sum()), len(new), np.stack([start, stop], axis=1).ravel().tolist(), kept.hexdigest()), strict=True):
                column.append(value)
        made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], names=["doc_id", "text_hash", "n_removed", "n_spans", "spans", "kept_sha256"])


def removals(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256): a row for each of docs (doc_id, text); spans are
    the removed runs of bytes, as from, to, from, to and so on.

    A null text is empty.  A null doc_id is larger than all; rows of one doc_id, repeated rows too, are no smaller
    than each other.  Texts of fewer than 50 bytes lose nothing.  Very long texts are hashed in pieces of 1 MB that
    overlap; memory grows with the longest text alone.  Columns of docs other than doc_id and text aren't read,
    whatever their names; an empty table gives an empty one.  hot: surroundings beyond which a gram's windows are
    looked at one by one (results are the same).
    """
    spark = docs.sparkSession
    last = (1 << 63) - 1
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    wide = rows.select(F.col("doc_id").alias("given"), F.coalesce("doc_id", F.lit(last)).alias("doc_id"), "text", F.unhex(F.md5("text")).alias("text_hash"))
    with scratch(spark):
        # equal texts: the one of least doc_id stands for them
        texts = wide.filter(F.octet_length("text") >= LENGTH).groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
        texts = stored(texts.withColumn("key", F.xxhash64("text_hash")), "texts")
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(parts, -(-total // (12 * GRAMS)))
        grams = texts.select("key", "text").mapInArrow(_grams(buckets), "bucket int, keys binary, counts binary, grams binary")
        in_buckets = grams.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        shared = stored(in_buckets.mapInArrow(_shared(hot), "key long, grams binary"), "grams")
        listed = shared.groupBy("key").agg(F.collect_list("grams").alias("grams"))
        fragments = stored(texts.select("key", "doc_id", "text").join(listed, "key").mapInArrow(_fragments, "key long, doc_id long, start long, bytes binary, hot binary"), "fragments")

        # a run has 14 windows or so, hence 63 bytes for 14
        total = fragments.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        buckets = max(parts, -(-5 * total // BYTES))
        distinct = fragments.select("doc_id", "bytes", "hot").mapInArrow(_distinct_runs(buckets), "bucket int, gram long, run long, bytes binary, least long, most long")
        distinct = distinct.repartition(min(buckets, 8 * parts), "bucket").groupBy("bucket", "gram", "run", "bytes").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        owners = stored(distinct.sortWithinPartitions("bucket").mapInArrow(_owners, "gram long, run long, least long, size long, spans binary"), "owners")
        met = fragments.mapInArrow(_occurrences, "gram long, run long, key long, doc_id long, at long").join(owners, ["gram", "run"])
        all_windows = F.concat(F.lit(b"\0\0\0\0"), _int32(F.col("size") - LENGTH + 1))
        spans = F.when(F.col("doc_id") > F.col("least"), all_windows).otherwise(F.col("spans"))
        found = met.select("key", "at", spans.alias("spans")).filter("octet_length(spans) > 0").groupBy("key").agg(F.collect_list(F.struct("at", "spans")).alias("found"))
        lost = texts.join(found, "key").select("doc_id", "text_hash", "text", "found").mapInArrow(_removed, "doc_id long, text_hash binary, n_removed long, n_spans long, spans array<long>, kept_sha256 string")
        lost = stored(lost, "lost")

        # every row: what its text's first document lost, or all of it if that is another one
        size = F.octet_length("text").cast("long").alias("n_bytes")
        plain = F.sha2("text", 256).alias("whole_sha256")
        every = wide.select("given", "doc_id", "text_hash", size, plain)
        stands = texts.select("text_hash", F.col("doc_id").alias("stands")).join(lost.drop("doc_id"), "text_hash", "left")
        every = every.join(stands, "text_hash", "left")
        again = F.coalesce(F.col("doc_id") > F.col("stands"), F.lit(False))
        none = F.lit(0).cast("long")
        done = every.select(
            F.col("given").alias("doc_id"), "n_bytes", F.when(again, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
            F.when(again, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
            F.when(again, F.array(none, F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
            F.when(again, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        )
        return keep(stored(done, "removals"))


def _int32(number):
    """A small whole number as four bytes, the least first."""
    big = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return F.concat(*(F.substring(big, k, 1) for k in (4, 3, 2, 1)))
