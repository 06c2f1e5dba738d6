"""Vectorised word and shingle hashing shared by the corpus operators.

A word is a maximal run of bytes other than space and 0x09-0x0D of the UTF-8 text; A-Z count
as a-z.  Both rules act on single ASCII bytes, so they can be applied to the encoded text as a
whole and numpy does the work for many documents at once.  A word is known by a 64-bit hash of
its bytes (a keyed polynomial followed by a bijective mix).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20
#: Texts that are unpacked at a time.
SLICE = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(4096)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many words each text has (null: none)."""
    global _POW
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    buf = _LOWER[np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)]
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    gap = _GAP[buf]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    length = stop - start
    if length.max() > len(_POW):
        _POW = _powers(int(length.max()))
    body = buf[~gap]
    first = np.cumsum(length) - length
    at = np.arange(len(body)) - np.repeat(first, length)
    h = np.add.reduceat(_BYTE[body] * _POW[at], first)
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return mix(h ^ (length.astype(np.uint64) << np.uint64(48))), counts


def in_chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters each; a longer text makes a range of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of a column with their texts; only a bounded amount of text, or one text that is longer, is
    unpacked at a time, and memory that was freed goes back at the end."""
    for at in range(0, len(column), SLICE):
        texts = column.slice(at, SLICE).to_pylist()
        for lo, hi in in_chunks(texts, limit):
            yield at + lo, at + hi, texts[lo:hi]
    pa.default_memory_pool().release_unused()


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; a text with fewer words has
    its whole sequence as the only one, and a text without words has none."""
    for lo, hi in in_chunks(texts):
        h, counts = word_hashes(texts[lo:hi])
        gram = _rolled(h, words)
        stop = np.cumsum(counts)
        for end, n in zip(stop.tolist(), counts.tolist(), strict=True):
            if n >= words:
                yield np.unique(gram[end - n : end - words + 1])
            elif n:
                yield mix(_rolled(h[end - n : end], n)[:1] + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, words: int) -> np.ndarray:
    """Order-dependent hash of each run of `words` hashes, by the run's start."""
    n = max(len(h) - words + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out
