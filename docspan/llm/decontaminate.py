"""Benchmark passages in documents, by pigeonhole edit matching.

A test item may differ from the passage by `rate` of its length in edits.  It is split into one
piece more than that, so a passage within the budget holds one piece unchanged.  One automaton finds
all pieces of all items in one reading of a text; around each hit Myers' bit-parallel algorithm
gives the least edit distance between the item and any passage there.

Texts and items are compared in lower case with each run of white space as one space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.words import text_slices

#: Characters of items that are searched in one reading of the documents; more items take more readings.
BLOCK_CHARS = 8_000_000
#: An edit spoils this many of a pattern's character n-grams at most, so a text that lacks more than
#: that for each edit of the budget is not near and needs no distance.
GRAM = 4


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern, m characters, to any passage of text, and the first
    passage's end.  masks: the pattern's positions of each character, as bits."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, ch in enumerate(text):
        eq = masks.get(ch, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = full & (down | ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def grams(text: str) -> list[str]:
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


class Finder:
    """Finds items (number, text) in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(n, p, math.floor(len(p) * rate)) for n, t in items if (p := normal(t))]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, p, budget) in enumerate(self.items):
            cuts = [len(p) * i // (budget + 1) for i in range(budget + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(p[lo:hi], []).append((k, lo))
        self.pieces = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.pieces.add_word(piece, (len(piece), at))
        if pieces:
            self.pieces.make_automaton()
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}
        self.grams: dict[int, list[str]] = {}

    def _may_hold(self, k: int, window: str) -> bool:
        _, p, budget = self.items[k]
        own = self.grams.get(k)
        if own is None:
            own = self.grams[k] = grams(p)
        spare = GRAM * budget
        for g in own:
            if g not in window:
                spare -= 1
                if spare < 0:
                    return False
        return True

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the nearest passage for each item within its budget, in
        characters of the normal form."""
        said = normal(text)
        if not said or not self.items:
            return []
        near: dict[int, list[tuple[int, int]]] = {}
        for last, (size, at) in self.pieces.iter(said):
            for k, offset in at:
                _, p, budget = self.items[k]
                lo = max(0, last + 1 - size - offset - budget)
                hi = min(len(said), last + 1 - size - offset + len(p) + budget)
                spans = near.setdefault(k, [])
                if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 2 * (len(p) + 2 * budget):
                    spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
                elif not spans or spans[-1] != (lo, hi):
                    spans.append((lo, hi))
        out = []
        for k, spans in near.items():
            number, p, budget = self.items[k]
            best = None
            for lo, hi in spans:
                exact = said.find(p, lo, hi)
                if exact >= 0:
                    best = (0, exact, exact + len(p))
                    break
                if not self._may_hold(k, said[lo:hi]):
                    continue
                if k not in self.masks:
                    self.masks[k] = masks_of(p), masks_of(p[::-1])
                forward, backward = self.masks[k]
                distance, end = nearest(forward, len(p), said[lo:hi])
                if distance <= budget and (best is None or distance < best[0]):
                    end += lo
                    _, back = nearest(backward, len(p), said[lo:end][::-1])
                    best = (distance, end - back, end)
            if best:
                out.append((number, *best))
        return sorted(out)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_chars; equal texts once, under their smallest number."""
    items = benchmark.filter(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.min(F.col(item_col).cast("long")).alias("item"))
    total = items.agg(F.sum(F.char_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for i in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i)
        yield sorted((r["item"], r["text"]) for r in part.select("item", "text").collect())


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): for each row of docs and each item that it holds,
    the nearest passage, the first of equals, in characters of the normal form.

    Null and blank texts and items match nothing, as do items without a number.  Items of equal text
    count as the one with the smallest number.  Very long texts are read whole.  A repeated row gives its
    hits again.  Empty tables, of documents or of items, give an empty result.  Other columns of docs,
    whatever their names, are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col, block_chars):
        found = src.mapInArrow(_finding(docs, items, rate), "doc_id long, item_id long, distance int, start int, end int")
        out = found if out is None else out.unionByName(found)
    return out


#: A worker's automaton, kept from task to task: building it takes longer than reading a small part.
_FINDER: dict[tuple, Finder] = {}


def _finder(name: int, items: list[tuple[int, str]], rate: float) -> Finder:
    if (name, rate) not in _FINDER:
        _FINDER.clear()
        _FINDER[name, rate] = Finder(items, rate)
    return _FINDER[name, rate]


def _finding(docs: DataFrame, items: list[tuple[int, str]], rate: float):
    sent = docs.sparkSession.sparkContext.broadcast(items)
    name = hash(tuple(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(name, sent.value, rate)
        for t in batches:
            ids = t.column(0).to_pylist()
            rows = [(doc, *hit) for lo, hi, texts in text_slices(t.column(1)) for doc, text in zip(ids[lo:hi], texts, strict=True) for hit in finder.find(text)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, whatever the names, that hold no item within its budget.

    Null, blank and very long texts, and items: as in leaks.  Repeated rows stay or go together.  An empty
    table of documents stays empty; without items all rows stay.
    """
    kept = docs
    for items in item_blocks(benchmark, item_col, item_text_col, block_chars):
        kept = kept.filter(_clean(docs, items, rate)(F.col(f"`{text_col}`")))
    return kept


def _clean(docs: DataFrame, items: list[tuple[int, str]], rate: float):
    """A function of texts: whether each holds none of the items."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    name = hash(tuple(items))

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        finder = _finder(name, sent.value, rate)
        return pa.array([not finder.find(t) for _, _, texts in text_slices(text) for t in texts], pa.bool_())

    return clean
