"""Quality classifier from weak labels.

1. Heuristic labellers each vote good, bad or nothing on a document.
2. Expectation-maximisation over the counts of vote patterns estimates, without any true label, how
   often each labeller gives each vote on good and on bad documents, and from that how likely each
   pattern is good.
3. These posterior labels train a linear scorer over hashed features (word shapes, pairs of
   shapes, binned statistics) on a bounded sample of documents.
4. The scorer runs over all documents.

Counts of patterns cover all documents; there are at most 3 ** 8 patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.llm.words import mix, text_slices

#: Documents, expected, that the scorer is trained on.
SAMPLE = 4000
WEIGHTS = 1 << 16
SEED = 40_961
#: Beta prior of a labeller's share of bad votes on good documents: its mean, and the votes it counts
#: for.  Without it, a kind of junk that few labellers see in a small corpus could be taken for good
#: documents on which they err; more documents than that override it.
FALSE_MEAN, FALSE_VOTES = 0.01, 200.0
CHUNK = 256 << 10

#: Name, words or lines needed for a vote, bad from, good to (for the last two, bad to, good from).
LABELLERS = (
    ("symbols", 1, 0.04, 0.005),
    ("capitals", 4, 0.3, 0.15),
    ("repeats", 8, 0.15, 0.03),
    ("lines", 4, 0.4, 0.2),
    ("bars", 4, 0.1, 0.0),
    ("doubled", 4, 0.1, 0.0),
    ("plain", 4, 0.75, 0.9),
    ("pairs", 16, 0.4, 0.7),
)
RISING = 6  # the first so many are bad when high
BINS = np.array([0.0, 0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9, 0.97])

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*@^~<>{}[]\\_=+`")] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_BYTE = mix(np.arange(11, 267, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hash_runs(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each position in first up to the next."""
    at = np.arange(len(buf)) - np.repeat(first, np.diff(np.append(first, len(buf))))
    return mix(np.add.reduceat(mix(_BYTE[buf] + at.astype(np.uint64)), first))


def _plain_shapes() -> np.ndarray:
    words = [a + b for a in (b"a", b"Aa", b"A") for b in (b"", b".", b",", b";", b":", b"!", b"?")]
    return np.array([_hash_runs(np.frombuffer(w, np.uint8), np.array([0]))[0] for w in words])


_PLAIN = _plain_shapes()


class Features:
    """Of some texts: statistics (a row each), and the hashed features of each word with its text."""

    def __init__(self, texts: list[str | None]) -> None:
        n = len(texts)
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        buf = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
        first = ends - [len(r) + 1 for r in raw] if n else ends
        per_text = lambda x: np.add.reduceat(x, first, dtype=np.int64) if n else np.zeros(0, np.int64)
        gap = _GAP[buf]
        ink, letters = per_text(~gap), per_text(_LETTER[buf])
        doubled = np.zeros(len(buf), bool)
        doubled[1:] = (buf[1:] == buf[:-1]) & ~_LETTER[buf[1:]] & (buf[1:] < 128) & ~gap[1:] & ~((buf[1:] >= 48) & (buf[1:] < 58))
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        start, stop = edge[0::2], edge[1::2]
        self.text = np.searchsorted(ends, start, side="right")
        self.words = np.bincount(self.text, minlength=n)
        if len(start):
            body, length = buf[~gap], stop - start
            at = np.cumsum(length) - length
            word = _hash_runs(body, at)
            shape = _SHAPE[body]
            turn = np.ones(len(shape), bool)
            turn[1:] = shape[1:] != shape[:-1]
            turn[at] = True
            shape_at = np.cumsum(turn)[at] - 1
            self.shape = _hash_runs(shape[turn], shape_at)
        else:
            word = self.shape = np.zeros(0, np.uint64)
        follows = np.zeros(len(word), bool)
        follows[1:] = self.text[1:] == self.text[:-1]
        before = np.zeros(len(word), np.uint64)
        before[1:] = np.where(follows[1:], word[:-1], 0)
        pair = mix(mix(before + np.uint64(7)) ^ word ^ mix(self.text.astype(np.uint64) + np.uint64(99)))
        _, one = np.unique(pair, return_index=True)
        last = np.zeros(len(word), np.uint64)
        last[1:] = np.where(follows[1:], self.shape[:-1], 0)
        self.pair = mix(mix(last + np.uint64(3)) ^ self.shape)
        lines = [(t or "").split("\n") for t in texts]
        self.lines = np.array([len(x) for x in lines], np.int64)
        w, by_word = np.maximum(self.words, 1), lambda x: np.bincount(self.text[x], minlength=n)
        self.stats = np.stack(
            [
                per_text(_SYMBOL[buf]) / np.maximum(ink, 1),
                per_text(_UPPER[buf]) / np.maximum(letters, 1),
                by_word(follows & (before == word)) / w,
                1 - np.array([len(set(x)) for x in lines]) / np.maximum(self.lines, 1),
                per_text(buf == 124) / w,
                per_text(doubled) / w,
                by_word(np.isin(self.shape, _PLAIN)) / w,
                by_word(one) / w,
            ],
            axis=1,
        ) if n else np.zeros((0, len(LABELLERS)))
        for k, (name, least, _, _) in enumerate(LABELLERS):  # too short to tell: as an ordinary text has it
            self.stats[(self.lines if name == "lines" else self.words) < least, k] = 0.0 if k < RISING else 1.0

    def votes(self) -> np.ndarray:
        """0 bad, 1 nothing, 2 good; a row each."""
        out = np.ones(self.stats.shape, np.int64)
        for k, (name, least, bad, good) in enumerate(LABELLERS):
            x = self.stats[:, k]
            may = (self.lines if name == "lines" else self.words) >= least
            out[may & ((x > bad) if k < RISING else (x < bad)), k] = 0
            out[may & ((x <= good) if k < RISING else (x >= good)), k] = 2
        return out

    def pattern(self) -> np.ndarray:
        return self.votes() @ (3 ** np.arange(len(LABELLERS)))

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights used by each word's shape, by its pair of shapes, and by each text's statistics."""
        cut = lambda h: (h & np.uint64(WEIGHTS - 1)).astype(np.int64)
        binned = np.searchsorted(BINS, self.stats, side="left") + 100 * np.arange(len(LABELLERS))
        return cut(self.shape), cut(self.pair), cut(mix(binned.astype(np.uint64) + np.uint64(5000)))

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Log-odds of being good.  weights has the bias last."""
        shape, pair, stats = self.places()
        by_text = np.bincount(self.text, weights[shape] + weights[pair], minlength=len(self.words))
        return weights[-1] + by_text / np.maximum(self.words, 1) + weights[stats].sum(axis=1)


def estimate(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Probability that a pattern is good, and P(vote | class) of each labeller (class 0 bad, 1 good)
    among the votes it casts; where it casts none it says nothing.

    It starts from how many vote bad, adds one of each vote to the bad class, and to the good class the
    votes of the prior (FALSE_MEAN, FALSE_VOTES)."""
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    bad, good = (votes == 0).sum(axis=1), (votes == 2).sum(axis=1)
    post = np.where(bad >= 2, 0.02, np.where((bad == 1) & (good < 5), 0.2, np.where(bad == 1, 0.5, 0.95)))
    table = np.full((len(LABELLERS), 2, 3), 1 / 3)
    prior = np.array([[1.0, 0.0, 1.0], [FALSE_MEAN * FALSE_VOTES, 0.0, (1 - FALSE_MEAN) * FALSE_VOTES]])
    for _ in range(rounds):
        share = (n * post).sum() / n.sum()
        share = min(max(share, 0.02), 0.98)
        for c, weight in enumerate((n * (1 - post), n * post)):
            for k in range(len(LABELLERS)):
                seen = np.bincount(votes[:, k], weight, minlength=3) + prior[c]
                seen[1] = 0.0
                table[k, c] = seen / seen.sum()
        log = np.log(np.where(table > 0, table, 1.0))
        odds = np.log(share / (1 - share)) + sum(log[k, 1, votes[:, k]] - log[k, 0, votes[:, k]] for k in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(patterns.tolist(), post.tolist(), strict=True)), table


def train(rows: list[tuple[float, list[int], list[float]]], rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adam over all rows at once: weights, the bias last."""
    w = np.zeros(WEIGHTS + 1)
    if not rows:
        return w
    y = np.array([r[0] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    used, at = np.unique(np.concatenate([np.asarray(r[1], np.int64) for r in rows]), return_inverse=True)
    x = np.concatenate([np.asarray(r[2]) for r in rows])
    v, bias = np.zeros(len(used)), 0.0
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(doc, x * v[at], minlength=len(rows))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(at, x * err[doc], minlength=len(used)) + l2 * v, err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        v, bias = v - step[:-1], bias - step[-1]
    w[used], w[-1] = v, bias
    return w


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The scorer's weights, and each labeller's estimated votes by class."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for _, _, texts in text_slices(t.column(0), CHUNK):
                p, n = np.unique(Features(texts).pattern(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], ["pattern", "n"])

    src = docs.select(F.col(f"`{text_col}`").alias("text"))
    counts = {r[0]: r[1] for r in src.mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect()}
    if not counts:
        return np.zeros(WEIGHTS + 1), np.full((len(LABELLERS), 2, 3), 1 / 3)
    posterior, table = estimate(counts)
    # a document is in the sample by a hash of its id and text, so copies are drawn one by one
    share = sample / sum(counts.values())
    draw = F.xxhash64(F.lit(seed), "text", *([F.col("doc_id")] if "doc_id" in docs.columns else []))
    part = docs.select(F.col(f"`{text_col}`").alias("text"), *(["doc_id"] if "doc_id" in docs.columns else [])).select("text", draw.alias("draw"))
    part = part.filter((F.col("draw") / float(1 << 63) + 1) / 2 < share)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            draws = t.column(1)
            for lo, hi, texts in text_slices(t.column(0), CHUNK):
                f = Features(texts)
                shape, pair, stats = f.places()
                doc = np.concatenate([f.text, f.text, np.repeat(np.arange(hi - lo), len(LABELLERS))])
                value = np.concatenate([np.repeat(1 / np.maximum(f.words, 1), f.words)] * 2 + [np.ones(stats.size)])
                both, back = np.unique(doc * WEIGHTS + np.concatenate([shape, pair, stats.ravel()]), return_inverse=True)
                total = np.bincount(back, value, minlength=len(both))
                cuts = np.searchsorted(both, np.arange(hi - lo + 1) * WEIGHTS)
                y = [posterior[p] for p in f.pattern().tolist()]
                yield pa.RecordBatch.from_arrays(
                    [draws.slice(lo, hi - lo), pa.array(y), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(both % WEIGHTS)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(total))],
                    ["draw", "y", "place", "value"],
                )

    got = part.mapInArrow(rows, "draw long, y double, place array<long>, value array<double>").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    return train([(r[1], r[2], r[3]) for r in got]), table


def classify(docs: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with quality (probability of being good, double) and keep
    (whether it is at least threshold).

    A null text is empty: no labeller votes on it, so it scores by the bias and its empty statistics.
    Repeated rows count each time and score alike.  Very long texts are read whole.  An empty table
    gives an empty result.  Columns of docs named quality or keep are replaced.
    """
    scored = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("quality", "keep")), _scorer(docs, sample, seed, text_col).alias("quality"))
    return scored.withColumn("keep", F.col("quality") >= threshold)


def _scorer(docs: DataFrame, sample: int, seed: int, text_col: str) -> Column:
    """The probability of being good, by a scorer fitted on docs.  Only texts go to Python workers."""
    weights, _ = fit(docs, sample, seed, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def quality(text: pa.Array) -> pa.Array:
        z = np.concatenate([np.zeros(0), *(Features(texts).score(sent.value) for _, _, texts in text_slices(text, CHUNK))])
        return pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return quality(F.col(f"`{text_col}`"))


def drop_rejected(docs: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs, whatever their names.  Null
    and very long texts, repeated rows and an empty table: as in classify."""
    return docs.filter(_scorer(docs, sample, seed, text_col) >= threshold)
