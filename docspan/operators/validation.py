"""Checks of boxes, confidences, word overlaps and structured results; findings are coded rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.functions.text import similarity

#: Severity of each code.
SEVERITY = {
    "INVALID_BBOX_FORMAT": "high",
    "BBOX_OUTSIDE_PAGE": "high",
    "BBOX_EXCEEDS_PAGE": "high",
    "INVALID_BBOX_DIMENSIONS": "high",
    "INVALID_CONFIDENCE_TYPE": "high",
    "CONFIDENCE_OUT_OF_RANGE": "high",
    "LOW_CONFIDENCE": "medium",
    "INVALID_WORD_BOX_FORMAT": "high",
    "WORD_BOXES_OVERLAP": "medium",
    "INVALID_KV_PAIR_FORMAT": "high",
    "ORPHANED_VALUE": "high",
    "HIGH_LOW_CONFIDENCE_RATIO": "high",
    "INVALID_STRUCTURED_FORMAT": "high",
    "CONTENT_NOT_PRESERVED": "high",
    "MINOR_CONTENT_DIFFERENCES": "low",
}
#: Height of the bands in which overlapping boxes are looked for.
BAND = 64
#: Pairs of boxes that are looked at at once.
PAIRS = 1 << 18
#: Boxes that are made of rows at once.
ROWS = 1 << 16


def severity(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))[code]


def bbox_code(x: Column, y: Column, w: Column, h: Column, page: tuple[int, int, int, int]) -> Column:
    """The first thing wrong with a box, or null."""
    px, py, pw, ph = page
    missing = x.isNull() | y.isNull() | w.isNull() | h.isNull()
    return (
        F.when(missing, "INVALID_BBOX_FORMAT")
        .when((x < px) | (y < py), "BBOX_OUTSIDE_PAGE")
        .when((x + w > px + pw) | (y + h > py + ph), "BBOX_EXCEEDS_PAGE")
        .when((w <= 0) | (h <= 0), "INVALID_BBOX_DIMENSIONS")
    )


def confidence_code(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "INVALID_CONFIDENCE_TYPE").when((c < 0) | (c > 1), "CONFIDENCE_OUT_OF_RANGE").when(c < 0.5, "LOW_CONFIDENCE")


def box_warnings(boxes: DataFrame, keys: Sequence[str], page: tuple[int, int, int, int]) -> DataFrame:
    code = bbox_code(F.col("x"), F.col("y"), F.col("w"), F.col("h"), page)
    return boxes.select(*keys, code.alias("code")).filter("code is not null").withColumn("severity", severity(F.col("code")))


def confidence_warnings(items: DataFrame, keys: Sequence[str], confidence: str = "confidence") -> DataFrame:
    return items.select(*keys, confidence_code(F.col(confidence)).alias("code")).filter("code is not null").withColumn("severity", severity(F.col("code")))


def word_overlaps(boxes: DataFrame, page_keys: Sequence[str], item: Sequence[str], threshold: float = 0.1, band: int = BAND) -> DataFrame:
    """Pairs of a page's boxes whose common area is over `threshold` of the smaller.  A box goes to
    each band of the page that it touches; a pair counts in the first band that both touch, so
    boxes far from each other never meet.  A band's boxes are swept from left to right: only those that reach the place
    of the sweep are held and compared with the next ones, so the time follows the pairs that meet.  Boxes
    without a width, height or place make no pair; equal boxes of different items are a pair."""
    rows = _in_bands(boxes, page_keys, item, band)
    ddl = lambda names, before="": [f"`{before}{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields]
    schema = ", ".join([*ddl(page_keys), *ddl(item, "a_"), *ddl(item, "b_"), "common double", "smaller double"])
    pairs = rows.mapInArrow(_pairs(len(page_keys), len(item), threshold), schema)
    return pairs.withColumn("ratio", F.round(F.col("common") / F.col("smaller"), 6)).filter(F.col("ratio") > threshold).drop("common", "smaller")


def _in_bands(boxes: DataFrame, page_keys: Sequence[str], item: Sequence[str], band: int) -> DataFrame:
    """Keys, item, x, y, w, h, top, band, in the order of page, band and x: boxes once for each band that they touch."""
    last = F.floor((F.greatest(F.col("y") + F.col("h"), F.col("y") + 1) - 1) / band)
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = boxes.filter("w > 0 and h > 0 and x is not null and y is not null").select(*page_keys, *item, *(number(c) for c in "xywh"), F.floor(F.col("y") / band).alias("top"), F.explode(F.sequence(F.floor(F.col("y") / band), last)).alias("band"))
    return rows.repartition(*page_keys, "band").sortWithinPartitions(*page_keys, "band", "x", *item)


def _ranks(column: pa.Array) -> np.ndarray:
    """Numbers in the order of a column's values, equal for equal ones."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        place = {repr(v): k for k, v in enumerate(sorted(values, key=lambda v: list(v.values()) if isinstance(v, dict) else v))}
        return np.array([place[repr(v)] for v in values], np.int64)
    return pc.rank(column, tiebreaker="dense").to_numpy().astype(np.int64)


def _changes(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Where rows are of another page or band (the last column) than the row before."""
    new = np.zeros(batch.num_rows, bool)
    for c in [*batch.columns[:n_keys], batch.columns[-1]]:
        if pa.types.is_nested(c.type):
            values = c.to_pylist()
            new[1:] |= np.array([p != q for p, q in zip(values, values[1:], strict=False)], bool)
        else:
            differs = pc.not_equal(c[1:], c[:-1])
            if c.null_count:
                differs = pc.coalesce(differs, pc.xor(pc.is_null(c[1:]), pc.is_null(c[:-1])))
            new[1:] |= differs.to_numpy(zero_copy_only=False)
    return new


def _meetings(batches: Iterator[pa.RecordBatch], n_keys: int, n_item: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows as `_in_bands` gives them, with pairs of them that share area, each in the first band of both: the place of the
    smaller item's box, of the larger one's, their common area and the smaller area.  Held are a batch, what of the page's
    boxes before it reaches into it, and about PAIRS pairs at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        before = held.num_rows if held else 0
        if held:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        page = np.cumsum(_changes(batch, n_keys))
        x, y, w, h, top, band = (c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys + n_item :])
        right, bottom, area = x + w, y + h, w * h
        # the boxes that begin before a box ends follow on it
        places = np.unique(x)
        wide = len(places) + 1
        end = np.searchsorted(page * wide + np.searchsorted(places, x), page * wide + np.searchsorted(places, right))
        start = np.maximum(np.arange(1, n + 1), before)
        count = np.maximum(end - start, 0)
        upto = np.cumsum(count)
        ranks = [_ranks(c) for c in batch.columns[n_keys : n_keys + n_item]]
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
            some = count[lo:hi]
            a = np.repeat(np.arange(lo, hi), some)
            b = np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(start[lo:hi], some)
            lo = hi
            on = (np.minimum(bottom[a], bottom[b]) > np.maximum(y[a], y[b])) & (np.maximum(top[a], top[b]) == band[b])
            a, b = a[on], b[on]
            less, same = np.zeros(len(a), bool), np.ones(len(a), bool)
            for r in ranks:
                less |= same & (r[a] < r[b])
                same &= r[a] == r[b]
            if same.any():
                a, b, less = a[~same], b[~same], less[~same]
            common = (np.minimum(right[a], right[b]) - x[b]) * (np.minimum(bottom[a], bottom[b]) - np.maximum(y[a], y[b]))
            yield batch, np.where(less, a, b), np.where(less, b, a), common, np.minimum(area[a], area[b])
        held = batch.filter(pa.array((page == page[-1]) & (right > x[-1])))


def _pairs(n_keys: int, n_item: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, second, common, smaller in _meetings(batches, n_keys, n_item):
            on = common > (threshold - 1e-6) * smaller
            names, one, other = batch.schema.names, pa.array(first[on]), pa.array(second[on])
            sides = [c.take(side) for side in (one, other) for c in batch.columns[n_keys : n_keys + n_item]]
            yield pa.RecordBatch.from_arrays(
                [*(c.take(one) for c in batch.columns[:n_keys]), *sides, pa.array(common[on]), pa.array(smaller[on])],
                [*names[:n_keys], *(f"{b}_{c}" for b in "ab" for c in names[n_keys : n_keys + n_item]), "common", "smaller"],
            )

    return run


def least_ratio(threshold: float) -> float:
    """The least number that is over threshold when it is rounded to six places, half up."""
    whole = math.floor(threshold * 10**6) - 1
    while float(Decimal(whole).scaleb(-6)) <= threshold:
        whole += 1
    return float((Decimal(whole) - Decimal("0.5")).scaleb(-6))


def _counts(n_keys: int, n_item: int, threshold: float):
    """How many pairs pages have; a page can have several rows."""
    least = least_ratio(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, _, common, smaller in _meetings(batches, n_keys, n_item):
            n = np.bincount(first[common / smaller >= least], minlength=batch.num_rows)
            some = np.flatnonzero(n)
            if len(some):
                keys = batch.select(batch.schema.names[:n_keys]).take(pa.array(some))
                out = pa.Table.from_batches([keys]).append_column("n", pa.array(n[some])).group_by(keys.schema.names).aggregate([("n", "sum")])
                yield from out.rename_columns([*keys.schema.names, "n"]).to_batches()

    return run


def overlap_counts(boxes: DataFrame, page_keys: Sequence[str], item: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """A coded row for each page with overlapping boxes, and how many pairs word_overlaps gives for it; the pairs are
    counted where they are found."""
    rows = _in_bands(boxes, page_keys, item, BAND)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*page_keys).schema.fields), "n long"])
    return _page_codes(rows.mapInArrow(_counts(len(page_keys), len(item), threshold), schema), page_keys)


def _page_codes(counts: DataFrame, page_keys: Sequence[str]) -> DataFrame:
    code = F.lit("WORD_BOXES_OVERLAP")
    return counts.groupBy(*page_keys).agg(F.sum("n").alias("overlap_count")).withColumns({"code": code, "severity": severity(code)})


def row_overlap_counts(rows: DataFrame, page_keys: Sequence[str], item: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """`overlap_counts` of boxes given by the row, as `geometry.word_rows_equal` does: rows go to the bands of the page, and their
    boxes, known by item and number, are made where they are compared.  Places and steps are whole numbers.  Held are the
    rows of a page's band, and about ROWS of their boxes at a time (those that begin at one place together)."""
    last = F.floor((F.greatest(F.col("y") + F.col("h"), F.col("y") + 1) - 1) / BAND)
    number = lambda c: F.col(c).cast("long").alias(c)
    names = ["x", "step", "wide", "right", "n", "y", "h"]
    there = rows.filter("n > 0 and h > 0 and right > x and step > 0 and y is not null").select(*page_keys, *item, *(number(c) for c in names), F.floor(F.col("y") / BAND).alias("top"))
    there = there.withColumn("band", F.explode(F.sequence("top", last))).repartition(*page_keys, "band").sortWithinPartitions(*page_keys, "band")
    n_keys, n_item = len(page_keys), len(item)
    count = _counts(n_keys, n_item + 1, threshold)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in there.select(*page_keys).schema.fields), "n long"])
    return _page_codes(there.mapInArrow(lambda batches: count(_boxes_of_rows(batches, n_keys, n_item)), schema), page_keys)


def _boxes_of_rows(batches: Iterator[pa.RecordBatch], n_keys: int, n_item: int) -> Iterator[pa.RecordBatch]:
    """Boxes of rows that come in the order of page and band: keys, item, number, x, y, w, h, top, band, by page, band and x."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        joint = pa.Table.from_batches([*(b.slice(b.num_rows - 1) for b in held[-1:]), batch]).combine_chunks().to_batches()[0]
        new = np.flatnonzero(_changes(joint, n_keys))
        if len(new):  # what ends in this batch
            cut = int(new[-1]) - len(held[-1:])
            yield from _made_boxes(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0], n_keys, n_item)
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield from _made_boxes(pa.Table.from_batches(held).combine_chunks().to_batches()[0], n_keys, n_item)


def _made_boxes(rows: pa.RecordBatch, n_keys: int, n_item: int) -> Iterator[pa.RecordBatch]:
    x, step, wide, right, n, y, h, top, band = (c.to_numpy() for c in rows.columns[n_keys + n_item :])
    n = np.minimum(n, -((x - right) // step))  # a word that begins at the right edge or behind has no width
    group = np.cumsum(_changes(rows, n_keys))
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    upto = np.r_[0, np.cumsum(n)][edges]
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + ROWS, side="right")) - 1)
        some = np.arange(edges[lo], edges[hi])
        slabs = -(-int(upto[hi] - upto[lo]) // ROWS) if hi == lo + 1 else 1
        places = np.linspace(x[some].min(), right[some].max(), slabs + 1).astype(np.int64)
        lo = hi
        for left, stop in zip(places, places[1:], strict=False):
            first, after = (np.clip(-((x[some] - p) // step[some]), 0, n[some]) for p in (left, stop))
            m = after - first
            of = np.repeat(some, m)
            k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first, m)
            at = x[of] + k * step[of]
            by = np.lexsort((at, group[of]))
            of, k, at = of[by], k[by], at[by]
            boxes = (v.astype(np.float64) for v in (at, y[of], np.minimum(at + wide[of], right[of]) - at, h[of]))
            known = [c.take(pa.array(of)) for c in rows.columns[: n_keys + n_item]]
            yield pa.RecordBatch.from_arrays([*known, *(pa.array(v) for v in (k, *boxes, top[of], band[of]))], [*rows.schema.names[: n_keys + n_item], "number", "x", "y", "w", "h", "top", "band"])


def overlap_warnings(boxes: DataFrame, page_keys: Sequence[str], item: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """The pairs of word_overlaps as coded rows."""
    code = F.lit("WORD_BOXES_OVERLAP")
    return word_overlaps(boxes, page_keys, item, threshold).drop("ratio").withColumns({"code": code, "severity": severity(code)})


def pair_code(key: Column, value: Column) -> Column:
    return F.when(key.isNull() | value.isNull(), "INVALID_KV_PAIR_FORMAT").when((key == "") & (value != ""), "ORPHANED_VALUE")


def validation_summary(items: DataFrame, keys: Sequence[str], page: tuple[int, int, int, int], low_ratio: float = 0.2) -> DataFrame:
    """For each page: elements, invalid (a wrong box and a wrong confidence count one each), how many
    have low confidence, and whether all is valid."""
    box = bbox_code(F.col("x"), F.col("y"), F.col("w"), F.col("h"), page)
    conf = confidence_code(F.col("confidence"))
    wrong = F.when(box.isNotNull(), 1).otherwise(0) + F.when(conf.isin("INVALID_CONFIDENCE_TYPE", "CONFIDENCE_OUT_OF_RANGE"), 1).otherwise(0)
    low = F.when(F.col("confidence") < 0.5, 1).otherwise(0)
    out = items.groupBy(*keys).agg(F.count("*").alias("total_elements"), F.sum(wrong).alias("invalid_elements"), F.sum(low).alias("low_confidence_count"))
    many = F.col("low_confidence_count") / F.col("total_elements") > low_ratio
    return out.withColumn("high_low_confidence_ratio", many).withColumn("valid", (F.col("invalid_elements") == 0) & ~many)


def _coded(rows: DataFrame, keys: Sequence[str], code: Column) -> DataFrame:
    return rows.select(*keys, code.alias("code")).filter("code is not null").withColumn("severity", severity(F.col("code")))


def word_format_warnings(words: DataFrame, keys: Sequence[str], word: str = "word", box: Sequence[str] = ("x", "y", "w", "h"), confidence: str = "confidence") -> DataFrame:
    """A coded row for each word that lacks its text, its confidence or a part of its box."""
    lacks = F.coalesce(*(F.when(F.col(c).isNull(), True) for c in (word, *box, confidence)))
    return _coded(words, keys, F.when(lacks, "INVALID_WORD_BOX_FORMAT"))


def ratio_warnings(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A coded row for each page of `validation_summary` that has too many elements of low confidence."""
    return _coded(summary, keys, F.when(F.col("high_low_confidence_ratio"), "HIGH_LOW_CONFIDENCE_RATIO"))


def structured_warnings(results: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """A coded row for each structured result that is no JSON object with sections; null content is none."""
    names = F.map_keys(F.try_variant_get(F.try_parse_json(content), "$", "map<string,variant>"))
    return _coded(results, keys, F.when(~F.coalesce(F.array_contains(names, "sections"), F.lit(False)), "INVALID_STRUCTURED_FORMAT"))


def schema_ok(content: Column, output_format: Column) -> Column:
    """Whether a result has the shape that its format asks for; text formats have none."""
    v = F.try_parse_json(content)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("-"))
    is_object, is_list = kind("$").startswith("OBJECT"), kind("$").startswith("ARRAY")
    field = lambda name, t: kind(f"$.{name}").startswith(t)
    there = lambda name: kind(f"$.{name}") != "-"
    as_json = is_object & there("document_type") & field("fields", "OBJECT") & (~there("line_items") | field("line_items", "ARRAY"))
    as_structured = is_object & there("document_type") & there("raw_text") & field("fields", "OBJECT") & field("tables", "ARRAY")
    tables = F.try_variant_get(v, "$", "array<variant>")
    part = lambda t, name: F.coalesce(F.schema_of_variant(F.try_variant_get(t, f"$.{name}", "variant")), F.lit("-")).startswith("ARRAY")
    as_table = is_list & F.coalesce(F.forall(tables, lambda t: part(t, "headers") & part(t, "rows")), F.lit(False))
    return F.when(output_format.isin("text", "markdown", "formula"), True).when(v.isNull(), False).when(output_format == "json", as_json).when(output_format == "table", as_table).when(output_format == "key_value", is_object).when(output_format == "structured", as_structured).otherwise(True)


def round_trip(original: DataFrame, sections: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Rebuilds each text from its sections and compares it with the original, both as trimmed lines:
    similarity, and a code where content was lost."""
    from docspan.functions.text import normalise

    head = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading"))
    piece = F.when(F.col("level") == 0, F.col("content")).otherwise(F.concat_ws("\n", head, F.when(F.col("content") != "", F.col("content"))))
    built = sections.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", piece.alias("piece")))), lambda s: s["piece"]), "\n").alias("built"))
    out = original.select(*keys, normalise(F.col(text)).alias("was")).join(built, list(keys), "left").withColumn("built", normalise(F.coalesce("built", F.lit(""))))
    out = out.withColumn("similarity", F.round(similarity("was", "built"), 6))
    code = F.when(F.col("similarity") < 0.95, "CONTENT_NOT_PRESERVED").when(F.col("similarity") < 1.0, "MINOR_CONTENT_DIFFERENCES")
    return out.select(*keys, "similarity", (F.col("similarity") >= 0.95).alias("preserved"), code.alias("code"))
