"""Text to rows with estimated boxes.

Each operator takes a table with a text column and gives one row an item, keeping the `keys` columns.
Boxes are of a page x, y, w, h; sizes are whole numbers, divided without remainder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspan.functions.options import line_label
from docspan.functions.text import blank, lines, split_lines, strip, words

Box = tuple[int, int, int, int]
PAGE: Box = (0, 0, 1000, 1000)
# Patterns of pairs and headings, and the characters of a word that take no width.
KV_COLON, KV_EQUALS = r"^([^:]+):\s*(.+)$", r"^([^=]+)=\s*(.+)$"
NO_WIDTH = r"[^\p{L}\p{M}\p{N}_\s-]"
#: Bytes of texts, and most texts, that are cut into sections at a time.
SLICE, SLICE_TEXTS = 1 << 20, 512
HEADING = r"^(#{1,6}|\d+\.|\d+\.\d+\.?)\s+(.+)$"


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def line_boxes(df: DataFrame, keys: Sequence[str], text: str = "text", page: Box = PAGE, confidence: float = 0.9) -> DataFrame:
    """Lines, trimmed, blank ones dropped, in bands of equal height."""
    x, y, w, h = page
    rows = df.select(*keys, F.transform(split_lines(F.col(text)), strip).alias("found"))
    rows = rows.select(*keys, F.size("found").alias("n"), F.posexplode("found").alias("line_no", "text"))
    tall = F.greatest(F.lit(1), _div(F.lit(h), F.col("n")))
    at = F.col("line_no") * tall
    return rows.select(*keys, "line_no", "text", F.lit(x).alias("x"), (F.lit(y) + at).alias("y"), F.lit(w).alias("w"), F.least(tall, F.lit(h) - at).alias("h"), F.lit(confidence).alias("confidence"))


def block_boxes(df: DataFrame, keys: Sequence[str], text: str = "text", kind: str = "type", page: Box = PAGE, confidence: str | None = None) -> DataFrame:
    """The whole content as one box, the page's, of the region's type; without a confidence column it is 1."""
    x, y, w, h = (F.lit(v) for v in page)
    sure = F.lit(1.0) if confidence is None else F.col(confidence)
    return df.select(*keys, F.col(text).alias("text"), F.col(kind).alias("type"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), sure.alias("confidence"))


def line_elements(df: DataFrame, keys: Sequence[str], text: str = "text", output_format: str = "text", page_w: int = 612, page_h: int = 792) -> DataFrame:
    """Elements of a page: one a line, labelled, or one in all for formats that aren't lines."""
    if output_format in ("json", "table", "key_value", "structured"):
        return df.select(*keys, F.lit(0).alias("index"), F.lit(output_format).alias("label"), F.col(text).alias("content"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(page_w).alias("x2"), F.lit(page_h).alias("y2"), F.lit(0.92).alias("confidence"))
    found = split_lines(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("whole"), found.alias("found"))
    none = F.size("found") == 0
    rows = rows.select(*keys, none.alias("none"), F.size("found").alias("n"), F.posexplode(F.when(none, F.array("whole")).otherwise(F.col("found"))).alias("index", "content"))
    tall = F.greatest(F.lit(12), _div(F.lit(page_h), F.greatest(F.col("n"), F.lit(1))))
    y1 = F.least(F.col("index") * tall, F.lit(page_h - 1))
    return rows.select(
        *keys,
        "index",
        F.when(F.col("none"), "text").otherwise(line_label(F.col("content"))).alias("label"),
        "content",
        F.lit(0).alias("x1"),
        y1.alias("y1"),
        F.lit(page_w).alias("x2"),
        F.when(F.col("none"), F.lit(page_h)).otherwise(F.least(F.lit(page_h), y1 + tall)).alias("y2"),
        F.lit(0.92).alias("confidence"),
    )


def _numbered(df: DataFrame, keys: Sequence[str], text: str, page: Box) -> DataFrame:
    """Every line with its number, of texts that aren't blank, and the height of one."""
    found = lines(F.col(text))
    rows = df.filter(~blank(F.col(text))).select(*keys, _div(F.lit(page[3]), F.size(found)).alias("tall"), found.alias("found"))
    return rows.select(*keys, "tall", F.posexplode("found").alias("line_no", "line"))


def _side_by_side(x: int, w: int) -> Callable[[str], Column]:
    """Start and width of each word of an array of words, of a line that begins at x and is w wide."""

    @F.arrow_udf("array<struct<start:int,wide:int>>")
    def place(found: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = found.flatten()
        line = np.repeat(np.arange(len(n)), n)
        size = lambda words: pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.bincount(line, size(flat), minlength=len(n))
        clean = size(pc.replace_substring_regex(flat, NO_WIDTH, ""))
        wide = np.maximum(10, np.floor(float(w) * (clean / total[line]))).astype(np.int64)
        after = np.cumsum(wide + 5)
        first = np.cumsum(n) - n
        begun = np.append(0, after)[first]  # what the lines before have taken
        start = x + after - wide - 5 - begun[line]
        items = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(wide.astype(np.int32))], ["start", "wide"])
        return pa.ListArray.from_arrays(pa.array(np.append(first, n.sum()).astype(np.int32)), items)

    return place


def word_boxes(df: DataFrame, keys: Sequence[str], text: str = "text", page: Box = PAGE, confidence: float = 0.9) -> DataFrame:
    """Words, each as wide as its share of the line's characters, at least 10, with 5 between.

    A line's words stay one array until they have their places, so no row leaves its task; the running sum
    over whole batches of lines is Arrow's and numpy's.
    """
    x, y, w, _ = page
    rows = _numbered(df, keys, text, page).withColumn("found", words(F.col("line"))).filter(F.size("found") > 0)
    rows = rows.withColumn("placed", _side_by_side(x, w)("found"))
    rows = rows.select(*keys, "tall", "line_no", F.posexplode(F.arrays_zip("found", "placed")).alias("word_no", "item"))
    conf = F.lit(confidence) * (F.lit(0.95) + F.lit(0.1) * (F.col("word_no") % 3) / F.lit(3.0))
    return rows.select(
        *keys,
        "line_no",
        "word_no",
        F.col("item.found").alias("word"),
        F.col("item.placed.start").alias("x"),
        (F.lit(y) + F.col("line_no") * F.col("tall")).alias("y"),
        F.col("item.placed.wide").alias("w"),
        F.col("tall").alias("h"),
        F.round(F.least(F.lit(1.0), conf), 3).alias("confidence"),
    )


def word_boxes_equal(df: DataFrame, keys: Sequence[str], content: str = "content", box: Sequence[str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Words of each element side by side in its box, equally wide."""
    found = F.filter(F.split(F.replace(F.col(content), F.lit("\n"), F.lit(" ")), " ", -1), lambda s: s.rlike(r"\S"))
    x1, y1, x2, y2 = (F.col(c) for c in box)
    rows = df.select(*keys, x1.alias("bx1"), y1.alias("by1"), x2.alias("bx2"), y2.alias("by2"), found.alias("found"))
    rows = rows.select(*keys, "bx1", "by1", "bx2", "by2", F.size("found").alias("n"), F.posexplode("found").alias("word_no", "word"))
    step = F.greatest(F.lit(1), _div(F.col("bx2") - F.col("bx1"), F.col("n")))
    left = F.col("bx1") + F.col("word_no") * step
    return rows.select(*keys, "word_no", "word", left.alias("x1"), F.col("by1").alias("y1"), F.least(left + F.greatest(step, F.lit(10)), F.col("bx2")).alias("x2"), F.col("by2").alias("y2"), F.lit(0.93).alias("confidence"))


def word_rows_equal(df: DataFrame, keys: Sequence[str], content: str = "content", box: Sequence[str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """The boxes of `word_boxes_equal`, a row for each element: word k of n begins at x + k * step and is `wide`, as far as the
    box reaches (to `right`)."""
    found = F.filter(F.split(F.replace(F.col(content), F.lit("\n"), F.lit(" ")), " ", -1), lambda s: s.rlike(r"\S"))
    x1, y1, x2, y2 = (F.col(c) for c in box)
    rows = df.select(*keys, x1.alias("x"), y1.alias("y"), x2.alias("right"), (y2 - y1).alias("h"), F.size(found).alias("n"))
    rows = rows.withColumn("step", F.greatest(F.lit(1), _div(F.col("right") - F.col("x"), F.col("n"))))
    return rows.withColumn("wide", F.greatest("step", F.lit(10)))


def reading_order(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """df with `order_no`, from 0: by y, then x, then position."""
    return df.withColumn("order_no", F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x", position)) - 1)


def merge_hyphens(df: DataFrame, word: str = "word") -> DataFrame:
    """Marks words that end in a hyphen; the words themselves stay."""
    return df.withColumn("hyphenated", F.col(word).endswith("-"))


def key_values(df: DataFrame, keys: Sequence[str], text: str = "text", page: Box = PAGE) -> DataFrame:
    """Lines `key: value`, or else `key = value`; the key has two fifths of the width."""
    x, y, w, _ = page
    rows = _numbered(df, keys, text, page).withColumn("line", strip(F.col("line")))
    colon, equals = F.col("line").rlike(KV_COLON), F.col("line").rlike(KV_EQUALS)
    rows = rows.filter(colon | equals).withColumn("pattern", F.when(colon, "colon").otherwise("equals"))
    part = lambda k: strip(F.when(F.col("pattern") == "colon", F.regexp_extract("line", KV_COLON, k)).otherwise(F.regexp_extract("line", KV_EQUALS, k)))
    top = F.lit(y) + F.col("line_no") * F.col("tall")
    return rows.select(
        *keys,
        F.col("line_no").alias("pair_no"),
        part(1).alias("key"),
        part(2).alias("value"),
        F.lit(x).alias("key_x"),
        top.alias("y"),
        F.lit(int(w * 0.4)).alias("key_w"),
        F.lit(x + int(w * 0.4)).alias("value_x"),
        F.lit(int(w * 0.6)).alias("value_w"),
        F.col("tall").alias("h"),
        F.when(F.col("pattern") == "colon", F.lit(0.9)).otherwise(F.lit(0.85)).alias("confidence"),
        "pattern",
    )


def group_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs with equal keys next to each other, keys in the order of their first pair: `order_no`."""
    first = F.min("pair_no").over(Window.partitionBy(*keys, "key"))
    rows = pairs.withColumn("__first", first)
    return rows.withColumn("order_no", F.row_number().over(Window.partitionBy(*keys).orderBy("__first", "pair_no")) - 1).drop("__first")


def pair_confidence(pairs: DataFrame) -> DataFrame:
    """pairs with key_confidence, value_confidence and pair_confidence."""
    base = F.when(F.col("pattern") == "colon", 0.9).when(F.col("pattern") == "equals", 0.85).when(F.col("pattern") == "table", 0.8).when(F.col("pattern") == "form", 0.75).otherwise(0.7)
    label = F.col("key").rlike("(Number|Name|Date|ID|Code)$")
    up = lambda cond, more: F.round(F.least(F.lit(1.0), base + F.when(cond, more).otherwise(0.0)), 3)
    return pairs.withColumns({"key_confidence": up(label, 0.05), "value_confidence": up(F.col("value") != "", 0.03), "pair_confidence": F.round(base, 3)})


def table_cells(df: DataFrame, keys: Sequence[str], text: str = "text", page: Box = PAGE) -> DataFrame:
    """Cells between bars, tabs or runs of blanks; lines without one make no row."""
    x, y, w, _ = page
    cells = F.filter(F.transform(F.split(strip(F.col("line")), r"\s{2,}|\t|\|", -1), strip), lambda c: c != "")
    rows = _numbered(df, keys, text, page).withColumn("cells", cells).filter(F.size("cells") > 0)
    rows = rows.select(*keys, "tall", F.col("line_no").alias("row_no"), _div(F.lit(w), F.size("cells")).alias("wide"), F.posexplode("cells").alias("col_no", "text"))
    return rows.select(*keys, "row_no", "col_no", "text", (F.lit(x) + F.col("col_no") * F.col("wide")).alias("x"), (F.lit(y) + F.col("row_no") * F.col("tall")).alias("y"), F.col("wide").alias("w"), F.col("tall").alias("h"))


def table_summary(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_row = cells.groupBy(*keys, "row_no").agg(F.count("*").alias("n"))
    return per_row.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.max("n").alias("n_columns"), F.sum("n").alias("n_cells"))


def sections(df: DataFrame, keys: Sequence[str], text: str = "text", page: Box = PAGE) -> DataFrame:
    """Headings (# marks, or numbers) with the lines below them; of the lines before the first heading,
    the first alone makes a preamble.  Null and blank texts have no sections.  A text's lines stay one array:
    Arrow batches are cut at the headings of all their texts at once, so the time is linear and no row leaves its task."""
    x, y, w, h = page
    rows = df.filter(~blank(F.col(text))).select(*keys, F.transform(lines(F.col(text)), strip).alias("said"))
    rows = rows.withColumn("heads", F.transform("said", lambda s: s.rlike(HEADING)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    cut = rows.mapInArrow(_cut_at_heads, f"{kept}, section_no int, first int, after int, n int, line string, below string")
    preamble = F.col("section_no") == 0
    marker = F.regexp_extract("line", HEADING, 1)
    numbered = F.char_length(marker) - F.char_length(F.replace(marker, F.lit("."))) + 1
    tall = _div(F.lit(h), F.col("n"))
    return cut.select(
        *keys,
        "section_no",
        F.when(preamble, 0).when(marker.startswith("#"), F.char_length(marker)).otherwise(numbered).cast("int").alias("level"),
        F.when(preamble, "Preamble").otherwise(F.regexp_extract("line", HEADING, 2)).alias("heading"),
        F.when(preamble, F.col("line")).otherwise(F.col("below")).alias("content"),
        F.lit(x).alias("x"),
        (F.lit(y) + F.col("first") * tall).cast("int").alias("y"),
        F.lit(w).alias("w"),
        (F.when(preamble, 1).otherwise(F.col("after") - F.col("first")) * tall).cast("int").alias("h"),
    )


def _cut_at_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sections of texts whose lines (`said`) and heads are lists: where each begins and ends among its text's lines,
    its first line, and the lines below that aren't empty.  As many texts as have SLICE bytes are cut at a time."""
    for batch in batches:
        said = batch.column("said")
        size = pc.binary_length(said.flatten()).to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(size, dtype=np.int64)][said.offsets.to_numpy().astype(np.int64) - said.offsets[0].as_py()]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, side="right")) - 1)
            hi = min(hi, lo + SLICE_TEXTS)
            yield _cut(batch.slice(lo, hi - lo))
            lo = hi


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    said, heads = batch.column("said"), batch.column("heads")
    edge = said.offsets.to_numpy().astype(np.int64)
    flat, at = said.flatten(), edge - edge[0]
    head = heads.flatten().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(head | np.isin(np.arange(len(head)), at[:-1]))  # a heading, or a text's first line
    text = np.searchsorted(at, first, "right") - 1
    after = np.minimum(np.r_[first[1:], len(head)][: len(first)], at[text + 1])
    before = np.cumsum(head) - head  # headings of the batch before each line
    number = np.where(head[first], before[first] - before[at[text]] + 1, 0)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    strings, place = flat.filter(pa.array(full)).to_pylist(), np.r_[0, np.cumsum(full)]
    below = ["\n".join(strings[place[lo + 1] : place[hi]]) for lo, hi in zip(first.tolist(), after.tolist(), strict=True)]
    kept = [c for c in batch.schema.names if c not in ("said", "heads")]
    made = [*(batch.column(c).take(pa.array(text)) for c in kept), *(pa.array(v.astype(np.int32)) for v in (number, first - at[text], after - at[text], at[text + 1] - at[text])), flat.take(pa.array(first)), pa.array(below, pa.string())]
    return pa.RecordBatch.from_arrays(made, [*kept, "section_no", "first", "after", "n", "line", "below"])


def vertical_segments(df: DataFrame, keys: Sequence[str], width: str, height: str, segments: int = 3, overlap: int = 40) -> DataFrame:
    """Bands of a page from top to bottom, overlapping, the last to the end; without any, the page."""
    n = max(2, segments)
    band = F.greatest(F.lit(1), _div(F.col(height), F.lit(n)))
    rows = df.select(*keys, F.col(width).cast("int").alias("right"), F.col(height).cast("int").alias("tall"), band.alias("band"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("segment_no"))
    top = F.greatest(F.lit(0), F.col("segment_no") * F.col("band") - overlap)
    bottom = F.when(F.col("segment_no") == n - 1, F.col("tall")).otherwise(F.least(F.col("tall"), (F.col("segment_no") + 1) * F.col("band") + overlap))
    return rows.select(*keys, "segment_no", F.lit(0).alias("left"), top.alias("top"), "right", bottom.alias("bottom")).filter("bottom > top")


def page_chunks(df: DataFrame, job: str, page: str, chunk: int = 10) -> DataFrame:
    """df with page_no from 1 in the order of page, and the chunk of pages it belongs to."""
    out = df.withColumn("page_no", F.row_number().over(Window.partitionBy(job).orderBy(page)))
    return out.withColumn("chunk_no", F.floor((F.col("page_no") - 1) / chunk).cast("int"))


def region_batches(df: DataFrame, index: str, size: int) -> DataFrame:
    return df.withColumn("batch_no", F.floor(F.col(index) / size).cast("int"))


def clamp(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A box inside the image, or null if nothing of it is."""
    into = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    box = F.struct(into(x1, width).alias("x1"), into(y1, height).alias("y1"), into(x2, width).alias("x2"), into(y2, height).alias("y2"))
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)
