"""Text expressions: trimming, lines, hashing, redaction, scores.

White space is that of `\\s` in Java and RE2: space and 0x09-0x0D.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.functions.diff import ratio

#: What is redacted, in this order.
REDACTIONS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def lines(text: Column) -> Column:
    """Split at newlines; a newline at the end makes an empty last line."""
    return F.split(text, "\n", -1)


def blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def split_lines(text: Column) -> Column:
    """Lines however they end (LF, CRLF, CR), without blank ones."""
    return F.filter(F.split(text, r"\r\n|[\n\r\x0b\f]", -1), lambda x: x.rlike(r"\S"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def layout_key(image: Column, options: Column) -> Column:
    """Cache key of a page's layout: image bytes and options, hashed."""
    return F.concat(F.lit("layout:"), F.sha2(F.concat(image, options), 256))


def preprocess_key(image: Column, params: Column) -> Column:
    """params: map; its entries in order of key."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.sha2(F.concat(image, F.lit(":"), shown), 256)


def redact(text: Column) -> Column:
    for name, pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, f"[{name}_REDACTED]")
    return text


def normalise(text: Column) -> Column:
    """Lines trimmed, blank ones dropped, joined by LF."""
    kept = F.filter(F.transform(F.split(text, r"\r\n|\r|\n", -1), strip), lambda x: x != "")
    return F.array_join(kept, "\n")


def line_count(text: Column) -> Column:
    """As splitlines counts: a newline at the end opens no further line."""
    n = F.size(lines(text)) - F.when(text.endswith("\n"), 1).otherwise(0)
    return F.when(text == "", 0).otherwise(n).cast("int")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def heuristic_confidence(raw: Column, has_fields: Column, has_tables: Column, document_type: Column) -> Column:
    bonus = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    known = F.coalesce(document_type, F.lit("unknown")) != "unknown"
    return F.round(F.least(F.lit(1.0), F.lit(0.5) + bonus(has_fields, 0.2) + bonus(has_tables, 0.1) + bonus(known, 0.1) + bonus(F.char_length(raw) > 100, 0.1)), 4)


def complexity(size_bytes: Column, text_length: Column, has_tables: Column, has_images: Column) -> Column:
    """0 to 1 from size, text length (null: not counted) and structure."""
    mb = size_bytes / 1048576.0
    by_size = F.when(mb < 0.5, 0.1).when(mb < 1.0, 0.2).when(mb < 2.0, 0.3).otherwise(0.4)
    by_text = F.when(text_length.isNull(), 0.0).when(text_length < 500, 0.05).when(text_length < 2000, 0.15).when(text_length < 5000, 0.25).otherwise(0.3)
    extra = F.when(has_tables, 0.15).otherwise(0.0) + F.when(has_images, 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), by_size + by_text + extra), 4)


def complexity_level(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.6, "medium").when(score < 0.8, "high").otherwise("very_high")


def half_even(x: Column, digits: int = 4) -> Column:
    """x, a double, rounded to so many digits behind the point as a binary number: what lies exactly between two
    goes to the even one, and what only looks so when written down goes where it is nearer to.  x * 10^digits is split
    into its double and the exact rest (Dekker's product), which decides where the double alone is a tie."""
    ten = float(10**digits)

    def halves(v: Column | float) -> tuple:
        wide = v * 134_217_729.0
        high = wide - (wide - v)
        return high, v - high

    p = x * F.lit(ten)
    (xh, xl), (th, tl) = halves(x), halves(ten)
    rest = ((xh * th - p) + xh * tl + xl * th) + xl * tl
    low = F.floor(p).cast("double")
    part = p - low
    even = low % 2 == 0
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & ~even)))
    rounded = (low + F.when(up, 1.0).otherwise(0.0)) / F.lit(ten)
    # beyond that a double has no digits to round; a zero keeps its sign
    return F.when(~(F.abs(p) < float(1 << 53)), x).when(rounded == 0, F.when(x < 0, F.lit(-0.0)).otherwise(x * 0.0)).otherwise(rounded)


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """How much of two texts is the same, from 0 to 1 (`diff.ratio`): 1 if both are empty, 0 if one is."""
    return pa.array([ratio(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.float64())
