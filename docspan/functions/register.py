"""The library's functions for SQL: scalar functions and table functions of a session.

Scalars are SQL expressions, so Catalyst sees through them; table functions turn one text into rows:

    SELECT d.doc_id, l.* FROM documents d, LATERAL extract_lines(d.text, 1000, 1000) l
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docspan.functions.text import REDACTIONS, similarity
from docspan.operators.geometry import HEADING, KV_COLON, KV_EQUALS

_FULL_LINES = r"filter(split(t, r'\r\n|[\n\r\x0b\f]', -1), s -> s rlike r'\S')"
_LINES = "split(t, '\\n', -1)"
_STRIP = r"regexp_replace(regexp_replace({}, r'^\s+', ''), r'\s+$', '')"
_COLON, _EQUALS = f"r'{KV_COLON}'", f"r'{KV_EQUALS}'"


def _redact() -> str:
    out = "t"
    for name, pattern in REDACTIONS:
        out = f"regexp_replace({out}, r'{pattern}', '[{name}_REDACTED]')"
    return out


def _statements() -> list[str]:
    line = _STRIP.format("line")
    part = lambda k: _STRIP.format(f"CASE WHEN line rlike {_COLON} THEN regexp_extract(line, {_COLON}, {k}) ELSE regexp_extract(line, {_EQUALS}, {k}) END")
    scalar = {
        "redact_pii(t STRING) RETURNS STRING": _redact(),
        "validate_bbox(x INT, y INT, w INT, h INT, page_w INT, page_h INT) RETURNS STRING": "CASE WHEN x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL THEN 'INVALID_BBOX_FORMAT' WHEN x < 0 OR y < 0 THEN 'BBOX_OUTSIDE_PAGE' WHEN x + w > page_w OR y + h > page_h THEN 'BBOX_EXCEEDS_PAGE' WHEN w <= 0 OR h <= 0 THEN 'INVALID_BBOX_DIMENSIONS' END",
        "score_confidence(t STRING, has_fields BOOLEAN, has_tables BOOLEAN, kind STRING) RETURNS DOUBLE": "round(least(1D, 0.5D + if(has_fields, 0.2D, 0D) + if(has_tables, 0.1D, 0D) + if(coalesce(kind, 'unknown') <> 'unknown', 0.1D, 0D) + if(char_length(t) > 100, 0.1D, 0D)), 4)",
    }
    tables = {
        "extract_lines(t STRING, page_w INT, page_h INT) RETURNS TABLE(line_no INT, line STRING, x INT, y INT, w INT, h INT)": f"SELECT line_no, {line}, 0, line_no * tall, page_w, least(tall, page_h - line_no * tall) FROM (SELECT greatest(1, page_h div size(found)) AS tall, posexplode(found) AS (line_no, line) FROM (SELECT {_FULL_LINES} AS found))",
        "extract_words(t STRING) RETURNS TABLE(line_no INT, word_no INT, word STRING)": rf"SELECT line_no, posexplode(filter(split(line, r'\s+', -1), w -> w <> '')) AS (word_no, word) FROM (SELECT posexplode({_LINES}) AS (line_no, line))",
        "extract_key_values(t STRING) RETURNS TABLE(pair_no INT, key STRING, value STRING)": f"SELECT pair_no, {part(1)}, {part(2)} FROM (SELECT pair_no, {_STRIP.format('raw')} AS line FROM (SELECT posexplode({_LINES}) AS (pair_no, raw))) WHERE line rlike {_COLON} OR line rlike {_EQUALS}",
        "extract_table(t STRING) RETURNS TABLE(row_no INT, col_no INT, cell STRING)": rf"SELECT row_no, posexplode(filter(transform(split({line}, r'\s{{2,}}|\t|\|', -1), c -> trim(c)), c -> c <> '')) AS (col_no, cell) FROM (SELECT posexplode({_LINES}) AS (row_no, line))",
    }
    make = "CREATE OR REPLACE TEMPORARY FUNCTION {} RETURN {}"
    return [make.format(head, body) for head, body in {**scalar, **tables}.items()]


# the heading pattern as Java reads it: `.` stops at any line terminator, `$` may stand before one at the end
_ENDS = "\n\r\x85\u2028\u2029"
_HEAD = re.compile(HEADING.replace(".+", f"[^{_ENDS}]+").replace("$", rf"(?:\r\n|[{_ENDS}])?\Z"), re.ASCII)
_BLANKS = " \t\n\x0b\f\r"


@udtf(returnType="section_no int, level int, heading string, content string, y int, h int", useArrow=True)
class ExtractSections:
    """extract_sections(text, page_h): the sections of a text and where they stand on a page of this height.  It
    goes from line to line and holds the section that is open."""

    def eval(self, text: str, page_h: int) -> Iterator[tuple]:
        if text is None or page_h is None or not text.strip(_BLANKS):
            return
        lines = [line.strip(_BLANKS) for line in text.split("\n")]
        tall = page_h // len(lines)
        held: list = []  # number, level, heading, first line, lines below
        number = 0
        for at, line in enumerate(lines):
            head = _HEAD.match(line)
            if head:
                if held:
                    yield self.row(held, at, tall)
                number += 1
                mark = head[1]
                level = len(mark) if mark.startswith("#") else mark.count(".") + 1
                held = [number, level, head[2], at, []]
            elif not held:
                held = [0, 0, "Preamble", at, [line]]
            elif held[0]:
                held[4].append(line)
        yield self.row(held, len(lines), tall)

    @staticmethod
    def row(held: list, after: int, tall: int) -> tuple:
        number, level, heading, first, below = held
        content = "\n".join(x for x in below if x) if number else below[0]
        return number, level, heading, content, first * tall, (after - first if number else 1) * tall


def register(spark: SparkSession) -> None:
    """Defines the functions in the session: redact_pii, validate_bbox, score_confidence, text_similarity;
    extract_lines, extract_words, extract_key_values, extract_table, extract_sections."""
    for statement in _statements():
        spark.sql(statement)
    spark.udf.register("text_similarity", similarity)
    spark.udtf.register("extract_sections", ExtractSections)
