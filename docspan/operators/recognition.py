"""The boundary to recognition models: pages in, elements out.

An engine is a function made once in each Python worker.  None can be shipped here, so the default is a
stand-in whose answers depend on the output format alone; a real one has the same signature.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.functions.text import redact

FORMATS = ("text", "table", "formula", "markdown", "key_value", "structured", "json")
#: What the vision model's answers count as: it gives no confidence of its own.
CONFIDENCE = 0.92
PAGE_W, PAGE_H = 612, 792

Element = tuple[str, str, tuple[int, int, int, int], float]
Engine = Callable[[dict], list[Element]]


def stand_in() -> Engine:
    """Answers with a short receipt in the wanted format."""
    receipt = {"number": "R-1", "total": "12.50"}
    whole = (0, 0, PAGE_W, PAGE_H)
    answers: dict[str, list[Element]] = {
        "text": [("title", "RECEIPT", (100, 50, 312, 90), 0.99), ("text", "Number: R-1", (100, 100, 450, 125), 0.97), ("text", "Total: 12.50", (100, 130, 420, 155), 0.96)],
        "table": [("table", json.dumps([{"headers": ["item", "price"], "rows": [["tea", "12.50"]]}]), whole, CONFIDENCE)],
        "formula": [("formula", "a^2 + b^2 = c^2", (100, 100, 400, 140), CONFIDENCE)],
        "markdown": [("text", "# RECEIPT\n\n**Number:** R-1\n\n**Total:** 12.50", whole, CONFIDENCE)],
        "key_value": [("key_value", json.dumps(receipt), whole, CONFIDENCE)],
        "structured": [("structured", json.dumps({"document_type": "receipt", "raw_text": "RECEIPT", "fields": receipt, "tables": []}), whole, CONFIDENCE)],
        "json": [("json", json.dumps({"document_type": "receipt", "fields": receipt, "line_items": []}), whole, CONFIDENCE)],
    }
    return lambda page: answers.get(page["output_format"], answers["text"])


def recognise(pages: DataFrame, keys: Sequence[str], engine: Callable[[], Engine] = stand_in) -> DataFrame:
    """One row an element of each page: keys, output_format, index, label, content, box, confidence, error.
    A page that the engine fails on gives one row with the error, so that others go on."""
    names = pages.columns
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "output_format string, index int, label string, content string, x1 int, y1 int, x2 int, y2 int, confidence double, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = engine()
        for pdf in batches:
            rows = []
            for page in pdf.to_dict("records"):
                head = [*(page[k] for k in keys), page["output_format"]]
                try:
                    rows += [[*head, i, label, content, *box, round(conf, 4), None] for i, (label, content, box, conf) in enumerate(ask(page))]
                except Exception as err:  # any failure of a model is that page's result
                    rows.append([*head, 0, None, None, None, None, None, None, None, str(err)])
            yield pd.DataFrame(rows, columns=[*keys, "output_format", "index", "label", "content", "x1", "y1", "x2", "y2", "confidence", "error"])

    assert "output_format" in names
    return pages.mapInPandas(run, schema)


def detect_layout(pages: DataFrame, keys: Sequence[str], detect: Callable[[], Callable[[dict], list[tuple]]]) -> DataFrame:
    """Regions (type, x1, y1, x2, y2, score) of each page, one row each, from a layout model."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "index int, raw_type string, x1 int, y1 int, x2 int, y2 int, score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = detect()
        for pdf in batches:
            rows = [[*(page[k] for k in keys), i, *region] for page in pdf.to_dict("records") for i, region in enumerate(find(page))]
            yield pd.DataFrame(rows, columns=[*keys, "index", "raw_type", "x1", "y1", "x2", "y2", "score"])

    return pages.mapInPandas(run, schema)


def named_entity_redaction(docs: DataFrame, text: str = "text", engine: Callable[[], Callable[[str], str]] | None = None) -> DataFrame:
    """docs with the text redacted by an entity recogniser, or by patterns without one."""
    if engine is None:
        return docs.withColumn(text, redact(F.col(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = engine()
        for t in batches:
            i = t.schema.get_field_index(text)
            cols = list(t.columns)
            cols[i] = pa.array([None if s is None else clean(s) for s in cols[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, t.schema.names)

    return docs.mapInArrow(run, docs.schema)
