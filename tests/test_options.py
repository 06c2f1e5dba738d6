"""Options checked by type, against plain Python, one request for each rule and more."""

import json

import pytest
from pyspark.sql import functions as F

from docspan.functions.options import FORMATS, SWITCHES, checked_options
from docspan.operators import assembly

CASES = [
    {}, {"output_format": "Table"}, {"output_format": 5}, {"output_format": None}, {"output_format": "xml"}, {"max_tokens": 64}, {"max_tokens": "8192 "}, {"max_tokens": "+70"}, {"max_tokens": 8193},
    {"max_tokens": 99.9}, {"max_tokens": True}, {"max_tokens": None}, {"max_tokens": [100]}, {"max_tokens": "1e3"}, {"max_tokens": ""}, {"extract_fields": None}, {"extract_fields": []}, {"extract_fields": ["a", " ", 1, 1.5, True, None]},
    {"extract_fields": " a , b,, "}, {"extract_fields": '["x", 2]'}, {"extract_fields": '{"x": 2}'}, {"extract_fields": "7"}, {"extract_fields": "  "}, {"extract_fields": {"k": 1, "l": 2}}, {"extract_fields": 5}, {"extract_fields": True},
    *({s: x} for s in SWITCHES for x in (True, "true", 1, None)), {"other": 1, "include_coordinates": False, "max_tokens": 100, "output_format": "JSON"},
]


def plain(image, prompt, options):
    """First reason, and what is made of the options."""
    fmt = str(options["output_format"]).lower() if "output_format" in options else None
    fields, bad_fields = None, False
    if "extract_fields" in options:
        raw = options["extract_fields"]
        if raw is None:
            fields = []
        elif isinstance(raw, str):
            try:
                inner = json.loads(raw.strip())
            except ValueError:
                inner = None
            fields = [str(f) for f in inner if str(f).strip()] if isinstance(inner, list) else [f.strip() for f in raw.split(",") if f.strip()]
        else:
            try:
                fields = [str(f) for f in list(raw) if str(f).strip()]
            except TypeError:
                bad_fields = True
    try:
        tokens = int(options["max_tokens"]) if "max_tokens" in options else None
        bad_tokens = tokens is not None and not 64 <= tokens <= 8192
    except (ValueError, TypeError):
        bad_tokens = True
    if not image:
        return "image_ref is required", fields
    if len(image) > 4096:
        return "image_ref is too long", fields
    if not image.startswith(("data:", "/")):
        return "image_ref must be a path or a data address", fields
    if prompt and len(prompt) > 2048:
        return "prompt is too long", fields
    for s in SWITCHES:
        if s in options and not isinstance(options[s], bool):
            return f"{s} must be a boolean", fields
    if fmt is not None and fmt not in FORMATS:
        return "output_format is unknown", fields
    if bad_tokens:
        return "max_tokens must be an integer between 64 and 8192", fields
    return ("extract_fields must be a list" if bad_fields else None), fields


def test_options_by_type(spark):
    rows = [(k, "/a", None, json.dumps(o)) for k, o in enumerate(CASES)]
    rows += [(100, None, None, "{}"), (101, "", None, "{}"), (102, "x" * 4097, None, "{}"), (103, "rel.png", None, "{}"), (104, "data:x", "p" * 2049, "{}"), (105, "data:x", "p" * 2048, "{}")]
    df = spark.createDataFrame(rows, "k int, image string, prompt string, options string")
    got = {r.k: (r.o.reason, r.o.extract_fields) for r in df.select("k", checked_options(F.col("image"), F.col("prompt"), F.col("options")).alias("o")).collect()}
    want = {k: plain(i, p, json.loads(o)) for k, i, p, o in rows}
    assert {k: (got[k], rows[k][3] if k < 100 else k) for k in want if got[k] != want[k]} == {}
    assert len({w[0] for w in want.values()}) == 11  # each rule, and none


@pytest.mark.parametrize("options", [None, "", "no json", "[1]", "5"])
def test_options_that_are_no_object(spark, options):
    df = spark.createDataFrame([(options,)], "options string").select(checked_options(F.lit("/a"), F.lit(None).cast("string"), F.col("options")).alias("o"))
    assert tuple(df.first().o) == (None, None, None, None)


def test_pages_keep_their_types(spark):
    rows = [("j", 2, '{"markdown":"b","n":1.5}', None, 0.6), ("j", 10, "plain", "", 1.0), ("j", 1, '{"markdown":"a","n":[1,null]}', None, 0.8), ("j", 3, '{"markdown":5}', None, 0.6), ("j", 4, "{}", "failed", 0.1), ("k", 1, None, "failed", 0.9)]
    df = spark.createDataFrame(rows, "job_id string, page int, content string, error string, confidence double")
    got = {r.job_id: json.loads(r.raw_content) for r in assembly.result_json(assembly.page_results(df)).collect()}
    assert got["j"]["pages"] == [{"page": 1, "result": {"markdown": "a", "n": [1, None]}}, {"page": 2, "result": {"markdown": "b", "n": 1.5}}, {"page": 3, "result": {"markdown": 5}}, {"page": 10, "result": "plain"}]
    assert got["j"]["markdown"] == "a\n\n---\n\nb" and got["j"]["page_count"] == 5 and got["j"]["confidence"] == 0.75
    assert got["k"] == {"job_id": "k", "model": "zai-org/GLM-OCR", "precision": "normal", "pages": [], "markdown": "", "page_count": 1, "confidence": 0.0}
