"""Row types of the engine's tables, as DDL, which every reader and UDF takes.

Boxes come in two conventions that must not be mixed: `XYWH` (corner and size) and `XYXY` (two
corners); `to_xyxy` and `to_xywh` convert.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XYWH = ("x int, y int, w int, h int")
XYXY = ("x1 int, y1 int, x2 int, y2 int")

JOB = (
    "id string, filename string, file_size bigint, content_type string, storage_path string, status string, workflow_id string, run_id string, batch_id string, result_path string, error_message string, page_count int, confidence double, output_formats string, created_at timestamp, updated_at timestamp"
)
QUEUED_JOB = ("job_id string, priority int, enqueued_at timestamp, started_at timestamp, completed_at timestamp, document_size bigint, status string, options map<string,string>, retry_count int, error_message string")
REGION = ("index int, type string, bbox struct<x1:int,y1:int,x2:int,y2:int>, confidence double, raw_type string, text string")
REGION_RESULT = ("region_id string, content string, confidence double, error string")
ELEMENT = ("index int, label string, content string, bbox_2d struct<x1:int,y1:int,x2:int,y2:int>, confidence double")
PAGE_RESULT = ("page int, width int, height int, markdown string, confidence double, prompt_tokens int, completion_tokens int")
ENVELOPE = (
    "schema_version string, job_id string, model string, document_confidence double, page_count int, extraction_time double, output_formats string, precision_mode string, result string, result_text string, raw_pages string, timestamp timestamp"
)
WARNING = ("code string, message string, severity string, details map<string,string>")
PROCESSING_METRIC = ("processing_time_ms double, page_size_bytes bigint, complexity_score double, timestamp timestamp")

JOB_STATUSES = ("PENDING", "UPLOADED", "PROCESSING", "COMPLETED", "FAILED")
QUEUE_STATUSES = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED")

#: Defaults of extraction options by entry point: they differ between a single upload and a batch.
WORKFLOW_DEFAULTS = {"output_formats": "text", "precision_mode": "normal", "granularity": "block", "include_coordinates": False}
UPLOAD_DEFAULTS = {"output_formats": "structured", "precision_mode": "high", "granularity": "word", "include_coordinates": True, "min_confidence": 0.5}
BATCH_DEFAULTS = {"output_formats": "text", "precision_mode": "normal", "granularity": "block", "include_coordinates": False}


def to_xyxy(box: Column) -> Column:
    return F.struct(box["x"].alias("x1"), box["y"].alias("y1"), (box["x"] + box["w"]).alias("x2"), (box["y"] + box["h"]).alias("y2"))


def to_xywh(box: Column) -> Column:
    return F.struct(box["x1"].alias("x"), box["y1"].alias("y"), (box["x2"] - box["x1"]).alias("w"), (box["y2"] - box["y1"]).alias("h"))
