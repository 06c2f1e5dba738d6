"""Files in, pages and results out.

Files are listed and read by Spark (`binaryFile`), so any store that it knows will do.  What can't be
read becomes a row with an error.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
MAX_BYTES = 10 << 20
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
OFFICE = (".docx", ".xlsx", ".pptx")
TEXTS = (".txt", ".csv")
FALLBACK_TEXTS = (".log",)
ARCHIVES = (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz", ".tgz", ".tbz2", ".txz")
DOCUMENTS = (".pdf", ".docx", ".xlsx", ".pptx", ".csv", ".txt", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".webp")
DEPTH = 10


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def is_archive(path: Column) -> Column:
    return extension(path).isin(*ARCHIVES)


def route(path: Column) -> Column:
    """What is done with a file, by its extension.  Logs are taken as text, as the fallback ingest does."""
    ext = extension(path)
    return F.when(ext == ".pdf", "pdf").when(ext.isin(*IMAGES), "image").when(ext.isin(*OFFICE), "office").when(ext.isin(*TEXTS, *FALLBACK_TEXTS), "text").when(is_archive(path), "archive").otherwise("unsupported")


def ingest(spark: SparkSession, path: str, pattern: str | None = None, limit: int = MAX_BYTES) -> DataFrame:
    """One row a file: path, size, modified, kind, hash, error.  Bytes are read only for the hash and
    stay out of the result; `contents` reads them again where they are needed."""
    files = _listed(spark, path, pattern)
    too_large = F.when(F.col("length") > limit, F.concat(F.lit("file is "), F.format_string("%.2f", F.col("length") / 1048576.0), F.lit(" MB, over the limit")))
    kind = route(F.col("path"))
    error = F.coalesce(too_large, F.when(kind == "unsupported", "file type is not supported"))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), kind.alias("kind"), F.when(too_large.isNull(), F.sha2("content", 256)).alias("hash"), error.alias("error"))


def _listed(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def contents(spark: SparkSession, path: str, pattern: str | None = None, limit: int = MAX_BYTES) -> DataFrame:
    return _listed(spark, path, pattern).filter(F.col("length") <= limit).select("path", "content")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content no known job has, the first path of equals."""
    fresh = files.join(known.select("hash").distinct(), "hash", "left_anti")
    return fresh.groupBy("hash").agg(F.min_by(F.struct(*(c for c in fresh.columns if c != "hash")), "path").alias("f")).select("hash", "f.*")


def read_text(files: DataFrame) -> DataFrame:
    """path and text of files (path, content) in UTF-8; other bytes become U+FFFD."""
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def decode_image(source: Column) -> Column:
    """Bytes of an image given as base64, with or without a data address before it."""
    return F.unbase64(F.regexp_replace(source, r"^data:[^,]*,", ""))


def flatten_archives(files: DataFrame, most: int = 256 << 20) -> DataFrame:
    """(path, member, content, error) of files (path, content): the documents in archives, and files that are documents
    themselves, as the data source of `archives` gives them from paths.  A member longer than `most` is an error."""
    from docspan.sources.archives import BYTES, SCHEMA, opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "member", "content", "error"])

        for t in batches:
            for path, data in zip(t.column(0).to_pylist(), t.column(1), strict=True):
                held, size = [], 0
                for row in opened(path.rsplit("/", 1)[-1], io.BytesIO(data.as_py() or b""), most):
                    held.append((path, *row))
                    size += len(row[1] or b"")
                    if size >= BYTES:
                        yield made(held)
                        held, size = [], 0
                if held:
                    yield made(held)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def rasterise(files: DataFrame, render: Callable[[bytes], list[bytes]] | None = None) -> DataFrame:
    """(path, page, content, error): images are one page; PDF and office files need `render`, which is
    given a file's bytes and returns its pages' images.  Without it they are rows with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows: list[tuple] = []
            for path, data in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                if path.lower().endswith(IMAGES):
                    rows.append((path, 1, data, None))
                elif render is None:
                    rows.append((path, None, None, "no renderer"))
                else:
                    try:
                        rows += [(path, i + 1, page, None) for i, page in enumerate(render(data))]
                    except Exception as err:  # the file's own fault
                        rows.append((path, None, None, str(err)))
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "page", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, content binary, error string")


def write_results(results: DataFrame, path: str, job: str = "job_id") -> None:
    """One folder a job, JSON lines in it."""
    results.write.mode("overwrite").partitionBy(job).json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
