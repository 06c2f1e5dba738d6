"""Putting pages together: region joins, page aggregation, markdown, fields, envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.functions.options import field_key, region_type
from docspan.functions.text import redact, strip

BREAK = "\n\n---\n\n"


def filter_regions(regions: DataFrame, min_confidence: float = 0.5, score: str = "score") -> DataFrame:
    """Regions with enough confidence; one without a score counts as certain."""
    return regions.filter(F.coalesce(F.col(score), F.lit(1.0)) >= min_confidence)


def standard_types(regions: DataFrame, raw: str = "raw_type") -> DataFrame:
    return regions.withColumn("type", region_type(F.col(raw)))


def region_counters(regions: DataFrame, keys: Sequence[str], min_confidence: float = 0.5, score: str = "score") -> DataFrame:
    kept = F.coalesce(F.col(score), F.lit(1.0)) >= min_confidence
    return regions.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(~kept).alias("filtered"), F.count_if(kept).alias("kept"))


def join_regions(layout: DataFrame, content: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every region of the layout with its content.  An errored result counts as none; a content
    confidence over 0 is averaged with the layout's, else the layout's stands."""
    ok = F.col("error").isNull() | (F.col("error") == "")
    got = content.filter(ok).select(*keys, "region_id", F.col("content").alias("__content"), F.col("confidence").alias("__confidence"))
    rows = layout.withColumn("region_id", F.concat(F.lit("region_"), F.col("index").cast("string"))).join(got, [*keys, "region_id"], "left")
    conf = F.when(F.col("__confidence") > 0, (F.col("confidence") + F.col("__confidence")) / 2).otherwise(F.col("confidence"))
    return rows.select(*keys, "index", F.col("type").alias("label"), F.coalesce("__content", F.lit("")).alias("content"), F.round(conf, 6).alias("confidence"))


def layout_only(layout: DataFrame, keys: Sequence[str]) -> DataFrame:
    return layout.groupBy(*keys).agg(F.count("*").alias("n_regions"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence")).withColumn("model", F.lit("PaddleOCR-only"))


def two_stage_confidence(pages: DataFrame, joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean confidence of each page's joined regions, 0 for a page without any."""
    mean = joined.groupBy(*keys).agg(F.avg("confidence").alias("__mean"))
    return pages.select(*keys).distinct().join(mean, list(keys), "left").select(*keys, F.round(F.coalesce("__mean", F.lit(0.0)), 4).alias("confidence"))


def two_stage_or_page(joined: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pages' regions, and for pages without any the whole page as one region."""
    return joined.unionByName(whole.join(joined.select(*keys).distinct(), list(keys), "left_anti"))


def element_markdown(label: Column, content: Column) -> Column:
    return F.when(label.isin("title", "heading"), F.concat(F.lit("## "), content)).when(label == "formula", F.concat(F.lit("$$\n"), content, F.lit("\n$$"))).otherwise(content)


def in_order(position: str, value: Column) -> Column:
    """Aggregate: the values that aren't null, in order of position."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(position).alias("p"), value.alias("v"))))), lambda s: s["v"])


def assemble_page(elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Markdown of a page's elements and its confidence: the mean of those with a box, else 0.9."""
    piece = F.when(F.coalesce(F.col("content"), F.lit("")) != "", element_markdown(F.col("label"), F.col("content")))
    boxed = F.avg(F.when(F.col("x1").isNotNull(), F.col("confidence")))
    return elements.groupBy(*keys).agg(F.array_join(in_order("index", piece), "\n\n").alias("markdown"), F.coalesce(F.round(boxed, 4), F.lit(0.9)).alias("confidence"))


def aggregate_pages(pages: DataFrame, job: str = "job_id") -> DataFrame:
    """One row a job: mean confidence of the pages without error (0 if none), their markdown in page
    order, and the number of pages handed in, errors included."""
    ok = F.col("error").isNull()
    text = F.when(ok & (F.coalesce(F.col("markdown"), F.lit("")) != ""), F.col("markdown"))
    return pages.groupBy(job).agg(
        F.array_join(in_order("page", text), BREAK).alias("markdown"),
        F.count("*").cast("int").alias("page_count"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)), 6).alias("confidence"),
        F.count_if(ok).cast("int").alias("pages_ok"),
    )


def page_results(pages: DataFrame, job: str = "job_id", content: str = "content") -> DataFrame:
    """One row a job: `pages`, an array of (page, result) in page order, where result is the page's JSON as a variant or,
    if it is none, its text; the `markdown` that results hold, joined; `page_count`, pages with errors
    included; and the mean `confidence` of those without.  Pages of the same number follow by their text; an error
    of "" is none; a job of nothing but errors has no pages and confidence 0."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    text = F.coalesce(F.col(content), F.lit(""))
    found = F.array_sort(F.collect_list(F.when(ok, F.struct(F.col("page"), text.alias("text")))))
    rows = pages.groupBy(job).agg(found.alias("found"), F.count("*").cast("int").alias("page_count"), F.round(F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)), 6).alias("confidence"))
    result = lambda p: F.coalesce(F.try_parse_json(p["text"]), p["text"].cast("variant"))
    rows = rows.withColumn("pages", F.transform("found", lambda p: F.struct(p["page"].alias("page"), result(p).alias("result"))))
    kind = lambda v: F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.markdown", "variant")), F.lit(""))
    said = F.transform("pages", lambda p: F.when(kind(p["result"]) == "STRING", F.try_variant_get(p["result"], "$.markdown", "string")))
    return rows.select(job, "pages", F.array_join(F.filter(said, lambda m: F.coalesce(m, F.lit("")) != ""), BREAK).alias("markdown"), "page_count", "confidence")


def result_json(results: DataFrame, job: str = "job_id", precision: str = "normal", model: str = "zai-org/GLM-OCR") -> DataFrame:
    """The rows of `page_results` as one JSON object each, in `raw_content`."""
    body = F.struct(F.col(job).alias("job_id"), F.lit(model).alias("model"), F.lit(precision).alias("precision"), "pages", "markdown", "page_count", "confidence")
    return results.select(job, F.to_json(body).alias("raw_content"), "confidence", "page_count")


def token_totals(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def chunk_confidence(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over all chunks, empty ones included."""
    return chunks.groupBy(*keys).agg(F.round(F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count("*"), 6).alias("confidence"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _wanted(fields: Sequence[str]) -> list[str]:
    return [f.lower().replace(" ", "_").replace("-", "_") for f in fields]


def _matches(key: Column, fields: Sequence[str]) -> Column:
    wanted = F.array(*(F.lit(f) for f in _wanted(fields)))
    return F.exists(wanted, lambda f: (F.instr(field_key(key), f) > 0) | (F.instr(f, field_key(key)) > 0))


def filter_fields(elements: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Elements that have to do with the fields: of a JSON object the matching keys stay, with their values as they
    are and in the order of their names (none: the element goes); other text stays if it or its label names a
    field.  Without fields all stays."""
    if not fields:
        return elements
    v = F.try_parse_json("content")
    kept = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: _matches(k, fields))
    said = F.regexp_replace(F.lower(F.concat(F.coalesce("content", F.lit("")), F.lit(" "), F.coalesce("label", F.lit("text")))), "[ -]", "_")
    named = F.exists(F.array(*(F.lit(f) for f in _wanted(fields))), lambda f: F.instr(said, f) > 0)
    rows = elements.withColumns({"__object": _is_object(v), "__kept": F.when(_is_object(v), kept), "__named": named})
    rows = rows.filter(F.when(F.col("__object"), F.size("__kept") > 0).otherwise(F.col("__named")))
    return rows.withColumn("content", F.when(F.col("__object"), F.to_json("__kept")).otherwise(F.col("content"))).drop("__object", "__kept", "__named")


def flat_fields(elements: DataFrame, keys: Sequence[str], fields: Sequence[str] = (), order: str = "index", intended: bool = False) -> DataFrame:
    """The fields of filtered elements as rows (field, value), value a variant, so that numbers stay numbers.  A key of
    a JSON element has its last element's value; if there is none, a field has what follows its name, a colon or
    white space and more in the first text that says so, in lower case.  A field of several words is looked for as
    the rule in force writes it, a pattern taken literally, so that it is hardly ever found; `intended` lets any
    of blank, line and hyphen stand between its words, or nothing."""
    v = F.try_parse_json("content")
    obj = F.map_entries(F.when(_is_object(v), F.try_variant_get(v, "$", "map<string,variant>")))
    said = F.transform(obj, lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"), F.lit(1).alias("kind")))
    told = []
    for name, f in zip(fields, _wanted(fields), strict=True):
        literal = "[ _-]?".join(rf"\Q{w}\E" for w in f.split("_")) if intended else rf"\Q{f.replace('_', '[ _-]?')}\E"
        pattern = rf"{literal}[:\s]+([^\n]+)"
        text = F.lower("content")
        told.append(F.when(~_is_object(v) & text.rlike(pattern), F.struct(F.lit(name).alias("field"), strip(F.regexp_extract(text, pattern, 1)).cast("variant").alias("value"), F.lit(0).alias("kind"))))
    found = F.coalesce(said, F.array_compact(F.array(*told))) if told else said
    rows = elements.select(*keys, F.col(order).alias("__order"), F.inline(found))
    json, first = F.max_by(F.when(F.col("kind") == 1, F.col("value")), F.when(F.col("kind") == 1, F.col("__order"))), F.min_by(F.when(F.col("kind") == 0, F.col("value")), F.when(F.col("kind") == 0, F.col("__order")))
    return rows.groupBy(*keys, "field").agg(F.coalesce(json, first).alias("value"))


def with_coordinates(value: Column, box: Column, confidence: Column, include: bool) -> Column:
    return F.struct(value.alias("value"), box.alias("bbox"), confidence.alias("confidence")) if include else value


def post_process(results: DataFrame, raw: str = "raw", redact_text: bool = True) -> DataFrame:
    """results with `result`, `result_text` and `document_confidence`: personal data redacted, a JSON
    object marked as processed, anything else wrapped, and a heuristic score."""
    from docspan.functions.text import heuristic_confidence

    text = redact(F.col(raw)) if redact_text else F.col(raw)
    rows = results.withColumn("result_text", text)
    v = F.try_parse_json("result_text")
    is_object = _is_object(v)
    wrapped = F.to_json(F.struct(F.col("result_text").alias("raw_text"), F.lit("unknown").alias("document_type"), F.create_map().cast("map<string,string>").alias("fields"), F.array().cast("array<string>").alias("tables"), F.lit(True).alias("_postprocessed"), F.lit("1.0").alias("_version")))
    marks = {"_postprocessed": "true", "_version": '"1.0"'}
    others = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*marks))
    marked = F.to_json(F.map_concat(others, F.create_map(*(x for k, text in marks.items() for x in (F.lit(k), F.parse_json(F.lit(text)))))))
    size = lambda path, kind: F.coalesce(F.size(F.try_variant_get(v, path, kind)), F.lit(0)) > 0
    score = heuristic_confidence(F.col("result_text"), is_object & size("$.fields", "map<string,variant>"), is_object & size("$.tables", "array<variant>"), F.when(is_object, F.try_variant_get(v, "$.document_type", "string")))
    return rows.withColumns({"result": F.when(is_object, marked).otherwise(wrapped), "document_confidence": score})


def envelope(results: DataFrame, model: str = "zai-org/GLM-OCR") -> DataFrame:
    """The final record of a job: post-processed results with version and names."""
    return results.withColumns({"schema_version": F.lit("2.0"), "model": F.lit(model), "timestamp": F.current_timestamp()})
