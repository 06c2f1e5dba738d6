"""Registered queries: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.functions import options as opt
from docspan.functions import text as txt
from docspan.operators import assembly, geometry, jobs, metrics, recognition, sequences, validation
from docspan.plans import carriers as c
from docspan.sources import archives, files
from docspan.sources.shared import shared_folder
from docspan.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PAGE = geometry.PAGE
Query = Callable[[SparkSession, str], DataFrame]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# text


@query
def pii_redaction(spark, sf):
    new = txt.redact(F.col("text"))
    return c.documents(spark, sf).select("doc_id", new.alias("redacted"), (new != F.col("text")).alias("changed"))


@query
def pii_counts_by_lang(spark, sf):
    changed = txt.redact(F.col("text")) != F.col("text")
    return c.documents(spark, sf).groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(changed).alias("n_changed"))


@query
def content_hash(spark, sf):
    return c.documents(spark, sf).select("doc_id", txt.content_hash(F.col("text")).alias("sha256"), txt.layout_key(F.col("text"), F.col("lang")).alias("layout_key"))


@query
def normalised_text(spark, sf):
    new = txt.normalise(F.col("text"))
    return c.documents(spark, sf).select("doc_id", new.alias("normalised"), F.char_length(new).alias("n"))


@query
def heuristic_confidence(spark, sf):
    score = txt.heuristic_confidence(F.col("text"), F.col("source") == "src0", F.col("text").contains("|"), F.when(F.col("lang") == "en", F.lit("letter")))
    return c.documents(spark, sf).select("doc_id", score.alias("score"))


@query
def line_and_word_counts(spark, sf):
    return c.documents(spark, sf).select("doc_id", txt.line_count(F.col("text")).alias("n_lines"), txt.word_count(F.col("text")).alias("n_words"))


@query
def complexity_scores(spark, sf):
    size = F.octet_length("text").cast("long") * 512
    score = txt.complexity(size, F.char_length("text"), F.col("text").contains("|"), F.col("text").contains("$$"))
    return c.documents(spark, sf).select("doc_id", score.alias("score"), txt.complexity_level(score).alias("level"))


# duplicates


@query
def dedup_groups(spark, sf):
    return jobs.first_of_content(c.documents(spark, sf), txt.content_hash(F.col("text"))).filter("n > 1")


@query
def dedup_survivors(spark, sf):
    return jobs.first_of_content(c.documents(spark, sf), txt.content_hash(F.col("text"))).select(F.col("first_id").alias("doc_id"))


@query
def dedup_lookup(spark, sf):
    docs = c.documents(spark, sf).select("doc_id", txt.content_hash(F.col("text")).alias("hash"))
    known = jobs.first_of_content(docs, F.col("hash")).select("hash", F.col("first_id").alias("known_id"), F.when(F.col("first_id") % 17 == 0, "FAILED").otherwise("COMPLETED").alias("status"))
    return jobs.dedup_lookup(docs, known).select("doc_id", "known_id", "is_new")


# geometry


@query
def line_boxes(spark, sf):
    return geometry.line_boxes(c.documents(spark, sf), ["doc_id"])


@query
def line_elements(spark, sf):
    return geometry.line_elements(c.documents(spark, sf), ["doc_id"])


@query
def word_boxes(spark, sf):
    return geometry.word_boxes(c.documents(spark, sf), ["doc_id"])


@query
def word_boxes_equal(spark, sf):
    elements = geometry.line_elements(c.documents(spark, sf), ["doc_id"])
    return geometry.word_boxes_equal(elements, ["doc_id", "index"])


@query
def reading_order(spark, sf):
    words = geometry.word_boxes(c.documents(spark, sf), ["doc_id"]).withColumn("at", F.col("line_no") * 100_000 + F.col("word_no"))
    return geometry.merge_hyphens(geometry.reading_order(words, ["doc_id"], "at")).select("doc_id", "order_no", "word", "hyphenated")


@query
def key_value_pairs(spark, sf):
    return geometry.pair_confidence(geometry.key_values(c.documents(spark, sf), ["doc_id"]))


@query
def key_value_grouped(spark, sf):
    pairs = geometry.key_values(c.documents(spark, sf), ["doc_id"])
    return geometry.group_pairs(pairs, ["doc_id"]).select("doc_id", "order_no", "key", "value")


@query
def table_cells(spark, sf):
    return geometry.table_cells(c.documents(spark, sf), ["doc_id"])


@query
def table_summary(spark, sf):
    return geometry.table_summary(geometry.table_cells(c.documents(spark, sf), ["doc_id"]), ["doc_id"])


def _headed(spark, sf):
    """Documents whose even paragraphs are headed, so that there are sections to find."""
    head = lambda line, i: F.when(i % 4 == 1, F.concat(F.lit("## "), line)).when(i % 4 == 3, F.concat(F.lit("2.1 "), line)).otherwise(line)
    return c.documents(spark, sf).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), head), "\n").alias("text"))


@query
def sections(spark, sf):
    return geometry.sections(_headed(spark, sf), ["doc_id"])


@query
def vertical_segments(spark, sf):
    docs = c.documents(spark, sf).withColumns({"width": F.lit(1200), "height": F.char_length("text")})
    return geometry.vertical_segments(docs, ["doc_id"], "width", "height")


@query
def page_chunks(spark, sf):
    pages = geometry.page_chunks(c.turns(spark, sf), "job_id", "page", 3)
    return pages.select("job_id", "page", "page_no", "chunk_no")


@query
def region_batches(spark, sf):
    rows = geometry.region_batches(c.regions(spark, sf), "index", 5)
    return rows.groupBy("page_id", "batch_no").agg(F.count("*").alias("n"))


@query
def region_crops(spark, sf):
    rows = c.regions(spark, sf)
    box = geometry.clamp(F.col("index") * 40 - 60, F.col("index") * 30 - 20, F.col("index") * 40 + 100, F.col("index") * 30 + 50, F.lit(612), F.lit(792))
    return rows.select("page_id", "index", box.alias("b")).filter("b is not null").select("page_id", "index", "b.x1", "b.y1", "b.x2", "b.y2")


# validation


def _boxes(spark, sf):
    return geometry.word_boxes(c.documents(spark, sf), ["doc_id"])


@query
def bbox_warnings(spark, sf):
    return validation.box_warnings(_boxes(spark, sf), ["doc_id", "line_no", "word_no"], PAGE)


@query
def confidence_warnings(spark, sf):
    rows = c.events(spark, sf).withColumn("confidence", F.col("value") / 100 - 0.1)
    return validation.confidence_warnings(rows, ["event_id"])


def _event_boxes(spark, sf):
    e = c.events(spark, sf)
    day = F.col("ts").cast("date").cast("string")
    return e.select("user_id", day.alias("day"), "event_id", F.floor("value").cast("int").alias("x"), (F.col("event_id") % 97 * 3).cast("int").alias("y"), F.lit(25).alias("w"), F.lit(12).alias("h"))


@query
def word_overlaps(spark, sf):
    return validation.word_overlaps(_event_boxes(spark, sf), ["user_id", "day"], ["event_id"])


@query
def overlap_warnings(spark, sf):
    return validation.overlap_warnings(_event_boxes(spark, sf), ["user_id", "day"], ["event_id"])


@query
def word_box_overlaps(spark, sf):
    """Pages whose lines have so many words that equally wide boxes run into each other."""
    rows = geometry.word_rows_equal(geometry.line_elements(c.documents(spark, sf), ["doc_id"]), ["doc_id", "index"])
    return validation.row_overlap_counts(rows, ["doc_id"], ["index"])


@query
def validation_summary(spark, sf):
    return validation.validation_summary(_boxes(spark, sf), ["doc_id"], PAGE)


@query
def structured_findings(spark, sf):
    """Events' properties as results: some with sections, some without, and some that are no object."""
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"sections":[{"level":1}],'), F.substring("props", 2, 1 << 20))).when(F.col("event_id") % 4 == 1, F.lit('["sections"]')).when(F.col("event_id") % 4 == 2, F.col("event_type")).otherwise(F.col("props"))
    return validation.structured_warnings(c.events(spark, sf).select("event_id", said.alias("content")), ["event_id"])


@query
def confidence_ratio_findings(spark, sf):
    """Regions of pages, of which many have a low score."""
    regions = c.regions(spark, sf).select("page_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"), (F.pmod(F.col("page_id") * 31 + F.col("index") * (F.col("page_id") % 5), F.lit(10)) / 10.0).alias("confidence"))
    return validation.ratio_warnings(validation.validation_summary(regions, ["page_id"], PAGE, low_ratio=0.5), ["page_id"])


@query
def pair_warnings(spark, sf):
    pairs = geometry.key_values(c.documents(spark, sf), ["doc_id"])
    return pairs.select("doc_id", "pair_no", validation.pair_code(F.col("key"), F.col("value")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query
def schema_check(spark, sf):
    e = c.events(spark, sf)
    fmt = F.element_at(F.array(*(F.lit(x) for x in ("text", "json", "table", "key_value", "structured"))), (F.col("event_id") % 5 + 1).cast("int"))
    content = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"document_type":"'), F.col("event_type"), F.lit('","raw_text":"","tables":[],"fields":'), F.col("props"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.lit('[{"headers":[],"rows":[]}]')).otherwise(F.col("props"))
    return e.select("event_id", fmt.alias("format"), validation.schema_ok(content, fmt).alias("ok"))


@query
def roundtrip_similarity(spark, sf):
    docs = _headed(spark, sf).withColumn("text", F.concat(F.lit("# Start\n"), F.col("text")))
    return validation.round_trip(docs, geometry.sections(docs, ["doc_id"]), ["doc_id"])


# assembly


@query
def page_aggregate(spark, sf):
    return assembly.aggregate_pages(c.turns(spark, sf))


@query
def page_results(spark, sf):
    """Turns as pages: every third is plain text, the others a JSON object."""
    said = F.to_json(F.struct(F.col("page").alias("n"), F.when(F.col("page") % 3 == 1, F.col("markdown")).alias("markdown")))
    pages = c.turns(spark, sf).withColumn("content", F.when(F.col("page") % 3 == 0, F.col("markdown")).otherwise(said))
    return assembly.result_json(assembly.page_results(pages))


@query
def element_markdown(spark, sf):
    return assembly.assemble_page(geometry.line_elements(c.documents(spark, sf), ["doc_id"]), ["doc_id"])


@query
def chunk_mean_confidence(spark, sf):
    return assembly.chunk_confidence(c.turns(spark, sf).withColumn("confidence", F.when(F.col("error").isNull(), F.col("confidence"))), ["job_id"])


@query
def token_totals(spark, sf):
    rows = c.turns(spark, sf).withColumns({"prompt_tokens": F.char_length("markdown").cast("long"), "completion_tokens": txt.word_count(F.col("markdown")).cast("long")})
    return assembly.token_totals(rows, ["job_id"])


@query
def region_content_join(spark, sf):
    layout = assembly.standard_types(c.regions(spark, sf))
    return assembly.join_regions(layout, c.region_contents(spark, sf), ["page_id"])


@query
def layout_only(spark, sf):
    return assembly.layout_only(c.regions(spark, sf), ["page_id"])


@query
def two_stage_confidence(spark, sf):
    layout = assembly.standard_types(c.regions(spark, sf))
    joined = assembly.join_regions(layout, c.region_contents(spark, sf), ["page_id"])
    return assembly.two_stage_confidence(c.table(spark, sf, "pages"), joined, ["page_id"])


@query
def block_boxes(spark, sf):
    rows = assembly.standard_types(c.regions(spark, sf))
    return geometry.block_boxes(rows, ["page_id", "index"], "raw_type", confidence="confidence")


@query
def full_page_fallback(spark, sf):
    layout = assembly.standard_types(assembly.filter_regions(c.regions(spark, sf), 0.95))
    joined = assembly.join_regions(layout.filter("type = 'title'"), c.region_contents(spark, sf), ["page_id"])
    whole = c.table(spark, sf, "pages").select("page_id", F.lit(0).alias("index"), F.lit("text").alias("label"), F.lit("").alias("content"), F.lit(0.9).alias("confidence"))
    return assembly.two_stage_or_page(joined, whole, ["page_id"])


@query
def region_types(spark, sf):
    rows = assembly.standard_types(c.regions(spark, sf))
    return rows.groupBy("type").agg(F.count("*").alias("n"))


@query
def region_filter(spark, sf):
    return assembly.region_counters(c.regions(spark, sf), ["page_id"])


def _field_elements(spark, sf):
    """Events as elements: objects with and without asked keys, a list, and texts with and without."""
    e, i = c.events(spark, sf), F.col("event_id")
    number = i.cast("string")
    kinds = [
        F.col("props"),
        F.concat(F.lit('{"Sub Total":'), number, F.lit(',"Sign-Up-No":{"a":['), number, F.lit(',2]},"z":"x"}')),
        F.concat(F.lit("Kind: "), F.col("event_type"), F.lit(" k: "), number, F.lit("\nSign up: no")),
        F.lit('{"zzz":1}'),
        F.lit('["k",1]'),
        F.col("event_type"),
    ]
    content = F.element_at(F.array(*kinds), (i % len(kinds) + 1).cast("int"))
    return e.select("event_id", "user_id", i.alias("index"), F.lit("text").alias("label"), content.alias("content"))


@query
def field_filter(spark, sf):
    return assembly.filter_fields(_field_elements(spark, sf), ["event_id"], ["K", "sign-up"]).select("event_id", "content")


@query
def flat_fields(spark, sf):
    fields = ["K", "sign-up"]
    kept = assembly.filter_fields(_field_elements(spark, sf), ["event_id"], fields)
    return assembly.flat_fields(kept, ["user_id"], fields, intended=True).select("user_id", "field", F.to_json("value").alias("value"))


@query
def post_process(spark, sf):
    rows = c.documents(spark, sf).select("doc_id", F.col("text").alias("raw"))
    return assembly.post_process(rows).select("doc_id", "result", "result_text", "document_confidence")


@query
def envelope(spark, sf):
    """Objects, objects that are marked already, and plain text."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"_version":"0.9","fields":{"n":'), F.col("event_id").cast("string"), F.lit("},"), F.substring("props", 2, 1 << 20))).otherwise(F.col("event_type"))
    rows = c.events(spark, sf).select("event_id", raw.alias("raw"))
    return assembly.envelope(assembly.post_process(rows)).select("event_id", "schema_version", "model", "result", "document_confidence")


# options


@query
def option_parsing(spark, sf):
    e = c.events(spark, sf)
    v = F.col("value").cast("string")
    spec = F.concat(F.lit(" text , "), F.col("event_type"), F.lit(",,json "))
    return e.select(
        "event_id",
        opt.parse_bool(F.when(F.col("event_type") == "view", "TRUE").otherwise(F.col("event_type"))).alias("flag"),
        opt.bounded_int(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")), 1200, 10, 72).alias("whole"),
        opt.bounded_int(F.col("event_type"), 1200, 10, 7200).alias("fallback"),
        opt.number(F.concat(F.lit(" "), v)).alias("number"),
        F.array_join(opt.field_list(spec), "|").alias("fields"),
        opt.valid_formats(spec, F.lit("")).alias("formats_ok"),
        opt.token_budget(F.col("user_id").cast("int") * 100, fast=False).alias("tokens"),
        opt.page_token_budget(F.col("user_id").cast("int") * 100).alias("page_tokens"),
        opt.repetition_penalty(F.when(F.col("user_id") % 2 == 0, "high").otherwise("normal")).alias("penalty"),
    )


@query
def prompt_for_region(spark, sf):
    r = c.regions(spark, sf).groupBy("raw_type").agg(F.count("*").alias("n"))
    kind = opt.region_type(F.col("raw_type"))
    return r.select("raw_type", "n", kind.alias("type"), opt.region_prompt(kind).alias("prompt"), opt.label_task(kind).alias("task"), opt.task_prompt(opt.label_task(kind)).alias("task_prompt"))


@query
def prompt_selection(spark, sf):
    e = c.events(spark, sf)
    custom = F.when(F.col("event_type") == "error", F.lit("Read it"))
    fields = opt.field_list(F.when(F.col("event_type") == "click", F.lit("date, amount")).otherwise(F.lit("")))
    formats = F.when(F.col("event_type") == "view", F.lit(" Table,text")).otherwise(F.lit("json"))
    return e.groupBy(opt.prompt(custom, fields, formats).alias("prompt")).agg(F.count("*").alias("n"))


@query
def request_checks(spark, sf):
    d = c.documents(spark, sf)
    reason = opt.request_error(F.col("text"), F.col("text"), F.col("n_chars").cast("int"))
    return d.select("doc_id", reason.alias("reason"), opt.size_allowed(F.col("n_chars"), 4000).alias("allowed"), opt.megabytes(F.col("n_chars") * 1024).alias("mb"))


_OPTIONS = (
    '{"include_coordinates":true,"output_format":"JSON","max_tokens":"128","extract_fields":["a",1,true,null," "]}',
    '{"include_coordinates":"true"}',
    '{"include_word_confidence":1}',
    '{"include_page_layout":null}',
    '{"output_format":"xml"}',
    '{"max_tokens":63}',
    '{"max_tokens":"many"}',
    '{"max_tokens":100.9,"extract_fields":"date, total ,,"}',
    '{"extract_fields":"[\\"x\\",\\"y z\\"]","output_format":"table"}',
    '{"extract_fields":5}',
    '{"extract_fields":{"k":1,"l":2}}',
    '{"extract_fields":null,"max_tokens":8192}',
    "{}",
)


@query
def option_checks(spark, sf):
    """Each document's id chooses its options; its text is the prompt, and some images have no path."""
    d, i = c.documents(spark, sf), F.col("doc_id")
    image = F.when(i % 41 == 0, "").when(i % 43 == 0, "scan.png").when(i % 47 == 0, F.repeat(F.lit("/a"), 2049)).when(i % 2 == 0, "data:image/png;base64,").otherwise("/in/scan.png")
    options = F.element_at(F.array(*(F.lit(o) for o in _OPTIONS)), (i % len(_OPTIONS) + 1).cast("int"))
    return d.select("doc_id", opt.checked_options(image, F.col("text"), options).alias("o")).select("doc_id", "o.reason", "o.output_format", "o.max_tokens", F.to_json("o.extract_fields").alias("extract_fields"))


@query
def field_matches(spark, sf):
    p = c.table(spark, sf, "part")
    return p.select("p_partkey", opt.field_match(F.col("p_type"), F.lit("anodized")).alias("a"), opt.field_match(F.col("p_name"), F.lit("Small Ring")).alias("b"), opt.field_key(F.col("p_name")).alias("key"))


@query
def image_rules(spark, sf):
    p = c.table(spark, sf, "part")
    w, h = F.col("p_size") * 100, F.col("p_size") * 70 + 300
    score = opt.image_score(F.col("p_size") < 10, F.col("p_retailprice") / 50, F.col("p_size") * 2, F.col("p_size") / 20.0, F.col("p_size") % 3 == 0)
    return p.select("p_partkey", score.alias("score"), opt.image_too_large(w, h, F.lit(3), 10).alias("too_large"), opt.bounded_edge(w, F.greatest(w, h), 1280).alias("new_w"), opt.bounded_edge(h, F.greatest(w, h), 1280).alias("new_h"), opt.percent_used(F.col("p_size"), F.lit(60)).alias("percent"), opt.backoff_seconds(F.col("p_size") % 5 + 1, 60.0).alias("wait"))


# files


def _paths():
    """A path for each document, of every kind of file in turn."""
    kinds = ("pdf", "PNG", "jpeg", "docx", "xlsx", "pptx", "txt", "csv", "log", "zip", "tar.gz", "txt.xz", "7z", "exe", "doc", "")
    return F.concat(F.lit("in/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("doc_id") % len(kinds) + 1).cast("int")))


@query
def file_routing(spark, sf):
    return c.documents(spark, sf).select("doc_id", _paths().alias("path")).select("doc_id", "path", files.route(F.col("path")).alias("kind"), files.is_archive(F.col("path")).alias("archive"))


# jobs


@query
def batch_status_counts(spark, sf):
    return jobs.status_counts(c.jobs(spark, sf))


@query
def batch_rollup(spark, sf):
    return jobs.batch_rollup(c.jobs(spark, sf))


@query
def system_stats(spark, sf):
    return jobs.system_stats(c.jobs(spark, sf))


@query
def list_jobs(spark, sf):
    return jobs.list_jobs(c.jobs(spark, sf), 100, 20).select("id", "batch_id", "status", "created_at")


@query
def batch_files(spark, sf):
    return jobs.batch_files(c.jobs(spark, sf)).select("batch_id", "file_no", "id", "status")


@query
def submit_summary(spark, sf):
    return jobs.submit_summary(c.jobs(spark, sf))


@query
def status_sync(spark, sf):
    j = c.jobs(spark, sf)
    flows = c.queue(spark, sf).select(F.col("job_id").alias("id"), F.when(F.col("priority") == 2, "COMPLETED").otherwise("RUNNING").alias("workflow_status"))
    return jobs.sync_status(j, flows).select("id", "status")


@query
def queue_unknown_jobs(spark, sf):
    known = c.jobs(spark, sf).filter("status <> 'FAILED'")
    return jobs.missing_jobs(c.queue(spark, sf), known).select("job_id", "status")


@query
def queue_order(spark, sf):
    return jobs.dequeue(c.queue(spark, sf).filter("status = 'QUEUED'"), 50).select("job_id", "priority", "score")


@query
def queue_position(spark, sf):
    return jobs.queue_positions(c.queue(spark, sf).filter("status = 'QUEUED'"), band=86_400).select("job_id", "score", "position")


@query
def queue_order_intended(spark, sf):
    return jobs.dequeue(c.queue(spark, sf).filter("status = 'QUEUED'"), 50, intended=True).select("job_id", "priority", "score")


@query
def queue_estimate(spark, sf):
    return jobs.queue_estimate(c.queue(spark, sf))


@query
def concurrency_slots(spark, sf):
    e = c.events(spark, sf).select("event_type", F.col("event_id").alias("id"), F.col("ms"), (F.col("ms") + F.floor(F.col("value") * 60_000).cast("long")).alias("until"))
    return jobs.concurrency(e, "ms", "until", ["event_type"])


@query
def cache_stats(spark, sf):
    e = c.events(spark, sf)
    return jobs.cache_stats(e.select(F.concat(F.col("event_type"), F.lit(":"), F.col("event_id").cast("string")).alias("key")))


@query
def health_rollup(spark, sf):
    e = c.events(spark, sf)
    kind = F.when(F.col("event_type") == "signup", "database").otherwise(F.col("event_type"))
    return jobs.health_rollup(e.select(F.col("ts").cast("date").cast("string").alias("report"), kind.alias("component"), F.when(F.col("value") > 300, "down").otherwise("healthy").alias("status")))


# metrics


@query
def performance_stats(spark, sf):
    return metrics.performance_stats(c.events(spark, sf), ["event_type"], order=("ts", "event_id"), slow=150.0)


@query
def moving_average(spark, sf):
    return metrics.moving_average(c.events(spark, sf), ["user_id"], order=("ts", "event_id")).select("event_id", "moving_average")


@query
def slow_pages(spark, sf):
    e = c.events(spark, sf).withColumn("size_bytes", F.col("event_id") * 77)
    return metrics.slow_pages(e, threshold=150.0).select("event_id", "exceeded_by", "exceeded_percent", "size_kb", "size_mb")


@query
def histogram_buckets(spark, sf):
    e = c.events(spark, sf).withColumn("seconds", F.col("value") / 50)
    return metrics.histogram(e, ["event_type"], "seconds", metrics.DURATION_EDGES)


@query
def histogram_quantile(spark, sf):
    e = c.events(spark, sf).withColumn("seconds", F.col("value") / 50)
    return metrics.histogram_quantile(metrics.histogram(e, ["event_type"], "seconds", metrics.DURATION_EDGES), ["event_type"], 0.95)


@query
def size_histogram(spark, sf):
    return metrics.histogram(c.documents(spark, sf), ["lang"], "n_chars", metrics.SIZE_EDGES)


@query
def rate_5m(spark, sf):
    return metrics.rate(c.events(spark, sf), ["event_type"])


@query
def error_ratio(spark, sf):
    return metrics.ratio(c.events(spark, sf), F.col("event_type") == "error", window="1 hour")


@query
def mean_duration(spark, sf):
    return metrics.mean_duration(c.events(spark, sf), ["event_type"])


@query
def half_even_values(spark, sf):
    """Values with all their digits, and values that are ties."""
    tie = (F.col("event_id") % 4096) / 32.0 - 60
    return c.events(spark, sf).select("event_id", txt.half_even(F.col("value"), 3).alias("value"), txt.half_even(tie).alias("tie"))


@query
def alert_intervals(spark, sf):
    e = c.events(spark, sf)
    return metrics.alert_intervals(e, ["event_type"], F.col("value") > 5, hold=600, every=3600)


@query
def rate_limit_sliding(spark, sf):
    return metrics.sliding_counts(c.events(spark, sf), "user_id", seconds=6 * 3600, limit=1).select("event_id", "in_window", "allowed")


# state from row to row


@query
def rate_limit_admitted(spark, sf):
    return sequences.admitted_requests(c.events(spark, sf).select("event_id", "user_id", "ms"), "user_id", seconds=6 * 3600, limit=1).select("event_id", "admitted", "in_window")


@query
def archive_members(spark, sf):
    """The documents, packed into ZIP and TAR archives and read from these again."""
    folder = shared_folder(spark, "archives")
    number = F.pmod(F.xxhash64("doc_id"), F.lit(23))
    ending = F.when(number % 3 == 0, ".zip").when(number % 3 == 1, ".tar").otherwise(".tar.gz")
    packed = c.documents(spark, sf).select(F.concat(F.lit("part"), number.cast("string"), ending).alias("archive"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    archives.write_archives(packed, folder).write.format("noop").mode("overwrite").save()
    archives.register(spark)
    rows = spark.read.format("archives").option("partitionBytes", 1 << 20).load(folder)
    return rows.select(F.regexp_extract("member", r"/(doc.*)$", 1).alias("name"), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "error")


# streams, each run over all of its source from an empty state


@query
def stream_rate_5m(spark, sf):
    """Windows that the watermark has closed."""
    counted = streams.rates(c.arriving_events(spark, sf), ["event_type"]).select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")
    return streams.caught_up(counted, shared_folder(spark, "rate"))


@query
def stream_dedup(spark, sf):
    first = streams.first_within(c.arriving_events(spark, sf).select("event_id", "user_id", "ms", "ts"), "user_id")
    return streams.caught_up(first.select("event_id", "user_id", "ms"), shared_folder(spark, "dedup"))


@query
def stream_rate_limit(spark, sf):
    limited = streams.admitted(c.arriving_events(spark, sf).select("event_id", "user_id", "ms", "ts"), "user_id", seconds=86_400, limit=2)
    return streams.caught_up(limited.select("event_id", "admitted", "in_window"), shared_folder(spark, "limit"))


@query
def stream_expiry(spark, sf):
    return streams.caught_up(streams.expired(c.arriving_events(spark, sf), "user_id"), shared_folder(spark, "expiry"))


@query
def circuit_breaker(spark, sf):
    e = c.events(spark, sf).select("event_id", "user_id", "ms", (F.col("event_type") == "error").alias("failed"))
    return sequences.circuit_breaker(e, "user_id", ["ms", "event_id"], threshold=2, timeout_ms=6 * 3_600_000).select("event_id", "executed", "state")


@query
def lru_replay(spark, sf):
    e = c.events(spark, sf).select("event_id", "user_id", "ms", "event_type", F.floor("value").cast("long").alias("bytes_needed"))
    return sequences.lru_cache(e, "user_id", ["ms", "event_id"], "event_type", "bytes_needed", max_bytes=120, ttl_ms=5 * 86_400_000).select("event_id", "hit", "entries", "bytes")


@query
def chunk_merge(spark, sf):
    return sequences.merge_chunks(c.turns(spark, sf), "job_id", "page", "markdown")


@query
def recognition_mock(spark, sf):
    pages = c.table(spark, sf, "pages").select("page_id", F.element_at(F.array(*(F.lit(f) for f in recognition.FORMATS)), (F.col("page_id") % len(recognition.FORMATS) + 1).cast("int")).alias("output_format"))
    return recognition.recognise(pages, ["page_id"]).select("page_id", "output_format", "index", "label", "content", "confidence")
