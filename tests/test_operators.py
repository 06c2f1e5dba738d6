import datetime as dt
import gzip
import io
import lzma
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from docspan import schemas
from docspan.functions import options as o
from docspan.functions import text as t
from docspan.operators import assembly, jobs, metrics, recognition, sequences, validation
from docspan.sources import files
from docspan.streaming import streams


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_redaction(spark):
    said = F.lit("Mail a@b.co SSN 123-45-6789 card 1234 5678 9012 3456 tel 555-123-4567")
    assert value(spark, t.redact(said)) == "Mail [EMAIL_REDACTED] SSN [SSN_REDACTED] card [CREDIT_CARD_REDACTED] tel [PHONE_REDACTED]"
    assert value(spark, t.redact(t.redact(said))) == value(spark, t.redact(said))


def test_text_functions(spark):
    assert value(spark, t.normalise(F.lit(" a \r\n\r\n b\rc\n"))) == "a\nb\nc"
    assert value(spark, t.line_count(F.lit("a\nb\n"))) == 2 and value(spark, t.line_count(F.lit(""))) == 0
    assert value(spark, t.word_count(F.lit("  a b\tc "))) == 3
    assert value(spark, t.heuristic_confidence(F.lit("short"), F.lit(False), F.lit(False), F.lit(None).cast("string"))) == 0.5
    assert value(spark, t.heuristic_confidence(F.lit("x" * 101), F.lit(True), F.lit(True), F.lit("invoice"))) == 1.0
    score = t.complexity(F.lit(int(0.6 * 1048576)), F.lit(1000), F.lit(True), F.lit(False))
    assert value(spark, score) == 0.5 and value(spark, t.complexity_level(score)) == "medium"
    assert value(spark, t.similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert value(spark, t.similarity(F.lit(""), F.lit(None).cast("string"))) == 1.0 and value(spark, t.similarity(F.lit("a"), F.lit(""))) == 0.0
    assert value(spark, t.layout_key(F.lit("a"), F.lit("b"))).startswith("layout:fb8e20fc")
    assert value(spark, t.preprocess_key(F.lit("i"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == value(spark, F.sha2(F.lit("i:a=2,b=1"), 256))


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: o.bounded_int(F.lit("9"), 1200, 10, 7200), 10),
        (lambda: o.bounded_int(F.lit("x"), 1200, 10, 7200), 1200),
        (lambda: o.bounded_int(F.lit(" 9000 "), 1200, 10, 7200), 7200),
        (lambda: o.parse_bool(F.lit("TrUe")), True),
        (lambda: o.parse_bool(F.lit(None).cast("string")), False),
        (lambda: o.number(F.lit(" 1.5 ")), 1.5),
        (lambda: o.number(F.lit("one")), None),
        (lambda: o.field_list(F.lit(" a, ,b ")), ["a", "b"]),
        (lambda: o.valid_formats(F.lit("text, json"), F.lit("")), True),
        (lambda: o.valid_formats(F.lit("text,png"), F.lit("")), False),
        (lambda: o.valid_formats(F.lit("png"), F.lit("own")), True),
        (lambda: o.region_type(F.lit("Table_Caption_2")), "table"),
        (lambda: o.region_type(F.lit("table_caption")), "caption"),
        (lambda: o.region_type(F.lit("blob")), "text"),
        (lambda: o.region_prompt(F.lit("TABLE")), "Table Recognition:"),
        (lambda: o.region_prompt(F.lit("seal"), F.lit("")), "Text Recognition:"),
        (lambda: o.field_match(F.lit("Invoice-Number"), F.lit("number")), True),
        (lambda: o.field_match(F.lit("Date"), F.lit("number")), False),
        (lambda: o.line_label(F.lit("  $$x$$")), "formula"),
        (lambda: o.token_budget(F.lit(None).cast("int")), 2048),
        (lambda: o.token_budget(F.lit(9000), fast=True), 512),
        (lambda: o.page_token_budget(F.lit(5)), 64),
        (lambda: o.request_error(F.lit(""), F.lit(""), F.lit(None).cast("int")), "image_ref is required"),
        (lambda: o.request_error(F.lit("x"), F.lit(""), F.lit(64)), None),
        (lambda: o.clean_prompt(F.lit("a\x00b\tc")), "ab\tc"),
        (lambda: o.storage_path(F.lit("/a"), "/srv/store"), "/a"),
        (lambda: o.storage_path(F.lit("srv/store/a"), "/srv/store"), "/srv/store/a"),
        (lambda: o.storage_path(F.lit("a"), "/srv/store"), "/srv/store/a"),
        (lambda: o.megabytes(F.lit(1572864)), 1.5),
        (lambda: o.backoff_seconds(F.lit(9), 60.0), 60.0),
        (lambda: o.bounded_edge(F.lit(2000), F.lit(4000), 1000), 500),
        (lambda: o.prompt(F.lit(""), F.array(F.lit("a"), F.lit("b")), F.lit("json")), "Text Recognition: Extract only the following fields from this document: a, b. Return a flat JSON object where each key is one of the requested field names."),
    ],
)
def test_options(spark, column, want):
    assert value(spark, column()) == want


def test_boxes_convert(spark):
    box = F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("w"), F.lit(4).alias("h"))
    assert tuple(value(spark, schemas.to_xyxy(box))) == (1, 2, 4, 6)
    assert tuple(value(spark, schemas.to_xywh(schemas.to_xyxy(box)))) == (1, 2, 3, 4)


def test_region_join(spark):
    layout = spark.createDataFrame([(1, 0, "text", 0.9), (1, 1, "table", 0.9), (1, 2, "text", 0.7)], "page int, index int, type string, confidence double")
    content = spark.createDataFrame([(1, "region_0", "a", 0.8, ""), (1, "region_1", "b", 0.8, "broken")], "page int, region_id string, content string, confidence double, error string")
    got = [tuple(r) for r in assembly.join_regions(layout, content, ["page"]).orderBy("index").select("content", "confidence").collect()]
    assert got == [("a", 0.85), ("", 0.9), ("", 0.7)]


def test_pages(spark):
    pages = spark.createDataFrame([("j", 3, "b", 0.6, None), ("j", 1, "a", 0.8, None), ("j", 2, "x", 0.1, "bad"), ("k", 1, None, None, "bad")], "job_id string, page int, markdown string, confidence double, error string")
    got = {r.job_id: (r.markdown, r.page_count, r.confidence) for r in assembly.aggregate_pages(pages).collect()}
    assert got == {"j": ("a\n\n---\n\nb", 3, 0.7), "k": ("", 1, 0.0)}
    elements = spark.createDataFrame([(1, 0, "title", "T", None, 0.5), (1, 1, "formula", "x", None, 0.5), (1, 2, "text", "", None, 0.5)], "p int, index int, label string, content string, x1 int, confidence double")
    assert tuple(assembly.assemble_page(elements, ["p"]).first()) == (1, "## T\n\n$$\nx\n$$", 0.9)


def test_fields_and_envelope(spark):
    rows = [(1, 0, "text", '{"Invoice-Number":"7","x":"y"}'), (1, 1, "text", '{"x":"y"}'), (1, 2, "text", "The number is 7"), (1, 3, "text", "nothing")]
    df = spark.createDataFrame(rows, "p int, index int, label string, content string")
    kept = assembly.filter_fields(df, ["p"], ["number"]).orderBy("index")
    assert [(r["index"], r.content) for r in kept.collect()] == [(0, '{"Invoice-Number":"7"}'), (2, "The number is 7")]
    flat = lambda d, *a, **k: sorted(map(tuple, assembly.flat_fields(d, ["p"], *a, **k).select("p", "field", F.to_json("value")).collect()))
    assert flat(kept) == [(1, "Invoice-Number", '"7"')]
    rows = [(1, 0, None, "Total amount: 9 EUR\nDate\t1 May"), (1, 1, "text", '{"Total Amount":5,"amount":{"a":[1,2.5]},"x":1}'), (1, 2, "text", '{"amount":null}'), (1, 3, "table", "[1]"), (2, 0, "amount", "none"), (2, 1, "text", None)]
    df = spark.createDataFrame(rows, "p int, index int, label string, content string")
    kept = assembly.filter_fields(df, ["p"], ["total amount", "Date"])
    assert {(r.p, r["index"]): r.content for r in kept.collect()} == {(1, 0): rows[0][3], (1, 1): '{"Total Amount":5,"amount":{"a":[1,2.5]}}', (1, 2): '{"amount":null}'}
    assert flat(kept, ["total amount", "Date"]) == [(1, "Date", '"1 may"'), (1, "Total Amount", "5"), (1, "amount", "null")]
    assert flat(kept, ["total amount"], intended=True) == [(1, "Total Amount", "5"), (1, "amount", "null"), (1, "total amount", '"9 eur"')]
    assert assembly.filter_fields(df, ["p"], []).count() == 6
    twice = spark.createDataFrame([(1, '{"_postprocessed":false,"_version":"0","n":1}')], "id int, raw string")
    assert assembly.post_process(twice).first().result == '{"n":1,"_postprocessed":true,"_version":"1.0"}'
    raw = spark.createDataFrame([(1, '{"fields":{"a":1},"tables":[1],"document_type":"x"}'), (2, "plain"), (3, "[1]"), (4, "{}")], "id int, raw string")
    got = {r.id: (r.result, r.document_confidence) for r in assembly.post_process(raw).collect()}
    assert got[1][1] == 0.9 and got[1][0].endswith(',"_postprocessed":true,"_version":"1.0"}')
    assert got[2] == ('{"raw_text":"plain","document_type":"unknown","fields":{},"tables":[],"_postprocessed":true,"_version":"1.0"}', 0.5) and '"raw_text":"[1]"' in got[3][0]
    assert got[4][0] == '{"_postprocessed":true,"_version":"1.0"}'


def test_batches(spark):
    df = spark.createDataFrame([(1, "b", "COMPLETED"), (2, "b", "COMPLETED"), (3, "b", "FAILED"), (4, "c", "PENDING"), (5, "c", "FAILED"), (6, "d", "FAILED")], "id int, batch_id string, status string")
    got = {r.batch_id: (r.progress, r.state, r.uploaded) for r in jobs.batch_rollup(df).collect()}
    assert got == {"b": ("100.0%", "COMPLETED_WITH_ERRORS", 0), "c": ("50.0%", "PROCESSING", 1), "d": ("100.0%", "FAILED", 0)}


def test_queue(spark):
    at = lambda s: dt.datetime.fromtimestamp(s, dt.UTC)
    q = spark.createDataFrame([(1, 2, at(100)), (2, 0, at(200))], "job_id int, priority int, enqueued_at timestamp")
    assert [(r.job_id, r.score) for r in jobs.dequeue(q, 2).collect()] == [(2, 200), (1, 2000100)]
    assert jobs.dequeue(q, 1, intended=True).first().job_id == 1
    assert [r.position for r in jobs.queue_positions(q).orderBy("position").collect()] == [1, 2]
    four = spark.createDataFrame([(i, "QUEUED", None, None) for i in range(4)], "job_id int, status string, started_at timestamp, completed_at timestamp")
    assert jobs.queue_estimate(four).first().wait_s == 120.0 and jobs.queue_full(four, 4).first().full
    spans = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 20), (1, 3, 10, 30)], "k int, id int, a long, b long")
    assert [(r.id, r.holders, r.admitted) for r in jobs.concurrency(spans, "a", "b", ["k"], 1).orderBy("id").collect()] == [(1, 1, True), (2, 2, False), (3, 2, False)]


def test_percentiles(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 21)], "k int, ts int, value double")
    r = metrics.performance_stats(df, ["k"]).first()
    assert (r.p50, r.p95, r.p99, r.total, r.slow) == (11.0, 20.0, 20.0, 20, 0)
    assert metrics.performance_stats(df, ["k"], history=4, recent=2).first()[5:7] == (19.5, 19.0)


def test_histograms(spark):
    df = spark.createDataFrame([("a", x) for x in (0.5, 1.5, 1.5, 3.0)] + [("b", 9.0)], "k string, v double")
    h = metrics.histogram(df, ["k"], "v", (1.0, 2.0, 4.0))
    assert {(r.k, r.bucket): r.n for r in h.collect()} == {("a", 0): 1, ("a", 1): 3, ("a", 2): 4, ("a", 3): 4, ("b", 0): 0, ("b", 1): 0, ("b", 2): 0, ("b", 3): 1}
    assert dict(metrics.histogram_quantile(h, ["k"], 0.5).collect()) == {"a": 1.5, "b": 4.0}


def test_sliding_limit_leaves_out_the_edge(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, start + dt.timedelta(milliseconds=m)) for m in (0, 59_999, 60_000, 60_000)], "k int, ts timestamp_ntz")
    got = metrics.sliding_counts(df, "k", limit=2).orderBy("ts", "in_window").collect()
    assert [r.in_window for r in got] == [1, 2, 3, 3] and [r.allowed for r in got] == [True, True, False, False]


def test_alerts(spark):
    start = dt.datetime(2024, 1, 1)
    up = [1, 1, 1, 0, 1, 1]
    df = spark.createDataFrame([("k", start + dt.timedelta(minutes=i), u) for i, u in enumerate(up)], "k string, ts timestamp, up int")
    got = metrics.alert_intervals(df, ["k"], F.col("up") == 1, hold=120).collect()
    assert [(r.since.minute, r.fires_at.minute, r.until.minute, r.n_samples) for r in got] == [(0, 2, 2, 3)]


def test_limiter_that_counts_the_admitted(spark):
    df = spark.createDataFrame([(1, m) for m in (0, 10, 20, 60_000, 60_005, 60_011)], "k int, ms long")
    got = sequences.admitted_requests(df, "k", limit=2).orderBy("ms").collect()
    assert [r.admitted for r in got] == [True, True, False, True, False, True]


def test_breaker(spark):
    calls = [(0, True), (1, True), (2, False), (40_000, False), (40_001, False), (40_002, False), (40_003, True), (40_004, True), (90_000, True)]
    df = spark.createDataFrame([("s", i, ms, bad) for i, (ms, bad) in enumerate(calls)], "k string, i int, ms long, failed boolean")
    got = [(r.executed, r.state) for r in sequences.circuit_breaker(df, "k", ["i"], threshold=2).orderBy("i").collect()]
    assert got == [(True, "CLOSED"), (True, "OPEN"), (False, "OPEN"), (True, "HALF_OPEN"), (True, "HALF_OPEN"), (True, "CLOSED"), (True, "CLOSED"), (True, "OPEN"), (True, "OPEN")]


def test_cache(spark):
    steps = [("a", 4, 0), ("b", 4, 1), ("a", 4, 2), ("c", 4, 3), ("b", 4, 4), ("a", 4, 5), ("z", 99, 6), ("b", 4, 5000)]
    df = spark.createDataFrame([(1, i, *s) for i, s in enumerate(steps)], "k int, i int, name string, size long, ms long")
    got = [(r.hit, r.entries, r.bytes) for r in sequences.lru_cache(df, "k", ["i"], "name", "size", max_bytes=8, ttl_ms=1000).orderBy("i").collect()]
    assert got == [(False, 1, 4), (False, 2, 8), (True, 2, 8), (False, 2, 8), (False, 2, 8), (False, 2, 8), (False, 2, 8), (False, 2, 8)]


def test_chunks_merge(spark):
    df = spark.createDataFrame([(1, 0, "Header\nA\nB"), (1, 1, "Header\nB\n\n C "), (1, 2, "c\nD")], "k int, i int, text string")
    assert [r.line for r in sequences.merge_chunks(df, "k", "i").orderBy("line_no").collect()] == ["Header", "A", "B", "C", "D"]
    far = spark.createDataFrame([(1, 0, "x\na\nb\nx")], "k int, i int, text string")
    assert [r.line for r in sequences.merge_chunks(far, "k", "i", recent=2).orderBy("line_no").collect()] == ["x", "a", "b", "x"]


def test_engines(spark):
    pages = spark.createDataFrame([(1, "text"), (2, "json")], "p int, output_format string")
    got = recognition.recognise(pages, ["p"])
    assert got.filter("p = 1").count() == 3
    assert got.filter("p = 2").select(validation.schema_ok(F.col("content"), F.col("output_format")).alias("ok")).first().ok

    def broken():
        def ask(page):
            raise ValueError("no sight")

        return ask

    assert {r.error for r in recognition.recognise(pages, ["p"], broken).collect()} == {"no sight"}
    regions = recognition.detect_layout(pages, ["p"], lambda: lambda page: [("text", 0, 0, 5, 5, 0.4), ("Title", 0, 0, 5, 5, None)])
    assert assembly.filter_regions(regions).count() == 2
    docs = spark.createDataFrame([("a@b.co",), (None,)], "text string")
    assert {r.text for r in recognition.named_entity_redaction(docs).collect()} == {"[EMAIL_REDACTED]", None}
    assert {r.text for r in recognition.named_entity_redaction(docs, engine=lambda: str.upper).collect()} == {"A@B.CO", None}


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_files(spark, tmp_path):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t_:
        info = tarfile.TarInfo("in/deep.txt")
        info.size = 4
        t_.addfile(info, io.BytesIO(b"deep"))
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.TXT").write_bytes(b"hello")
    (tmp_path / "c.zip").write_bytes(archive(x__txt="x", skip__exe="no", sheet__xlsx="s", inner__zip=archive(y__csv="y"), t__tgz=tar.getvalue()))
    (tmp_path / "d.txt.gz").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "e.zip").write_bytes(b"broken")
    (tmp_path / "j.pptx").write_bytes(b"slides")
    (tmp_path / "k.txt.xz").write_bytes(lzma.compress(b"small"))
    (tmp_path / "l.log").write_bytes(b"line")
    (tmp_path / "f.rar").write_bytes(b"rar")
    (tmp_path / "g.png").write_bytes(b"\x89PNG")
    (tmp_path / "h.pdf").write_bytes(b"%PDF")
    (tmp_path / "i.exe").write_bytes(b"x" * 50)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.ingest(spark, str(tmp_path), limit=40_000).collect()}
    assert {k: v.kind for k, v in got.items()} == {"a.txt": "text", "b.TXT": "text", "c.zip": "archive", "d.txt.gz": "archive", "e.zip": "archive", "f.rar": "archive", "g.png": "image", "h.pdf": "pdf", "i.exe": "unsupported", "j.pptx": "office", "k.txt.xz": "archive", "l.log": "text"}
    assert got["a.txt"].hash == got["b.TXT"].hash and got["i.exe"].error and got["a.txt"].error is None
    assert files.ingest(spark, str(tmp_path), limit=10).filter("path like '%i.exe'").first().error.endswith("over the limit")
    all_ = files.contents(spark, str(tmp_path))
    inside = {r.member: (bytes(r.content) if r.content is not None else None, r.error) for r in files.flatten_archives(all_).collect()}
    assert inside["c.zip/x.txt"] == (b"x", None) and inside["c.zip/inner.zip/y.csv"] == (b"y", None) and inside["c.zip/t.tgz/in/deep.txt"] == (b"deep", None)
    assert inside["c.zip/sheet.xlsx"] == (b"s", None) and inside["k.txt"] == (b"small", None)
    assert inside["d.txt"] == (b"packed", None) and inside["e.zip"][1].startswith("cannot be read") and inside["f.rar"][1] and "c.zip/skip.exe" not in inside
    fresh = files.new_files(files.ingest(spark, str(tmp_path), "*.[tT][xX][tT]"), spark.createDataFrame([("0",)], "hash string"))
    assert [r.path.rsplit("/", 1)[1] for r in fresh.collect()] == ["a.txt"]
    pages = {(r.path.rsplit("/", 1)[1], r.page): r.error for r in files.rasterise(all_.filter("path like '%.png' or path like '%.pdf'")).collect()}
    assert pages == {("g.png", 1): None, ("h.pdf", None): "no renderer"}
    drawn = files.rasterise(all_.filter("path like '%.pdf'"), lambda data: [data, data])
    assert [r.page for r in drawn.orderBy("page").collect()] == [1, 2]
    assert {r.text for r in files.read_text(all_.filter("path like '%a.txt'")).collect()} == {"hello"}
    assert bytes(value(spark, files.decode_image(F.lit("data:image/png;base64,aGk=")))) == b"hi"
    results = spark.createDataFrame([("j1", "x"), ("j2", "y")], "job_id string, markdown string")
    files.write_results(results, str(tmp_path / "out"))
    assert files.read_results(spark, str(tmp_path / "out"), "job_id string, markdown string").count() == 2


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=37 * i), "error" if i % 4 == 0 else "view", f"h{i % 9}", i % 2, 37_000 * i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, event_type string, hash string, user int, ms long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: streams.read_folder(spark, str(tmp_path / "in"), df.schema)
    got = streams.available(streams.rates(src(), ["event_type"]), "s_rates", str(tmp_path / "c1"), "complete")
    want = metrics.rate(df, ["event_type"])
    assert {(r.event_type, r.window_start, r.n) for r in got.collect()} == {(r.event_type, r.window_start, r.n) for r in want.collect()}
    ratios = streams.available(streams.error_ratios(src(), F.col("event_type") == "error"), "s_ratio", str(tmp_path / "c2"), "complete")
    assert ratios.agg(F.sum("errors")).first()[0] == 15
    seen = streams.available(streams.first_seen(src().select("hash", "ts")), "s_first", str(tmp_path / "c3"))
    assert sorted(r.hash for r in seen.collect()) == [f"h{i}" for i in range(9)]
    with streams.keyed_state(spark):
        limited = streams.available(streams.admitted(src().select("id", "user", "ms", "ts"), "user", seconds=100, limit=1), "s_limit", str(tmp_path / "c4"))
    batch = sequences.admitted_requests(df.select("id", "user", "ms"), "user", seconds=100, limit=1)
    assert {(r.id, r.admitted) for r in limited.collect()} == {(r.id, r.admitted) for r in batch.collect()}
    taken = []
    q = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).select(F.col("id").alias("job_id"), F.lit(0).alias("priority"), F.col("ts").alias("enqueued_at"))
    run = streams.drain(q, lambda part: taken.extend(r.job_id for r in part.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c5")).start()
    run.awaitTermination(60)
    assert taken == list(range(10))
    out = streams.write_metrics(streams.rates(src(), ["event_type"]), str(tmp_path / "metrics"), str(tmp_path / "c6")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "metrics")).count() >= 1
