import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspan.operators import geometry as g
from docspan.operators import validation as v


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id int, text string")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_line_boxes(spark):
    got = g.line_boxes(one(spark, "a\n\n b \r\nc"), ["doc_id"], page=(0, 0, 100, 100))
    assert rows(got.orderBy("line_no"), "text", "y", "h") == [("a", 0, 33), ("b", 33, 33), ("c", 66, 33)]
    eight = g.line_boxes(one(spark, "\n".join("abcdefgh")), ["doc_id"], page=(0, 0, 100, 50)).orderBy("line_no").collect()
    assert (eight[0].h, eight[-1].y, eight[-1].h) == (6, 42, 6)
    assert g.line_boxes(one(spark, None), ["doc_id"]).count() == 0


def test_line_elements(spark):
    got = g.line_elements(one(spark, "# T\n|a|b|\n\nplain"), ["doc_id"]).orderBy("index")
    assert rows(got, "label", "x1", "y1", "x2", "y2", "confidence") == [("title", 0, 0, 612, 264, 0.92), ("table", 0, 264, 612, 528, 0.92), ("text", 0, 528, 612, 792, 0.92)]
    assert rows(g.line_elements(one(spark, " \n"), ["doc_id"]), "label", "content", "y2") == [("text", " \n", 792)]
    assert rows(g.line_elements(one(spark, "{}"), ["doc_id"], output_format="json"), "label", "content") == [("json", "{}")]


def test_word_boxes(spark):
    got = g.word_boxes(one(spark, "Hello world\nThis is a test"), ["doc_id"]).orderBy("line_no", "word_no")
    assert rows(got, "word", "x", "y", "w", "h", "confidence") == [
        ("Hello", 0, 0, 500, 500, 0.855),
        ("world", 505, 0, 500, 500, 0.885),
        ("This", 0, 500, 363, 500, 0.855),
        ("is", 368, 500, 181, 500, 0.885),
        ("a", 554, 500, 90, 500, 0.915),
        ("test", 649, 500, 363, 500, 0.855),
    ]
    warned = v.box_warnings(got, ["word"], g.PAGE).collect()
    assert {(r.word, r.code, r.severity) for r in warned} == {("world", "BBOX_EXCEEDS_PAGE", "high"), ("test", "BBOX_EXCEEDS_PAGE", "high")}


def test_equal_words(spark):
    df = spark.createDataFrame([(1, "a b\nc", 0, 0, 100, 20)], "doc_id int, content string, x1 int, y1 int, x2 int, y2 int")
    got = g.word_boxes_equal(df, ["doc_id"]).orderBy("word_no")
    assert rows(got, "word", "x1", "x2", "confidence") == [("a", 0, 33, 0.93), ("b", 33, 66, 0.93), ("c", 66, 99, 0.93)]


def test_key_values(spark):
    got = g.key_values(one(spark, "Name: A\nAge: 30\nCity: B"), ["doc_id"]).orderBy("pair_no")
    assert rows(got, "key", "value", "key_x", "y", "key_w", "value_x", "value_w", "h", "confidence") == [("Name", "A", 0, 0, 400, 400, 600, 333, 0.9), ("Age", "30", 0, 333, 400, 400, 600, 333, 0.9), ("City", "B", 0, 666, 400, 400, 600, 333, 0.9)]
    assert rows(g.key_values(one(spark, "k= v"), ["doc_id"]), "key", "value", "confidence", "pattern") == [("k", "v", 0.85, "equals")]
    grouped = g.group_pairs(g.key_values(one(spark, "a:1\nb:2\na:3"), ["doc_id"]), ["doc_id"]).orderBy("order_no")
    assert rows(grouped, "key", "value") == [("a", "1"), ("a", "3"), ("b", "2")]
    sure = g.pair_confidence(g.key_values(one(spark, "Invoice Number: 1"), ["doc_id"]))
    assert rows(sure, "key_confidence", "value_confidence", "pair_confidence") == [(0.95, 0.93, 0.9)]


def test_tables(spark):
    cells = g.table_cells(one(spark, "\n".join(["Col1  Col2  Col3"] * 3)), ["doc_id"])
    assert rows(g.table_summary(cells, ["doc_id"]), "n_rows", "n_columns", "n_cells") == [(3, 3, 9)]
    assert set(rows(cells, "w", "h")) == {(333, 333)}
    assert rows(g.table_cells(one(spark, "|a|\tb|"), ["doc_id"]).orderBy("col_no"), "text", "x") == [("a", 0), ("b", 500)]


def test_sections(spark):
    got = g.sections(one(spark, "# H1\nx\n## H2\ny"), ["doc_id"]).orderBy("section_no")
    assert rows(got, "level", "heading", "content", "y", "h") == [(1, "H1", "x", 0, 500), (2, "H2", "y", 500, 500)]
    early = g.sections(one(spark, "p1\np2\n1. A"), ["doc_id"]).orderBy("section_no")
    assert rows(early, "level", "heading", "content") == [(0, "Preamble", "p1", ), (2, "A", "")]
    assert rows(g.sections(one(spark, "\np2"), ["doc_id"]), "heading", "content") == [("Preamble", "")]


def test_segments_and_chunks(spark):
    df = spark.createDataFrame([(1, 100, 300)], "doc_id int, w int, h int")
    assert rows(g.vertical_segments(df, ["doc_id"], "w", "h", 3, 10).orderBy("segment_no"), "top", "bottom") == [(0, 110), (90, 210), (190, 300)]
    pages = spark.createDataFrame([(1, i) for i in range(21)], "job int, page int")
    assert [r.chunk_no for r in g.page_chunks(pages, "job", "page").orderBy("page").collect()] == [0] * 10 + [1] * 10 + [2]
    box = spark.range(1).select(g.clamp(F.lit(-5), F.lit(2), F.lit(20), F.lit(9), F.lit(10), F.lit(5)).alias("b")).first().b
    assert tuple(box) == (0, 2, 10, 5)
    assert spark.range(1).select(g.clamp(F.lit(20), F.lit(2), F.lit(30), F.lit(9), F.lit(10), F.lit(5)).alias("b")).first().b is None


def test_overlaps(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 5, 0, 10, 10), (1, 2, 0, 60, 10, 10), (1, 3, 0, 62, 10, 200), (2, 0, 5, 0, 10, 10), (1, 4, 14, 9, 10, 10)], "page int, i int, x int, y int, w int, h int")
    got = v.word_overlaps(df, ["page"], ["i"]).collect()
    assert {(r.page, r.a_i, r.b_i, r.ratio) for r in got} == {(1, 0, 1, 0.5), (1, 2, 3, 0.8)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab :|=#-\t.", max_size=12), min_size=1, max_size=8))
def test_boxes_of_any_text(spark, lines):
    df = one(spark, "\n".join(lines))
    words = g.word_boxes(df, ["doc_id"]).orderBy("line_no", "word_no").collect()
    assert [w.word for w in words] == "\n".join(lines).split()
    for a, b in zip(words, words[1:], strict=False):
        assert b.line_no > a.line_no or b.x == a.x + a.w + 5
    assert all(0 <= w.y and w.y + w.h <= 1000 for w in words)
    assert all(0 <= b.y < 1000 for b in g.line_boxes(df, ["doc_id"]).collect())


@pytest.mark.parametrize("content, fmt, ok", [("{", "json", False), ('{"document_type":"x","fields":{}}', "json", True), ('{"document_type":"x","fields":[]}', "json", False), ('[{"headers":[],"rows":[[1]]}]', "table", True), ('[{"headers":[]}]', "table", False), ("[]", "key_value", False), ("any", "text", True), ('{"document_type":1,"raw_text":"","fields":{},"tables":[]}', "structured", True)])
def test_schema_check(spark, content, fmt, ok):
    assert spark.range(1).select(v.schema_ok(F.lit(content), F.lit(fmt)).alias("ok")).first().ok is ok


def test_round_trip(spark):
    df = one(spark, "# A\nx\n## B\ny z")
    assert rows(v.round_trip(df, g.sections(df, ["doc_id"]), ["doc_id"]), "similarity", "preserved", "code") == [(1.0, True, None)]
    lost = one(spark, "p\n" + "q " * 200 + "\n# A")
    assert v.round_trip(lost, g.sections(lost, ["doc_id"]), ["doc_id"]).first().code == "CONTENT_NOT_PRESERVED"


def test_sections_of_many_texts(spark):
    """Against plain reading of lines, several texts in a batch, blank and null ones among them."""
    import random
    import re

    rng = random.Random(4)
    lines = ["# One", "## Two ", "1. First", "1.2 Second", "1.2. Third", "text", " more text ", "", "#no", "####### seven", "3.a", "été", "# x\ry", "a\tb"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["", " \n ", None]
    want = []
    for k, text in enumerate(texts):
        if text is None or not text.strip():
            continue
        said = [x.strip(" \t\n\x0b\f\r") for x in text.split("\n")]
        heads = [i for i, x in enumerate(said) if re.match(r"^(#{1,6}|\d+\.|\d+\.\d+\.?)[ \t]+([^\r]+)\Z", x)]
        tall = 1000 // len(said)
        if heads[:1] != [0]:
            want.append((k, 0, 0, "Preamble", said[0], 0, tall))
        for n, (lo, hi) in enumerate(zip(heads, [*heads[1:], len(said)], strict=False)):
            mark, heading = said[lo].split(None, 1)
            level = len(mark) if mark[0] == "#" else mark.count(".") + 1
            want.append((k, n + 1, level, heading, "\n".join(x for x in said[lo + 1 : hi] if x), lo * tall, (hi - lo) * tall))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    cols = ["doc_id", "section_no", "level", "heading", "content", "y", "h"]
    assert sorted(rows(g.sections(df, ["doc_id"]), *cols)) == sorted(want)
    assert g.sections(df.limit(0), ["doc_id"]).count() == 0
    from docspan.functions.register import register

    register(spark)
    df.createOrReplaceTempView("headed")
    told = spark.sql("SELECT d.doc_id, s.* FROM headed d, LATERAL extract_sections(d.text, 1000) s")
    assert sorted(map(tuple, told.select(*cols).collect())) == sorted(want)


def test_sections_of_a_long_text(spark):
    text = "\n".join(f"# head {i}" if i % 3 == 0 else f"line {i}" for i in range(60_000))
    got = g.sections(one(spark, text), ["doc_id"])
    assert got.count() == 20_000 and got.filter("section_no = 7").first().content == "line 19\nline 20"


def test_sections_are_cut_a_few_texts_at_a_time(monkeypatch):
    """What a batch takes in Python follows SLICE, not the batch; sections are the same."""
    import pyarrow as pa

    said = [["# A", "x" * 40, "", "y"], ["p"], [], ["é" * 30, "# B"], ["# C", "z"]] * 3
    whole = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(15)), "said": pa.array(said), "heads": pa.array([[t.startswith("#") for t in x] for x in said])})
    want = pa.Table.from_batches([g._cut(whole.slice(2))]).to_pylist()
    monkeypatch.setattr(g, "SLICE", 70)
    parts = list(g._cut_at_heads(iter([whole.slice(2)])))
    assert pa.Table.from_batches(parts).to_pylist() == want and len(parts) > 5
    assert all(len(set(p.column("doc_id").to_pylist())) <= 3 for p in parts)
