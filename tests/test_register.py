from docspan.functions.register import register
from docspan.operators import geometry


def test_sql_functions(spark):
    register(spark)
    text = "Name: A\n\n a@b.co  x | y\nk = v"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    df.createOrReplaceTempView("docs_for_sql")
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT redact_pii(text) FROM docs_for_sql WHERE doc_id = 1")[0][0] == text.replace("a@b.co", "[EMAIL_REDACTED]")
    lines = rows("SELECT l.line_no, l.line, l.y, l.h FROM docs_for_sql d, LATERAL extract_lines(d.text, 1000, 1000) l")
    want = [tuple(r) for r in geometry.line_boxes(df, ["doc_id"]).select("line_no", "text", "y", "h").collect()]
    assert sorted(lines) == sorted(want)
    words = rows("SELECT w.line_no, w.word_no, w.word FROM docs_for_sql d, LATERAL extract_words(d.text) w")
    assert sorted(words) == sorted(tuple(r) for r in geometry.word_boxes(df, ["doc_id"]).select("line_no", "word_no", "word").collect())
    assert rows("SELECT p.key, p.value FROM docs_for_sql d, LATERAL extract_key_values(d.text) p ORDER BY p.pair_no") == [("Name", "A"), ("k", "v")]
    cells = rows("SELECT c.row_no, c.col_no, c.cell FROM docs_for_sql d, LATERAL extract_table(d.text) c")
    assert sorted(cells) == sorted(tuple(r) for r in geometry.table_cells(df, ["doc_id"]).select("row_no", "col_no", "text").collect())
    assert rows("SELECT validate_bbox(0, 0, 11, 5, 10, 10), validate_bbox(0, 0, 1, 1, 10, 10), score_confidence('x', true, false, 'letter'), text_similarity('abcd', 'bcde')") == [("BBOX_EXCEEDS_PAGE", None, 0.8, 0.75)]
