import numpy as np
from pyspark.sql import functions as F

from docspan.llm import ann, html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x --><div class="ad">Buy <b>now</b></div>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Head&amp;line</h1><span>by me</span></header>
<p>One&nbsp;<b>two</b>three<br>four &lt;5 &#233; &copy;&am<p>Sec<i>o</i>nd
  line<ul><li>item<li>more</ul><aside>side</aside><form><input>f<button>go</button></form><div class="share">Share</div></article>
<section id="comments"><p>nice!</p></section></main><div class="sidebar">S</div><footer>&copy; me</footer>"""


def test_article_text():
    assert html.main_text(PAGE) == "Head&line One twothree four <5 é ©&am Second line item more"


def test_pages_of_other_kinds():
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("just words  here") == "just words here"
    assert html.main_text("<p>a<p>b") == "a b"
    assert html.main_text("<div>a</div>b<span>c</span>") == "a bc"
    assert html.main_text("<nav>menu") == ""
    assert html.main_text("a < b <b>c</b> 1<2") == "a < b c 1<2"
    assert html.main_text("<table><tr><td>x<td>y</table>") == "x y"
    assert html.main_text("<script>if (a<b) '<p>'</script>t<style>") == "t"
    assert html.main_text("<p hidden>x</p><p style='display: none'>y</p><p>z</p>") == "z"
    assert html.main_text("<div>" * 30_000 + "deep") == "deep"
    assert html.main_text("<div>" * 20_000 + "</p></section>" * 20_000 + "deep") == "deep"
    assert html.main_text("<p title=it's>a</p><p title='b'>c</p><p title=\"open>d</p>e") == "a c d e"
    assert html.main_text("<p>" + "long " * 200_000).count("long") == 200_000


def test_words_in_classes_tell_of_no_prose():
    page = '<article><p>Intro</p><h2 id="related-work">Related work</h2><p id="notice">Body one</p><p class="notice">Two</p><section class="social-history">Three</section><div class="ad">no</div><div class="cookie-notice box">no</div><div id="menu">no</div></article>'
    assert html.main_text(page) == "Intro Related work Body one Two Three"
    assert html.main_text('<div id="page-menu-wrapper"><p>All of it</p></div>') == "All of it"
    assert html.main_text('<div class="main-nav">x</div><div class="skip-link">x</div><p>y</p>') == "y"


def test_broken_markup_takes_linear_time():
    import time

    for bad in ("<a b='", '<a b="', "<a b=", "<!--", "<p title='x>", "</", "<a b='>'"):
        start = time.time()
        html.main_text(bad * (1_000_000 // len(bad)))
        assert time.time() - start < 5, bad


def test_templates_inside_articles(spark):
    rows = []
    for i in range(20):  # a line that most articles of the site hold goes, whatever its class
        rows.append((i, f"http://a.example/{i}", f"<article><h1>Title {i}</h1><p>Story {i} of its own.</p><p>Write to our desk!</p></article>"))
    for i in range(20, 40):  # near copies of an article keep their text
        rows.append((i, f"http://b.example/{i}", "<article>" + "".join(f"<p>Part {k}{'' if k != i % 8 else ' changed ' + str(i)}.</p>" for k in range(8)) + "</article>"))
    for i in range(40, 70):  # a line that some articles share stays
        rows.append((i, f"http://c.example/{i}", f"<article><p>Text {i}.</p>{'<p>A saying.</p>' if i < 50 else ''}</article>"))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == f"Title {i} Story {i} of its own."
    for i in range(20, 40):
        assert got[i] == " ".join(f"Part {k}{'' if k != i % 8 else ' changed ' + str(i)}." for k in range(8))
    for i in range(40, 70):
        assert got[i] == f"Text {i}." + (" A saying." if i < 50 else "")


def test_templates_go_and_copies_stay(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://Site.example/{i}", f"<body><div><p>Welcome to us</p><p>Call 123</p></div><div><p>Story {i} of its own</p></div></body>"))
    for i in range(12, 24):  # copies of one page, and an article that quotes the template
        rows.append((i, f"https://copies.example:80/{i}", "<body><div><p>The same story</p></div></body>"))
    for i in range(24, 36):
        rows.append((i, f"http://marked.example/{i}", f"<body><p>Banner text</p><article><p>All share this line</p><p>Text {i}</p></article></body>"))
    rows += [(90, None, "<p>no address</p>"), (91, "nonsense", None), (92, "http://site.example/x", ""), (None, "http://site.example/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("template", F.lit("h"))
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    for i in range(12):
        assert got[i] == (f"Story {i} of its own", len(f"Story {i} of its own"))
        assert got[12 + i][0] == "The same story"
        assert got[24 + i][0] == f"Text {24 + i}"
    assert got[90][0] == "no address" and got[91] == ("", 0) and got[92] == ("", 0) and got[None][0] == "Story 0 of its own"
    assert html.extract(df.limit(0)).collect() == []


def brute(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def searched(spark, ids, x, **kw):
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_few_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8)).astype(np.float32).astype(float)
    x[40:70] = x[40]  # ties
    ids = rng.permutation(90)
    assert searched(spark, ids, x) == brute(ids, x, 20)
    few = searched(spark, ids[:5] * 20, x[:5])
    assert all(len(v) == 4 for v in few.values()) and len(few) == 5


def clustered(n, d=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    x = centres[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


def recall_of(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])


def compared(level, x, q):
    """Share of the rows that the queries are compared with."""
    sizes = np.bincount(level.place(x), minlength=level.parts)
    return (ann.wanted([level], x[q], sizes, 21) @ sizes).mean() / len(x)


def test_parts_follow_the_table():
    assert [ann.parts_for(n, min(n, ann.SAMPLE)) for n in (20, 100, 500, 5000, 51_282, 10**9)] == [1, 2, 2, 16, 128, 128]
    x = clustered(5000)
    level = ann.fit(x, 5000, 20, 0.95)
    assert level.parts == 16 and compared(level, x, np.arange(0, 5000, 20)) < 0.5
    noise = np.random.default_rng(1).normal(size=(5000, 64))
    assert ann.fit(noise, 5000, 20, 0.95).parts == 16


def test_recall_of_the_learned_partition(spark):
    x, ids = clustered(4000), np.arange(4000)
    got, want = searched(spark, ids, x, sample=2000), brute(ids, x, 20)
    assert set(got) == set(want) and recall_of(got, want) >= 0.9
    for q, rows in got.items():
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[1], r[0])) and all(i != q for i, _ in rows)


def test_recall_with_two_levels_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 64)
    monkeypatch.setattr(ann, "MOST", 8)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 20)
    x, ids = clustered(4000, seed=5), np.random.default_rng(3).permutation(4000)
    got, want = searched(spark, ids, x, sample=1000), brute(ids, x, 20)
    assert set(got) == set(want) and recall_of(got, want) >= 0.9
    assert all(rows == sorted(rows, key=lambda r: (-r[1], r[0])) for rows in got.values())


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [0.2, 0.1]), (7, [0.2, 0.1]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("part", F.lit(2))
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 7), (20, 1, 0), (20, 2, 7)]
    assert ann.search(df.limit(0)).collect() == []


def test_queries_bring_back_no_more_from_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng, each = np.random.default_rng(8), []
    for n in (1600, 6400):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(n, 8)))], "id long, x array<double>")
        placed, levels = ann._placed(df, n, 20, 0.95, ann.SAMPLE)
        found = ann._met(placed, levels, "id % 20 = 0", n, 20)
        each.append(found.count() / (n / 20))
    assert each[1] < 1.5 * each[0]  # before, about four times as many
