"""Main text of web pages, with site templates removed.

1. Each page is cut into elements; every element that holds text gets a hash of its subtree.
2. Spark counts on how many different pages of a host each subtree occurs.
3. Subtrees that recur on many of a host's pages are its template and are deleted, as are elements whose
   name, role or class says that they are no part of an article.

Where a page marks its article (article, main, role=main or an equivalent class), what is outside of it
goes.  Inside it, a block is the host's template only if it recurs beside many different other blocks, so
copies and near copies of an article keep their text; and words in classes tell of no paragraph or heading.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import BROADCAST_ROWS, stored

# a quote counts after "=" and if another follows; a tag without an end runs to the end of the page
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[\"'])*+)(>|\Z)", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Names of HTML elements by how they are treated, roles, and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
GONE = frozenset("head title script style noscript template iframe svg canvas object audio video nav footer aside form button select option textarea dialog menu math map".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: A class tells of an element if all its parts are among these words, one of them not a place or a shape.
GONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notification newsletter subscribe subscription popup modal overlay comment comments commentlist disqus respond related recommended recommendations share sharing social widget pagination pager login signup skip".split()
)
PLACES = frozenset("the site page main top bottom left right side inner outer box block bar container wrapper wrap list area section item items links link icons buttons banner header content form message policy".split())
OUTER_CLASS = re.compile(r"(?:^|\s)(?:header|masthead|site-header|page-header|top-?bar|banner)(?:$|\s)", re.I)
MAIN_CLASS = re.compile(r"(?:^|\s)(?:article|article-?body|article-content|post|post-?body|post-content|entry|entry-content|main-content|content|main|story|story-body)(?:$|\s)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote li dd dt td th figcaption h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LOOSE_BLOCKS = PROSE | frozenset("article main body html".split())
SCOPE = frozenset("article main section div table ul ol dl td th body html nav aside header footer form blockquote".split())


@dataclass
class Page:
    """Elements in page order, each with its parent's number, and the pieces of text."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    attrs: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    hash: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    pieces: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """Forgiving: stray ends are skipped, open elements end with their parent or with the page, and
    a block ends an open paragraph."""
    page, open_, parts, pos, size = Page(), [0], [[]], 0, len(source)
    live: Counter[str] = Counter()  # open elements by tag
    token = _TOKEN

    def text(raw: str) -> None:
        if raw:
            said = html.unescape(raw) if "&" in raw else raw
            page.pieces.append((open_[-1], said))
            kept = said.split()
            if kept:
                page.chars[open_[-1]] += sum(map(len, kept))
                parts[-1].append(" ".join(kept))

    def start(tag: str, attrs: str) -> None:
        if tag not in INLINE:
            page.pieces.append((open_[-1], " "))
        page.tag.append(tag)
        page.attrs.append(attrs)
        page.parent.append(open_[-1])
        page.hash.append(0)
        page.chars.append(0)
        open_.append(len(page.tag) - 1)
        parts.append([tag])
        live[tag] += 1

    def end() -> None:
        i, own = open_.pop(), parts.pop()
        live[page.tag[i]] -= 1
        page.hash[i] = xxhash.xxh64_intdigest("\x00".join(own).encode("utf-8", "replace")) >> 1
        parts[-1].append(f"\x01{page.hash[i]:x}")
        page.chars[page.parent[i]] += page.chars[i]
        if page.tag[i] not in INLINE:
            page.pieces.append((page.parent[i], " "))

    def end_through(tags: tuple[str, ...], scope: frozenset[str]) -> None:
        """Ends open elements up to the nearest one of these tags, unless the scope ends first."""
        if not any(live[t] for t in tags):
            return
        for depth in range(len(open_) - 1, 0, -1):
            name = page.tag[open_[depth]]
            if name in tags:
                while len(open_) > depth:
                    end()
                return
            if name in scope:
                return

    while pos < size:
        m = token.search(source, pos)
        if m is not None and m[2] is not None and not m[4] and token is _TOKEN:
            token = _LOOSE  # quotes that pair up wrongly: from here on they count for nothing
            m = token.search(source, m.start())
        if m is None:
            text(source[pos:])
            break
        text(source[pos : m.start()])
        if m[2] is not None and not m[4]:
            break
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in VOID:
                continue
            end_through((tag,), frozenset() if tag in SCOPE else SCOPE - {tag})
            continue
        if tag not in INLINE and tag not in VOID:
            end_through(("p",), SCOPE)
        if tag in CLOSES:
            end_through(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        start(tag, m[3])
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            end()
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, pos)
            if tag not in ("script", "style"):
                text(source[pos : close.start() if close else size])
            pos = close.end() if close else size
            end()
    while len(open_) > 1:
        end()
    return page


def _attr(attrs: str, *names: str) -> str:
    return " ".join(x or y or z for name, x, y, z in _ATTR.findall(attrs) if name.lower() in names)


@dataclass
class Layout:
    """What a page's elements say of themselves, by element."""

    gone: list[bool]
    inside: list[bool]  # of what is marked as the article
    marked: set[int]


def layout(page: Page) -> Layout:
    n = len(page.tag)
    gone, inside = [False] * n, [False] * n
    for i in range(1, n):
        gone[i] = gone[page.parent[i]] or _out(page.tag[i], page.attrs[i])
    marked: set[int] = set()
    for want in ("article", "main", "class"):
        for i in range(1, n):
            tag, attrs = page.tag[i], page.attrs[i]
            hit = tag == "article" if want == "article" else tag == "main" or "role" in attrs and "main" in _attr(attrs, "role").split() if want == "main" else bool(attrs) and tag in ("div", "section") and bool(MAIN_CLASS.search(_attr(attrs, "class", "id", "itemprop")))
            if hit and not gone[i] and page.chars[i]:
                marked.add(i)
        if marked:
            break
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or i in marked
    return Layout(gone, inside, marked)


def article_blocks(page: Page, seen: Layout) -> dict[int, int]:
    """Innermost blocks with text inside the marked article, each with a hash that stands for what else the
    article holds: the least hash of its other blocks.  An article of one block has none."""
    full: set[int] = set()
    out = []
    for i in range(len(page.tag) - 1, 0, -1):
        if not page.chars[i] or page.tag[i] in INLINE:
            continue
        if seen.inside[i] and not seen.gone[i] and i not in seen.marked and i not in full:
            out.append(i)
        up = page.parent[i]
        while up > 0 and up not in full:
            full.add(up)
            up = page.parent[up]
    least = sorted({page.hash[i] for i in out})[:2]
    return {i: least[page.hash[i] == least[0]] for i in out} if len(least) > 1 else {}


def within(h: int) -> int:
    """The hash under which a block counts inside articles."""
    return (h * 0x9E3779B97F4A7C15 + 0x632BE59B) % (1 << 63)


def main_text(source: str | None, template: frozenset[int] = frozenset()) -> str:
    """The article's text: references decoded, white space in a block as one space, blocks joined by
    one space.  template: hashes of the site's recurring subtrees."""
    if not source:
        return ""
    page = parse(source)
    seen = layout(page)
    gone, inside, marked = seen.gone, seen.inside, seen.marked
    n = len(page.tag)
    header = [False] * n
    for i in range(1, n):
        up, tag = page.parent[i], page.tag[i]
        outer = tag == "header" or tag not in LOOSE_BLOCKS and bool(page.attrs[i]) and bool(OUTER_CLASS.search(_attr(page.attrs[i], "class")))
        # a header goes; in an article its headings stay
        header[i] = (header[up] or outer) and not (inside[i] and tag in HEADINGS)
        if template and i not in marked:
            gone[i] = gone[i] or (page.hash[i] if not inside[i] else within(page.hash[i])) in template
        gone[i] = gone[i] or gone[up]
    out = [t for i, t in page.pieces if not gone[i] and not header[i] and (inside[i] or not marked)]
    return " ".join("".join(out).split())


def _out(tag: str, attrs: str) -> bool:
    if tag in GONE:
        return True
    if not attrs:
        return False
    low = attrs.lower()
    if "role" in low and GONE_ROLES.intersection(_attr(attrs, "role").lower().split()):
        return True
    if "hidden" in low and (re.search(r"(?:^|\s)hidden(?:\s|=|$)", low) or "true" in _attr(attrs, "aria-hidden").lower()) or "none" in low and re.search(r"display\s*:\s*none", _attr(attrs, "style").lower()):
        return True
    if tag in LOOSE_BLOCKS and not (tag in ("article", "section") and "comment" in low):
        return False
    return "class" in low and any(map(_telling, _attr(attrs, "class").lower().split())) or "id" in low and _attr(attrs, "id").lower() in GONE_WORDS


def _telling(name: str) -> bool:
    parts = [x for x in re.split("[-_]+", name) if x]
    return bool(GONE_WORDS.intersection(parts)) and all(x in GONE_WORDS or x in PLACES for x in parts)


def subtree_hashes(source: str | None) -> list[tuple[int, int | None]]:
    """Distinct hashes of a page's elements that hold text, each with what it counts by: nothing for the page
    itself, or for blocks of a marked article the hash of its other blocks."""
    if not source:
        return []
    page = parse(source)
    own = {(h, None) for h, c, t in zip(page.hash, page.chars, page.tag, strict=True) if c and t not in ("#page", "html", "body", "head")}
    return [*own, *{(within(page.hash[i]), other) for i, other in article_blocks(page, layout(page)).items()}]


def site_templates(pages: DataFrame, min_pages: int, min_share: float, url_col: str, html_col: str) -> DataFrame:
    """(host, template): for each host the hashes of subtrees that occur on min_pages of its different pages
    and on min_share of them; blocks of articles, with so many different other blocks.  A host has at most
    2 / min_share times as many of them as its pages have elements on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            host, digest, found = [], [], []
            for h, d, s in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True):
                got = [*subtree_hashes(s), (-1, None)]  # -1 stands for the page itself
                host += [h] * len(got)
                digest += [d if by is None else by for _, by in got]
                found += [x for x, _ in got]
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(digest, pa.int64()), pa.array(found, pa.int64())], ["host", "digest", "h"])

    src = pages.select(_host(url_col), F.xxhash64(f"`{html_col}`").alias("digest"), F.col(f"`{html_col}`").alias("html")).filter("host is not null")
    seen = src.mapInArrow(run, "host long, digest long, h long").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    seen = stored(seen.filter(F.col("n") >= min_pages), "subtrees")
    whole = seen.filter("h = -1").select("host", F.col("n").alias("pages"))
    often = seen.filter("h <> -1").join(whole, "host").filter(F.col("n") >= F.col("pages") * min_share)
    return often.groupBy("host").agg(F.collect_list("h").alias("template"))


def _host(url_col: str):
    name = F.lower(F.regexp_extract(url_col, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(name != "", F.xxhash64(name)).alias("host")


def extract(pages: DataFrame, min_pages: int = 8, min_share: float = 0.5, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All rows and columns of pages with text (never null) and n_chars, its code points.

    A null page is empty; a very long one is read whole, in time that grows with its length.  Pages without a host in their url have no site template; what elements
    say of themselves still counts.  Repeated pages count once for templates and each keep their
    row.  Columns of pages named text or n_chars are replaced.  An empty table gives an empty result.
    """
    src = pages.drop("text", "n_chars")
    templates = stored(site_templates(src, min_pages, min_share, url_col, html_col), "templates")
    hosts = templates.select("host", F.explode("template")).limit(BROADCAST_ROWS + 1).count()
    templates = F.broadcast(templates) if hosts <= BROADCAST_ROWS else templates

    @F.pandas_udf("string")
    def texts(source: pd.Series, template: pd.Series) -> pd.Series:
        held: dict[bytes, frozenset[int]] = {}
        out = []
        for s, t in zip(source, template, strict=True):
            known = frozenset()
            if t is not None and len(t):
                key = t.tobytes()
                known = held.get(key)
                if known is None:
                    known = held[key] = frozenset(t.tolist())
            out.append(main_text(s, known))
        return pd.Series(out, dtype=object)

    # the page goes in one struct, so that its columns can have any names
    whole = src.select(F.struct(*(F.col(f"`{c}`") for c in src.columns)).alias("page"), _host(url_col))
    done = whole.join(templates, "host", "left").withColumn("text", texts(F.col(f"page.`{html_col}`"), F.col("template")))
    return done.select(*(F.col(f"page.`{c}`").alias(c) for c in src.columns), "text", F.char_length("text").cast("long").alias("n_chars"))
