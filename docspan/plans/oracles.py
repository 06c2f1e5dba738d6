"""DuckDB twins of the registered queries, written on their own from the operators' definitions."""

from __future__ import annotations

JOBS = """(SELECT o_orderkey AS id, o_custkey AS batch_id, CASE WHEN o_orderkey % 17 = 0 THEN 'FAILED' WHEN o_orderstatus = 'F' THEN 'COMPLETED'
  WHEN o_orderstatus = 'P' THEN 'PROCESSING' ELSE 'UPLOADED' END AS status, o_orderdate AS created_at FROM orders)"""
QUEUE = """(SELECT o_orderkey AS job_id, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END AS priority, epoch(o_orderdate)::BIGINT AS t0,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PROCESSING' ELSE 'QUEUED' END AS status, floor(o_totalprice)::BIGINT AS ms FROM orders)"""
TURNS = "(SELECT conv_id AS job_id, turn AS page, text AS markdown, 0.5::DOUBLE + turn % 5 / 10.0::DOUBLE AS confidence, CASE WHEN role = 'system' THEN 'unreadable' END AS error FROM conversations)"
EVENTS = "(SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"
REGIONS = """(SELECT page_id, i - 1 AS index, raw[i] AS raw_type, CASE WHEN (i - 1) % 7 <> 0 THEN (i - 1) % 10 / 10.0::DOUBLE END AS score,
  coalesce(CASE WHEN (i - 1) % 7 <> 0 THEN (i - 1) % 10 / 10.0::DOUBLE END, 1.0) AS confidence
  FROM (SELECT page_id, raw, unnest(range(1, len(raw) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) AS raw FROM pages WHERE html IS NOT NULL)))"""
CONTENTS = f"""(SELECT page_id, 'region_' || index AS region_id, upper(raw_type) AS content, index % 4 / 4.0::DOUBLE AS confidence, CASE WHEN index % 11 = 10 THEN 'no text' ELSE '' END AS error
  FROM {REGIONS} WHERE index % 5 <> 4)"""


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def redact(x: str) -> str:
    for name, pattern in (
        ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
        ("PHONE", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
        ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
        ("CREDIT_CARD", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '[{name}_REDACTED]', 'g')"
    return x


#: Every line with its number from 0, of texts that aren't blank, with the number of lines.
LINES = r"(SELECT doc_id, i - 1 AS line_no, l[i] AS line, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE regexp_matches(text, '\S'))))"
#: Lines that aren't blank, numbered among themselves.
FULL = r"(SELECT doc_id, i - 1 AS line_no, l[i] AS line, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\f]'), lambda x: regexp_matches(x, '\S')) AS l FROM documents)))"
LABEL = f"CASE WHEN {strip('line')} LIKE '#%' THEN 'title' WHEN {strip('line')} LIKE '|%' AND {strip('line')} LIKE '%|' THEN 'table' WHEN contains(line, '$$') OR contains(line, '\\frac') OR contains(line, '\\int') THEN 'formula' ELSE 'text' END"
ELEMENTS = f"""(SELECT doc_id, line_no AS index, {LABEL} AS label, line AS content, 0 AS x1, least(line_no * greatest(12, 792 // n), 791) AS y1, 612 AS x2,
  least(792, least(line_no * greatest(12, 792 // n), 791) + greatest(12, 792 // n)) AS y2, 0.92::DOUBLE AS confidence FROM {FULL}
  UNION ALL SELECT doc_id, 0, 'text', coalesce(text, ''), 0, 0, 612, 792, 0.92::DOUBLE FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '\\S'))"""
WORDS = rf"""(WITH found AS (SELECT doc_id, line_no, 1000 // n AS tall, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS w FROM {LINES}),
  each AS (SELECT doc_id, line_no, tall, i - 1 AS word_no, w[i] AS word, list_sum(list_transform(w, lambda x: length(x))) AS total FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM found)),
  wide AS (SELECT *, greatest(10, floor(1000.0::DOUBLE * (length(regexp_replace(word, '[^\p{{L}}\p{{M}}\p{{N}}_\s-]', '', 'g'))::DOUBLE / total::DOUBLE))::INT) AS w FROM each)
  SELECT doc_id, line_no, word_no, word, coalesce(sum(w + 5) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS x,
  line_no * tall AS y, w, tall AS h, round(least(1.0::DOUBLE, 0.9::DOUBLE * (0.95::DOUBLE + 0.1::DOUBLE * (word_no % 3) / 3.0::DOUBLE)), 3) AS confidence FROM wide)"""
PAIRS = rf"""(WITH l AS (SELECT doc_id, line_no, 1000 // n AS h, {strip('line')} AS line FROM {LINES}),
  p AS (SELECT *, CASE WHEN regexp_matches(line, '^([^:]+):\s*(.+)$') THEN 'colon' WHEN regexp_matches(line, '^([^=]+)=\s*(.+)$') THEN 'equals' END AS pattern FROM l)
  SELECT doc_id, line_no AS pair_no, {strip("CASE pattern WHEN 'colon' THEN regexp_extract(line, '^([^:]+):\\s*(.+)$', 1) ELSE regexp_extract(line, '^([^=]+)=\\s*(.+)$', 1) END")} AS key,
  {strip("CASE pattern WHEN 'colon' THEN regexp_extract(line, '^([^:]+):\\s*(.+)$', 2) ELSE regexp_extract(line, '^([^=]+)=\\s*(.+)$', 2) END")} AS value, h, pattern FROM p WHERE pattern IS NOT NULL)"""
CELLS = rf"""(SELECT doc_id, line_no AS row_no, i - 1 AS col_no, c[i] AS text, (i - 1) * (1000 // len(c)) AS x, line_no * (1000 // n) AS y, 1000 // len(c) AS w, 1000 // n AS h FROM
  (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, line_no, n, list_filter(list_transform(regexp_split_to_array({strip('line')}, '\s{{2,}}|\t|\|'), lambda s: {strip('s')}), lambda s: s <> '') AS c FROM {LINES})))"""
HEADED = "(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 4 = 1 THEN '## ' || l WHEN (i - 1) % 4 = 3 THEN '2.1 ' || l ELSE l END), chr(10)) AS text FROM documents)"
KIND = {
    "text": "text", "title": "title", "table": "table", "figure": "figure", "formula": "formula", "list": "list_item", "header": "header", "footer": "footer", "caption": "caption", "reference": "reference",
    "abstract": "abstract", "code": "code", "seal": "seal", "handwriting": "handwriting", "paragraph": "text", "heading": "title", "table_caption": "caption", "figure_caption": "caption", "footnote": "text", "page_number": "text",
}


def region_type(x: str) -> str:
    exact = " ".join(f"WHEN lower({x}) = '{k}' THEN '{v}'" for k, v in KIND.items())
    part = " ".join(f"WHEN contains(lower({x}), '{k}') THEN '{v}'" for k, v in KIND.items())
    return f"CASE {exact} {part} ELSE 'text' END"


JOINED = f"""(SELECT r.page_id, r.index, {region_type('r.raw_type')} AS label, coalesce(c.content, '') AS content,
  round(CASE WHEN c.confidence > 0 THEN (r.confidence + c.confidence) / 2 ELSE r.confidence END, 6) AS confidence
  FROM {REGIONS} r LEFT JOIN {CONTENTS} c ON c.page_id = r.page_id AND c.region_id = 'region_' || r.index AND c.error = '')"""
EDGES = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)


def buckets(table: str, key: str, value: str, edges: tuple[float, ...]) -> str:
    rows = ", ".join(f"({i}, {e}::DOUBLE)" for i, e in enumerate(edges)) + f", ({len(edges)}, NULL)"
    return f"(SELECT {key}, bucket, le, count(*) FILTER (WHERE le IS NULL OR {value} <= le) AS n FROM {table} CROSS JOIN (VALUES {rows}) e(bucket, le) WHERE {value} IS NOT NULL GROUP BY ALL)"


ORACLES: dict[str, str] = {
    "pii_redaction": f"SELECT doc_id, {redact('text')} AS redacted, {redact('text')} <> text AS changed FROM documents",
    "pii_counts_by_lang": f"SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE {redact('text')} <> text) AS n_changed FROM documents GROUP BY lang",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, 'layout:' || sha256(text || lang) AS layout_key FROM documents",
    "normalised_text": rf"SELECT doc_id, t AS normalised, length(t) AS n FROM (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: {strip('x')}), lambda x: x <> ''), chr(10)) AS t FROM documents)",
    "heuristic_confidence": "SELECT doc_id, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN source = 'src0' THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN contains(text, '|') THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN lang = 'en' THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN length(text) > 100 THEN 0.1 ELSE 0 END::DOUBLE), 4) AS score FROM documents",
    "line_and_word_counts": r"SELECT doc_id, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END)::INT AS n_lines, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS n_words FROM documents",
    "complexity_scores": """SELECT doc_id, s AS score, CASE WHEN s < 0.3 THEN 'low' WHEN s < 0.6 THEN 'medium' WHEN s < 0.8 THEN 'high' ELSE 'very_high' END AS level FROM (SELECT doc_id, round(least(1.0::DOUBLE,
  CASE WHEN strlen(text) * 512 < 524288 THEN 0.1 WHEN strlen(text) * 512 < 1048576 THEN 0.2 WHEN strlen(text) * 512 < 2097152 THEN 0.3 ELSE 0.4 END::DOUBLE
  + CASE WHEN length(text) < 500 THEN 0.05 WHEN length(text) < 2000 THEN 0.15 WHEN length(text) < 5000 THEN 0.25 ELSE 0.3 END::DOUBLE
  + (CASE WHEN contains(text, '|') THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN contains(text, '$$') THEN 0.15 ELSE 0 END::DOUBLE)), 4) AS s FROM documents)""",
    "dedup_groups": "SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "dedup_survivors": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)",
    "dedup_lookup": "SELECT d.doc_id, k.id AS known_id, k.id IS NULL AS is_new FROM documents d LEFT JOIN (SELECT text, min(doc_id) AS id FROM documents GROUP BY text HAVING min(doc_id) % 17 <> 0) k ON k.text = d.text",
    "line_boxes": f"SELECT doc_id, line_no, {strip('line')} AS text, 0 AS x, line_no * greatest(1, 1000 // n) AS y, 1000 AS w, least(greatest(1, 1000 // n), 1000 - line_no * greatest(1, 1000 // n)) AS h, 0.9::DOUBLE AS confidence FROM {FULL}",
    "line_elements": f"SELECT * FROM {ELEMENTS}",
    "word_boxes": f"SELECT * FROM {WORDS}",
    "word_boxes_equal": f"""SELECT doc_id, index, i - 1 AS word_no, w[i] AS word, x1 + (i - 1) * s AS x1, y1, least(x1 + (i - 1) * s + greatest(s, 10), x2) AS x2, y2, 0.93::DOUBLE AS confidence FROM
  (SELECT *, unnest(range(1, len(w) + 1)) AS i, greatest(1, (x2 - x1) // len(w)) AS s FROM (SELECT *, list_filter(string_split(replace(content, chr(10), ' '), ' '), lambda w: regexp_matches(w, '\\S')) AS w FROM {ELEMENTS}))""",
    "reading_order": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, line_no * 100000 + word_no) - 1 AS order_no, word, word LIKE '%-' AS hyphenated FROM {WORDS}",
    "key_value_pairs": f"""SELECT doc_id, pair_no, key, value, 0 AS key_x, pair_no * h AS y, 400 AS key_w, 400 AS value_x, 600 AS value_w, h, CASE pattern WHEN 'colon' THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence, pattern,
  round(least(1.0, CASE pattern WHEN 'colon' THEN 0.9 ELSE 0.85 END + CASE WHEN regexp_matches(key, '(Number|Name|Date|ID|Code)$') THEN 0.05 ELSE 0 END)::DOUBLE, 3) AS key_confidence,
  round(least(1.0, CASE pattern WHEN 'colon' THEN 0.9 ELSE 0.85 END + CASE WHEN value <> '' THEN 0.03 ELSE 0 END)::DOUBLE, 3) AS value_confidence, CASE pattern WHEN 'colon' THEN 0.9 ELSE 0.85 END::DOUBLE AS pair_confidence FROM {PAIRS}""",
    "key_value_grouped": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first, pair_no) - 1 AS order_no, key, value FROM (SELECT *, min(pair_no) OVER (PARTITION BY doc_id, key) AS first FROM {PAIRS})",
    "table_cells": f"SELECT * FROM {CELLS}",
    "table_summary": f"SELECT doc_id, count(*) AS n_rows, max(n) AS n_columns, sum(n)::BIGINT AS n_cells FROM (SELECT doc_id, row_no, count(*) AS n FROM {CELLS} GROUP BY ALL) GROUP BY doc_id",
    "sections": rf"""WITH l AS (SELECT doc_id, i - 1 AS line_no, {strip('l[i]')} AS line, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {HEADED} WHERE regexp_matches(text, '\S')))),
  m AS (SELECT *, CASE WHEN regexp_matches(line, '^(#{{1,6}}|\d+\.|\d+\.\d+\.?)\s+(.+)$') THEN regexp_extract(line, '^(#{{1,6}}|\d+\.|\d+\.\d+\.?)\s+(.+)$', 1) END AS marker FROM l),
  s AS (SELECT *, count(marker) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM m),
  g AS (SELECT doc_id, sec, 1000 // n AS tall, n, min(line_no) AS first, max(marker) AS marker, max(CASE WHEN marker IS NOT NULL THEN regexp_extract(line, '^(#{{1,6}}|\d+\.|\d+\.\d+\.?)\s+(.+)$', 2) END) AS heading,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE marker IS NULL AND line <> ''), '') AS content FROM s WHERE sec > 0 OR line_no = 0 GROUP BY doc_id, sec, n)
  SELECT doc_id, sec::INT AS section_no, CASE WHEN sec = 0 THEN 0 WHEN marker LIKE '#%' THEN length(marker) ELSE length(marker) - length(replace(marker, '.', '')) + 1 END::INT AS level, CASE WHEN sec = 0 THEN 'Preamble' ELSE heading END AS heading,
  content, 0 AS x, first * tall AS y, 1000 AS w, (CASE WHEN sec = 0 THEN 1 ELSE coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY sec), n) - first END * tall)::INT AS h FROM g""",
    "vertical_segments": """SELECT doc_id, i AS segment_no, 0 AS "left", greatest(0, i * b - 40) AS top, 1200 AS "right", CASE WHEN i = 2 THEN h ELSE least(h, (i + 1) * b + 40) END AS bottom
  FROM (SELECT doc_id, length(text) AS h, greatest(1, length(text) // 3) AS b, unnest([0, 1, 2]) AS i FROM documents) WHERE CASE WHEN i = 2 THEN h ELSE least(h, (i + 1) * b + 40) END > greatest(0, i * b - 40)""",
    "page_chunks": "SELECT conv_id AS job_id, turn AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS page_no, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::INT AS chunk_no FROM conversations",
    "region_batches": f"SELECT page_id, (index // 5)::INT AS batch_no, count(*) AS n FROM {REGIONS} GROUP BY ALL",
    "region_crops": f"""SELECT * FROM (SELECT page_id, index, greatest(0, least(index * 40 - 60, 612)) AS x1, greatest(0, least(index * 30 - 20, 792)) AS y1, greatest(0, least(index * 40 + 100, 612)) AS x2, greatest(0, least(index * 30 + 50, 792)) AS y2 FROM {REGIONS}) WHERE x2 > x1 AND y2 > y1""",
    "bbox_warnings": f"SELECT *, 'high' AS severity FROM (SELECT doc_id, line_no, word_no, CASE WHEN x < 0 OR y < 0 THEN 'BBOX_OUTSIDE_PAGE' WHEN x + w > 1000 OR y + h > 1000 THEN 'BBOX_EXCEEDS_PAGE' WHEN w <= 0 OR h <= 0 THEN 'INVALID_BBOX_DIMENSIONS' END AS code FROM {WORDS}) WHERE code IS NOT NULL",
    "confidence_warnings": "SELECT event_id, code, CASE code WHEN 'LOW_CONFIDENCE' THEN 'medium' ELSE 'high' END AS severity FROM (SELECT event_id, CASE WHEN c < 0 OR c > 1 THEN 'CONFIDENCE_OUT_OF_RANGE' WHEN c < 0.5 THEN 'LOW_CONFIDENCE' END AS code FROM (SELECT event_id, value / 100 - 0.1::DOUBLE AS c FROM events)) WHERE code IS NOT NULL",
    "word_overlaps": """WITH b AS (SELECT user_id, ts::DATE AS day, event_id, floor(value)::INT AS x, (event_id % 97 * 3)::INT AS y, 25 AS w, 12 AS h FROM events),
  p AS (SELECT a.user_id, a.day, a.event_id AS a_event_id, b.event_id AS b_event_id, least(a.x, b.x) + 25 - greatest(a.x, b.x) AS ox, least(a.y, b.y) + 12 - greatest(a.y, b.y) AS oy FROM b a JOIN b ON a.user_id = b.user_id AND a.day = b.day AND a.event_id < b.event_id)
  SELECT user_id, day::VARCHAR AS day, a_event_id, b_event_id, round(ox * oy / 300.0::DOUBLE, 6) AS ratio FROM p WHERE ox > 0 AND oy > 0 AND round(ox * oy / 300.0::DOUBLE, 6) > 0.1""",
    "validation_summary": f"""SELECT *, low_confidence_count / total_elements > 0.2 AS high_low_confidence_ratio, invalid_elements = 0 AND NOT (low_confidence_count / total_elements > 0.2) AS valid FROM
  (SELECT doc_id, count(*) AS total_elements, sum(CASE WHEN x + w > 1000 OR y + h > 1000 OR w <= 0 OR h <= 0 THEN 1 ELSE 0 END)::BIGINT AS invalid_elements, sum(CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END)::BIGINT AS low_confidence_count FROM {WORDS} GROUP BY doc_id)""",
    "pair_warnings": f"SELECT CASE WHEN key = '' AND value <> '' THEN 'ORPHANED_VALUE' END AS code, count(*) AS n FROM {PAIRS} GROUP BY 1",
    "schema_check": """SELECT event_id, f AS format, CASE WHEN f = 'text' THEN true WHEN f = 'json' THEN k = 0 WHEN f = 'table' THEN k = 1 WHEN f = 'key_value' THEN k <> 1 ELSE k = 0 END AS ok
  FROM (SELECT event_id, event_id % 3 AS k, ['text', 'json', 'table', 'key_value', 'structured'][event_id % 5 + 1] AS f FROM events)""",
    "page_aggregate": f"""SELECT job_id, coalesce(string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) FILTER (WHERE error IS NULL AND coalesce(markdown, '') <> ''), '') AS markdown, count(*)::INT AS page_count,
  round(coalesce(avg(confidence) FILTER (WHERE error IS NULL), 0), 6) AS confidence, (count(*) FILTER (WHERE error IS NULL))::INT AS pages_ok FROM {TURNS} GROUP BY job_id""",
    "element_markdown": f"""SELECT doc_id, coalesce(string_agg(CASE label WHEN 'title' THEN '## ' || content WHEN 'formula' THEN '$$' || chr(10) || content || chr(10) || '$$' ELSE content END, chr(10) || chr(10) ORDER BY index) FILTER (WHERE content <> ''), '') AS markdown,
  round(avg(confidence), 4) AS confidence FROM {ELEMENTS} GROUP BY doc_id""",
    "chunk_mean_confidence": f"SELECT job_id, round(sum(CASE WHEN error IS NULL THEN confidence ELSE 0 END) / count(*), 6) AS confidence FROM {TURNS} GROUP BY job_id",
    "token_totals": r"SELECT conv_id AS job_id, sum(length(text))::BIGINT AS prompt_tokens, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS completion_tokens FROM conversations GROUP BY 1",
    "region_content_join": f"SELECT * FROM {JOINED}",
    "two_stage_confidence": f"SELECT p.page_id, round(coalesce(avg(j.confidence), 0.0::DOUBLE), 4) AS confidence FROM (SELECT DISTINCT page_id FROM pages) p LEFT JOIN {JOINED} j ON j.page_id = p.page_id GROUP BY p.page_id",
    "block_boxes": f"SELECT page_id, index, raw_type AS text, {region_type('raw_type')} AS type, 0 AS x, 0 AS y, 1000 AS w, 1000 AS h, confidence FROM {REGIONS}",
    "layout_only": f"SELECT page_id, count(*) AS n_regions, round(avg(confidence), 6) AS confidence, 'PaddleOCR-only' AS model FROM {REGIONS} GROUP BY page_id",
    "full_page_fallback": f"""WITH j AS (SELECT j.* FROM {JOINED} j JOIN {REGIONS} r USING (page_id, index) WHERE coalesce(r.score, 1.0) >= 0.95 AND j.label = 'title')
  SELECT * FROM j UNION ALL SELECT page_id, 0, 'text', '', 0.9 FROM pages WHERE page_id NOT IN (SELECT page_id FROM j)""",
    "region_types": f"SELECT {region_type('raw_type')} AS type, count(*) AS n FROM {REGIONS} GROUP BY 1",
    "region_filter": f"SELECT page_id, count(*) AS total, count(*) FILTER (WHERE coalesce(score, 1.0) < 0.5) AS filtered, count(*) FILTER (WHERE coalesce(score, 1.0) >= 0.5) AS kept FROM {REGIONS} GROUP BY page_id",
    "option_parsing": """SELECT event_id, event_type = 'view' AS flag, greatest(10, least(72, user_id))::INT AS whole, 1200 AS fallback, value AS number, 'text|' || event_type || '|json' AS fields, false AS formats_ok,
  least(user_id * 100, 8192)::INT AS tokens, greatest(64, least(8192, user_id * 100))::INT AS page_tokens, CASE WHEN user_id % 2 = 0 THEN 1.15 ELSE 1.05 END::DOUBLE AS penalty FROM events""",
    "prompt_for_region": f"""SELECT raw_type, n, type, CASE type WHEN 'table' THEN 'Table Recognition:' WHEN 'formula' THEN 'Formula Recognition:' ELSE 'Text Recognition:' END AS prompt, CASE WHEN type IN ('table', 'formula') THEN type ELSE 'text' END AS task,
  CASE type WHEN 'table' THEN 'Table Recognition:' WHEN 'formula' THEN 'Formula Recognition:' ELSE 'Text Recognition:' END AS task_prompt FROM (SELECT raw_type, count(*) AS n, {region_type('raw_type')} AS type FROM {REGIONS} GROUP BY raw_type)""",
    "prompt_selection": """SELECT CASE event_type WHEN 'error' THEN 'Read it' WHEN 'click' THEN 'Text Recognition: Extract only the following fields from this document: date, amount. Return a flat JSON object where each key is one of the requested field names.'
  WHEN 'view' THEN 'Table Recognition:' ELSE 'Text Recognition:' END AS prompt, count(*) AS n FROM events GROUP BY 1""",
    "request_checks": "SELECT doc_id, CASE WHEN text = '' THEN 'image_ref is required' WHEN length(text) > 4096 THEN 'image_ref is too long' WHEN length(text) > 2048 THEN 'prompt is too long' WHEN n_chars < 64 OR n_chars > 8192 THEN 'max_tokens is out of range' END AS reason, n_chars <= 4000 AS allowed, round(n_chars * 1024 / 1048576.0::DOUBLE, 2) AS mb FROM documents",
    "file_routing": """SELECT doc_id, 'in/' || source || '/f' || doc_id || '.' || k AS path, CASE WHEN k = 'pdf' THEN 'pdf' WHEN k IN ('PNG', 'jpeg') THEN 'image' WHEN k IN ('docx', 'xlsx', 'pptx') THEN 'office'
  WHEN k IN ('txt', 'csv', 'log') THEN 'text' WHEN k IN ('zip', 'tar.gz', 'txt.xz', '7z') THEN 'archive' ELSE 'unsupported' END AS kind, k IN ('zip', 'tar.gz', 'txt.xz', '7z') AS archive
  FROM (SELECT *, ['pdf', 'PNG', 'jpeg', 'docx', 'xlsx', 'pptx', 'txt', 'csv', 'log', 'zip', 'tar.gz', 'txt.xz', '7z', 'exe', 'doc', ''][doc_id % 16 + 1] AS k FROM documents)""",
    "field_matches": "SELECT p_partkey, contains(replace(replace(lower(p_type), ' ', '_'), '-', '_'), 'anodized') OR contains('anodized', replace(replace(lower(p_type), ' ', '_'), '-', '_')) AS a, contains(replace(lower(p_name), ' ', '_'), 'small_ring') OR contains('small_ring', replace(lower(p_name), ' ', '_')) AS b, replace(replace(lower(p_name), ' ', '_'), '-', '_') AS key FROM part",
    "image_rules": """SELECT p_partkey, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - CASE WHEN p_size < 10 THEN 0.2 ELSE 0 END::DOUBLE - least(p_retailprice / 50 / 100, 0.3::DOUBLE) - CASE WHEN p_size * 2 < 30 THEN 0.2 ELSE 0 END::DOUBLE - CASE WHEN p_size / 20.0::DOUBLE > 1 THEN 0.1 ELSE 0 END::DOUBLE - CASE WHEN p_size % 3 = 0 THEN 0.1 ELSE 0 END::DOUBLE)), 4) AS score,
  w::BIGINT * h * 3 > 10 * 1048576 AS too_large, CASE WHEN greatest(w, h) <= 1280 THEN w ELSE greatest(1, floor(w * (1280.0::DOUBLE / greatest(w, h)))) END::INT AS new_w, CASE WHEN greatest(w, h) <= 1280 THEN h ELSE greatest(1, floor(h * (1280.0::DOUBLE / greatest(w, h)))) END::INT AS new_h,
  round(p_size / 60::DOUBLE * 100, 2) AS percent, least(pow(2.0::DOUBLE, p_size % 5), 60.0::DOUBLE) AS wait FROM (SELECT *, p_size * 100 AS w, p_size * 70 + 300 AS h FROM part)""",
    "batch_status_counts": f"SELECT batch_id, status, count(*) AS n FROM {JOBS} GROUP BY ALL",
    "batch_rollup": f"""SELECT batch_id, total, completed, failed, processing, total - completed - failed - processing AS uploaded, printf('%.1f', round((completed + failed)::DOUBLE / total * 100, 1)) || '%' AS progress,
  CASE WHEN completed + failed < total THEN 'PROCESSING' WHEN failed = total THEN 'FAILED' WHEN failed > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS state
  FROM (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'PROCESSING') AS processing FROM {JOBS} GROUP BY batch_id)""",
    "system_stats": f"SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'PROCESSING') AS processing FROM {JOBS}",
    "list_jobs": f"SELECT * FROM {JOBS} ORDER BY created_at DESC, id LIMIT 100 OFFSET 20",
    "batch_files": f"SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, id)::INT AS file_no, id, status FROM {JOBS}",
    "submit_summary": f"SELECT batch_id, count(*) FILTER (WHERE status <> 'FAILED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM {JOBS} GROUP BY batch_id",
    "status_sync": f"SELECT j.id, CASE WHEN q.priority = 2 THEN 'COMPLETED' ELSE j.status END AS status FROM {JOBS} j JOIN {QUEUE} q ON q.job_id = j.id",
    "queue_unknown_jobs": f"SELECT id AS job_id, status FROM {JOBS} WHERE status = 'FAILED'",
    "queue_order": f"SELECT job_id, priority, t0 + priority * 1000000 AS score FROM {QUEUE} WHERE status = 'QUEUED' ORDER BY score, job_id LIMIT 50",
    "queue_order_intended": f"SELECT job_id, priority, t0 - priority * 1000000 AS score FROM {QUEUE} WHERE status = 'QUEUED' ORDER BY score, job_id LIMIT 50",
    "queue_position": f"SELECT job_id, t0 + priority * 1000000 AS score, row_number() OVER (ORDER BY t0 + priority * 1000000, job_id) AS position FROM {QUEUE} WHERE status = 'QUEUED'",
    "queue_estimate": f"""SELECT queue_length, processing, completed, avg_ms, queue_length * avg_ms / 1000::DOUBLE AS wait_s, round(3600000 / avg_ms::DOUBLE, 6) AS per_hour FROM (SELECT count(*) FILTER (WHERE status = 'QUEUED') AS queue_length, count(*) FILTER (WHERE status = 'PROCESSING') AS processing,
  count(*) FILTER (WHERE status = 'COMPLETED') AS completed, (sum(ms) FILTER (WHERE status = 'COMPLETED') // count(*) FILTER (WHERE status = 'COMPLETED'))::BIGINT AS avg_ms FROM {QUEUE})""",
    "concurrency_slots": f"""WITH s AS (SELECT event_type, event_id AS id, ms, ms + floor(value * 60000)::BIGINT AS until FROM {EVENTS}), p AS (SELECT event_type, id, ms AS t0, 1 AS step FROM s UNION ALL SELECT event_type, id, until, -1 FROM s)
  SELECT event_type, id, t0 AS "at", holders::INT AS holders, holders <= 5 AS admitted FROM (SELECT *, sum(step) OVER (PARTITION BY event_type ORDER BY t0, step, id ROWS UNBOUNDED PRECEDING) AS holders FROM p) WHERE step = 1""",
    "cache_stats": "SELECT event_type AS prefix, count(*) AS n FROM events GROUP BY 1",
    "health_rollup": "SELECT ts::DATE::VARCHAR AS report, CASE WHEN count(*) FILTER (WHERE value > 300 AND event_type = 'signup') > 0 THEN 'unhealthy' WHEN count(*) FILTER (WHERE value > 300) > 0 THEN 'degraded' ELSE 'healthy' END AS status, count(*) FILTER (WHERE value > 300) AS n_bad FROM events GROUP BY 1",
    "performance_stats": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events),
  a AS (SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 150) AS slow, round(avg(value), 6) AS mean, round(avg(value) FILTER (WHERE back <= 100), 6) AS mean_recent, list_sort(list(value) FILTER (WHERE back <= 1000)) AS v FROM r GROUP BY event_type)
  SELECT event_type, total, slow, round(slow / total * 100, 6) AS slow_percent, mean, mean_recent, v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[floor(len(v) * 0.99)::INT + 1] AS p99 FROM a""",
    "moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS moving_average FROM events",
    "slow_pages": "SELECT event_id, round(value - 150, 6) AS exceeded_by, round((value - 150) / 150 * 100, 1) AS exceeded_percent, round(event_id * 77 / 1024.0::DOUBLE, 2) AS size_kb, round(event_id * 77 / 1048576.0::DOUBLE, 2) AS size_mb FROM events WHERE value > 150",
    "histogram_buckets": f"SELECT * FROM {buckets('(SELECT event_type, value / 50 AS s FROM events)', 'event_type', 's', EDGES)}",
    "histogram_quantile": f"""WITH b AS (SELECT *, max(n) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS rank, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lo FROM {buckets('(SELECT event_type, value / 50 AS s FROM events)', 'event_type', 's', EDGES)} WINDOW w AS (PARTITION BY event_type ORDER BY bucket))
  SELECT event_type, round(CASE WHEN le IS NULL THEN lo ELSE lo + (le - lo) * ((rank - below) / (n - below)) END, 6) AS value FROM b WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY bucket) = 1""",
    "size_histogram": f"SELECT * FROM {buckets('documents', 'lang', 'n_chars', (1e2, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8))}",
    "rate_5m": "SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, round(count(*) / 300::DOUBLE, 9) AS per_second FROM events GROUP BY ALL",
    "error_ratio": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE * 100, 6) AS error_percent FROM events GROUP BY 1",
    "mean_duration": "SELECT event_type, round(sum(value) / count(value), 6) AS mean FROM events GROUP BY 1",
    "alert_intervals": """WITH s AS (SELECT event_type, value > 5 AS up, floor(epoch(ts))::BIGINT AS t0, ts FROM events),
  f AS (SELECT *, CASE WHEN up AND coalesce(lag(up) OVER w, false) AND t0 - lag(t0) OVER w <= 3600 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS island FROM f),
  g AS (SELECT event_type, min(t0) AS a, max(t0) AS b, count(*) AS n_samples FROM i WHERE up GROUP BY event_type, island)
  SELECT event_type, make_timestamp(a * 1000000) AS since, make_timestamp((a + 600) * 1000000) AS fires_at, make_timestamp(b * 1000000) AS until, n_samples FROM g WHERE b - a >= 600""",
    "rate_limit_sliding": f"SELECT event_id, n AS in_window, n <= 1 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 21599999 PRECEDING AND CURRENT ROW) AS n FROM {EVENTS})",
    "chunk_merge": rf"""WITH l AS (SELECT conv_id, turn, i, {strip('x[i]')} AS line FROM (SELECT conv_id, turn, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\r\n|[\n\r\x0b\f]') AS x FROM conversations))),
  f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(regexp_replace(line, '\s+', ' ', 'g')) ORDER BY turn, i) AS nth FROM l WHERE line <> '')
  SELECT conv_id AS job_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS line_no, line FROM f WHERE nth = 1""",
}
ORACLES["overlap_warnings"] = f"SELECT user_id, day, a_event_id, b_event_id, 'WORD_BOXES_OVERLAP' AS code, 'medium' AS severity FROM ({ORACLES['word_overlaps']})"


def _replayed(seconds: int, limit: int) -> str:
    """Each user's events one after another, with the admitted ones that are still in the window."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS nth FROM {EVENTS}),
  run AS (SELECT event_id, user_id, ms, nth, true AS admitted, [ms] AS held FROM e WHERE nth = 1
    UNION ALL SELECT event_id, user_id, ms, nth, len(kept) < {limit}, CASE WHEN len(kept) < {limit} THEN list_append(kept, ms) ELSE kept END
      FROM (SELECT e.*, list_filter(run.held, lambda t: t > e.ms - {seconds * 1000}) AS kept FROM run JOIN e ON e.user_id IS NOT DISTINCT FROM run.user_id AND e.nth = run.nth + 1))"""


ORACLES |= {
    "archive_members": "SELECT 'doc' || doc_id || '.txt' AS name, strlen(coalesce(text, '')) AS n_bytes, sha256(coalesce(text, '')) AS sha256, CAST(NULL AS VARCHAR) AS error FROM documents",
    "rate_limit_admitted": f"{_replayed(6 * 3600, 1)} SELECT event_id, admitted, len(held) AS in_window FROM run",
    "stream_rate_limit": f"{_replayed(86_400, 2)} SELECT event_id, admitted, len(held) AS in_window FROM run",
    "stream_dedup": f"{_replayed(86_400, 1)} SELECT event_id, user_id, ms FROM run WHERE admitted",
    "stream_rate_5m": """SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n FROM events
  GROUP BY ALL HAVING time_bucket(INTERVAL 5 MINUTE, min(ts)) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events)""",
    "stream_expiry": f"""SELECT user_id, ms AS last_ms, ms + 86400000 AS expired_ms FROM (SELECT user_id, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS next_ms, max(ms) OVER () AS latest FROM {EVENTS})
  WHERE CASE WHEN next_ms IS NULL THEN ms + 86400000 <= latest ELSE next_ms - ms >= 86400000 END""",
}

#: Elements of events, those that are objects by key, with the names as they are compared.
_ELEMENTS = """e AS (SELECT event_id, user_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"Sub Total":' || event_id || ',"Sign-Up-No":{"a":[' || event_id || ',2]},"z":"x"}'
    WHEN 2 THEN 'Kind: ' || event_type || ' k: ' || event_id || chr(10) || 'Sign up: no' WHEN 3 THEN '{"zzz":1}' WHEN 4 THEN '["k",1]' ELSE event_type END AS content FROM events),
  o AS (SELECT *, json_valid(content) AND coalesce(json_type(CASE WHEN json_valid(content) THEN content END), '') = 'OBJECT' AS is_object FROM e),
  k AS (SELECT event_id, user_id, content, unnest(json_keys(content)) AS key FROM o WHERE is_object),
  m AS (SELECT *, json_extract(content, '$."' || key || '"') AS value FROM k
    WHERE len(list_filter(['k', 'sign_up'], lambda f: contains(replace(replace(lower(key), ' ', '_'), '-', '_'), f) OR contains(f, replace(replace(lower(key), ' ', '_'), '-', '_')))) > 0),
  t AS (SELECT * FROM o WHERE NOT is_object AND len(list_filter(['k', 'sign_up'], lambda f: contains(replace(replace(lower(content || ' text'), ' ', '_'), '-', '_'), f))) > 0)"""
ORACLES |= {
    "field_filter": f"""WITH {_ELEMENTS} SELECT event_id, '{{' || string_agg('"' || key || '":' || value, ',' ORDER BY key) || '}}' AS content FROM m GROUP BY event_id UNION ALL SELECT event_id, content FROM t""",
    "flat_fields": rf"""WITH {_ELEMENTS}, f AS (SELECT user_id, event_id, key AS field, CAST(value AS VARCHAR) AS value, 1 AS kind FROM m
    UNION ALL SELECT user_id, event_id, 'K', '"' || trim(regexp_extract(lower(content), 'k[:\s]+([^\n]+)', 1)) || '"', 0 FROM t WHERE regexp_matches(lower(content), 'k[:\s]+([^\n]+)')
    UNION ALL SELECT user_id, event_id, 'sign-up', '"' || trim(regexp_extract(lower(content), 'sign[ _-]?up[:\s]+([^\n]+)', 1)) || '"', 0 FROM t WHERE regexp_matches(lower(content), 'sign[ _-]?up[:\s]+([^\n]+)'))
  SELECT user_id, field, coalesce(arg_max(value, event_id) FILTER (WHERE kind = 1), arg_min(value, event_id) FILTER (WHERE kind = 0)) AS value FROM f GROUP BY user_id, field""",
    "post_process": f"""SELECT doc_id, '{{"raw_text":' || CAST(to_json({redact('text')}) AS VARCHAR) || ',"document_type":"unknown","fields":{{}},"tables":[],"_postprocessed":true,"_version":"1.0"}}' AS result,
  {redact('text')} AS result_text, CASE WHEN length({redact('text')}) > 100 THEN 0.6 ELSE 0.5 END::DOUBLE AS document_confidence FROM documents""",
    "envelope": """SELECT event_id, '2.0' AS schema_version, 'zai-org/GLM-OCR' AS model, CASE event_id % 3 WHEN 0 THEN '{"k":' || json_extract(props, '$.k') || ',"_postprocessed":true,"_version":"1.0"}'
    WHEN 1 THEN '{"fields":{"n":' || event_id || '},"k":' || json_extract(props, '$.k') || ',"_postprocessed":true,"_version":"1.0"}'
    ELSE '{"raw_text":"' || event_type || '","document_type":"unknown","fields":{},"tables":[],"_postprocessed":true,"_version":"1.0"}' END AS result,
  CASE event_id % 3 WHEN 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS document_confidence FROM events""",
}
ORACLES |= {
    "half_even_values": "SELECT event_id, CAST(printf('%.3f', value) AS DOUBLE) AS value, CAST(printf('%.4f', (event_id % 4096) / 32.0::DOUBLE - 60) AS DOUBLE) AS tie FROM events",
    "word_box_overlaps": f"""WITH b AS (SELECT doc_id, index, word_no, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area FROM ({ORACLES['word_boxes_equal']}) WHERE x2 > x1 AND y2 > y1)
  SELECT a.doc_id, count(*) AS overlap_count, 'WORD_BOXES_OVERLAP' AS code, 'medium' AS severity FROM b a JOIN b ON a.doc_id = b.doc_id AND (a.index, a.word_no) < (b.index, b.word_no)
    AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2
  WHERE round((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least(a.area, b.area)::DOUBLE, 6) > 0.1 GROUP BY a.doc_id""",
}

_OPTIONS = """(SELECT doc_id, text, CASE WHEN doc_id % 41 = 0 THEN '' WHEN doc_id % 43 = 0 THEN 'scan.png' WHEN doc_id % 47 = 0 THEN repeat('/a', 2049) WHEN doc_id % 2 = 0 THEN 'data:image/png;base64,' ELSE '/in/scan.png' END AS image,
  ['{"include_coordinates":true,"output_format":"JSON","max_tokens":"128","extract_fields":["a",1,true,null," "]}', '{"include_coordinates":"true"}', '{"include_word_confidence":1}', '{"include_page_layout":null}', '{"output_format":"xml"}',
   '{"max_tokens":63}', '{"max_tokens":"many"}', '{"max_tokens":100.9,"extract_fields":"date, total ,,"}', '{"extract_fields":"[\\"x\\",\\"y z\\"]","output_format":"table"}', '{"extract_fields":5}', '{"extract_fields":{"k":1,"l":2}}', '{"extract_fields":null,"max_tokens":8192}', '{}'][doc_id % 13 + 1]::JSON AS o FROM documents)"""
_SWITCHES = " ".join(f"WHEN list_contains(json_keys(o), '{n}') AND json_type(o, '$.{n}') <> 'BOOLEAN' THEN '{n} must be a boolean'" for n in ("include_coordinates", "include_word_confidence", "include_page_layout"))
_ITEM = "coalesce(CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN upper(left(CAST(x AS VARCHAR), 1)) || substr(CAST(x AS VARCHAR), 2) ELSE CAST(x AS VARCHAR) END, 'None')"
ORACLES |= {
    "option_checks": f"""WITH r AS (SELECT *, lower(o ->> '$.output_format') AS fmt, json_type(o, '$.extract_fields') AS kind, trim(o ->> '$.extract_fields') AS said, trunc(TRY_CAST(o ->> '$.max_tokens' AS DOUBLE))::BIGINT AS n FROM {_OPTIONS}),
  f AS (SELECT *, CASE WHEN NOT list_contains(json_keys(o), 'extract_fields') THEN NULL WHEN kind = 'NULL' THEN []::VARCHAR[] WHEN kind = 'ARRAY' THEN list_filter(list_transform(CAST(json_extract(o, '$.extract_fields') AS JSON[]), lambda x: {_ITEM}), lambda x: trim(x) <> '')
    WHEN kind = 'OBJECT' THEN json_keys(o, '$.extract_fields') WHEN kind = 'VARCHAR' AND json_valid(said) THEN list_transform(CAST(CASE WHEN json_valid(said) THEN said END AS JSON[]), lambda x: {_ITEM})
    WHEN kind = 'VARCHAR' THEN list_filter(list_transform(string_split(said, ','), lambda x: trim(x)), lambda x: x <> '') END AS fields FROM r)
  SELECT doc_id, CASE WHEN image = '' THEN 'image_ref is required' WHEN length(image) > 4096 THEN 'image_ref is too long' WHEN NOT (image LIKE 'data:%' OR image LIKE '/%') THEN 'image_ref must be a path or a data address'
    WHEN length(text) > 2048 THEN 'prompt is too long' {_SWITCHES} WHEN fmt NOT IN ('text', 'json', 'markdown', 'table', 'key_value', 'structured', 'formula') THEN 'output_format is unknown'
    WHEN list_contains(json_keys(o), 'max_tokens') AND coalesce(n NOT BETWEEN 64 AND 8192, true) THEN 'max_tokens must be an integer between 64 and 8192' WHEN list_contains(json_keys(o), 'extract_fields') AND fields IS NULL THEN 'extract_fields must be a list' END AS reason,
    fmt AS output_format, n AS max_tokens, CAST(to_json(fields) AS VARCHAR) AS extract_fields FROM f""",
    "page_results": f"""WITH p AS (SELECT *, CASE WHEN page % 3 = 0 THEN to_json(coalesce(markdown, '')) WHEN page % 3 = 1 AND markdown IS NOT NULL THEN json_object('markdown', markdown, 'n', page) ELSE json_object('n', page) END AS result FROM {TURNS}),
  g AS (SELECT job_id, string_agg('{{"page":' || page || ',"result":' || result || '}}', ',' ORDER BY page) FILTER (WHERE error IS NULL) AS pages, count(*)::INT AS page_count, round(coalesce(avg(confidence) FILTER (WHERE error IS NULL), 0), 6) AS confidence,
    coalesce(string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) FILTER (WHERE error IS NULL AND page % 3 = 1 AND markdown <> ''), '') AS markdown FROM p GROUP BY job_id)
  SELECT job_id, '{{"job_id":' || job_id || ',"model":"zai-org/GLM-OCR","precision":"normal","pages":[' || coalesce(pages, '') || '],"markdown":' || to_json(markdown) || ',"page_count":' || page_count || ',"confidence":' || confidence || '}}' AS raw_content, confidence, page_count FROM g""",
}
ORACLES |= {
    "structured_findings": """WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"sections":[{"level":1}],' || substr(props, 2) WHEN 1 THEN '["sections"]' WHEN 2 THEN event_type ELSE props END AS content FROM events)
  SELECT event_id, 'INVALID_STRUCTURED_FORMAT' AS code, 'high' AS severity FROM r WHERE CASE WHEN json_valid(content) THEN json_extract(content, '$.sections') END IS NULL""",
    "confidence_ratio_findings": """WITH t AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)))) AS index FROM pages WHERE html IS NOT NULL),
  g AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE (page_id * 31 + index * (page_id % 5)) % 10 < 5) AS low FROM t GROUP BY page_id)
  SELECT page_id, 'HIGH_LOW_CONFIDENCE_RATIO' AS code, 'high' AS severity FROM g WHERE low / n::DOUBLE > 0.5""",
}
