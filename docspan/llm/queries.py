"""Registered queries of the corpus operators: thin callers that read whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.llm import ann, chat, decontaminate, html, lm, mixing, negatives, pii, quality, repair, repeats, sharding
from docspan.llm.common import table
from docspan.llm.jaccard import Rule, jaccard_components

#: Stands for the secret that a deployment keeps to itself.
DEMO_KEY = b"docspan demonstration key"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents")).select("doc_id", F.round("quality", 6).alias("quality"), "keep")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    done = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return done.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), lm.in_training("doc_id"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2)
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.kinds_found(pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY))
    kinds = [f"pii_{k}" for k in pii.Pseudonyms.KINDS]
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *kinds)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), Rule(words=4, share=85))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return done.select("conv_id", "part", "perspective", "n_turns", "text", spans.alias("mask_spans"), "trained_chars")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.conversation_repair(table(spark, sf_dir, "conversations"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    poisoned = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, label=poisoned)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_sharding, op3_html_extraction, op4_lm_scoring, op5_mixing, op6_ann, op7_decontamination, op8_pii, op9_ngram_jaccard_join, op10_chat_formatting, op11_conversation_repair, op12_suffix_array_dedup, op13_hard_negatives)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op9_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE
      WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(y) AS component_id
FROM sets JOIN reach ON sets.doc_id = reach.x GROUP BY sets.doc_id, len(s)
""",
    "op10_chat_formatting": """
WITH turns AS (
  SELECT conv_id, CAST(floor(turn / 512) AS BIGINT) AS part, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM (SELECT conv_id, turn, text, replace(coalesce(nullif(trim(role), ''), 'unknown'), '<|', '< |') AS role FROM conversations)
), sides AS (
  SELECT DISTINCT conv_id, part, role AS perspective FROM turns WHERE role <> 'system'
), pieces AS (
  SELECT s.conv_id, s.part, s.perspective, t.role = s.perspective AS own,
    '<|im_start|>' || CASE WHEN t.role = s.perspective THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS before,
    t.text || '<|im_end|>' AS body,
    row_number() OVER (PARTITION BY s.conv_id, s.part, s.perspective ORDER BY t.turn NULLS LAST, t.role, t.text) AS nth
  FROM sides s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.part IS NOT DISTINCT FROM s.part
), placed AS (
  SELECT *, sum(length(before) + length(body) + 1) OVER (PARTITION BY conv_id, part, perspective ORDER BY nth) AS upto FROM pieces
)
SELECT conv_id, CAST(part AS VARCHAR) AS part, perspective, count(*) AS n_turns,
  string_agg(before || body || chr(10), '' ORDER BY nth) AS text,
  coalesce(string_agg(CAST(upto - 1 - length(body) AS BIGINT)::VARCHAR || '-' || CAST(upto - 1 AS BIGINT)::VARCHAR, ',' ORDER BY nth) FILTER (WHERE own), '') AS mask_spans,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS trained_chars
FROM placed GROUP BY conv_id, part, perspective
""",
    "op11_conversation_repair": """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), faults AS (
  SELECT given.* EXCLUDE (k), xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS f
  FROM given, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM faults WHERE f <> 0
), placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS c, lag(left(role, 1)) OVER w AS prior, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, seen = '' AS blank, seen <> '' AND again AS duplicate, seen <> '' AND NOT again AND right(seen, 1) NOT IN ('.', '!', '?') AS truncated FROM placed
), inserted(p, n, m) AS (
  VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)
), steps(m, c, q) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), edits AS (
  SELECT m, c, q, 'K' AS e, 0 AS price FROM steps UNION ALL SELECT m, c, q, 'R', 3 FROM steps WHERE c <> 's' UNION ALL SELECT m, NULL, m, 'D', 4 FROM (VALUES (0), (1), (2), (3)) v(m)
), front(conv_id, i, q, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, '000000000' FROM judged
  UNION ALL
  SELECT f.conv_id, r.i, e.q, min(lpad(CAST(CAST(left(f.best, 9) AS BIGINT) + 3 * n + price + CASE WHEN r.truncated AND e.e <> 'D' THEN 3 ELSE 0 END AS VARCHAR), 9, '0') || substr(f.best, 10) || repeat('I', n) || e.e)
  FROM front f JOIN judged r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1 JOIN inserted s ON s.p = f.q
    JOIN edits e ON e.m = s.m AND (e.e = 'D' OR NOT r.blank AND NOT r.duplicate AND (e.e = 'R' OR e.c = r.c))
  GROUP BY f.conv_id, r.i, e.q
), sizes AS (
  SELECT conv_id, max(i) AS n FROM judged GROUP BY conv_id
), ended AS (
  SELECT f.conv_id, min(lpad(CAST(CAST(left(best, 9) AS BIGINT) + 3 * [0, 2, 1, 0][q + 1] AS VARCHAR), 9, '0') || substr(best, 10) || repeat('I', [0, 2, 1, 0][q + 1])) AS best
  FROM front f JOIN sizes ON sizes.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = sizes.n GROUP BY f.conv_id
), audits AS (
  SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ended
), symbols AS (
  SELECT conv_id, unnest(range(1, len(audit) + 1)) AS nr, unnest(string_split(audit, '')) AS e FROM audits WHERE audit <> ''
), numbered AS (
  SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS nth FROM symbols WINDOW w AS (PARTITION BY conv_id ORDER BY nr)
), lines AS (
  SELECT n.conv_id, n.nr, n.e, n.nth, r.role, r.text, bool_or(n.nth = 1 AND n.e = 'K' AND r.c = 's') OVER (PARTITION BY n.conv_id) AS headed
  FROM numbered n LEFT JOIN judged r ON n.e <> 'I' AND r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.i WHERE n.e <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth % 2 = 1) = headed THEN 'assistant' ELSE 'user' END || ':' || coalesce(text, ''), chr(10) ORDER BY nr) AS body FROM lines GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE prior IS NOT NULL AND prior || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN audits ON audits.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id
""",
    "op12_suffix_array_dedup": """
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
  SELECT row, doc_id, i, b[i:i + 49] AS w FROM (SELECT *, unnest(range(1, octet_length(b) - 48)) AS i FROM docs)
), marked AS (
  SELECT row, i FROM (SELECT row, i, doc_id, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id
), steps AS (
  SELECT row, i, lag(i) OVER (PARTITION BY row ORDER BY i) AS prior FROM marked
), runs AS (
  SELECT row, i, sum(CASE WHEN prior IS NULL OR i - prior > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY i) AS run FROM steps
), spans AS (
  SELECT row, min(i) AS lo, max(i) + 50 AS hi FROM runs GROUP BY row, run
), between_spans AS (
  SELECT row, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 1) AS lo, lo AS hi FROM spans
  UNION ALL SELECT row, max(hi), NULL FROM spans GROUP BY row
), kept AS (
  SELECT k.row, unhex(string_agg(hex(b[k.lo:coalesce(k.hi, octet_length(b) + 1) - 1]), '' ORDER BY k.lo)) AS rest
  FROM between_spans k JOIN docs ON docs.row = k.row WHERE coalesce(k.hi, octet_length(b) + 1) > k.lo GROUP BY k.row
), summed AS (
  SELECT row, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY row
)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE coalesce(rest, ''::BLOB) END) AS kept_sha256
FROM docs d LEFT JOIN summed ON summed.row = d.row LEFT JOIN kept ON kept.row = d.row
""",
    "op13_hard_negatives": """
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.row, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.row <> b.row WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, other) AS nth FROM pairs WHERE same QUALIFY nth <= 5
), found AS (
  SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.row, p.nth ORDER BY n.score DESC, n.other) AS rank
  FROM positives p JOIN pairs n ON n.row = p.row AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
""",
}
