"""One query for each operator over its whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, neardup, neighbours, packing, parsing, quality, spelling, substring, tokens, toxicity, whitening
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), n=4)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, docs.where(~language.held_out()))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = language.held_out(parts=5, part=0)
    found = toxicity.toxicity(docs, labels.where(~out))
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.size("removed").alias("n_removed"), substring.removed_text().alias("removed"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsing.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.length("kept").cast("long")
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_pack, op3_licenses, op4_neighbours, op5_near_duplicates, op6_quality, op7_language, op8_toxicity, op9_token_counts, op10_substring_dedup,
        op11_spelling_variants, op12_whitening, op13_suffix_dedup,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, dg.n, item_id FROM dg JOIN win ON dg.gram = win.gram AND dg.n = win.n),
spans AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON w.doc_id = m.a""",
    "op10_substring_dedup": f"""
WITH p AS (
  SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '\\n|[^.!?\\n]+[.!?]*|[.!?]+') AS x FROM documents WHERE text <> '')),
w AS (SELECT doc_id, piece, k, regexp_extract_all({_LOWER.format("piece")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM p),
s AS (
  SELECT doc_id, k, piece, w, len(w) > 0 AS is_unit, sum(length(piece)) OVER so_far - length(piece) AS start,
         count_if(len(w) > 0) OVER so_far - 1 AS unit, count_if(piece = chr(10)) OVER so_far AS line, lag(piece) OVER (PARTITION BY doc_id ORDER BY k) AS before
  FROM w WINDOW so_far AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
u AS (
  SELECT doc_id, k, unit, start, start + length(piece) AS stop, len(w) AS n_words, coalesce(before, chr(10)) = chr(10) AS line_start,
         first_value(doc_id) OVER same AS first_doc_id, first_value(unit) OVER same AS first_unit
  FROM s WHERE is_unit WINDOW same AS (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, unit)),
lines AS (
  SELECT doc_id, min(unit) AS unit, count(*) AS span, sum(len(w)) AS n_words, string_agg(array_to_string(w, ' '), ' ' ORDER BY k) AS g
  FROM s WHERE is_unit GROUP BY doc_id, line),
again AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY g ORDER BY doc_id, unit) AS first_doc_id, first_value(unit) OVER (PARTITION BY g ORDER BY doc_id, unit) AS first_unit,
         count(*) OVER (PARTITION BY g) AS n
  FROM lines),
whole AS (
  SELECT doc_id, unnest(range(unit::BIGINT, (unit + span)::BIGINT)) AS unit, first_doc_id, first_unit FROM again
  WHERE NOT (doc_id = first_doc_id AND unit = first_unit) AND (n_words >= {substring.LINE_WORDS} OR n >= greatest({substring.COMMON}, {substring.COMMON_SHARE}::DOUBLE * (SELECT count(*) FROM documents)))),
later AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM u WHERE NOT (doc_id = first_doc_id AND unit = first_unit)),
runs AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS total FROM later),
going AS (
  SELECT u.doc_id, u.unit, u.start, u.stop, u.line_start, coalesce(whole.first_doc_id, runs.first_doc_id) AS first_doc_id, coalesce(whole.first_unit, runs.first_unit) AS first_unit
  FROM u LEFT JOIN whole ON u.doc_id = whole.doc_id AND u.unit = whole.unit LEFT JOIN runs ON u.doc_id = runs.doc_id AND u.unit = runs.unit AND total >= {substring.MIN_RUN_WORDS}
  WHERE whole.unit IS NOT NULL OR runs.unit IS NOT NULL),
grouped AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS part FROM going),
gone AS (SELECT *, max(unit) OVER r AS last_unit, arg_min(line_start, unit) OVER r AS at_line FROM grouped WINDOW r AS (PARTITION BY doc_id, part)),
left_over AS (
  SELECT s.doc_id, string_agg(s.piece, '' ORDER BY s.k) AS text
  FROM s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.unit = g.unit
  WHERE g.doc_id IS NULL OR (NOT s.is_unit AND NOT at_line AND g.unit = g.last_unit)
  GROUP BY s.doc_id),
lists AS (
  SELECT doc_id, count(*) AS n, string_agg(start || '-' || stop || ':' || first_doc_id || '.' || first_unit, ',' ORDER BY unit) AS removed
  FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_over.text, '') END AS text,
       coalesce(lists.n, 0)::INTEGER AS n_removed, coalesce(lists.removed, '') AS removed
FROM documents d LEFT JOIN left_over USING (doc_id) LEFT JOIN lists USING (doc_id)""",
    # The checksum: its table by rule, then over the bytes of "<doc_id>:<run>", whose characters are all under U+0100.
    "op11_spelling_variants": f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
b AS (
  SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)]::BIGINT[] END)) AS bytes
  FROM r),
h AS (SELECT run, n, xor(list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b, tab),
o AS (SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v),
gaps AS (SELECT DISTINCT word, word[1 : p - 1] || '*' || word[p + 1 :] AS pattern, word[1 : p - 1] || word[p + 1 :] AS shorter, p FROM places),
pairs AS (
  SELECT a.word AS x, b.word AS y FROM gaps a JOIN gaps b ON a.pattern = b.pattern AND a.word <> b.word
  UNION SELECT gaps.word, v.word FROM gaps JOIN v ON gaps.shorter = v.word
  UNION SELECT v.word, gaps.word FROM gaps JOIN v ON gaps.shorter = v.word),
near AS (SELECT x AS word, count(*) AS n_near, arg_min(y, (-n, y)) AS form, max(n) AS form_n FROM pairs JOIN v ON v.word = y GROUP BY x),
told AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS root, form AS following FROM told UNION ALL SELECT chain.word, told.word, told.form FROM chain JOIN told ON told.word = chain.following)
SELECT told.word, told.form, chain.root, told.n, told.n_near, told.form_n FROM told JOIN chain ON chain.word = told.word AND chain.following IS NULL""",
}
