"""Query op8: license phrases and template matches of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import table
from harrow.llm.licenses import LOWER, PHRASES, TEMPLATES, THRESHOLD, UPPER, at_least, own_words, scan, span_of

NAME = "op8_licenses"


def digests(scanned: DataFrame) -> DataFrame:
    labels = lambda c: F.array_sort(F.array_distinct(c))
    best = F.coalesce(F.array_max("matches.score"), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.place").cast("long").alias("first_word"),
        F.array_max("places.place").cast("long").alias("last_word"),
        F.array_join(labels(F.col("places.label")), ",").alias("base_labels"),
        F.array_join(labels(F.concat("places.label", "matches.label")), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, r, unnest(list_filter(range(0, len(w)), lambda i: {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1))})) AS place, '{label}' AS label FROM words"
    for phrase, label in PHRASES.items()
)
_OWN = own_words()
_TEMPLATES = ", ".join(
    f"({k}, '{label}', list_distinct(string_split('{words}', ' ')), {sorted(_OWN[label, words])}::VARCHAR[], {at_least(THRESHOLD, len(_OWN[label, words]))}, {span_of(words)})" for k, (label, words) in enumerate(TEMPLATES)
)
ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, text, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
places AS ({_PLACES}),
templates(k, label, tokens, marks, few, span) AS (VALUES {_TEMPLATES}),
raw AS (
  SELECT r, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT r, string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10)) AS l FROM words)),
worded AS (SELECT r, i, regexp_extract_all(line, '{_WORD}') AS w FROM raw),
parts AS (SELECT r, i, w, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS part FROM worded),
paragraphs AS (SELECT r, part, flatten(list(w ORDER BY i)) AS w FROM parts WHERE len(w) > 0 GROUP BY r, part),
spread AS (SELECT r, part, generate_subscripts(w, 1) AS p, unnest(w) AS t FROM paragraphs),
tokens AS (SELECT k, span, unnest(tokens) AS t, marks FROM templates),
held AS (SELECT r, part, p, spread.t, k, span, list_contains(marks, spread.t) AS mark FROM spread JOIN tokens USING (t)),
blocks AS (
  SELECT a.r, a.part, a.p, a.k, count(DISTINCT b.t) AS n, count(DISTINCT CASE WHEN b.mark THEN b.t END) AS marked
  FROM held a JOIN held b ON b.r = a.r AND b.part = a.part AND b.k = a.k AND b.p BETWEEN a.p AND a.p + a.span - 1 GROUP BY 1, 2, 3, 4),
met AS (
  SELECT r, part, label, max(n) / any_value(len(tokens)) AS score FROM blocks JOIN templates USING (k)
  WHERE n >= ceil({THRESHOLD} * len(tokens)) AND marked >= few GROUP BY r, part, k, label),
base AS (SELECT r, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
best AS (SELECT r, max(score) AS score FROM met GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM met UNION ALL SELECT r, label FROM places) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.f::BIGINT AS first_word, base.l::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.score, 0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)
"""
