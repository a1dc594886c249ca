"""Query op1: every document whose id is divisible by 20 asks with its whole text for its ten best documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import table
from harrow.llm.search import K1, TOP, B, top_similar

NAME = "op1_search"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = top_similar(docs, docs.where(F.col("doc_id") % 20 == 0), terms=None)
    return found.select("query_id", F.col("hit_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, min(place) AS place FROM words GROUP BY ALL),
len AS (SELECT doc_id, count(*)::DOUBLE AS n FROM words GROUP BY ALL),
stats AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM words)::DOUBLE / (SELECT count(*) FROM documents) AS average),
df AS (SELECT term, ln(1.0::DOUBLE + (any_value(stats.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term),
asked AS (
  SELECT tf.doc_id AS query_id, tf.term, idf FROM tf JOIN df USING (term) WHERE tf.doc_id % 20 = 0),
scored AS (
  SELECT query_id, tf.doc_id, sum(round_even(idf * (tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * len.n / average))) * 1e6, 0)) AS score
  FROM asked JOIN tf USING (term) JOIN len ON len.doc_id = tf.doc_id, stats GROUP BY ALL)
SELECT query_id, doc_id, round(score / 1e6, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM scored QUALIFY rank <= {TOP}
"""
