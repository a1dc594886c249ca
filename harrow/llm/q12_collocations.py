"""Query op12: each language's best phrases of two and three words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrow.llm.collocations import LEAST, PART, TOP, collocations
from harrow.llm.common import table

NAME = "op12_collocations"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text")).withColumnRenamed("grp", "lang")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAM = lambda k: " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: {_GRAM(k)})) AS phrase FROM worded WHERE len(w) >= {k}" for k in (1, 2, 3))
_CUT = lambda k: f"SELECT lang, phrase, a, {k} AS k, array_to_string(w[:{k}], ' ') AS x, array_to_string(w[{k} + 1:], ' ') AS y FROM many WHERE len(w) > {k}"
ORACLE_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
f AS (SELECT lang, phrase, size, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL),
words AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
many AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {LEAST}),
cuts AS ({_CUT(1)} UNION ALL {_CUT(2)}),
scores AS (
  SELECT lang, cuts.phrase, a, k, p.f AS l, q.f AS r, (1000000::HUGEINT * a * a // (p.f::HUGEINT * q.f))::BIGINT AS score FROM cuts
  JOIN f p USING (lang) JOIN f q USING (lang) WHERE p.phrase = x AND q.phrase = y),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS o FROM many, (SELECT unnest([1, 2]) AS s) WHERE len(w) = 3 GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE o IS NULL OR 100 * o < {PART} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN words USING (lang) QUALIFY rank <= {TOP}
"""
