"""Query op11: host, path, rule and verdict of every page's address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import table
from harrow.llm.urls import ADDRESS, DEPTH, EXTENSION, KEEP_ROWS, KEEP_SHARE, KINDS, LOWER, PURE, SIGMAS, UPPER, WEIGHT, with_verdicts

NAME = "op11_urls"
#: Verdict, host and path of each rule (fixed values).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A page's second segment begins with the number of the document that it shows; that document's labels are the address's.
NUMBER = "^/[^/]*/([0-9]{1,18})"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    number = F.expr(f"try_cast(regexp_extract(path, '{NUMBER}', 1) AS BIGINT)")
    return with_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), labels, number, RULES).drop("url")


_KIND = " ".join(f"WHEN regexp_matches(stem, '{pattern}') THEN '{name}'" for name, pattern in KINDS)
_WILD = (
    f"CASE WHEN s = '{{rest}}' OR s = '' THEN s ELSE (SELECT '{{' || CASE {_KIND} ELSE 'w' END || CASE WHEN regexp_matches(s, '[^.]{EXTENSION}') THEN '.' ELSE '' END || '}}'"
    f" FROM (SELECT regexp_replace(s, '([^.]){EXTENSION}', '\\1') AS stem)) END"
)
_LITERAL = "CASE WHEN s = '{rest}' THEN s ELSE replace(replace(s, '{', '{{'), '*', '{*') END"


def _levels() -> str:
    out = []
    for k in range(DEPTH + 1):
        out.append(f"""
open{k} AS (SELECT host, prefix, rest[1] AS s, sum(n) AS n FROM t{k} WHERE len(rest) > 0 GROUP BY ALL),
kept{k} AS (SELECT host, prefix, s, true AS kept FROM open{k} QUALIFY n >= {KEEP_ROWS} AND n >= {KEEP_SHARE}::DOUBLE * sum(n) OVER (PARTITION BY host, prefix)),
t{k + 1} AS (
  SELECT host, path, CASE WHEN len(rest) > 0 THEN list_append(prefix, CASE WHEN kept THEN {_LITERAL} ELSE {_WILD} END) ELSE prefix END AS prefix, rest[2:] AS rest, n, labelled, good
  FROM (SELECT t.*, t.rest[1] AS s, kept FROM t{k} t LEFT JOIN kept{k} k ON k.host = t.host AND k.prefix = t.prefix AND k.s = t.rest[1]))""")
    return ",".join(out)


def _merges() -> str:
    out = []
    for k in range(DEPTH + 1, 0, -1):
        out.append(f"""
a{k} AS (SELECT *, CASE WHEN len(branch) >= {k} THEN list_concat(list_append(branch[:{k - 1}], '*'), branch[{k + 1}:]) ELSE branch END AS around FROM b{k + 1}),
c{k} AS (
  SELECT *, sum(labelled) OVER own AS m, sum(good) OVER own AS g, row_number() OVER (PARTITION BY host, branch ORDER BY template) = 1 AS first_,
         sum(labelled) OVER every AS mm, sum(good) OVER every AS gg FROM a{k} WINDOW own AS (PARTITION BY host, branch), every AS (PARTITION BY host, around)),
d{k} AS (
  SELECT *, CASE WHEN m = 0 OR mm - m = 0 THEN true ELSE
      (g / m - (gg - g) / (mm - m)) * (g / m - (gg - g) / (mm - m)) <= {SIGMAS * SIGMAS}::DOUBLE * (gg / mm * (1 - gg / mm) * (1.0::DOUBLE / m + 1.0::DOUBLE / (mm - m))) END AS alike FROM c{k}),
b{k} AS (
  SELECT host, template, labelled, good, CASE WHEN alike AND count(*) FILTER (first_ AND alike) OVER (PARTITION BY host, around) >= 2 THEN around ELSE branch END AS branch FROM d{k})""")
    return ",".join(out)


_FITS = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_RULE = lambda value: "CASE " + " ".join(f"WHEN {_FITS(h, p)} THEN '{value(v, h + p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
_PARTS = "string_split(path[2:], '/')"
ORACLE_SQL = f"""
WITH pages_ AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{ADDRESS}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages),
paths AS (SELECT host, path, count(*) AS n, try_cast(regexp_extract(path, '{NUMBER}', 1) AS BIGINT) AS key FROM pages_ GROUP BY host, path),
marks AS (SELECT doc_id AS key, bool_and(quality = 1 AND toxic = 0) AS mark FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
t0 AS (
  SELECT host, path, []::VARCHAR[] AS prefix,
         CASE WHEN path = '' THEN []::VARCHAR[] WHEN len({_PARTS}) > {DEPTH} THEN list_append({_PARTS}[:{DEPTH}], '{{rest}}') ELSE {_PARTS} END AS rest,
         n, (mark IS NOT NULL)::BIGINT AS labelled, coalesce(mark, false)::BIGINT AS good FROM paths LEFT JOIN marks USING (key)),
{_levels()},
b{DEPTH + 2} AS (SELECT host, prefix AS template, prefix AS branch, sum(labelled) AS labelled, sum(good) AS good FROM t{DEPTH + 1} GROUP BY host, prefix),
{_merges()},
prior AS (SELECT coalesce(sum(good) / nullif(sum(labelled), 0), 1.0) AS p FROM b1),
hosts AS (SELECT host, (sum(good) + {WEIGHT}::DOUBLE * (SELECT p FROM prior)) / (sum(labelled) + {WEIGHT}::DOUBLE) AS h FROM b1 GROUP BY host),
pure AS (SELECT host, branch, (sum(good) + {WEIGHT}::DOUBLE * any_value(h)) / (sum(labelled) + {WEIGHT}::DOUBLE) AS purity FROM b1 JOIN hosts USING (host) GROUP BY host, branch),
known AS (SELECT t.host, t.path, b1.branch, purity FROM t{DEPTH + 1} t JOIN b1 ON b1.host = t.host AND b1.template = t.prefix JOIN pure ON pure.host = t.host AND pure.branch = b1.branch)
SELECT page_id, host, path, {_RULE(lambda v, r: r)} AS rule,
       coalesce({_RULE(lambda v, r: v)}, CASE WHEN purity < {PURE}::DOUBLE AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(branch, '/') AS template, purity
FROM pages_ JOIN known USING (host, path)
"""
