"""Query op13: leaves, roots, proofs and their verification for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import table
from harrow.llm.merkle import FIELDS, folded, hexed, leaf_of, manifest, tree_of

NAME = "op13_merkle"
#: Rows whose number of characters is one more when the proof is tried.
TAMPERED = "coalesce(crc32(cast(doc_id AS string)) % 7 = 0, false)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    leaf = lambda n: leaf_of(*[n if c == "n_chars" else F.col(c) for c in FIELDS])
    changed = F.when(F.expr(TAMPERED) & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1))
    leaves = docs.select("doc_id", tree_of(F.col("lang")).alias("tree"), leaf(F.col("n_chars")).alias("digest"), changed.alias("changed"))
    found = manifest(leaves, ["doc_id"])
    again = folded(F.coalesce("changed", "digest"), F.col("path"), F.col("idx"), F.col("height"), F.col("top"))
    siblings = F.aggregate("path", F.lit(b""), lambda all_, s: F.concat(all_, s))
    rows = found.select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), F.sha2(hexed(siblings).cast("binary"), 256).alias("proof_sha256"), hexed(again).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = " || ".join("CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END".format(c=c) for c in FIELDS)
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda s, x: " + "STEP8" + ")"
_SHIFT = lambda e: f"list_reduce([{e}, 0, 0, 0, 0, 0, 0, 0, 0], lambda t, u: xor(t >> 1, (t & 1) * 3988292384))"
_CRC = f"xor({_CRC.replace('STEP8', _SHIFT('xor(s, x)'))}, 4294967295)"
#: A tree level by level: pairs of neighbours by number, the last one alone.
_LEVELS = """
  SELECT tree, level + 1 AS level, i // 2 AS i, (n + 1) // 2 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {t} WHERE n > 1 GROUP BY tree, level, i // 2, n"""
_UP = lambda t, leaf: (
    f"SELECT a.row, {leaf} + b.level AS level, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < b.i) AS l, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > b.i) AS r"
    f" FROM {t}_at a JOIN {t} b ON b.tree = a.tree AND b.i = a.i >> b.level AND b.n > 1 LEFT JOIN {t} s ON s.tree = b.tree AND s.level = b.level AND s.i // 2 = b.i // 2 AND s.i <> b.i GROUP BY a.row, {leaf} + b.level"
)
ORACLE_SQL = f"""
WITH RECURSIVE made AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('1' || lang, '0') AS tree, sha256({_LEAF}) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM made),
low AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM placed UNION ALL {_LEVELS.format(t="low")}),
subroots AS (SELECT tree, level AS height, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT '' AS tree, 0 AS level, i, n, h FROM subroots UNION ALL {_LEVELS.format(t="high")}),
low_at AS (SELECT row, tree, i FROM placed),
high_at AS (SELECT row, '' AS tree, subroots.i FROM placed JOIN subroots USING (tree)),
steps AS ({_UP("low", "0")} UNION ALL {_UP("high", "1000")}),
proofs AS (SELECT row, list(struct_pack(l := coalesce(l, ''), r := coalesce(r, '')) ORDER BY level) AS p FROM steps GROUP BY row),
every AS (SELECT placed.*, coalesce(p, []) AS p, subroots.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root FROM placed JOIN subroots USING (tree) LEFT JOIN proofs USING (row)),
done AS (
  SELECT *, list_reduce(list_prepend(struct_pack(l := coalesce(changed, leaf), r := ''), p), lambda a, s: struct_pack(l := sha256(s.l || a.l || s.r), r := '')).l AS folded_root FROM every)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(p, lambda s: s.l || s.r), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
