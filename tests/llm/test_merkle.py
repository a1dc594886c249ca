"""The Merkle manifest against a plain version, for two and for three nodes a run."""

import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from harrow.llm import merkle, q13_merkle
from tests.test_queries import TABLES
from tests.test_queries import rows as plain_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx string, tree string"
DOCS = [
    (1, "one", "en", "s", 3, "x", "y"),
    (2, None, "en", None, None, "x", "y"),
    (2, None, "en", None, None, "x", "y"),
    (3, "", "en", "s", 0, None, None),
    (None, "no id", "en", "s", 5, None, None),
    (4, "a" * 300_000, "en", "s", 300_000, None, None),
    (5, "élan", "fr", "s", 4, None, None),
    (6, "no lang", None, "s", 7, None, None),
    (7, "empty lang", "", "s", 10, None, None),
    *[(k, f"text {k % 9}", "en" if k % 3 else "de", "s", 6, None, None) for k in range(10, 60)],
]


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, more=0):
    sized = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    n = None if row["n_chars"] is None else row["n_chars"] + more
    return sha(*map(sized, (row["doc_id"], row["source"], row["lang"], n, row["text"])))


def climb(nodes, arity):
    """Root, and per place the (left, right) siblings from the leaf up."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            low = i - i % arity
            proofs[k].append((nodes[low:i], nodes[i + 1 : low + arity]))
        nodes = [sha(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], proofs


def brute(docs, arity=2):
    groups = {}
    for r in docs:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        low[g] = climb([leaf(r) for r in groups[g]], arity)
    root, high = climb([low[g][0] for g in order], arity) if order else (None, [])
    out = []
    for g, above in zip(order, high):
        for r, proof in zip(groups[g], low[g][1]):
            id_ = r["doc_id"]
            fold = leaf(r, int(id_ is not None and zlib.crc32(str(id_).encode()) % 7 == 0))
            for left, right in proof + above:
                fold = sha(*left, fold, *right)
            siblings = sha(*[h for left, right in proof + above for h in left + right])
            out.append((id_, leaf(r), low[g][0], root, siblings, fold, fold == root))
    return sorted(out, key=str)


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("rows", [DOCS, DOCS[:1], DOCS[4:9], []], ids=["all", "one", "lone leaves", "empty"])
def test_against_plain_version_and_sql(spark, tmp_path, rows):
    write(spark, rows, str(tmp_path))
    docs = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    found = q13_merkle.query(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert plain_rows(found.toPandas()) == plain_rows(c.execute(q13_merkle.ORACLE_SQL).df())


def test_whole_table_against_sql(spark, sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    found = q13_merkle.query(spark, sf).toPandas()
    assert plain_rows(found) == plain_rows(c.execute(q13_merkle.ORACLE_SQL).df())
    assert 0 < (~found.verified).sum() < len(found) / 3


def test_runs_of_three_shuffled_and_broadcast(spark, monkeypatch):
    docs = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in DOCS]
    df = spark.createDataFrame(DOCS, SCHEMA)
    leaves = df.select("doc_id", merkle.tree_of(F.col("lang")).alias("tree"), merkle.leaf_of(*map(F.col, merkle.FIELDS)).alias("digest"))
    for most in (merkle.BROADCAST_BYTES, 0):
        monkeypatch.setattr(merkle, "BROADCAST_BYTES", most)
        found = merkle.manifest(leaves, ["doc_id"], 3)
        again = merkle.folded(F.col("digest"), F.col("path"), F.col("idx"), F.col("height"), F.col("top"), 3)
        got = found.select("doc_id", merkle.hexed(F.col("digest")), merkle.hexed(F.col("subroot")), merkle.hexed(F.col("root")), merkle.hexed(again))
        want = [(r[0], r[1], r[2], r[3], r[3]) for r in brute(docs, 3)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
