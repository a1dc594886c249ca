"""Phrases against a plain count, whatever the sample proposes, and against the SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from harrow.llm import collocations as C
from harrow.llm import q12_collocations
from tests.test_queries import rows as plain_rows

WORDS = "a b c d e the The Élan élan new york times {x} c-d ..".split()
SCHEMA = "lang string, text string, grp string, phrase string, n long"


def made():
    out = []
    for k in range(400):
        words = [WORDS[(k * 7 + j * j * (k % 5 + 1)) % len(WORDS)] for j in range(k % 23)]
        ends = [". ", " ", "\t", "\n", " \v", "  ", "; "]
        text = "".join(w + ends[(k + 3 * j) % len(ends)] for j, w in enumerate(words))
        out.append((("en", "fr", None, "", "en")[k % 5], text, "x", None, 1))
    out += [("en", None, None, None, None), ("fr", "", None, None, None), ("en", "new york " * 3000, None, None, None), ("en", "the same " * 30, None, None, None)]
    return out + out[:50]


def plain(rows, longest=3, least=10, part=50, top=2000):
    f, n = {}, Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + size])] += 1
    out = []
    for lang, held in f.items():
        many = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        over = Counter()
        for p, a in many.items():
            for inner in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                over[inner] = max(over[inner], a)
        kept = []
        for p, a in many.items():
            if 100 * over[p] >= part * a:
                continue
            score, _, left, right = min((1000000 * a * a // (held[p[:k]] * held[p[k:]]), k, held[p[:k]], held[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("sample_rows", [0, 3, 10_000])
def test_any_sample_gives_the_same(spark, sample_rows):
    df = spark.createDataFrame(made(), SCHEMA).repartition(5)
    got = sorted(map(tuple, C.collocations(df, sample_rows=sample_rows).collect()))
    assert got == plain(made())
    assert {r[0] for r in got} >= {"en", "fr", "und", ""}


def test_a_false_hit_of_an_earlier_map_does_not_count():
    words = C.Words([b"x y z"], ["en"])
    x, y, z = words.hashes()
    pairs = np.array([C.turned(x) ^ y, C.turned(y) ^ z])

    def bits(*hashes):
        out = np.zeros(4096, np.uint8)
        for h in hashes:
            at = int(h) % 32768
            out[at >> 3] |= 1 << (at & 7)
        return out

    first, second = [bits(y, z), bits(*pairs)], [bits(x, y, z), bits(*pairs)]  # the first map has x y without x
    passes = [{size: len(h) for size, h in C.admitted_hashes(words, maps, 3)} for maps in ([first], [first, second])]
    assert passes == [{1: 3, 2: 1, 3: 0}, {1: 0, 2: 1, 3: 1}]


def test_longer_phrases_a_small_top_and_short_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 200)
    monkeypatch.setattr(C, "MOST_BITS", 1 << 15)
    df = spark.createDataFrame(made(), SCHEMA).repartition(3)
    got = sorted(map(tuple, C.collocations(df, longest=5, least=4, top=7, sample_rows=20).collect()))
    assert got == plain(made(), longest=5, least=4, top=7)


def test_long_texts_are_cut_where_pieces_end():
    text = b"a b. c d, e f " * 40
    parts = list(C.pieces_of(text, 50))
    assert b"".join(p + b"." for p in parts).replace(b",", b".") == text.replace(b",", b".") + b"."
    assert max(map(len, parts)) <= 50
    assert list(C.pieces_of(b"x" * 99, 50)) == [b"x" * 99]
    chunk = [r for b in C.count_texts(iter([]), C.hashed, None, 3, 50) for r in b.to_pylist()]
    assert chunk == []


def test_against_sql_and_empty(spark, tmp_path):
    for name, rows in (("some", made()), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        found = q12_collocations.query(spark, folder)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        assert plain_rows(found.toPandas()) == plain_rows(c.execute(q12_collocations.ORACLE_SQL).df())


def test_counts_past_64_bits(spark):
    counted = spark.createDataFrame([("g", 2, "x y", 10**14), ("g", 1, "x", 3 * 10**14), ("g", 1, "y", 10**14 + 1)], "grp string, size int, phrase string, n long")
    row = C.scored(counted).collect()[0]
    assert row["score"] == 10**6 * 10**28 // (3 * 10**14 * (10**14 + 1))
