"""The classifier chain against a plain version: marks by slicing words, sums by loops, selection from whole pairs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import toxicity as T

SCHEMA = "doc_id long, text string, toxicity string, quality int"




def pieces(text):
    """All marks of a text as (kind, bytes), repeats included: words, five bytes of a word, beginnings of longer words."""
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    out = []
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", low):
        out.append((0, w))
        out += [(0, w[k : k + T.GRAM]) for k in range(len(w) - T.GRAM + 1)]
        out += [(n, w[:n]) for n in T.PREFIXES if len(w) > n]
    return out


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(4)
    common = [f"word{k}" for k in range(60)] + ["Straße", "naïve", "zz"]
    bad = ["blorkish", "snargle", "vexoid", "grumpf", "quazzle"]
    texts, labels = [], []
    for k in range(600):
        toxic, good = rng.random() < 0.2, rng.random() < 0.6
        words = rng.choices(common, k=rng.randrange(0, 40)) + (rng.choices(bad, k=2) if toxic else [])
        words += ["junk"] * (not good)
        rng.shuffle(words)
        texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
        labels.append((int(toxic and good), int(toxic and not good), int(toxic)))
    return texts, np.array(labels), T.train(texts, np.array(labels), list(T.CATEGORIES))


def test_scores_by_plain_sums(spark, trained):
    texts, labels, chain = trained
    assert len(chain.marks) > 3
    rows = [*texts[:200], None, "", "…", "blorkish " * 50_000, "BLORKISH snargle", "blorkishness"]
    hashed = lambda kind, piece: T.word_hashes(np.frombuffer(b"\0" + piece + b"\0", np.uint8), np.array([1]), np.array([1 + len(piece)]))
    mark = {(k, p): int((T.mix(hashed(k, p) ^ np.uint64(k)) if k else hashed(k, p))[0]) for k, p in {x for t in rows for x in pieces(t)}}
    place = {int(m): i for i, m in enumerate(chain.marks)}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], SCHEMA)
    got = {r["doc_id"]: [r["out"][c] for c in chain.categories] for r in T.with_toxicity(df, chain, out="out").collect()}
    for i, t in enumerate(rows):
        count = {}
        for p in pieces(t):
            count[mark[p]] = count.get(mark[p], 0) + 1
        held = {place[m] for m in count if m in place}
        held |= {place[a] for m, n in count.items() if n > 1 and (a := int(T.again(np.array([m], np.uint64))[0])) in place}
        earlier = []
        for w in chain.weights:
            z = sum(float(w[k]) for k in held) + sum(float(w[len(chain.marks) + k]) * p for k, p in enumerate(earlier)) + float(w[-1])
            earlier.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        assert got[i] == pytest.approx(earlier, abs=1e-9), t
    assert got[203][2] > 0.5 and got[204][2] > 0.5 and got[201][2] < 0.5


def test_counts_by_fold_select_what_whole_pairs_do(trained):
    texts, labels, chain = trained
    y = labels[:, -1].astype(float)
    fold = np.arange(len(texts)) % T.FOLDS
    rows, marks = T.with_repeats(*T.held_marks(texts))
    able, _ = T.possible_marks(texts, y, fold)
    for out in (*range(T.FOLDS), None):
        inside = fold != out if out is not None else np.ones(len(texts), bool)
        seen = inside[rows]
        number = np.cumsum(inside) - 1
        whole = T.select_marks(number[rows[seen]], marks[seen], y[inside])
        few = np.isin(marks, able) & seen
        assert whole.tolist() == T.select_marks(number[rows[few]], marks[few], y[inside]).tolist() and len(whole)
    assert chain.marks.tolist() == T.select_marks(rows, marks, y).tolist()


def test_none_all_and_empty(spark):
    for labels in ([[0, 0, 0]] * 4, [[1, 0, 1]] * 4):
        chain = T.train(["a b", "c", "", "d"], np.array(labels), list(T.CATEGORIES))
        share = T.Chain.probabilities(chain, ["x", None])
        assert (abs(share[:, 2] - np.clip(labels[0][2], 1e-3, 1 - 1e-3)) < 1e-9).all()
    assert len(T.train([], np.zeros((0, 3), np.int64), list(T.CATEGORIES)).marks) == 0
    df = spark.createDataFrame([(1, "x", "kept", 1)], SCHEMA)
    out = T.with_toxicity(df, chain, out="score")
    assert out.columns == [*df.columns, "score"] and out.first()["toxicity"] == "kept"
    assert T.with_toxicity(df, chain).columns == df.columns and T.with_toxicity(df.limit(0), chain).where(F.col("toxicity").isNotNull()).collect() == []
