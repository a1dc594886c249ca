"""SimHash groups against brute force: hot groups, clashing names, null keys, similarity of word sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrow.llm import common, simhash
from tests.llm.test_llm import DOCS, HARD


def words(text):
    return (text or "").encode().lower().split()


def five(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else {()})


def edited(rng, base, rate):
    out = list(base)
    for i in np.flatnonzero(rng.random(len(out)) < rate):
        out[i] = f"new{rng.integers(1e9)}"
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        for rate in (0, 0, 0.002, 0.01, 0.02, 0.04, 0.08):
            rows.append(" ".join(edited(rng, base, rate)))
    return list(enumerate(rows))


def brute_groups(rows, similarity=0.8):
    sets = {i: five(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for i in sets:
        for j in sets:
            if i < j and (both := len(sets[i] & sets[j])) and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}, pairs


@pytest.mark.parametrize("block", [simhash.SETS, 7])
@pytest.mark.parametrize("bits", [simhash.DISTANCE, 0])
def test_similar_groups_lose_no_link(spark, monkeypatch, block, bits):
    """Pairs at the threshold itself, chains of them, and a group of copies that are mostly not alike; whatever fingerprints propose."""
    monkeypatch.setattr(simhash, "SETS", block)
    monkeypatch.setattr(simhash.links, "__defaults__", (bits,))
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**9)}"
    rows = [(k, t) for k, t in enumerate((None, "", "a b", "A b", "a b c d e f"))]
    for _ in range(60):  # n shingles, of which changed ones at the end only: on both sides of 0.8
        n = int(rng.integers(5, 60))
        base = [word() for _ in range(n + 4)]
        for _ in range(3):
            cut = int(rng.integers(0, n // 6 + 2))
            rows.append((len(rows), " ".join(base[: len(base) - cut] + [word() for _ in range(cut)])))
    base = [word() for _ in range(120)]
    for _ in range(80):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 5)):
            own[at] = word()
        rows.append((len(rows), " ".join(own)))
    want, pairs = brute_groups(rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert found == want and len(pairs) > 100


def test_similar_groups(spark):
    rows = corpus(3)
    want, pairs = brute_groups(rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    caught = np.mean([found[a] == found[b] for a, b in pairs])
    assert caught >= 0.95, caught  # fingerprints propose by chance; what they propose is decided exactly
    assert all(want[a] == want[b] for a in found for b in found if found[a] == found[b])
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(found.values()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_keep_one_with_clashing_names_nulls_and_repeats(spark, monkeypatch, broadcast):
    """Input columns may have any name; a hot key, null keys and repeated rows leave one row; both ways of marking give the same."""
    monkeypatch.setattr(common, "MOST_MARKS", 1_000_000 if broadcast else 0)
    long = "one two three four five six seven eight nine ten"
    rows = [r[:2] for r in HARD] + [(50, long)] * 200 + [(51, long.upper()), (None, long), (None, "alone and without an id here"), (60, "a different text altogether with many words")]
    df = spark.createDataFrame(rows, DOCS)
    clash = df
    for name in ("k", "h", "root", "_k", "_h", "_mark", "node", "component_id", "text_hash", "first", "n", "_key", "names"):
        clash = clash.withColumn(name, F.lit(7))
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # 1: near 0 by upper case only; 2, 3, 4, 7: no words
    want = [(False, i) for i in (0, 2, 5, 6, 50, 60)] + [(True, 0)] * 2
    assert got == sorted(want)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_hot_keys_do_not_meet(spark, monkeypatch):
    left = common.materialize(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("key"), F.col("id").alias("v")), "left")
    right = common.materialize(spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x")), "right")
    found = common.lookup(left, right, "key")
    assert {(r["key"], r["v"], r["x"]) for r in found.collect()} == {(1 if v % 3 == 0 else v, v, 2 if v % 3 == 0 else 2 * v) for v in range(3000)}
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_wide_links_are_a_forest_of_all_that_meets(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.blocked, "__defaults__", (block,))
    rng = np.random.default_rng(2)
    centre = rng.integers(-(1 << 62), 1 << 62, 2)
    prints = {tuple(int(x) for x in centre)}
    for _ in range(120):
        p = list(next(iter(prints)))
        for b in rng.choice(128, rng.integers(1, 7), replace=False):
            v = p[b // 64] ^ (1 << int(b % 64))
            p[b // 64] = ((v + (1 << 63)) % (1 << 64)) - (1 << 63)
        prints.add(tuple(p))
    prints = sorted(prints)
    found = simhash.met(simhash.replicas(spark.createDataFrame(prints, "p0 long, p1 long"), simhash.WIDE), 12).collect()
    near = lambda a, b: sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(a, b)) <= 12
    edges = [((r["a_p0"], r["a_p1"]), (r["b_p0"], r["b_p1"])) for r in found]
    assert all(near(a, b) and a < b for a, b in edges) and len(edges) < 8 * len(prints)

    def groups(pairs):
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {p: find(p) for p in prints}

    # 12 bits over 8 segments: at most one in some segment, so every near pair meets
    assert groups(edges) == groups([(a, b) for a in prints for b in prints if a < b and near(a, b)])


def test_shingles_of_hard_texts():
    texts = [None, "", " \t", "A b", "a B", "a b c d e f", "é É a b c d", "x" * 100000, "\x85 \xa0 z"]
    sets = [set(h.tolist()) for _, hashes, count in simhash.shingle_hashes(texts, 5) for h in np.split(hashes, np.cumsum(count)[:-1])]
    assert [len(s) for s in sets] == [0, 0, 0, 1, 1, 2, 2, 1, 1]
    assert sets[3] == sets[4] and len(set().union(*sets)) == 7


@pytest.mark.parametrize("few", [simhash.FEW, 1, 10**9])
def test_shared_shingles_count_pair_by_pair_or_by_products(monkeypatch, few):
    """One block against itself must not make a column for each shingle that a single set has: 400 sets of 500 own ones were 200,000 columns."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(8)
    sets = lambda n: [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.int32)) for _ in range(n)]
    x, y = sets(30), sets(20)
    want = lambda a, b: np.array([[len(np.intersect1d(s, t)) for t in b] for s in a])
    assert (simhash.shared_shingles(x, y) == want(x, y)).all()
    apart = ~np.eye(len(x), dtype=bool)
    assert (simhash.shared_shingles(x, x) == want(x, x))[apart].all()
    made = []
    zeros = np.zeros
    monkeypatch.setattr(simhash, "FEW", 256)
    monkeypatch.setattr(simhash.np, "zeros", lambda shape, *a: made.append(int(np.prod(shape))) or zeros(shape, *a))
    own = [np.arange(k * 500, k * 500 + 501, dtype=np.int32) for k in range(400)]  # each shares one with the next
    shared = simhash.shared_shingles(own, own)
    monkeypatch.undo()
    assert all(shared[k, k + 1] == 1 for k in range(399)) and max(made) <= 400 * 400


def test_finer_counts_part_large_sets_and_keep_what_is_alike(monkeypatch):
    """64 bins never parted sets of some thousand shingles: all that share one rare shingle were compared whole, by blocks of each other."""
    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32))
    sets = [draw(n) for n in (4000, 4100, 4200, 9000, 700, 60, 5, 0, 40_000)]
    for s in list(sets):  # of 0.8 and more, and of just under, by leaving out and by putting in
        sets += [s[rng.permutation(len(s))[: int(np.ceil(len(s) * share))]] for share in (0.8, 0.79)]
        sets.append(np.union1d(s, draw(len(s) // 5)))
    sets = [np.sort(s) for s in sets]
    n = np.array([len(s) for s in sets], np.int64)
    part = pd.DataFrame({"cell": 1, "i": 0, "j": 1, "own": np.arange(len(sets)) % 2, "comp": np.arange(len(sets)), "node": np.arange(len(sets)), "n": n})
    part["bins"] = [simhash.finer(s).tobytes() for s in sets]
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    want = [(a, b) for a in range(0, len(sets), 2) for b in range(1, len(sets), 2) if alike(a, b)]
    for pairs in (simhash.PAIRS, 1):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        found = pd.concat(simhash.closer(0.8)(iter([part.iloc[:9], part.iloc[9:]])))
        root = list(range(len(sets)))
        for a, b in found.itertuples(index=False):
            root = [root[a] if r == root[b] else r for r in root]
        assert len(want) > 8 and all(root[a] == root[b] for a, b in want)
        assert len({root[k] for k in (0, 1, 2, 3, 4)}) == 5  # sets of their own, however large


def test_shared_shingles_hold_a_range_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(-(1 << 31), 1 << 31, 300).astype(np.int32)) for _ in range(12)]
    sets = [np.union1d(s, sets[(k + 1) % 12][:100]) for k, s in enumerate(sets)]
    want = simhash.shared_shingles(sets[:5], sets[5:])
    seen = []
    whole = simhash.shared_in_range
    monkeypatch.setattr(simhash, "shared_in_range", lambda x, y: seen.append(sum(map(len, x))) or whole(x, y))
    monkeypatch.setattr(simhash, "HELD", 500)
    assert (simhash.shared_shingles(sets[:5], sets[5:]) == want).all() and want.max() >= 100
    assert len(seen) > 5 and max(seen) < 1000
