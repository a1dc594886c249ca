"""As-of, range, concordance, partners, waves, descent and retention against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.operators import joins as J
from harrow.operators import linking as L
from harrow.streaming import merge as M
from harrow.streaming.streams import waves

V4 = "0" * 20 + "ffff"


@pytest.mark.parametrize("seed", range(3))
def test_as_of_any_order(spark, seed):
    rng = random.Random(seed)
    ips = [1, 2, 3, 4, None]
    requests = [(i, rng.choice(ips), rng.choice([None, *range(0, 400_000, 7_000)]), "x") for i in range(300)]
    log = [(rng.choice(ips[:3] + [None]), rng.randrange(0, 400_000, 7_000), h, rng.choice([None, *"abcdef"])) for h in range(60)]
    found = J.enrich_as_of(spark.createDataFrame(requests, "id long, ip long, t long, data string"), spark.createDataFrame(log, "ip long, t long, hlc long, value string"), "value", "found")
    assert found.columns == ["id", "ip", "t", "data", "found"]
    want = {}
    for i, ip, t, _ in requests:
        own = sorted((u, h, v) for j, u, h, v in log if j == ip and v is not None) if None not in (ip, t) else []
        before = [x for x in own if x[0] <= t] if own else []
        want[i] = (before[-1] if before else own[0])[2] if own else None
    assert {r["id"]: r["found"] for r in found.collect()} == want


def test_as_of_of_one_hot_source(spark):
    """A third of a million rows of one source; the old plan's work grew with the square of it."""
    requests = spark.range(300_000).select("id", F.lit(7).alias("ip"), (F.col("id") * 10).alias("t"))
    log = spark.range(1, 3001).select(F.lit(7).alias("ip"), (F.col("id") * 1000).alias("t"), F.col("id").alias("hlc"), F.col("id").alias("data"))
    row = J.enrich_as_of(requests, log).agg(F.count_if(F.col("data") != F.greatest(F.floor(F.col("t") / 1000), F.lit(1))).alias("wrong"), F.count(F.lit(1)).alias("n")).first()
    assert (row["wrong"], row["n"]) == (0, 300_000)


def key(n):
    return f"{n:032x}"


@pytest.mark.parametrize("seed", range(3))
def test_geo_join(spark, seed, monkeypatch):
    """Both families, unaligned and nested ranges, ranges of one address, of all, and upside down; broadcast and shuffled."""
    rng = random.Random(seed)
    v4, v6 = int(V4, 16) << 32, 0x20010DB8 << 96
    ends = [(0, 2**128 - 1)] if seed else []
    for k in range(120):
        base, bits = (v4, 32) if k % 2 else (v6, 96)
        low = base + rng.randrange(2 ** rng.randrange(1, bits))
        ends.append((low, low + rng.choice([0, 1, 255, rng.randrange(2 ** rng.randrange(1, bits))])))
    ends += [(v4 + 100, v4 + 50), (v4, v4 + 2**32 - 1), (v6, v6 + 2**96 - 1)]
    points = sorted({min(max(x + d, 0), 2**128 - 1) for e in ends for x in e for d in (-1, 0, 1)} | {v4 + rng.randrange(2**32) for _ in range(50)})
    sources = [(i, key(p)) for i, p in enumerate(points)] + [(-1, None)]
    ranges = spark.createDataFrame([(key(a), key(b).upper(), f"c{i}", i) for i, (a, b) in enumerate(ends)], "low string, high string, country string, asn long")
    monkeypatch.setattr(J, "MOST_PREFIXES", 1_000_000 if seed % 2 else 0)
    found = J.geo_join(spark.createDataFrame(sources, "id long, ip_key string"), ranges)
    assert found.columns == ["id", "ip_key", "country", "asn"]
    want = {-1: None}
    for i, p in enumerate(points):
        held = [(a, -b, k) for k, (a, b) in enumerate(ends) if a <= p <= b]
        want[i] = {k for a, b, k in held if (a, b) == max(held)[:2]} if held else None
    got = {r["id"]: r["asn"] for r in found.collect()}
    assert got.keys() == want.keys() and all(got[i] in w if w else got[i] is None for i, w in want.items())


def test_aligned_prefixes_are_the_fewest(spark):
    import ipaddress

    rng = random.Random(5)
    ends = [sorted(rng.randrange(2**32) for _ in range(2)) for _ in range(60)] + [(0, 2**32 - 1), (7, 7), (8, 15), (0, 0), (2**32 - 1, 2**32 - 1)]
    df = spark.createDataFrame([(V4 + f"{a:08x}", V4 + f"{b:08x}") for a, b in ends], "low string, high string")
    for r in df.select("low", "high", J.aligned_prefixes(F.col("low"), F.col("high")).alias("p")).collect():
        nets = ipaddress.summarize_address_range(ipaddress.IPv4Address(int(r["low"][24:], 16)), ipaddress.IPv4Address(int(r["high"][24:], 16)))
        assert {(p["key"], p["bits"]) for p in r["p"]} == {(V4 + f"{int(n.network_address):08x}", 96 + n.prefixlen) for n in nets}


def test_concordance():
    """Inversions against all pairs, ties at either end and both, pairs of all lengths."""
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 4, 5, 8, 9, 31, 64, 65, 200, 500, 0, 1]
    pair = np.repeat(np.arange(len(sizes)), sizes)
    ta, tb = (np.concatenate([rng.integers(0, max(2, n // 2), n) for n in sizes]) for _ in range(2))
    place = np.concatenate([np.arange(n) for n in sizes])
    s, n = L.concordance(pair, place, ta, tb, len(sizes))
    for k in range(len(sizes)):
        a, b = ta[pair == k], tb[pair == k]
        sign = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
        assert (s[k], n[k]) == (np.triu(sign, 1).sum(), (np.triu(sign, 1) != 0).sum())


@pytest.mark.parametrize("most", [0, 4, 30, 10**9])
def test_canary_links(spark, most):
    """Values of few and of many sources, sources that use their own values, repeated rows, nulls."""
    rng = random.Random(most)
    served = [(rng.choice([None, *range(9)]) if k % 3 else 1, rng.choice([None, *range(40)])) for k in range(200)]
    used = [(rng.choice([None, *range(9)]) if k % 3 else 1, rng.choice([None, *range(20, 70)])) for k in range(200)]
    pairs = {(o, u) for v, o in served for w, u in used if v == w and None not in (v, o, u) and o != u}
    by, of = defaultdict(int), defaultdict(int)
    for o, u in pairs:
        by[o] += 1
        of[u] += 1
    df = lambda rows: spark.createDataFrame(rows + rows[:20], "value_hash long, ip long")
    found = {r["ip"]: (r["used_by"], r["uses_of"]) for r in J.canary_links(df(served), df(used), most).collect()}
    assert found == {ip: (by[ip], of[ip]) for ip in {*by, *of}}


def test_canary_links_bytes(spark, monkeypatch):
    """Sources with sets of their own: no map is moved or written for each set, and the counts are those of all pairs."""
    rng, written, write = random.Random(5), [], J.materialize
    keep = lambda df, name: written.append(write(df, name)) or written[-1]
    monkeypatch.setattr(J, "materialize", keep)
    sides = [sorted({(v, ip) for ip in range(400) for v in rng.sample(range(30), rng.randrange(1, 7))} | {(100 + ip % 190, ip) for ip in range(400)}) for _ in range(2)]
    pairs = {(o, u) for v, o in sides[0] for w, u in sides[1] if v == w and o != u}
    df = lambda rows: spark.createDataFrame(rows, "value_hash long, ip long")
    found = {r["ip"]: r["n"] for r in J.distinct_partners(df(sides[0]), df(sides[1]), 100).collect()}
    assert found == {ip: sum(o == ip for o, _ in pairs) for ip in {o for o, _ in pairs}}
    maps = [df for df in written if "binary" in dict(df.dtypes).values()]
    assert sum(df.count() for df in maps) <= 30


def test_first_reuse(spark):
    """Uses in the serving's own second and before it do not count; days lie between some."""
    rng = random.Random(8)
    served = [(k, rng.choice([None, *range(6)]), rng.choice("ab"), rng.randrange(0, 400_000, 5_000)) for k in range(300)]
    used = [(rng.choice([None, *range(8)]), rng.randrange(0, 300_000, 5_000)) for _ in range(60)]
    want = {(k, kind, min(u - t for w, u in used if w == v and u > t)) for k, v, kind, t in served if any(w == v and u > t for w, u in used if w is not None)}
    found = J.first_reuse(spark.createDataFrame(served, "request_id long, value_hash long, kind string, t long"), spark.createDataFrame(used, "value_hash long, t long"))
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 50


@pytest.mark.parametrize("seed", range(2))
def test_waves(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.randrange(12), rng.randrange(0, 300_000, rng.choice([1, 500]))) for _ in range(900)]
    one = lambda s: spark.createDataFrame([(s,)], "shape string")
    for seconds, least in ((600, 2), (5000, 4), (90_000, 12)):
        want = {}
        for shape in "ab":
            own = [(t, ip) for s, ip, t in rows if s == shape]
            times = [t for t, _ in own if len({ip for u, ip in own if t - seconds < u <= t}) >= least]
            if times:
                want[shape] = min(times)
        found = waves(spark.createDataFrame(rows, "shape string, ip long, t long"), one("c"), seconds, least, uncounted=one("d"))
        assert {r["shape"]: r["t"] for r in found.collect()} == want


def test_tombstones_of_long_chains(spark):
    """Chains of a hundred, a cycle, parents that are not here, hidden rows and blocked origins."""
    up = {i: i - 1 for i in range(1, 100)} | {i: i - 1 for i in range(201, 300)} | {400: 401, 401: 402, 402: 400, 403: 402, 500: 999, 600: None, 601: 600, 700: None, 701: 700}
    rows = [(i, up.get(i), "n2" if i == 600 else "n1") for i in [*range(100), *range(200, 300), *range(400, 404), 500, 600, 601, 700, 701]]
    df = spark.createDataFrame(rows, "uid long, up long, origin string")
    tombs = spark.createDataFrame([(3, "n1"), (250, "n2"), (401, "n1"), (700, "other")], "uid long, origin string")
    hidden, blocked = spark.createDataFrame([(290,), (999,)], "uid long"), spark.createDataFrame([("n2",)], "origin string")
    kept = {r["uid"] for r in M.apply_tombstones(df, tombs, parent="up", hidden=hidden, blocked=blocked).collect()}
    assert kept == {0, 1, 2, *range(200, 290), 700, 701}
    assert {r["uid"] for r in M.apply_tombstones(df, tombs).collect()} == {r[0] for r in rows} - {3, 401}
    assert M.apply_tombstones(df.limit(0), tombs, parent="up").collect() == []


def test_retention(spark):
    day, now = 86_400, 100 * 86_400
    old, new = now - 31 * day, now - 29 * day
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "requests": t([(1, old), (2, new), (3, None)], "id long, t long"),
        "uploads": t([(10, 1), (11, 2), (12, None)], "uid long, request_id long"),
        "scans": t([(20, 30, old, new), (21, 31, old, None), (22, 32, new, None), (23, 34, old, old)], "uid long, job_uid long, t long, finished long"),
        "ports": t([(1, 20), (2, 21), (3, 22), (4, 99)], "port long, scan_uid long"),
        "batches": t([(1, old), (2, new)], "uid long, last_t long"),
        "fingerprints": t([(1, None, old), (2, None, new), (3, 1, new), (4, 2, old), (5, 3, old)], "uid long, request_id long, t long"),
        # with a younger scan, with an old one only, unfinished, young, without a scan and an end, failed long ago, unknown state
        "jobs": t([(30, "done", old, old), (31, "done", old, old), (33, "queued", old, None), (35, "done", old, new), (36, "refused", old, None), (34, "failed", old, old), (37, None, old, old)], "uid long, status string, queued long, finished long"),
        "other": t([(1,)], "x long"),
    }
    kept = {name: [r[0] for r in df.orderBy(df.columns[0]).collect()] for name, df in M.retention(tables, now, 30).items()}
    assert kept == {"requests": [2, 3], "uploads": [11, 12], "scans": [20, 22], "ports": [1, 3, 4], "batches": [2], "fingerprints": [2, 4, 5], "jobs": [30, 33, 35, 37], "other": [1]}
    assert all(M.retention(tables, now, 30)[n].columns == tables[n].columns for n in tables)


def test_prune_partitions(spark, tmp_path):
    """Days before the edge go whole, the edge's own day is rewritten, younger files stay as they are."""
    path, now = str(tmp_path / "requests"), 100 * 86_400 + 40_000
    rows = spark.range(200).select("id", (F.lit(80 * 86_400) + F.col("id") * 9000).alias("t")).withColumn("day", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd"))
    rows.write.partitionBy("day").parquet(path)
    before = {str(p) for p in (tmp_path / "requests").rglob("*.parquet")}
    assert M.prune_partitions(spark, path, now, 10) == 10
    cutoff = now - 10 * 86_400
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {r["id"] for r in rows.where(F.col("t") >= cutoff).collect()}
    after = {str(p) for p in (tmp_path / "requests").rglob("*.parquet")}
    assert len(after - before) <= 4 and len(after & before) >= 10
    assert M.prune_partitions(spark, path, now, 10) == 0


@pytest.mark.parametrize("cap", [1, 3])
def test_upload_timeline(spark, cap):
    rng = random.Random(cap)
    paths = ["/a", "/a/", "/a/b", "/a/b/c", "/a//b", "/ab", "x/y", None]
    asked = [(i, rng.choice(["n", "m", None]), rng.choice([None, *range(0, 300_000, 20_000)]), rng.choice(paths)) for i in range(400)]
    sent = [(1000 + i, rng.choice([None, *range(400)]), rng.choice(["n", "m", None]), rng.choice([None, *range(0, 300_000, 20_000)]), rng.choice([*paths, "/"]), rng.choice([True, False, None])) for i in range(80)]
    plain = []
    for uid, request, origin, t, at, under in sent:
        hits = []
        for i, o, rt, path in asked:
            later = None not in (t, rt) and (rt > t or (rt == t and request is not None and i > request))
            places = path is not None and at is not None and (path == at or (under and (path.startswith(at + "/") or (at.endswith("/") and path.startswith(at)))))
            if later and places and o == origin and o is not None:
                hits.append((rt, i, path))
        plain += [(uid, t, i, rt, path) for rt, i, path in sorted(hits)[:cap]]
    u = spark.createDataFrame(sent, "uid long, request_id long, origin string, t long, answered_path string, path_is_prefix boolean")
    r = spark.createDataFrame(asked, "id long, origin string, t long, path string")
    assert sorted(map(tuple, J.upload_timeline(u, r, cap).collect())) == sorted(plain)


def test_upload_timeline_grows_with_the_input(spark):
    """Every upload is before every request of its place: what meets is a block of ``cap`` numbers or two, not all."""
    n = 2000
    u = spark.range(n).selectExpr("id AS uid", "id AS request_id", "'n' AS origin", "0L AS t", "'/a' AS answered_path", "false AS path_is_prefix")
    r = spark.range(n).selectExpr("id", "'n' AS origin", "id + 1 AS t", "'/a' AS path")
    found = J.upload_timeline(u, r, 2)
    rows = found.count()
    metrics = found._jdf.queryExecution().executedPlan().toString()
    assert rows == 2 * n and "_block" in metrics
