"""Linking jobs against plain Python on random graphs."""

import random
from itertools import combinations

import pytest

from harrow.operators import linking as L


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def brute_merge(groups, soft):
    """One merge a round: the pair of groups with most links, ties by name, among those that reach min(size, size, 2)."""
    root = {ip: g for ip, g in groups.items()}
    for x in {x for e in soft for x in e}:
        root.setdefault(x, x)
    while True:
        size, links = {}, {}
        for g in root.values():
            size[g] = size.get(g, 0) + 1
        for a, b in soft:
            pair = tuple(sorted((root[a], root[b])))
            if pair[0] != pair[1]:
                links[pair] = links.get(pair, 0) + 1
        able = [(-n, *pair) for pair, n in links.items() if n >= min(size[pair[0]], size[pair[1]], 2)]
        if not able:
            return root
        _, a, b = min(able)
        root = {x: a if g == b else g for x, g in root.items()}


@pytest.mark.parametrize("seed", range(6))
def test_guarded_merge_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    ips = list(range(60))
    groups = {}
    for _ in range(12):
        some = rng.sample(ips, rng.randint(2, 4))
        if not any(x in groups for x in some):
            groups |= {x: min(some) for x in some}
    soft = list({tuple(sorted(rng.sample(ips, 2))) for _ in range((25, 40, 60)[seed % 3])})
    found = L.guarded_merge(spark.createDataFrame(list(groups.items()), "ip long, grp long"), spark.createDataFrame(soft, "a long, b long"))
    assert {r["ip"]: r["grp"] for r in found.collect()} == brute_merge(groups, soft)


def brute_loose(sightings, grouped, least, per_source):
    newest = {}
    for ip, value, t in sightings:
        if ip not in grouped:
            newest[ip, value] = max(t, newest.get((ip, value), t))
    n = {}
    for _, v in newest:
        n[v] = n.get(v, 0) + 1
    own = {}
    for (ip, v), t in newest.items():
        if n[v] > 1:
            own.setdefault(ip, []).append((-t, v))
    namers = {}
    for ip, vs in own.items():
        for _, v in sorted(vs)[:per_source]:
            namers.setdefault(v, set()).add(ip)
    root = {v: v for v in namers}
    for a, b in combinations(sorted(namers), 2):
        if len(namers[a] & namers[b]) >= max(least, -(-max(len(namers[a]), len(namers[b])) // 10)):
            x, y = sorted((find(root, a), find(root, b)))
            root[y] = x
    clouds = {}
    for v, ips in namers.items():
        members, values = clouds.setdefault(find(root, v), (set(), set()))
        members |= ips
        values.add(v)
    same = {}
    for c, (members, values) in clouds.items():
        key = frozenset(members)
        same[key] = (min(c, same[key][0]), same[key][1] | values) if key in same else (c, values)
    owner = {ip: min((-len(m), min(m), c) for m, (c, _) in same.items() if ip in m) for ip in set().union(*same)} if same else {}
    up = {ip: ip for ip in owner}
    for m, (c, values) in same.items():
        for v in values:
            kept = sorted(ip for ip in namers[v] if owner[ip][2] == c)
            for ip in kept[1:]:
                x, y = sorted((find(up, kept[0]), find(up, ip)))
                up[y] = x
    groups = {}
    for ip in up:
        groups.setdefault(find(up, ip), []).append(ip)
    return {ip: g for g, ips in groups.items() if len(ips) > 1 for ip in ips}


@pytest.mark.parametrize("seed", range(4))
def test_group_loose(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), f"v{int(rng.random() ** 2 * 18)}", rng.randrange(100)) for _ in range((60, 120, 200, 300)[seed])]
    grouped = {ip: 0 for ip in range(0, 40, 9)}
    per_source = (16, 3)[seed % 2]
    found = L.group_loose(spark.createDataFrame(rows, "ip long, value string, t long"), spark.createDataFrame(list(grouped.items()), "ip long, grp long"), 2, per_source)
    assert {r["ip"]: r["grp"] for r in found.collect()} == brute_loose(rows, grouped, 2, per_source)
    few = L.left_out(spark.createDataFrame(rows, "ip long, value string, t long"), "value", 3).collect()
    assert {r["ip"]: r["left_out"] for r in few} == {ip: n - 3 for ip in range(40) if (n := len({v for i, v, _ in rows if i == ip})) > 3}


def shapes(spark, times):
    """Two sources that ask for the same shapes, at the given times, and a third that asks for others."""
    rows = [(ip, f"s{k:02}", t) for ip, ts in times.items() for k, t in enumerate(ts)] + [(9, f"x{k}", k) for k in range(3)]
    return spark.createDataFrame(rows, "ip long, shape string, t long")


@pytest.mark.parametrize(("second", "edge"), [(list(range(10)), True), (list(range(10))[::-1], False), ([5] * 10, True)])
def test_order_veto(spark, second, edge):
    own = shapes(spark, {1: list(range(10)), 2: second})
    none = spark.createDataFrame([], "ip long, fingerprint string")
    assert [(r["a"], r["b"], r["shared"]) for r in L.soft_edges(own, none).collect()] == ([(1, 2, 10)] if edge else [])
    assert L.soft_edges(own, none, veto=None).count() == 1


def test_order_looks_at_the_rarest_shapes(spark):
    """Common shapes are asked for in reverse, the rarest in order; only the rarest count."""
    rows = []
    for k in range(20):
        rows += [(1, f"a{k:02}", 100 - k), (2, f"a{k:02}", k), *[(10 + i, f"a{k:02}", 0) for i in range(3)]]
    for k in range(10):
        rows += [(1, f"b{k:02}", 200 + k), (2, f"b{k:02}", 200 + k)]
    df = spark.createDataFrame(rows, "ip long, shape string, t long")
    pair = spark.createDataFrame([(1, 2)], "a long, b long")
    assert L.order_agreement(pair, df, most=10).first()["order"] == 1.0
    assert L.order_agreement(pair, df).first()["order"] < 1.0


def test_support_and_common_shapes(spark):
    """A score between the two thresholds needs a shared fingerprint; common shapes weigh in the score but make no pair."""
    rows = [(ip, f"c{k}", k * ip) for ip in range(100, 160) for k in range(4)]
    rows += [(1, f"s{k}", 0) for k in range(4)] + [(2, f"s{k}", 0) for k in range(4)] + [(1, f"p{k}", 0) for k in range(2)] + [(2, f"q{k}", 0) for k in range(2)]
    df = spark.createDataFrame(rows, "ip long, shape string, t long")
    prints = lambda rows: spark.createDataFrame(rows, "ip long, fingerprint string")
    assert L.soft_edges(df, prints([(1, "f"), (2, "g")]), alone=0.6, supported=0.45).count() == 0
    found = L.soft_edges(df, prints([(1, "f"), (2, "f"), *[(i, "f") for i in range(100, 160)]]), alone=0.6, supported=0.45).collect()
    assert [(r["a"], r["b"], r["shared"]) for r in found] == [(1, 2, 4)]


def brute_walk(rows, focus, depth, hub, most):
    own = {(str(ip), v) for ip, v in rows if ip is not None and v is not None}
    if not any(ip == str(focus) for ip, _ in own):
        return set()
    seen = {("ip", str(focus)): 0}
    front = [("ip", str(focus))]
    for hop in range(1, depth + 1):
        found = set()
        for kind, node in front:
            if kind == "ip":
                found |= {("item", v) for ip, v in own if ip == node}
            elif kind == "item":
                holders = {ip for ip, v in own if v == node}
                found |= {("ip", ip) for ip in holders} if len(holders) <= hub else {("group", node)}
        front = sorted(found - set(seen))[: most - len(seen)]
        seen |= dict.fromkeys(front, hop)
    return {(k, n, h) for (k, n), h in seen.items()}


@pytest.mark.parametrize(("depth", "hub", "most"), [(1, 3, 400), (2, 3, 400), (3, 3, 400), (3, 100, 400), (3, 3, 12), (4, 5, 30), (2, 0, 400), (3, 3, 1)])
def test_neighbourhood(spark, depth, hub, most):
    rng = random.Random(depth * hub + most)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *"abcdefghijklmnop"])) for _ in range(110)] + [(0, "a"), (0, "zz")]
    df = spark.createDataFrame(rows + rows[:9], "ip long, value string")
    for focus in (0, 7, 99):
        found = L.neighbourhood(df, focus, depth, hub, most)
        assert found.columns == ["kind", "node", "hops"]
        got = list(map(tuple, found.collect()))
        assert len(got) == len(set(got)) and set(got) == brute_walk(rows, focus, depth, hub, most)


def test_tuning_is_the_job_at_every_point(spark):
    rng = random.Random(2)
    rows = [(ip, f"s{rng.randrange(12) + 6 * (ip % 4)}", rng.randrange(9)) for ip in range(24) for _ in range(9)]
    own, none = spark.createDataFrame(rows, "ip long, shape string, t long"), spark.createDataFrame([], "ip long, fingerprint string")
    hard = spark.createDataFrame([(0, 4), (1, 5)], "a long, b long")
    grid = [(0.6, 0.45), (0.3, 0.2), (0.05, 0.01)]
    found = {(r["alone"], r["supported"]): (r["groups"], r["members"], r["largest"]) for r in L.campaign_tuning(own, none, hard, grid).collect()}
    for alone, supported in grid:
        merged = L.guarded_merge(L.groups_of(hard), L.soft_edges(own, none, alone, supported)).groupBy("grp").count().where("count > 1").collect()
        sizes = [r["count"] for r in merged]
        assert found[alone, supported] == (len(sizes), sum(sizes), max(sizes))
    assert found[0.05, 0.01][1] >= found[0.6, 0.45][1] >= 4


def test_campaign_report_finds_hard_edges_once(spark, monkeypatch):
    from harrow.plans import queries_linking

    calls = []
    edges = queries_linking.J.hard_edges
    monkeypatch.setattr(queries_linking.J, "hard_edges", lambda s: calls.append(1) or edges(s))
    seen = spark.createDataFrame([("key", "v", 1), ("key", "v", 2), ("tag", "w", 3)], "kind string, value string, ip long")
    asked = spark.createDataFrame([(1, 5, "/p", "a", "b")], "ip long, t long, path string, ja4 string, ja4h string")
    rows = queries_linking.report_of(seen, asked).collect()
    assert len(calls) == 1 and [tuple(r) for r in rows] == [("hard", 1, 0)]


def test_campaign_report_counts_the_whole_pass(spark):
    """Groups are merged before soft edges are withheld; candidates, orders and excluded values are counted."""
    from harrow.plans import queries_linking

    seen = [("key", "v", 1), ("key", "v", 2), ("tag", "w", 5), ("tag", "w", 6)] + [("tag", "wide", ip) for ip in range(100, 151)]
    both = lambda a, b, n, step: [(ip, 5 + (i if ip == a else step * i), f"/{a}-{b}-{i}", f"j{ip}", "h") for i in range(n) for ip in (a, b)]
    asked = both(2, 3, 4, 1) + both(2, 5, 4, 1) + both(8, 9, 9, -1)
    asked = [(ip, t + 100, path, ja4, ja4h) for ip, t, path, ja4, ja4h in asked]
    found = queries_linking.report_of(spark.createDataFrame(seen, "kind string, value string, ip long"), spark.createDataFrame(asked, "ip long, t long, path string, ja4 string, ja4h string"))
    assert found.columns == ["class", "edges", "withheld"]
    # 3 joins 1 and 2 over one link, as it is alone; 5 and 6 do not; 8 and 9 asked in turned order
    assert {tuple(r) for r in found.collect()} == {("hard", 2, 0), ("soft", 2, 1), ("candidate", 3, 1), ("ordered", 1, 1), ("excluded", 1, 1)}
