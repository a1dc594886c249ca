"""The URL filter against a plain version, its rules and its hard cases."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from harrow.llm import common, q11_urls, urls
from tests.test_queries import rows as plain_rows

PAGES = "page_id long, url string, host string, template string, _row string"
LABELS = "doc_id long, quality int, toxic int"


def made():
    out = []
    for k in range(600):
        host = ["big.example.net", "Big.Example.NET", "b.example.org", "c.example.com", "d.test"][k % 5 if k % 3 else 0]
        path = [f"/en/{k}", f"/fr/{k}.html", f"/spam/{k}", f"/en/{k}/", f"/a/b/c/d/e/f/g/{k}", "", "/", f"/x{k}y/2024-01-0{k % 9}", f"/{k:08x}/p", "/{n}/*/q", f"/de/{k % 4}"][k % 11]
        out.append((k, f"http{'s' * (k % 2)}://{host}{path}{['', '?a=/b/c', '#top/x'][k % 3]}", "h", "t", "r"))
    out += [(900, None, None, None, None), (901, "", None, None, None), (902, "no scheme/en/1", None, None, None), (None, "x://EXAMPLE.org/en/12?://a", None, None, None)]
    out += [(903, "a://b://c/d", None, None, None), (904, "://net", None, None, None), (905, "s://example.org/es/", None, None, None), (906, "s://notexample.org/es/x\ny", None, None, None), (907, "s://com/fr/", None, None, None)]
    return out + out[:30] + [out[7]] * 300


def labels():
    return [(k, int(k % 11 != 2), int(k % 50 == 0)) for k in range(0, 600, 2)] + [(None, 1, 0), (4, None, 0), (6, 0, 0)]


def split(url):
    m = re.match("(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def kind(s):
    if s in ("", "{rest}"):
        return s
    m = re.search(r"(?<=[^.])\.[A-Za-z]{1,5}\Z", s)
    stem = s[: m.start()] if m else s
    k = next((n for n, p in (("n", "[0-9]+"), ("d", "[0-9-]+"), ("h", "[0-9a-f]{8,}")) if re.fullmatch(p, stem)), "x" if re.search("[0-9]", stem) else "w")
    return "{" + k + ("." if m else "") + "}"


def plain(pages, marks, depth=urls.DEPTH):
    good = {}
    for d, q, t in marks:
        if None not in (d, q, t):
            good[d] = good.get(d, True) and q == 1 and t == 0
    count = Counter(split(p[1]) for p in pages)
    state = []
    for (host, path), n in count.items():
        parts = path[1:].split("/") if path else []
        m = re.match("^/[^/]*/([0-9]{1,18})", path)
        label = good.get(int(m[1])) if m else None
        state.append([host, path, (), tuple(parts[:depth]) + (("{rest}",) if len(parts) > depth else ()), n, int(label is not None), int(label or 0)])
    levels = 0
    while any(s[3] for s in state):
        levels += 1
        child, total = Counter(), Counter()
        for h, _, pre, rest, n, *_ in state:
            if rest:
                child[h, pre, rest[0]] += n
                total[h, pre] += n
        for s in state:
            h, _, pre, rest, *_ = s
            if rest:
                n = child[h, pre, rest[0]]
                keep = n >= urls.KEEP_ROWS and n >= urls.KEEP_SHARE * total[h, pre]
                s[2:4] = pre + ((rest[0] if rest[0] == "{rest}" else rest[0].replace("{", "{{").replace("*", "{*")) if keep else kind(rest[0]),), rest[1:]
    sums = defaultdict(lambda: [0, 0])
    for h, _, t, _, _, m, g in state:
        sums[h, t][0] += m
        sums[h, t][1] += g
    branch = {k: k[1] for k in sums}
    for level in range(levels, 0, -1):
        own, group = defaultdict(lambda: [0, 0]), defaultdict(set)
        for k, (m, g) in sums.items():
            own[k[0], branch[k]][0] += m
            own[k[0], branch[k]][1] += g
        around = lambda b: b[: level - 1] + ("*",) + b[level:] if len(b) >= level else b  # noqa: B023, E731
        for h, b in own:
            group[h, around(b)].add(b)
        turned = {}
        for (h, a), members in group.items():
            mm, gg = (sum(own[h, b][i] for b in members) for i in (0, 1))
            alike = set()
            for b in members:
                m, g = own[h, b]
                if m == 0 or mm == m:
                    alike.add(b)
                else:
                    p = gg / mm
                    if (g / m - (gg - g) / (mm - m)) ** 2 <= urls.SIGMAS**2 * (p * (1 - p) * (1 / m + 1 / (mm - m))):
                        alike.add(b)
            for b in alike if len(alike) >= 2 else ():
                turned[h, b] = a
        branch = {k: turned.get((k[0], b), b) for k, b in branch.items()}
    whole = [sum(s[i] for s in sums.values()) for i in (0, 1)]
    prior = whole[1] / whole[0] if whole[0] else 1.0
    host, pure = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, (m, g) in sums.items():
        for of, key in ((host, k[0]), (pure, (k[0], branch[k]))):
            of[key][0] += m
            of[key][1] += g
    template = {(s[0], s[1]): s[2] for s in state}
    out = []
    for page in pages:
        h, p = split(page[1])
        b = branch[h, template[h, p]]
        hp = (host[h][1] + urls.WEIGHT * prior) / (host[h][0] + urls.WEIGHT)
        m, g = pure[h, b]
        purity = (g + urls.WEIGHT * hp) / (m + urls.WEIGHT)
        fits = [(len(rh + rp), rh + rp, v) for v, rh, rp in q11_urls.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        verdict = max(fits)[2] if fits else "block" if purity < urls.PURE and h else "allow"
        out.append((page[0], h, p, max(fits)[1] if fits else None, verdict, "/" + "/".join(b), round(purity, 9)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("urls"))
    spark.createDataFrame(made(), PAGES).repartition(4).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame(labels(), LABELS).write.parquet(f"{at}/labels.parquet")
    return at


def got(df):
    return sorted(((*r[:-1], round(r[-1], 9)) for r in map(tuple, df.collect())), key=str)


@pytest.mark.parametrize("most", [common.MOST_MARKS, 0], ids=["broadcast", "shuffled"])
def test_against_plain_version(spark, folder, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_MARKS", most)
    found = q11_urls.query(spark, folder)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    rows = got(found)
    assert rows == plain(made(), labels())
    verdicts = Counter(r[4] for r in rows if r[3] is None)
    assert verdicts["block"] > 5 and verdicts["allow"] > 100


def test_against_sql(spark, folder):
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert plain_rows(q11_urls.query(spark, folder).toPandas()) == plain_rows(c.execute(q11_urls.ORACLE_SQL).df())


def test_rules(spark):
    cases = {
        "s://example.org/es/x": "example.org/es/", "s://a.example.org/en/123": "example.org/en/1", "s://example.org/en/2": "org/", "s://notexample.org/es/": "org/", "s://org": None, "s://com/de/": "com/de/",
        "s://x.com/de": None, "s://com:80/de/": None, "s://net/": None, "S://X.COM/fr/?q": "com/fr/", "/fr/": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    assert {r["url"]: r["rule"] for r in df.select("url", urls.rule_of(host, path, q11_urls.RULES)["rule"].alias("rule")).collect()} == cases
    assert df.select(urls.rule_of(host, path, [])["rule"].alias("rule")).where("rule IS NOT NULL").count() == 0


def test_clashing_names_no_labels_and_empty(spark):
    rows = [(1, "https://h.net/a/1", "mine", "also"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "key long, url string, path string, good string")
    none = spark.createDataFrame([], "key long, good boolean")
    out = urls.with_verdicts(df, none, F.expr("try_cast(get(split(path, '/'), 2) AS BIGINT)"), [], path="url_path")
    assert out.columns == ["key", "url", "path", "good", "host", "url_path", "rule", "verdict", "template", "purity"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, rows[0][1], "mine", "also", "h.net", "/a/1", None, "allow", "/{w}/{n}", 1.0), (2, None, None, None, "", "", None, "allow", "/", 1.0)]
    assert urls.with_verdicts(df.limit(0), none, F.lit(1).cast("long"), []).collect() == []
