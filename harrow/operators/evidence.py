"""Evidence, readings, blocklist, quality of rules and indicator extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.columns import AGENT_LABELS, WEAK_LABELS, normalize_text, path_shape
from harrow.operators.joins import geo_join
from harrow.operators.stats import DAY, keep_top

#: Verdicts, first match wins: name, whether an exit is enough, and alternatives of (kinds that are there, kinds that are not) (fixed values).
VERDICTS = [
    ("declared", True, []),
    ("rented fleet", False, [(("fleet.key",), ()), (("fleet.canary",), ()), (("fleet.dense", "net.hosting"), ()), (("name.scanner", "net.hosting"), ())]),
    ("rented", False, [(("net.hosting",), ())]),
    ("consumer device", False, [(("device.cpe", "net.eyeball"), ("name.scanner",))]),
    ("proxy on a consumer line", False, [(("device.proxy", "net.eyeball"), ())]),
    ("device only", False, [(("device.cpe",), ("net.eyeball",)), (("device.proxy",), ("net.eyeball",))]),
    ("unknown", False, [((), ())]),
]
#: Readings of how many parties share an address, in the same form (fixed values).
READINGS = [
    ("operator", True, [(("net.hosting",), ()), (("name.scanner",), ()), (("fleet.key",), ()), (("fleet.canary",), ())]),
    ("subscriber-pooled", False, [(("device.cpe", "name.pool"), ())]),
    ("subscriber", False, [(("device.cpe",), ())]),
    ("shared-pool", False, [(("name.cgn",), ())]),
    ("shared-mobile", False, [(("name.mobile",), ()), (("net.eyeball=mobile",), ())]),
    ("pooled-line", False, [(("name.pool",), ())]),
    ("consumer-line", False, [(("name.consumer",), ())]),
    ("insufficient", False, [((), ())]),
]
#: Kinds of rows that a reading shows (fixed values).
SHOWN = {
    "operator": ("net.hosting", "name.scanner", "fleet.key", "fleet.canary"), "subscriber-pooled": ("device.cpe", "name.pool"), "subscriber": ("device.cpe",), "shared-pool": ("name.cgn", "name.mobile", "net.eyeball=mobile", "name.pool"),
    "shared-mobile": ("name.mobile", "net.eyeball=mobile", "name.pool"), "pooled-line": ("name.pool",), "consumer-line": ("name.consumer",), "insufficient": (),
}
#: Lists of name patterns (fixed values).
NAME_LISTS = ("consumer", "pool", "cgn", "mobile", "scanner")
#: Matchers of a rule and the fields that they read, raw and decoded (the agent raw only).
MATCHERS = {"target_regex": "target", "body_regex": "body", "ua_regex": "agent", "header_regex": "headers"}
#: Labels and weights by method; others are unusual (fixed values).
METHODS = {"form-interaction": (3, ("POST",)), "write-method": (3, ("PUT", "PATCH", "DELETE")), "proxy-probe": (2, ("CONNECT",))}
QUIET_METHODS = ("GET", "HEAD", "OPTIONS")


def matched(text: Column, pattern: str) -> Column:
    """Without case, null texts match nothing; as in most regular-expression dialects only a line feed ends a line."""
    return F.coalesce(text.rlike(f"(?iud){pattern}"), F.lit(False))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def rule_columns(rules: list[dict], fields: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(labels, tags, weight) of the rules that fire, in the format of ``sources.readers.load_rules``.

    A rule fires when one of its matchers does, or its method alone if it has no
    other; ``methods`` limits it, and ``unless_target_regex`` vetoes it. Patterns
    are tried on raw and decoded text.
    """
    labels, tags, weights = [], [], []
    for rule in rules:
        both = lambda name, pattern: matched(fields[name], pattern) | (matched(fields[f"{name}_plain"], pattern) if name != "agent" else F.lit(False))
        tests = [both(field, rule[m]) for m, field in MATCHERS.items() if rule.get(m)]
        if rule.get("path_exact"):
            tests.append(F.coalesce(fields["path"] == rule["path_exact"], F.lit(False)))
        hit = _any(tests) if tests else F.lit(True)
        if rule.get("methods"):
            hit = hit & F.coalesce(fields["method"].isin(*rule["methods"]), F.lit(False))
        if rule.get("unless_target_regex"):
            hit = hit & ~both("target", rule["unless_target_regex"])
        labels.append(F.when(hit, F.lit(rule["label"])))
        tags.append(F.when(hit, F.array(*map(F.lit, rule["owasp"]))) if rule.get("owasp") else F.lit(None).cast("array<string>"))
        weights.append(F.when(hit, F.lit(rule["weight"])).otherwise(0))
    empty = F.array().cast("array<string>")
    return F.array_compact(F.array(*labels)) if labels else empty, F.flatten(F.array_compact(F.array(*tags))) if tags else empty, F.greatest(F.lit(0), F.lit(0), *weights)


def classify(requests: DataFrame, rules: list[dict], paths: int = 10, count: int = 20) -> DataFrame:
    """Add rule_labels, owasp, rule_severity, scan_level. Needs target, body, agent, headers, path, method, paths_1h, requests_1h.

    ``to_proxy``, ``webdriver`` and ``inhuman_fill`` (boolean) count if they are
    there. After the rules comes the ladder: many paths or requests in the hour
    make a path-scanner, else a request with no label but an agent's is a probe;
    then the method, the proxy and the signs of a bot. The weight is the largest
    of all; who shows only weak labels is scanned at level 1 at most.
    """
    fields = {n: F.col(n) for n in ("target", "body", "agent", "headers", "path", "method")}
    plain = {f"{n}_plain": normalize_text(F.col(n)) for n in ("target", "body", "headers")}
    names = {n: f"_{n}" for n in plain}
    marked = requests.withColumns({names[n]: c for n, c in plain.items()})
    labels, tags, weight = rule_columns(rules, fields | {n: F.col(c) for n, c in names.items()})
    marked = marked.withColumns({"_l": labels, "_o": tags, "_w": weight})
    scanner = F.coalesce((F.col("paths_1h") >= paths) | (F.col("requests_1h") >= count), F.lit(False))
    steps = [("path-scanner", 2, scanner), ("probe", 1, ~scanner & F.forall("_l", lambda x: x.isin(*AGENT_LABELS)))]
    known = [*QUIET_METHODS, *(m for _, ms in METHODS.values() for m in ms)]
    steps += [(label, w, F.coalesce(F.col("method").isin(*ms), F.lit(False))) for label, (w, ms) in METHODS.items()]
    steps.append(("unusual-method", 2, F.coalesce(~F.col("method").isin(*known), F.lit(True))))
    flags = {"to_proxy": ("proxy-probe", 2), "webdriver": ("automation", 2), "inhuman_fill": ("inhuman-behavior", 3)}
    steps += [(label, w, F.coalesce(F.col(c), F.lit(False))) for c, (label, w) in flags.items() if c in requests.columns]
    extra = F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, _, test in steps]))
    heaviest = F.greatest("_w", *[F.when(test, w).otherwise(0) for _, w, test in steps])
    sorted_ = lambda c: F.array_sort(F.array_distinct(c))
    out = marked.withColumns({"rule_labels": sorted_(F.concat("_l", extra)), "owasp": sorted_(F.col("_o")), "rule_severity": heaviest})
    weak = F.forall("rule_labels", lambda x: x.isin(*WEAK_LABELS))
    return out.withColumn("scan_level", F.least("rule_severity", F.when(weak, 1).otherwise(4))).drop("_l", "_o", "_w", *names.values())


def evidence_rows(df: DataFrame, kind: str | Column, value: Column, ref: Column) -> DataFrame:
    return df.select("ip", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.cast("string").alias("value"), ref.cast("long").alias("ref")).where("value IS NOT NULL")


def _first(entries: list[dict], test) -> Column:
    """struct<kind, id> of the first entry whose test holds."""
    found = [F.when(test(e), F.struct(F.lit(f"device.{e['kind']}").alias("kind"), F.lit(e["id"]).alias("id"))) for e in entries]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<kind:string,id:string>")


def device_evidence(scans: DataFrame, ports: DataFrame, facts: DataFrame, last_seen: DataFrame, catalogue: list[dict], stale: int = DAY) -> DataFrame:
    """Device and proxy signatures that a source's scans show, unless a scan is older than its last request by over ``stale``.

    Per open port and kind the first matching entry, the first that matches the
    OS guess, and per fact the first of its kind. ``catalogue``: entries as of
    ``sources.readers.load_devices``.
    """
    from functools import reduce

    fresh = scans.join(last_seen.select("ip", "last_seen"), "ip", "left").where(F.col("last_seen").isNull() | (F.col("t") >= F.col("last_seen") - stale)).select(F.col("uid").alias("scan_uid"), "ip", "os_guess")
    on_port = lambda e, at: at.isin(*e["ports"]) if e.get("ports") else F.lit(True)
    fits = lambda e, field: F.coalesce(F.col(field).rlike(e[field]), F.lit(False)) if e.get(field) else F.lit(True)
    ported = [e for e in catalogue if not e.get("os_guess") and not e.get("fact")]
    of_port = lambda kind: _first([e for e in ported if e["kind"] == kind], lambda e: on_port(e, F.col("port")) & fits(e, "product") & fits(e, "service"))
    seen = [fresh.join(ports.where("state = 'open'"), "scan_uid").select("ip", "scan_uid", F.explode(F.array_compact(F.array(of_port("proxy"), of_port("cpe")))).alias("d"))]
    seen.append(fresh.select("ip", "scan_uid", _first([e for e in catalogue if e.get("os_guess")], lambda e: fits(e, "os_guess")).alias("d")))
    seen.append(fresh.join(facts, "scan_uid").select("ip", "scan_uid", _first([e for e in catalogue if e.get("fact")], lambda e: (F.col("kind") == e["fact"]) & F.coalesce(on_port(e, F.col("port")), F.lit(False))).alias("d")))
    found = reduce(DataFrame.unionByName, seen).where("d IS NOT NULL").groupBy("ip", "d").agg(F.min("scan_uid").alias("ref"))
    return evidence_rows(found, F.col("d.kind"), F.col("d.id"), F.col("ref"))


def unmatched_devices(scans: DataFrame, ports: DataFrame, catalogue: list[dict]) -> DataFrame:
    """(what, value, sources): OS guesses that no entry reads, so that the catalogue can grow from data."""
    entries = [e["os_guess"] for e in catalogue if e.get("os_guess")]
    rows = scans.where((F.col("os_guess") != "") & ~_any([F.col("os_guess").rlike(p) for p in entries]))
    return rows.groupBy(F.lit("os guess").alias("what"), F.col("os_guess").alias("value")).agg(F.countDistinct("ip").alias("sources"))


def name_evidence(names: DataFrame, last_seen: DataFrame, lists: dict[str, list[dict]], days: int = 30) -> DataFrame:
    """Per list the first pattern that a source's name matches, unless the name was last confirmed over ``days`` before its last request.

    ``lists``: as of ``sources.readers.load_names``.
    """
    fresh = names.join(last_seen.select("ip", F.col("last_seen").alias("_last")), "ip", "left").where(F.col("_last").isNull() | (F.col("last_seen") >= F.col("_last") - days * DAY))
    first = lambda entries: F.coalesce(*[F.when(F.lower("name").rlike(e["pattern"]), F.lit(e["id"])) for e in entries], F.lit(None).cast("string"))
    each = F.array(*[F.struct(F.lit(f"name.{n}").alias("kind"), first(lists.get(n, [])).alias("value")) for n in NAME_LISTS])
    found = fresh.select("ip", F.col("last_seen").alias("ref"), F.inline(each)).where("value IS NOT NULL").groupBy("ip", "kind", "value").agg(F.max("ref").alias("ref"))
    return evidence_rows(found, F.col("kind"), F.col("value"), F.col("ref"))


def fleet_key(host_keys: DataFrame, low: int = 2, high: int = 50) -> DataFrame:
    """A key on ``low`` to ``high`` other sources, on each of its holders."""
    own = host_keys.groupBy("kind", "fingerprint", "ip").agg(F.min("scan_uid").alias("ref"))
    many = own.groupBy("kind", "fingerprint").agg((F.count(F.lit(1)) - 1).alias("others")).where(F.col("others").between(low, high))
    return evidence_rows(own.join(many, ["kind", "fingerprint"]).drop("kind"), "fleet.key", F.col("fingerprint"), F.col("ref"))


def fleet_canary(reuse: DataFrame) -> DataFrame:
    """A value served to another source came back from this one, in a header or a body."""
    rows = reuse.where("NOT same_source AND place IN ('header', 'body')")
    return evidence_rows(rows.groupBy(F.col("used_ip").alias("ip")).agg(F.count(F.lit(1)).alias("n"), F.min("used_id").alias("ref")), "fleet.canary", F.col("n"), F.col("ref"))


def fleet_dense(sources: DataFrame, prefix: str, least: int = 16) -> DataFrame:
    by = sources.groupBy(prefix).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return evidence_rows(sources.join(by, prefix), "fleet.dense", F.col(prefix), F.col("n"))


def net_type(sources: DataFrame, as_types: DataFrame) -> DataFrame:
    """``as_types``: (asn, type, value), one row per network; the value says where a hosting network's type comes from, and what an eyeball network's lines are."""
    rows = sources.join(as_types, "asn")
    return evidence_rows(rows, F.concat(F.lit("net."), F.col("type")), F.col("value"), F.col("asn"))


def first_rule(evidence: DataFrame, exits: DataFrame, rules, out: str) -> DataFrame:
    """(ip, out): the first rule that a source's kinds of evidence meet. Kinds are flags, combined before the shuffle."""
    every = evidence.select("ip", "kind", "value").unionByName(exits.select("ip", F.lit("exit").alias("kind"), F.lit(None).cast("string").alias("value")))
    kinds = sorted({k for _, _, ways in rules for need, no in ways for k in (*need, *no)} | {"exit"})
    named = lambda k: (F.col("kind") == k.split("=")[0]) & (F.coalesce(F.col("value") == k.split("=")[1], F.lit(False)) if "=" in k else F.lit(True))
    flags = every.groupBy("ip").agg(*[F.bool_or(named(k)).alias(f"_{i}") for i, k in enumerate(kinds)])
    has = {k: F.col(f"_{i}") for i, k in enumerate(kinds)}

    def way(need, no) -> Column:
        ok = F.lit(True)
        for k in need:
            ok = ok & has[k]
        for k in no:
            ok = ok & ~has[k]
        return ok

    met = [(name, _any([*([has["exit"]] if exit_ else []), *[way(*w) for w in ways]])) for name, exit_, ways in rules]
    return flags.select("ip", F.coalesce(*[F.when(c, F.lit(name)) for name, c in met]).alias(out))


def verdict(evidence: DataFrame, exits: DataFrame, rules=VERDICTS) -> DataFrame:
    """What the source is, by the first of the verdict rules that it meets."""
    return first_rule(evidence, exits, rules, "verdict")


def sharing_reading(evidence: DataFrame, exits: DataFrame, rules=READINGS) -> DataFrame:
    """How many parties may share the address, by the first of the reading rules that it meets."""
    return first_rule(evidence, exits, rules, "reading")


def reading_rows(evidence: DataFrame, readings: DataFrame, shown=SHOWN) -> DataFrame:
    """The rows of evidence that each source's reading rests on and shows."""
    pairs = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k.split("=")[0]).alias("k"), F.lit(k.split("=")[1] if "=" in k else None).cast("string").alias("v")) for r, ks in shown.items() for k in ks])
    holds = F.exists(pairs, lambda p: (p["r"] == F.col("reading")) & (p["k"] == F.col("kind")) & (p["v"].isNull() | (p["v"] == F.col("value"))))
    return evidence.join(readings, "ip").where(holds)


def evidence_report(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ip").alias("sources"))


def blocklist(
    requests: DataFrame, exits: DataFrame, crawlers: DataFrame, now: int, days: int, severity: int, delay: int, unseen: DataFrame | None = None, keys: DataFrame | None = None, never: DataFrame | None = None
) -> DataFrame:
    """Sources with a released request of the severity in the window, less exits, verified crawlers and ``unseen`` ones, and less those whose key (``keys``: ip, ip_key) lies in a network of one's own or one that is never listed (``never``: low, high)."""
    hit = requests.where((F.col("severity") >= severity) & (F.col("t") >= now - days * DAY - delay) & (F.col("t") + delay <= now))
    found = hit.groupBy("ip").agg(F.max("severity").alias("max_severity"), F.max("t").alias("last_seen"))
    for out in (exits, crawlers, unseen):
        found = found if out is None else found.join(out.select("ip"), "ip", "left_anti")
    if never is None:
        return found
    spared = geo_join(keys.select("ip", "ip_key"), never.select("low", "high", F.lit(True).alias("spared"))).where("spared")
    return found.join(spared.select("ip"), "ip", "left_anti")


def collapse_networks(listed: DataFrame, spared: DataFrame, prefix: str, least: int = 3) -> DataFrame:
    """(entry, is_network): a network with enough entries and no spared address becomes one entry."""
    many = listed.groupBy(prefix).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).join(spared.select(prefix).distinct(), prefix, "left_anti").select(prefix)
    networks = many.select(F.col(prefix).cast("string").alias("entry"), F.lit(True).alias("is_network"))
    return listed.join(many, prefix, "left_anti").select(F.col("ip").cast("string").alias("entry"), F.lit(False).alias("is_network")).unionByName(networks)


def new_shapes(rollup: DataFrame, since: int, unknown_only: bool = False) -> DataFrame:
    rows = rollup.where(F.col("first_seen") >= since)
    return rows.where("hits = 0") if unknown_only else rows


def rules_agreement(requests: DataFrame, stored: str, fresh: list[str], n: int = 500, severities: tuple[str, list[str]] | None = None) -> DataFrame:
    """Newest n per node: how many carry other labels, or another severity, than a fresh classification, and in percent.

    A source's history is not quite known afterwards; ``fresh`` (and the second of
    ``severities``) name the results under each way to read it, and a row agrees
    if it agrees with one of them whole.
    """
    newest = keep_top(requests, ["origin"], [F.desc("t"), F.desc("id")], n)
    same = [F.col(stored).eqNullSafe(F.col(f)) for f in fresh]
    if severities:
        same = [a & F.col(severities[0]).eqNullSafe(F.col(s)) for a, s in zip(same, severities[1], strict=True)]
    counts = newest.groupBy("origin").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~_any(same)).alias("differ"))
    return counts.withColumn("percent", F.col("differ") * 100 / F.col("checked"))


def rules_carried(requests: DataFrame, fingerprint: str, n: int = 500) -> DataFrame:
    """The newest rules fingerprint per node, and how many others its newest n rows carry."""
    newest = keep_top(requests, ["origin"], [F.desc("t"), F.desc("id")], n)
    return newest.groupBy("origin").agg(F.max_by(fingerprint, F.struct("t", "id")).alias("newest"), (F.countDistinct(fingerprint) - 1).alias("others"))


def reclassify(requests: DataFrame, rules: list[dict], stored: str) -> DataFrame:
    """Rows whose labels a fresh run changes."""
    return classify(requests, rules).where(~F.col(stored).eqNullSafe(F.col("rule_labels")))


URL = r"(?i)\b((?:https?|ftp)://[a-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>;|)]*)?)"
#: Layers that are opened: escaped bytes, hexadecimal and base64 runs, each with what turns a run into binary.
HEX_RUN, ESCAPED_RUN, BASE64_RUN = r"\b((?:[0-9a-fA-F]{2}){8,})\b", r"((?:\\x[0-9a-fA-F]{2}){4,})", r"([A-Za-z0-9+/]{16,}={0,2})"
PRINTABLE = r"^[\x09\x0A\x0D\x20-\x7E\u00A0-\uFFFF]+$"
DEPTH = 6


#: Commands and functions that fetch what they are given, hosts that are no one's, and local names (fixed values).
FETCHERS = "wget curl tftp ftpget fetch lwp-download iwr invoke-webrequest certutil bitsadmin file_get_contents fopen urlretrieve urlopen include_once include require_once require copy".split()
LOCAL_NAMES = "localhost localdomain local internal intranet lan home corp test invalid example".split()
NOT_PUBLIC = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])|22[4-9]|2[3-5][0-9])\."
#: A command that fetches, up to the end of its statement; functions that run what they are given; tools.
FETCHED = rf"(?i)\b(?:{'|'.join(FETCHERS)})\b([^\n;|]*)"
EXECUTED = r"(?i)\b(?:system|exec|shell_exec|passthru|popen|proc_open|eval|assert)\s*\("
TOOLS, SSH_KEY = r"(?i)\b(wget|curl|busybox|tftp)\b", r"(ssh-(?:rsa|ed25519) [A-Za-z0-9+/=]{20,})"


def opened(at: Column) -> Column:
    """array<struct<text, via>>: what the percent, escape, hexadecimal and base64 layers of a text hold, every run of it; only printable text counts."""
    text = lambda b: F.try_validate_utf8(b.cast("string"))
    unpadded = lambda r: F.regexp_replace(r, "=+$", "")
    whole = lambda r: F.when(F.length(r) % 4 == 1, F.substr(r, F.lit(1), F.length(r) - 1)).otherwise(r)
    padded = lambda r: F.rpad(r, F.ceil(F.length(r) / 4).cast("int") * 4, "=")
    runs = lambda pattern: F.regexp_extract_all(at, F.lit(pattern), F.lit(1))
    via = lambda texts, name: F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(name).alias("via")))
    pieces = F.concat(
        via(F.array(F.when(at.contains("%"), normalize_text(at))), "percent"),
        via(F.transform(runs(ESCAPED_RUN), lambda r: text(F.try_to_binary(F.replace(r, F.lit("\\x"), F.lit("")), F.lit("hex")))), "escape"),
        via(F.transform(runs(HEX_RUN), lambda r: text(F.try_to_binary(r, F.lit("hex")))), "hex"),
        via(F.transform(runs(BASE64_RUN), lambda r: text(F.try_to_binary(padded(whole(unpadded(r))), F.lit("base64")))), "base64"),
    )
    return F.filter(pieces, lambda p: p["text"].isNotNull() & (p["text"] != at) & p["text"].rlike(PRINTABLE))


def opened_layers(text: Column, depth: int = DEPTH) -> Column:
    """array<struct<text, depth, via>>: the text and what its layers hold, layer in layer to ``depth``; ``via`` names the layers around, the outermost first. What was just opened is all that the next pass reads."""
    start = F.struct(F.array(F.struct(text.alias("text"), F.lit(0).alias("depth"), F.lit("").alias("via"))).alias("all"), F.array(F.struct(text.alias("text"), F.lit("").alias("via"))).alias("at"))
    inside = lambda p: F.transform(opened(p["text"]), lambda o: F.struct(o["text"].alias("text"), F.when(p["via"] == "", o["via"]).otherwise(F.concat(p["via"], F.lit(">"), o["via"])).alias("via")))

    def step(state: Column, level: Column) -> Column:
        found = F.array_distinct(F.flatten(F.transform(state["at"], inside)))
        bound = F.transform(F.array(found), lambda f: F.struct(F.concat(state["all"], F.transform(f, lambda o: F.struct(o["text"].alias("text"), level.alias("depth"), o["via"].alias("via")))).alias("all"), f.alias("at")))
        return F.when(F.size(state["at"]) == 0, state).otherwise(F.get(bound, F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)["all"]


def host_in(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "://([^/:]+)", 1))


def on_names(host: Column, names) -> Column:
    """Whether the host is one of the names or under one."""
    return _any([(host == n) | host.endswith(f".{n}") for n in names])


def joinable(host: Column, never=()) -> Column:
    """Whether a host can say anything about who runs it: a public address, or a name with a dot and a real last label that is neither local nor one of ``never``."""
    last = F.substring_index(host, ".", -1)
    numbers = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
    name = host.contains(".") & ~host.rlike(r"^\.|\.\.|\.$") & ~last.rlike("^(?:[0-9]+|0x.*)$") & ~on_names(host, LOCAL_NAMES)
    return F.when(host.rlike(numbers), ~host.rlike(NOT_PUBLIC)).otherwise(name) & ~on_names(host, never)


def extract_indicators(
    df: DataFrame, text: str, keys: list[str], shared_hosts: tuple[str, ...] = ("example.com",), never: tuple[str, ...] = (), sender: str | None = None, exploits: list[tuple[str, str]] = (), request: tuple[str, str, str] | None = None
) -> DataFrame:
    """(keys, kind, role, value, depth, via): one row per indicator of a row, where it stands least deep.

    URLs (``url``) and their hosts (``host``, not for ``shared_hosts``) are ``stager``
    where a command or function fetches them, in the same statement of the same
    layer, ``self-hosted`` if that is the ``sender`` column's own address, and
    ``queried`` where they are only named, or are no host that says who runs it
    (``never``). A host that the row fetches from is not ``queried`` elsewhere in it.
    SSH keys have the role ``key``, tools ``tag``. ``exploits`` are names and patterns
    of a rule catalogue, read in every layer; with ``request`` (columns of method,
    path and query) a request that carries something executable is named by method,
    path shape and its arguments' names. A cheap test comes before any layer is opened.
    """
    cheap = F.col(text).rlike(r"(?i)https?:|ftp:|%[0-9a-f]{2}|\\x[0-9a-f]{2}|[A-Za-z0-9+/]{16}|ssh-|" + "|".join([*FETCHERS, "busybox"]))
    asked = F.coalesce(F.upper(request[0]) == "PUT", F.lit(False)) if request else F.lit(False)
    worth = F.coalesce(cheap | F.col(text).rlike(EXECUTED) | _any([matched(F.col(text), p) for _, p in exploits]), F.lit(False)) | asked
    own = F.lower(F.col(sender).cast("string")) if sender else F.lit(None).cast("string")
    more = [F.col(c).alias(f"_{n}") for n, c in zip(("method", "path", "query"), request or ())]
    layers = df.where(worth).select(*keys, own.alias("_sender"), *more, F.inline_outer(opened_layers(F.coalesce(text, F.lit("")))).alias("_text", "_depth", "_via"))
    at = F.col("_text")
    every = lambda pattern, column=at: F.regexp_extract_all(column, F.lit(pattern), F.lit(1))
    statements = F.transform(every(FETCHED), lambda s: F.substring_index(s, "&&", 1))
    staged = F.flatten(F.transform(statements, lambda s: every(URL, s)))
    names = [F.when(matched(at, p), F.lit(n)) for n, p in exploits]
    runs = (F.size("_staged") > 0) | at.rlike(EXECUTED)
    read = layers.withColumns({"_urls": every(URL), "_staged": staged}).withColumn("_runs", runs)
    of = lambda kind, role, values: F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), v.alias("value")))

    def urls(u: Column) -> Column:
        role = F.when(~F.array_contains("_staged", u) | ~joinable(host_in(u), never), "queried").when(host_in(u) == F.col("_sender"), "self-hosted").otherwise("stager")
        return F.struct(F.lit("url").alias("kind"), role.alias("role"), u.alias("value"))

    of_urls = F.transform(F.array_distinct("_urls"), urls)
    said = F.transform(F.filter(of_urls, lambda f: ~host_in(f["value"]).isin(*shared_hosts) if shared_hosts else F.lit(True)), lambda f: F.struct(F.lit("host").alias("kind"), f["role"].alias("role"), host_in(f["value"]).alias("value")))
    plain = F.concat(of("tool", "tag", F.transform(every(TOOLS), F.lower)), of("ssh-key", "key", every(SSH_KEY)), of("exploit", "exploit", F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")))
    if request:
        arguments = F.transform(F.split(F.coalesce("_query", F.lit("")), "&"), lambda a: F.substring_index(a, "=", 1))
        named = F.array_sort(F.array_distinct(F.transform(F.filter(arguments, lambda a: a.rlike(r"^[A-Za-z0-9_.\[\]-]{1,64}$")), lambda a: F.ltrim(path_shape(F.concat(F.lit("/"), a)), F.lit("/")))))
        title = F.concat_ws(" ", F.upper("_method"), path_shape(F.col("_path")), F.when(F.size(named) > 0, F.concat(F.lit("?"), F.array_join(named, " "))))
        put = (F.upper("_method") == "PUT") & (at != "") & (F.col("_depth") == 0)
        plain = F.concat(plain, F.when(F.coalesce(F.col("_runs") | put, F.lit(False)), of("exploit", "exploit", F.array(title))).otherwise(of("exploit", "exploit", F.array().cast("array<string>"))))
    rows = read.select(*keys, F.col("_depth").alias("depth"), F.col("_via").alias("via"), F.inline(F.concat(of_urls, said, plain)))
    least = F.min(F.struct("depth", "via"))
    found = rows.groupBy(*keys, "kind", "role", "value").agg(least.alias("_at"))
    fetched = F.max(F.col("role").isin("stager", "self-hosted")).over(Window.partitionBy(*keys, "kind", "value"))  # in one pass: a join would open every layer twice
    kept = found.withColumn("_fetched", fetched).where("NOT (kind = 'host' AND role = 'queried' AND _fetched)")
    return kept.select(*keys, "kind", "role", "value", "_at.depth", "_at.via")


def extract_tokens(df: DataFrame, places: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, place, value_hash) of candidate values: 6 to 128 letters, digits, - and _."""
    from harrow.functions.columns import value_hash

    rows = F.concat(*[F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_-]{6,128})"), 1)), _place(p)) for p, c in places.items()])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.place", value_hash(F.col("r.value")).alias("value_hash"))


def _place(place: str):
    return lambda v: F.struct(F.lit(place).alias("place"), v.alias("value"))


def registry_pick(intel: DataFrame, own: str) -> DataFrame:
    """Per source: all nodes agree, else the own node's, else a strict plurality, else disputed. One row per node: its newest."""
    newest = intel.groupBy("ip", "origin").agg(F.max_by("data", "hlc").alias("data"), F.max("hlc").alias("hlc"))
    votes = newest.groupBy("ip", "data").agg(F.count(F.lit(1)).alias("n"))
    most = votes.groupBy("ip").agg(F.count(F.lit(1)).alias("values"), F.max("n").alias("top"), F.max_by("data", F.struct("n", "data")).alias("winner"))
    top = votes.join(most, "ip").groupBy("ip").agg(F.count_if(F.col("n") == F.col("top")).alias("tied"))
    mine = newest.where(F.col("origin") == own).select("ip", F.col("data").alias("own"))
    rows = most.join(top, "ip").join(mine, "ip", "left")
    how = F.when(F.col("values") == 1, "agreed").when(F.col("own").isNotNull(), "own").when(F.col("tied") == 1, "plurality").otherwise("disputed")
    return rows.select("ip", how.alias("how"), F.when(how == "agreed", F.col("winner")).when(how == "own", F.col("own")).when(how == "plurality", F.col("winner")).alias("data"))


def source_props(sources: DataFrame, evidence: DataFrame, readings: DataFrame, scans: DataFrame, jobs: DataFrame, agents: DataFrame) -> DataFrame:
    """Per source: reading, exit, net type, and whether a device answered on it, it is in a fleet, an agent (``agents``: ip), scanned or waiting."""
    net = F.startswith("kind", F.lit("net."))
    flags = evidence.groupBy("ip").agg(F.max_by(F.when(net, F.substring("kind", 5, 20)), F.when(net, F.col("ref"))).alias("net_type"), F.bool_or(F.col("kind").startswith("device.")).alias("device"), F.bool_or(F.col("kind").startswith("fleet.")).alias("fleet"))
    rows = sources.select("ip", "is_exit").join(readings, "ip", "left").join(flags, "ip", "left")
    for name, of in (("agent", agents), ("scanned", scans), ("waiting", jobs.where("status IN ('queued', 'running')"))):
        rows = rows.join(of.select("ip").distinct().withColumn(name, F.lit(True)), "ip", "left")
    return rows.na.fill(False, ["device", "fleet", "agent", "scanned", "waiting"])
