"""Readers: request tables, light rows, scan reports, reference feeds, rules, change streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.columns import V4, ip_key, net_range
from harrow.schemas import schema
from harrow.sources.scratch import materialize


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The request table with its fixed schema; a ``day`` partition column is pruned on."""
    return spark.read.schema(schema("requests")).parquet(path)


def light_rows(batches: DataFrame) -> DataFrame:
    """One row per light request: position from 1, ``uid#n``; the batch's drops only on its last row."""
    each = batches.select("*", F.posexplode("rows").alias("pos", "row")).withColumn("n", F.col("pos") + 1)
    drops = F.when(F.col("n") == F.size("rows"), F.col("dropped")).otherwise(0)
    return each.select(F.concat("uid", F.lit("#"), "n").alias("uid"), "ip", "n", "row.*", drops.cast("long").alias("unrecorded"))


#: Fact kinds by script and element key (fixed values).
FACTS = {
    "http-title": {"title": "http.title", "redirect_url": "http.redirect"},
    "rdp-ntlm-info": {"NetBIOS_Computer_Name": "ntlm.netbios_computer", "NetBIOS_Domain_Name": "ntlm.netbios_domain", "DNS_Computer_Name": "ntlm.dns_computer", "DNS_Domain_Name": "ntlm.dns_domain", "DNS_Tree_Name": "ntlm.dns_tree", "Product_Version": "ntlm.product_version"},
    "dns-nsid": {"bind.version": "dns.nsid", "id.server": "dns.nsid"},
    "smb-os-discovery": {"server": "smb.server", "domain": "smb.domain", "fqdn": "smb.fqdn", "domain_dns": "smb.domain_dns", "forest_dns": "smb.forest_dns", "workgroup": "smb.workgroup", "os": "smb.os", "lanmanager": "smb.lanmanager"},
}
_ELEM = "elem array<struct<_key:string,_VALUE:string>>"
_SCRIPT = f"script array<struct<_id:string,_output:string,{_ELEM},table:array<struct<_key:string,{_ELEM},table:array<struct<_key:string,{_ELEM}>>>>>>".replace("elem array", "elem:array")
REPORT = (
    "_starttime bigint, address array<struct<_addr:string,_addrtype:string>>, os struct<osmatch:array<struct<_name:string,_accuracy:int>>>, "
    f"ports struct<port:array<struct<_protocol:string,_portid:int,state:struct<_state:string>,service:struct<_name:string,_product:string,_version:string,_devicetype:string>,{_SCRIPT.replace('script array', 'script:array')}>>>, "
    f"hostscript struct<{_SCRIPT.replace('script array', 'script:array')}>"
)


def ingest_scan_reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Scan report XML files to ``scans``, ``ports``, ``host_keys`` and ``scan_facts``. They are parsed once, into a table that all four read."""
    return report_tables(scan_reports(spark, path))


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """(uid, ip, started_at, os_guess, port, script) of each host in scan report XML files, from a written table without what is derived.

    The built-in XML source splits large files by host; compressed ones are read by a task each.
    """
    hosts = spark.read.format("xml").option("rowTag", "host").schema(REPORT).load(path)
    ip = F.get(F.filter("address", lambda a: a["_addrtype"] != "mac"), F.lit(0))["_addr"]
    base = hosts.select(ip.alias("ip"), F.col("_starttime").alias("started"), F.get("os.osmatch", F.lit(0))["_name"].alias("os_guess"), "ports.port", F.col("hostscript.script").alias("script"))
    base = materialize(base, "scan-reports")
    return base.select(F.sha2(F.concat_ws("|", "ip", "started"), 256).alias("uid"), "ip", F.timestamp_seconds("started").alias("started_at"), "os_guess", "port", "script")


def ports_of(reports: DataFrame, *more: str) -> DataFrame:
    """One row per port of each report, with ``more`` of the report's columns."""
    return reports.select(F.col("uid").alias("scan_uid"), *more, F.explode("port").alias("p")).select(
        "scan_uid", *more, F.col("p._portid").alias("port"), F.col("p._protocol").alias("proto"), F.col("p.state._state").alias("state"),
        F.col("p.service._name").alias("service"), F.col("p.service._product").alias("product"), F.col("p.service._version").alias("version"), F.col("p.service._devicetype").alias("devicetype"),
    )


def report_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """The four tables of ``scan_reports``."""
    at_port = reports.select(F.col("uid").alias("scan_uid"), "ip", F.explode("port").alias("p"))
    at_host = reports.select(F.col("uid").alias("scan_uid"), "ip", F.lit(None).cast("int").alias("port"), F.explode("script").alias("s"))
    scripts = at_port.select("scan_uid", "ip", F.col("p._portid").alias("port"), F.explode("p.script").alias("s")).unionByName(at_host)
    return {"scans": reports.drop("port", "script"), "ports": ports_of(reports), "host_keys": host_keys_of(scripts), "scan_facts": facts_of(scripts)}


def _element(elements: Column, key: str) -> Column:
    return F.get(F.filter(elements, lambda e: e["_key"] == key), F.lit(0))["_VALUE"]


def host_keys_of(scripts: DataFrame) -> DataFrame:
    """(scan_uid, ip, port, kind, fingerprint, detail) of SSH host keys and TLS certificates: SHA-256 of the key or certificate itself."""
    ssh = scripts.where("s._id = 'ssh-hostkey'").select("scan_uid", "ip", "port", F.explode("s.table.elem").alias("e"))
    blob = F.try_to_binary(F.trim(_element(F.col("e"), "key")), F.lit("base64"))
    digest = F.regexp_replace(F.base64(F.unhex(F.sha2(blob, 256))), "=+$", "")
    keys = ssh.select("scan_uid", "ip", "port", F.lit("ssh-hostkey").alias("kind"), F.concat(F.lit("SHA256:"), digest).alias("fingerprint"), F.trim(F.concat_ws(" ", F.coalesce(_element(F.col("e"), "type"), F.lit("unknown")), _element(F.col("e"), "bits"))).alias("detail"))
    pem = F.regexp_replace(_element(F.col("s.elem"), "pem"), r"-----[^-]*-----|\s", "")
    der = F.try_to_binary(pem, F.lit("base64"))
    subject = _element(F.get(F.filter("s.table", lambda t: t["_key"] == "subject"), F.lit(0))["elem"], "commonName")
    certs = scripts.where("s._id = 'ssl-cert'").select("scan_uid", "ip", "port", F.lit("tls-cert").alias("kind"), F.sha2(der, 256).alias("fingerprint"), F.coalesce(subject, F.lit("")).alias("detail"))
    return keys.unionByName(certs).where("fingerprint IS NOT NULL AND port IS NOT NULL")


def facts_of(scripts: DataFrame, most: int = 256) -> DataFrame:
    """(scan_uid, ip, port, kind, value): what the scripts of a scan say of a port (null: of the host), cut to ``most`` bytes."""
    from harrow.functions.columns import cut_bytes

    known = F.create_map(*[F.lit(x) for script, keys in FACTS.items() for key, kind in keys.items() for x in (f"{script}/{key}", kind)])
    fact = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    keyed = F.transform("s.elem", lambda e: fact(F.try_element_at(known, F.concat(F.col("s._id"), F.lit("/"), e["_key"])), F.regexp_replace(e["_VALUE"], r"\\x00$", "")))
    plain = F.when(F.col("s._id") == "http-server-header", F.transform(F.filter("s.elem", lambda e: e["_key"].isNull()), lambda e: fact(F.lit("http.server"), e["_VALUE"])))
    realm = lambda t: _element(F.get(F.filter(t["table"], lambda x: x["_key"] == "params"), F.lit(0))["elem"], "realm")
    auth = F.when(F.col("s._id") == "http-auth", F.transform("s.table", lambda t: fact(F.lit("http.auth"), F.concat(_element(t["elem"], "scheme"), F.coalesce(F.concat(F.lit(' realm="'), realm(t), F.lit('"')), F.lit(""))))))
    socks = F.when(F.col("s._id") == "socks-auth-info", F.transform("s.table", lambda t: fact(F.lit("socks.method"), _element(t["elem"], "name"))))
    every = F.concat(*[F.coalesce(a, none) for a in (keyed, plain, auth, socks)])
    rows = scripts.select("scan_uid", "ip", "port", F.inline(every))
    return rows.withColumn("value", cut_bytes(F.trim("value"), most)).where("kind IS NOT NULL AND value <> ''")


def load_reference_feed(df: DataFrame, least: int, name: str) -> DataFrame:
    """The feed, or an error if it has fewer than ``least`` rows: a broken download replaces nothing."""
    held = df.limit(least).count()
    if held < least:
        raise ValueError(f"{name}: {held} rows, at least {least} are expected")
    return df


def read_exit_list(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    lines = spark.read.text(path).where(F.col("value").rlike(r"^ExitAddress\s+\S+"))
    return load_reference_feed(lines.select(F.regexp_extract("value", r"^ExitAddress\s+(\S+)", 1).alias("ip")).distinct(), least, "exit list")


def read_asn_list(spark: SparkSession, path: str, least: int = 300) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^(?:AS)?([0-9]+)", 1).alias("asn")).where("asn <> ''")
    return load_reference_feed(lines.select(F.col("asn").cast("long")).distinct(), least, "hosting networks")


def read_geo_prefixes(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(low, high, country, asn) of a geo table as CSV with a header: ``network`` (an address with a prefix length) or ``low`` and ``high`` (addresses), ``country``, ``asn``, as ``joins.geo_join`` takes it.

    Rows whose ends are no addresses, or are of two families, are left out; a country is two letters in upper case, else null.
    """
    rows = spark.read.option("header", True).csv(path)
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    low, high = net_range(F.trim(given("network")))
    ends = rows.select(F.coalesce(low, ip_key(F.trim(given("low")))).alias("low"), F.coalesce(high, ip_key(F.trim(given("high")))).alias("high"), F.upper(F.trim(given("country"))).alias("country"), F.regexp_extract(given("asn"), "^(?i:AS)?([0-9]{1,10})$", 1).alias("asn"))
    family = lambda c: F.startswith(c, F.lit(V4))
    whole = ends.where((F.col("low") <= F.col("high")) & (family("low") == family("high")))
    return load_reference_feed(whole.select("low", "high", F.when(F.col("country").rlike("^[A-Z]{2}$"), F.col("country")).alias("country"), F.when(F.col("asn") != "", F.col("asn")).cast("long").alias("asn")), least, "geo table")


def read_relays(spark: SparkSession, path: str) -> DataFrame:
    """Relay index JSON to one row per relay address."""
    shape = "relays array<struct<nickname:string,fingerprint:string,or_addresses:array<string>,exit_addresses:array<string>,flags:array<string>,first_seen:string>>"
    relays = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("relays").alias("r")).select("r.*")
    address = lambda a: F.regexp_replace(F.regexp_replace(a, r":[0-9]+$", ""), r"^\[|\]$", "")
    every = F.array_distinct(F.concat(F.transform(F.coalesce("or_addresses", F.array().cast("array<string>")), address), F.coalesce("exit_addresses", F.array().cast("array<string>"))))
    return relays.select("nickname", "fingerprint", F.array_contains("flags", "Exit").alias("is_exit"), F.explode(every).alias("ip"))


#: Keys that a rule may have, and those of which it needs one (fixed values).
RULE_KEYS = frozenset({"label", "weight", "target_regex", "body_regex", "ua_regex", "header_regex", "path_exact", "methods", "unless_target_regex", "owasp"})
MATCHERS = ("target_regex", "body_regex", "ua_regex", "header_regex", "path_exact", "methods")
#: Catalogue files in all are no larger.
MAX_CATALOGUE_BYTES = 16 << 20


def _toml_files(spark: SparkSession, path: str) -> list[tuple[str, dict]]:
    """(name, content) of the TOML files of a folder or pattern, by name. They are configuration of a bounded size."""
    import tomllib

    where = path if path.endswith(".toml") or "*" in path else f"{path.rstrip('/')}/*.toml"
    files = spark.read.text(where, wholetext=True).select(F.input_file_name().alias("name"), "value")
    if (files.agg(F.sum(F.octet_length("value"))).first()[0] or 0) > MAX_CATALOGUE_BYTES:
        raise ValueError(f"{path}: too large for a catalogue")
    return [(r["name"], tomllib.loads(r["value"])) for r in files.orderBy("name").collect()]


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules of all TOML files, checked: known keys, a label, a matcher, methods that are tokens, weight 1 to 4, tags like A03:2021 or OAT-014."""
    import re

    rules = []
    for name, content in _toml_files(spark, path):
        for rule in content.get("rule", []):
            methods, tags = rule.get("methods"), rule.get("owasp", [])
            good = (
                set(rule) <= RULE_KEYS and rule.get("label") and any(m in rule for m in MATCHERS) and isinstance(rule.get("weight"), int) and 1 <= rule["weight"] <= 4
                and (methods is None or methods and all(re.fullmatch(r"[A-Za-z0-9!#$%&'*+\-.^_`|~]+", m) for m in methods))
                and all(re.fullmatch(r"A(0[1-9]|10):2021|OAT-0[0-9]{2}", t) for t in tags)
            )
            if not good:
                raise ValueError(f"{name}: bad rule {rule.get('label')}")
            rules.append(rule)
    return rules


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The catalogue as a table, one row per rule in its order."""
    rows = [(i, r["label"], r["weight"], [m for m in MATCHERS if m in r], r.get("methods"), r.get("unless_target_regex"), r.get("owasp", [])) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "position int, label string, weight int, matchers array<string>, methods array<string>, unless_target_regex string, owasp array<string>")


def load_devices(spark: SparkSession, path: str) -> list[dict]:
    """Device signatures in their order: id, kind (proxy or cpe), and ports with product and service, or os_guess, or fact."""
    devices = [d for _, content in _toml_files(spark, path) for d in content.get("device", [])]
    for d in devices:
        if not d.get("id") or d.get("kind") not in ("proxy", "cpe") or not any(d.get(k) for k in ("ports", "product", "service", "os_guess", "fact")):
            raise ValueError(f"bad device signature {d.get('id')}")
    return devices


def load_names(spark: SparkSession, path: str) -> dict[str, list[dict]]:
    """Name patterns (id, pattern) by list: consumer, pool, cgn, mobile, scanner."""
    out: dict[str, list[dict]] = {}
    for name, content in _toml_files(spark, path):
        for kind, entries in content.items():
            if kind not in ("consumer", "pool", "cgn", "mobile", "scanner") or not all(e.get("id") and e.get("pattern") for e in entries):
                raise ValueError(f"{name}: bad name patterns {kind}")
            out.setdefault(kind, []).extend(entries)
    return out


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """Change records as a stream of JSON files; route them by ``kind``."""
    return spark.readStream.schema(schema("changes")).json(folder)
