"""Registered streams (run to the end of what is there), merges, readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harrow.operators import stats as S
from harrow.plans.registry import register, register_raw
from harrow.plans.standins import DAY, NOW, view
from harrow.sources import readers, writers
from harrow.sources.scratch import materialize, scratch_dir
from harrow.streaming import merge as M
from harrow.streaming import streams as T

R = register


#: The stand-in's rows come in three deliveries; ROWS_LATE of the last day of each come with the next one, and ROWS_AGAIN come twice.
DELIVERIES, ROWS_LATE, ROWS_AGAIN = 3, "id % 10 = 0", "id % 7 = 0"


def deliveries(requests):
    """Requests in three deliveries by time, with late and repeated rows; then a tick of the clock, a row without a source, that lets all times pass."""
    span = requests.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    step = (span["high"] - span["low"]) // DELIVERIES + 1
    own = F.floor((F.col("t") - span["low"]) / step)
    last_day = F.pmod(F.col("t") - span["low"], F.lit(step)) >= step - DAY
    late = own + F.when(F.expr(ROWS_LATE) & last_day, 1).otherwise(0)
    again = F.when(F.expr(ROWS_AGAIN) & last_day, F.array(late, F.least(late + 1, F.lit(DELIVERIES)))).otherwise(F.array(late))
    rows = requests.withColumn("ts", F.timestamp_seconds("t")).withColumn("_at", F.explode(again))
    for k in range(DELIVERIES + 1):
        yield rows.where(F.col("_at") == k).drop("_at")
    tick = requests.sparkSession.range(1).select(F.lit(span["high"] + 60 * DAY).alias("t")).withColumn("ts", F.timestamp_seconds("t"))
    yield requests.limit(0).withColumn("ts", F.timestamp_seconds("t")).unionByName(tick, allowMissingColumns=True)


def run_stream(spark, sf_dir, build, mode: str = "append", keys: list[str] | None = None, change=lambda r: r):
    """Stream the requests' deliveries, one run on the same state after each, and read what the streams wrote."""
    root = f"{scratch_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    requests = change(view(spark, sf_dir, "requests"))
    schema = requests.limit(0).withColumn("ts", F.timestamp_seconds("t")).schema
    for rows in deliveries(requests):
        rows.write.mode("append").parquet(f"{root}/in")
        T.run_to_table(build(spark.readStream.schema(schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/state", mode)
    return spark.read.parquet(f"{root}/out") if mode == "append" else T.newest(spark, f"{root}/out", keys)


@register_raw("stream_rollups", sql="SELECT ip, count(*) AS requests, max(severity) AS max_severity, min(t) AS first_seen, max(t) AS last_seen FROM requests GROUP BY ip")
def _rollups(spark, sf_dir):
    return run_stream(spark, sf_dir, T.stream_rollups, "update", ["ip"])


@register_raw("stream_label_rollups", sql="SELECT ip, label, count(*) AS requests FROM (SELECT id, ip, label FROM requests UNION SELECT id, ip, concat('m-', method) FROM requests) GROUP BY ip, label")
def _label_rollups(spark, sf_dir):
    labelled = lambda r: r.withColumn("labels", F.array("label", F.concat(F.lit("m-"), "method"), "label"))
    return run_stream(spark, sf_dir, lambda s: T.stream_label_rollups(labelled(s)), "update", ["ip", "label"])


@register_raw("stream_timeline", sql="SELECT t - t % 3600 AS bucket, count(*) AS requests FROM requests GROUP BY 1")
def _timeline(spark, sf_dir):
    return run_stream(spark, sf_dir, T.stream_timeline, "update", ["bucket"])


@register_raw("stream_history", sql="SELECT id, count(*) OVER (PARTITION BY ip ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS requests_1h FROM requests")
def _history(spark, sf_dir):
    return run_stream(spark, sf_dir, T.stream_history)


@register_raw("stream_sampling")
def _sampling(spark, sf_dir):
    return run_stream(spark, sf_dir, lambda s: T.stream_sampling(s, 1 / 7200, 5, 4))


_WAVES = f"""WITH f AS (SELECT path AS shape, ip, t FROM requests WHERE k >= 5), c AS (SELECT x.shape, x.t, count(DISTINCT y.ip) AS n FROM f x JOIN f y ON y.shape = x.shape AND y.t > x.t - {DAY} AND y.t <= x.t GROUP BY 1, 2) SELECT shape, min(t) AS t FROM c WHERE n >= 2 GROUP BY shape"""


def _known(requests):
    return requests.where("k < 5").select(F.col("path").alias("shape")).distinct()


R("waves", "requests", sql=_WAVES)(lambda r: T.waves(r.withColumn("shape", F.col("path")), _known(r), DAY, 2))


@register_raw("stream_waves", sql=_WAVES)
def _stream_waves(spark, sf_dir):
    known = materialize(_known(view(spark, sf_dir, "requests")), "known-shapes")
    return run_stream(spark, sf_dir, lambda s: T.stream_waves(s, known, DAY, 2), change=lambda r: r.withColumn("shape", F.col("path"))).select("shape", "t")


@register_raw("stream_release", sql="SELECT id, t + 3600 + CAST('0x' || substr(md5(CAST(id AS STRING)), 1, 7) AS BIGINT) % 601 AS public_at FROM requests")
def _release(spark, sf_dir):
    return run_stream(spark, sf_dir, lambda s: T.stream_release(s, 3600, 600))


@register_raw("stream_records", sql="SELECT kind, count(*) AS records, count(DISTINCT ip) AS sources FROM changes GROUP BY kind")
def _records(spark, sf_dir):
    """Changes as JSON files, streamed back and counted by kind."""
    root = f"{scratch_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    rows = view(spark, sf_dir, "changes").select("kind", F.col("uid").cast("string").alias("uid"), "origin", F.col("version").alias("hlc"), F.to_json(F.struct("ip", "value")).alias("payload"))
    rows.write.json(f"{root}/in")
    parsed = readers.stream_records(spark, f"{root}/in").withColumn("p", F.from_json("payload", "ip bigint, value double")).select("kind", "p.ip")
    T.run_to_table(parsed, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").groupBy("kind").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("ip").alias("sources"))


R("merge_latest", "changes", sql="SELECT ip, kind, version, value FROM changes QUALIFY row_number() OVER (PARTITION BY ip, kind ORDER BY version DESC, origin DESC) = 1")(
    lambda c: M.merge_latest(c.where("uid % 2 = 0"), c.where("uid % 2 = 1"), ["ip", "kind"]).select("ip", "kind", "version", "value")
)
R("merge_idempotent", "changes", sql="SELECT uid, ip FROM changes")(lambda c: M.merge_idempotent(c.where("uid % 3 = 0"), c.union(c)).select("uid", "ip"))
_TOMBS = "uid % 25 = 0 AND origin = 'n1' OR uid % 101 = 3"
R("apply_tombstones", "changes", sql=f"""WITH RECURSIVE c AS (SELECT uid, CASE WHEN uid % 10 <> 0 THEN uid - 1 END AS up, origin FROM changes), gone AS (SELECT uid FROM c WHERE {_TOMBS} OR origin = 'n2' AND uid % 10 = 9 UNION SELECT c.uid FROM c JOIN gone ON c.up = gone.uid)
  SELECT uid FROM c WHERE uid NOT IN (SELECT uid FROM gone)""")(
    lambda c: M.apply_tombstones(
        c.select("uid", F.when(F.col("uid") % 10 != 0, F.col("uid") - 1).alias("up"), F.when((F.col("uid") % 10 == 9) & (F.col("origin") == "n2"), "n9").otherwise(F.col("origin")).alias("origin")),
        c.where("uid % 25 = 0").select("uid", F.lit("n1").alias("origin")), parent="up", hidden=c.where("uid % 101 = 3").select("uid"), blocked=c.sparkSession.createDataFrame([("n9",)], "origin string"),
    ).select("uid")
)
R("deferred_children", "changes", sql="SELECT 'apply' AS state, count(*) AS n FROM changes WHERE uid % 7 = 0 AND uid % 3 = 1 UNION ALL SELECT 'wait', count(*) FROM changes WHERE uid % 7 <> 0 AND uid % 3 = 1")(
    lambda c: (lambda d: d["apply"].agg(S.count_().alias("n")).select(F.lit("apply").alias("state"), "n").unionByName(d["wait"].agg(S.count_().alias("n")).select(F.lit("wait").alias("state"), "n")))(
        M.deferred_children(c.select(F.col("uid").alias("parent")), c.where("uid % 7 = 0").select("uid"), c.where("uid % 3 <> 1").select("uid"))
    )
)
#: Jobs and scans of the driver's tables are older than its requests; so many seconds set them beside each other.
_LATER = NOW - 996_624_000
_KEEP = f"{NOW - 10 * DAY}"


def _retention(requests, uploads, tokens, canaries, scans, ports, host_keys, jobs):
    """(table, rows, checksum) of what retention keeps in each of ten tables."""
    late = lambda df, *cs: df.withColumns({c: F.col(c) + _LATER for c in cs})
    tables = {
        "requests": requests.select("id", "t"), "uploads": uploads.select(F.col("uid").alias("id"), "request_id"), "tokens": tokens.select(F.col("value_hash").alias("id"), "request_id"), "canaries": canaries.select(F.col("value_hash").alias("id"), "request_id"),
        "scans": late(scans.where("uid % 5 <> 0").select("uid", (F.col("uid") + F.col("uid") % 2).alias("job_uid"), "t"), "t"), "ports": ports.select(F.col("port").alias("id"), "scan_uid"), "host_keys": host_keys.select(F.col("port").alias("id"), "scan_uid"),
        "jobs": late(jobs.select("uid", "status", "queued", "finished"), "queued", "finished"), "batches": requests.where("id % 13 = 0").select("id", F.col("t").alias("last_t")),
        "fingerprints": requests.select((F.col("id") * 2).alias("id"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("request_id"), "t"),
    }
    out = None
    for name, rows in M.retention(tables, NOW, 10).items():
        key = "id" if "id" in rows.columns else "uid"
        row = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col(key).cast("long")), F.lit(0)).alias("checksum")).select(F.lit(name).alias("table"), "rows", "checksum")
        out = row if out is None else out.unionByName(row)
    return out


_OF_OLD = f"(SELECT id FROM requests WHERE t < {_KEEP})"
_KEPT = {
    "requests": ("id", f"requests WHERE t >= {_KEEP}"), "uploads": ("uid", f"uploads WHERE request_id NOT IN {_OF_OLD}"), "tokens": ("value_hash", f"tokens WHERE request_id NOT IN {_OF_OLD}"), "canaries": ("value_hash", f"canaries WHERE request_id NOT IN {_OF_OLD}"),
    "scans": ("uid", f"sc WHERE t >= {_KEEP}"), "ports": ("port", f"ports WHERE scan_uid NOT IN (SELECT uid FROM sc WHERE t < {_KEEP})"), "host_keys": ("port", f"host_keys WHERE scan_uid NOT IN (SELECT uid FROM sc WHERE t < {_KEEP})"),
    "jobs": ("uid", f"jobs WHERE NOT (status IN ('done', 'failed') AND finished + {_LATER} < {_KEEP} AND uid NOT IN (SELECT job_uid FROM sc WHERE t >= {_KEEP}))"), "batches": ("id", f"requests WHERE id % 13 = 0 AND t >= {_KEEP}"),
    "fingerprints": ("id * 2", f"requests WHERE t >= {_KEEP}"),
}
R("retention", "requests", "uploads", "tokens", "canaries", "scans", "ports", "host_keys", "jobs", sql=f"WITH sc AS (SELECT uid, uid + uid % 2 AS job_uid, t + {_LATER} AS t FROM scans WHERE uid % 5 <> 0) " + " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS rows, coalesce(sum({key}), 0)::BIGINT AS checksum FROM {rest}" for name, (key, rest) in _KEPT.items()))(_retention)


def batches_of(requests):
    """Requests of a source in an hour as a light batch."""
    hour = F.floor(F.col("t") / 3600)
    rows = F.sort_array(F.collect_list(F.struct("t", "id", "path")))
    return requests.groupBy("ip", hour.alias("hour")).agg(rows.alias("rows")).withColumn("uid", F.concat("ip", F.lit("-"), "hour")).withColumn("dropped", F.col("hour") % 4)


R("light_rows", "requests", sql="SELECT concat(ip, '-', t // 3600, '#', row_number() OVER w) AS uid, ip, CAST(row_number() OVER w AS INT) AS n, id, CASE WHEN lead(id) OVER w IS NULL THEN t // 3600 % 4 ELSE 0 END AS unrecorded FROM requests WINDOW w AS (PARTITION BY ip, t // 3600 ORDER BY t, id)")(
    lambda r: readers.light_rows(batches_of(r)).select("uid", "ip", "n", "id", "unrecorded")
)
R("last_in_batch", "requests", sql="SELECT id, lead(id) OVER (PARTITION BY ip, t // 3600 ORDER BY t, id) IS NULL AS last FROM requests")(
    lambda r: readers.light_rows(batches_of(r).withColumn("dropped", F.lit(1))).select("id", (F.col("unrecorded") > 0).alias("last"))
)
R("skipped_counts", "requests", sql="SELECT ip, CAST(sum(n + hour % 4) AS BIGINT) AS skipped FROM (SELECT ip, t // 3600 AS hour, count(*) AS n FROM requests GROUP BY 1, 2) GROUP BY ip")(lambda r: S.skipped_counts(batches_of(r)))


def _target(spark, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _wide(spark, sf_dir):
    rows = view(spark, sf_dir, "requests")
    return rows.select(F.col("id").cast("string").alias("uid"), "origin", F.timestamp_seconds("t").alias("ts"), F.col("ip").cast("string").alias("ip"), "method", "path", F.array("label").alias("labels"), "severity", "status", "user_agent")


@register_raw("write_dataset_parquet", sql="SELECT CAST(id AS STRING) AS uid, CAST(ip AS STRING) AS ip, path, severity FROM requests")
def _parquet(spark, sf_dir):
    writers.write_dataset_parquet(_wide(spark, sf_dir), path := _target(spark, "dataset"), {"severity": 0})
    return spark.read.parquet(path).select("uid", "ip", "path", "severity")


@register_raw("read_requests", sql="SELECT CAST(id AS STRING) AS uid, status FROM requests WHERE severity >= 2")
def _read(spark, sf_dir):
    _wide(spark, sf_dir).write.parquet(path := _target(spark, "requests"))
    return readers.read_requests(spark, path).where("severity >= 2").select("uid", "status")


@register_raw("write_dataset_csv", sql="SELECT CAST(id AS STRING) AS uid, concat('[\"', label, '\"]') AS labels FROM requests")
def _csv(spark, sf_dir):
    writers.write_dataset_csv(_wide(spark, sf_dir), path := _target(spark, "csv"))
    return spark.read.option("header", True).option("escape", '"').csv(path).select("uid", "labels")


@register_raw("write_timeline_jsonl", sql="SELECT concat(method, ' ', path, ' [', label, ']') AS message, CAST(id AS STRING) AS uid FROM requests")
def _jsonl(spark, sf_dir):
    writers.write_timeline_jsonl(_wide(spark, sf_dir), path := _target(spark, "jsonl"))
    return spark.read.schema("message string, datetime string, uid string").json(path).select("message", "uid")


@register_raw("write_uploads", sql="SELECT CAST(uid AS STRING) AS uid, filename, size FROM uploads")
def _uploads(spark, sf_dir):
    u = view(spark, sf_dir, "uploads")
    rows = u.select(F.col("uid").cast("string").alias("uid"), F.col("uid").cast("string").alias("request_uid"), "origin", F.timestamp_seconds("t").alias("ts"), F.col("ip").cast("string").alias("ip"), F.lit("form").alias("kind"), "filename", "sniffed_type", "size", F.sha2("filename", 256).alias("sha256"), "answered_path")
    writers.write_uploads(rows, path := _target(spark, "uploads"))
    return spark.read.parquet(path).select("uid", "filename", "size")


@register_raw("write_blocklist", sql="SELECT CAST(ip AS STRING) AS value, count(*) AS n FROM sources WHERE NOT is_exit GROUP BY 1")
def _blocklist(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").where("NOT is_exit").select(F.col("ip").cast("string").alias("entry"), F.col("ip").alias("key"), (F.col("ip") % 5 == 0).alias("shared"))
    writers.write_blocklist(rows, path := _target(spark, "blocklist"))
    return spark.read.text(path).where(~F.col("value").startswith("#")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@register_raw("write_dossiers", sql="SELECT ip, country, coalesce(n, 0) AS requests_total, least(5, coalesce(n, 0)) AS shown FROM sources LEFT JOIN (SELECT ip, count(*) AS n FROM requests GROUP BY ip) USING (ip)")
def _dossiers(spark, sf_dir):
    requests = view(spark, sf_dir, "requests").select("ip", "path", "status", (-F.col("t")).alias("order"))
    writers.write_dossiers(writers.dossiers(view(spark, sf_dir, "sources").select("ip", "country"), {"requests": requests}, "ip", 5), path := _target(spark, "dossiers"))
    back = spark.read.schema("ip bigint, country string, requests_total bigint, requests array<struct<order:bigint,path:string,status:int>>").json(path)
    return back.select("ip", "country", F.coalesce("requests_total", F.lit(0)).alias("requests_total"), F.coalesce(F.size("requests"), F.lit(0)).alias("shown"))


_FACT = "SELECT ip, 'http.title' AS what, port, concat('title ', product) AS value FROM ports JOIN scans ON uid = scan_uid WHERE state = 'open' AND service = 'svc1'"
_HOST_KEY = "SELECT ip, 'ssh-hostkey', port, concat('SHA256:', rtrim(to_base64(unhex(sha256(concat('key ', service, ' ', port)))), '=')) FROM ports JOIN scans ON uid = scan_uid WHERE state = 'open' AND service = 'svc2'"


#: Hosts in a compressed file of reports.
HOSTS_PER_FILE = 20_000


@register_raw("ingest_scan_reports", sql=f"SELECT ip, state AS what, port, concat(service, '/', product) AS value FROM ports JOIN scans ON uid = scan_uid UNION ALL {_FACT} UNION ALL {_HOST_KEY}")
def _reports(spark, sf_dir):
    """Scan reports are written as XML from the stand-ins and read back: ports, facts and host keys.

    The XML is compressed, in files of HOSTS_PER_FILE hosts so that many tasks read it, and a
    port's scripts are made where it is written: only the ports' own columns are shuffled.
    """
    scans, ports = view(spark, sf_dir, "scans"), view(spark, sf_dir, "ports")
    element = lambda key, value: F.struct(F.lit(key).alias("_key"), value.alias("_VALUE"))

    def port(p):
        opened, service, product = p["state"] == "open", p["service"], p["product"]
        blob = F.base64(F.concat_ws(" ", F.lit("key"), service, p["port"]).cast("binary"))
        title = F.struct(F.lit("http-title").alias("_id"), F.array(element("title", F.concat(F.lit("title "), product))).alias("elem"), F.lit(None).cast("array<struct<elem:array<struct<_key:string,_VALUE:string>>>>").alias("table"))
        key = F.struct(F.lit("ssh-hostkey").alias("_id"), F.lit(None).cast("array<struct<_key:string,_VALUE:string>>").alias("elem"), F.array(F.struct(F.array(element("key", blob), element("type", F.lit("ssh-ed25519"))).alias("elem"))).alias("table"))
        script = F.when(opened & (service == "svc1"), F.array(title)).when(opened & (service == "svc2"), F.array(key))
        return F.struct(p["proto"].alias("_protocol"), p["port"].alias("_portid"), F.struct(p["state"].alias("_state")).alias("state"), F.struct(service.alias("_name"), product.alias("_product")).alias("service"), script.alias("script"))

    hosts = ports.groupBy("scan_uid").agg(F.collect_list(F.struct("proto", "port", "state", "service", "product")).alias("port")).join(scans.select(F.col("uid").alias("scan_uid"), "ip"), "scan_uid")
    rows = hosts.select(F.col("scan_uid").alias("_starttime"), F.array(F.struct(F.col("ip").cast("string").alias("_addr"), F.lit("ipv4").alias("_addrtype"))).alias("address"), F.struct(F.transform("port", port).alias("port")).alias("ports"))
    rows.write.format("xml").option("rootTag", "nmaprun").option("rowTag", "host").option("compression", "gzip").option("maxRecordsPerFile", HOSTS_PER_FILE).save(path := _target(spark, "xml"))
    reports = readers.scan_reports(spark, path)
    tables = readers.report_tables(reports)
    listed = readers.ports_of(reports, "ip").select("ip", F.col("state").alias("what"), "port", F.concat_ws("/", "service", "product").alias("value"))
    facts = tables["scan_facts"].select("ip", F.col("kind").alias("what"), "port", "value")
    keys = tables["host_keys"].select("ip", F.col("kind").alias("what"), "port", F.col("fingerprint").alias("value"))
    return listed.unionByName(facts).unionByName(keys).withColumn("ip", F.col("ip").cast("long"))


@register_raw("load_reference_feeds", sql="SELECT DISTINCT concat('10.0.', ip // 250, '.', ip % 250) AS ip FROM sources WHERE is_exit")
def _feeds(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").where("is_exit").select(F.concat(F.lit("ExitAddress 10.0."), F.floor(F.col("ip") / 250), F.lit("."), F.col("ip") % 250, F.lit(" 2024-01-01 00:00:00")).alias("value"))
    rows.write.text(path := _target(spark, "exits"))
    return readers.read_exit_list(spark, path)


@register_raw("read_geo_prefixes", sql="""SELECT DISTINCT concat('00000000000000000000ffff', lpad(lower(to_hex(n)), 8, '0')) AS low, concat('00000000000000000000ffff', lpad(lower(to_hex(n + 255)), 8, '0')) AS high, CASE WHEN n % 3 <> 0 THEN concat('C', chr(CAST(65 + n // 256 % 26 AS INT))) END AS country, CASE WHEN n % 5 <> 0 THEN n // 256 % 1000 END AS asn
  FROM (SELECT CAST(167772160 + ip % 7 * 65536 + ip % 200 * 256 AS BIGINT) AS n FROM sources)""")
def _geo_table(spark, sf_dir):
    n = F.lit(167_772_160) + F.col("ip") % 7 * 65_536 + F.col("ip") % 200 * 256
    rows = view(spark, sf_dir, "sources").select(n.alias("n"), F.concat(F.lit("10."), F.col("ip") % 7, F.lit("."), F.col("ip") % 200, F.lit(".9/24 ")).alias("network")).distinct()
    table = rows.select("network", F.when(F.col("n") % 3 != 0, F.concat(F.lit("c"), F.char(65 + F.floor(F.col("n") / 256) % 26))).otherwise("none").alias("country"), F.when(F.col("n") % 5 != 0, F.concat(F.lit("AS"), F.floor(F.col("n") / 256) % 1000)).otherwise("?").alias("asn"))
    broken = spark.createDataFrame([("10.1.2.3/99", "DE", "1"), ("no address", "DE", "1"), (None, None, None)], "network string, country string, asn string")
    table.unionByName(broken).write.option("header", True).csv(path := _target(spark, "geo"))
    return readers.read_geo_prefixes(spark, path)


@register_raw("read_asn_list", sql="SELECT DISTINCT asn * 1000 + ip AS asn FROM sources")
def _asn_list(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").select((F.col("asn") * 1000 + F.col("ip")).alias("n")).select(F.explode(F.array(F.concat(F.lit("AS"), "n", F.lit(" # hosting")), F.col("n").cast("string"), F.lit("# a comment"))).alias("value"))
    rows.write.text(path := _target(spark, "asns"))
    return readers.read_asn_list(spark, path, 100)


@register_raw("read_relays", sql="SELECT concat('relay', ip) AS nickname, CAST(ip AS STRING) AS fingerprint, is_exit, unnest(CASE WHEN is_exit THEN [concat('10.0.0.', ip % 250), concat('2001:db8::', ip % 100), '192.0.2.1'] ELSE [concat('10.0.0.', ip % 250), concat('2001:db8::', ip % 100)] END) AS ip FROM sources")
def _relays(spark, sf_dir):
    s = view(spark, sf_dir, "sources")
    addresses = F.array(F.concat(F.lit("10.0.0."), F.col("ip") % 250, F.lit(":9001")), F.concat(F.lit("[2001:db8::"), F.col("ip") % 100, F.lit("]:443")))
    relay = F.struct(
        F.concat(F.lit("relay"), "ip").alias("nickname"), F.col("ip").cast("string").alias("fingerprint"), addresses.alias("or_addresses"), F.when(F.col("is_exit"), F.array(F.lit("192.0.2.1"))).alias("exit_addresses"),
        F.when(F.col("is_exit"), F.array(F.lit("Running"), F.lit("Exit"))).otherwise(F.array(F.lit("Running"))).alias("flags"),
    )
    s.groupBy(F.pmod("ip", F.lit(64)).alias("part")).agg(F.collect_list(relay).alias("relays")).drop("part").write.option("maxRecordsPerFile", 1).json(path := _target(spark, "relays"))
    return readers.read_relays(spark, path)
