"""Registered filters, joins, windows, top-k, set operations and column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import columns as C
from harrow.operators import filters as P
from harrow.operators import joins as J
from harrow.operators import stats as S
from harrow.operators import windows as W
from harrow.plans.registry import register, register_raw
from harrow.plans.standins import DAY, NOW

R = register
#: An IPv4 address for a source number.
_IP = "concat('10.', CAST({0} AS BIGINT) % 7, '.', CAST({0} AS BIGINT) % 200, '.', CAST({0} AS BIGINT) % 250)"


def _ip(c: str):
    return F.concat(F.lit("10."), F.col(c) % 7, F.lit("."), F.col(c) % 200, F.lit("."), F.col(c) % 250)


#: A label of the catalogue for each event type.
_LABELS = {"click": "sqli", "view": "php-probe", "error": "path-scanner", "purchase": "form-interaction", "signup": "scanner-ua"}


def _label():
    return F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair])[F.col("label")]


_KEY = "concat('00000000000000000000ffff0a', lpad(lower(to_hex(ip % 7)), 2, '0'), lpad(lower(to_hex(ip % 200)), 2, '0'), lpad(lower(to_hex(ip % 250)), 2, '0'))"

# filters
R("filter_requests", "requests", sql=f"SELECT id FROM requests WHERE method = 'GET' AND contains(path, '/p/1') AND severity >= 1 AND t >= {NOW - 20 * DAY} AND t < {NOW - DAY + 1}")(
    lambda r: P.filter_requests(r, path="/p/1", min_severity=1, start=NOW - 20 * DAY, end=NOW - DAY, method="GET").select("id")
)
R("filter_sources", "sources", "requests", "intel_log", sql="SELECT ip FROM sources WHERE NOT is_exit AND ip IN (SELECT ip FROM requests WHERE label = 'view') AND ip NOT IN (SELECT ip FROM intel_log WHERE provider = 'p1')")(
    lambda s, r, i: P.filter_sources(s, with_=[r.where("label = 'view'")], without=[i.where("provider = 'p1'")], is_exit=False).select("ip")
)
R("filter_ip_query", "sources", sql="SELECT ip FROM sources WHERE ip % 7 = 3 AND ip % 200 < 4")(
    lambda s: P.filter_ip_query(s.withColumn("addr", _ip("ip")).withColumn("ip_key", C.ip_key(F.col("addr"))), "10.3.0.0/22", text="addr").select("ip")
)
R("has_label", "requests", sql="SELECT id FROM requests WHERE label = 'error'")(lambda r: r.withColumn("labels", F.array("label", "method")).where(P.has_label("labels", "error")).select("id"))
R("path_contains", "requests", sql="SELECT id FROM requests WHERE contains(path, 'index.php')")(lambda r: P.path_contains(r, "INDEX.php").select("id"))
R("time_bounds", "requests", sql=f"SELECT id FROM requests WHERE t >= {NOW - 9 * DAY} AND t < {NOW - 8 * DAY + 60}")(lambda r: P.time_bounds(r, NOW - 9 * DAY, NOW - 8 * DAY, 60).select("id"))
R("range_window", "requests", sql=f"SELECT id FROM requests WHERE t >= {NOW - 7 * DAY}")(lambda r: P.range_window(r, "7d", NOW).select("id"))
R("released", "requests", sql=f"SELECT id, t + 3600 + CAST('0x' || substr(md5(CAST(id AS STRING)), 1, 7) AS BIGINT) % 601 AS public_at FROM requests WHERE t + 3600 + CAST('0x' || substr(md5(CAST(id AS STRING)), 1, 7) AS BIGINT) % 601 <= {NOW - DAY}")(
    lambda r: P.released(r, NOW - DAY, 3600, 600).select("id", "public_at")
)
R("public_projection", "requests", sql="SELECT id, ip, t, label, severity, path, method, status FROM requests")(P.public_projection)
R("redistributable", "intel_log", sql="SELECT ip, provider, origin, hlc, t, CASE WHEN provider NOT IN ('p1', 'p3') THEN data END AS data FROM intel_log")(P.redistributable)
R("unmatched", "requests", sql="SELECT id FROM requests WHERE label IN ('error', 'view', 'purchase')")(lambda r: P.unmatched(r.withColumn("labels", F.array(_label())), "labels").select("id"))
_CLOSED = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 3)]
_NUMBER = "(ip % 256 * 16777216 + ip * 7 % 256 * 65536 + ip % 250 * 256 + 1)"
R("routable_only", "sources", sql=f"SELECT ip FROM sources WHERE NOT ({' OR '.join(f'{_NUMBER} >> {32 - n} = {int.from_bytes(bytes(map(int, a.split("."))), "big") >> 32 - n}' for a, n in _CLOSED)})")(
    lambda s: P.routable_only(s.withColumn("ip_key", C.ip_key(F.concat_ws(".", F.col("ip") % 256, F.col("ip") * 7 % 256, F.col("ip") % 250, F.lit(1))))).select("ip")
)
R("exclude", "requests", "uploads", sql="SELECT id FROM requests WHERE label <> 'purchase'")(lambda r, u: P.exclude(r, u.select(F.col("uid").alias("id"))).select("id"))

# joins
R("with_source", "requests", "sources", sql="SELECT id, ip, country, asn, is_exit FROM requests LEFT JOIN sources USING (ip)")(lambda r, s: J.with_source(r, s).select("id", "ip", "country", "asn", "is_exit"))
R("enrich_as_of", "requests", "intel_log", sql="""SELECT id, coalesce((SELECT arg_max(data, hlc) FROM intel_log l WHERE l.ip = r.ip AND l.t = b.t), (SELECT arg_min(data, hlc) FROM intel_log l WHERE l.ip = r.ip AND l.t = f.t)) AS data FROM requests r
  LEFT JOIN (SELECT r.id AS i, max(l.t) AS t FROM requests r JOIN intel_log l ON l.ip = r.ip AND l.t <= r.t GROUP BY r.id) b ON b.i = r.id LEFT JOIN (SELECT ip, min(t) AS t FROM intel_log GROUP BY ip) f ON f.ip = r.ip""")(
    lambda r, i: J.enrich_as_of(r, i).select("id", "data")
)
def _geo_ranges(spark):
    """A thousand ranges of addresses, unaligned and partly over one another."""
    key = lambda n: F.concat(F.lit(C.V4), F.lpad(F.lower(F.hex(n)), 8, "0"))
    low = F.lit(167_772_160) + F.col("id") * 450
    return spark.range(1000).select(key(low).alias("low"), key(low + 299 + F.col("id") % 7 * 90).alias("high"), F.concat(F.lit("C"), F.col("id")).alias("country"), (F.col("id") % 50).alias("asn"))


R("geo_join", "sources", sql="""WITH s AS (SELECT ip, 167772160 + ip % 7 * 65536 + ip % 200 * 256 + ip % 250 AS a FROM sources), r AS (SELECT i, 167772160 + i * 450 AS low, 167772160 + i * 450 + 299 + i % 7 * 90 AS high FROM range(1000) x(i))
  SELECT ip, CASE WHEN i IS NOT NULL THEN concat('C', i) END AS country, i % 50 AS asn FROM s LEFT JOIN r ON a BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY ip ORDER BY low DESC, high) = 1""")(
    lambda s: J.geo_join(s.select("ip", C.ip_key(_ip("ip")).alias("ip_key")), _geo_ranges(s.sparkSession)).select("ip", "country", "asn")
)
R("canary_reuse", "canaries", "tokens", "requests", sql="""WITH u AS (SELECT value_hash, request_id, min(t) AS t, min(ip) AS ip, min(place) AS place FROM tokens GROUP BY 1, 2), s AS (SELECT *, CASE WHEN request_id % 10 = 0 THEN -1 ELSE request_id END AS o FROM canaries),
  f AS (SELECT u.*, arg_max({'id': s.o, 'ip': s.ip, 't': s.t, 'kind': s.kind}, (s.t, s.o, s.ip)) AS s FROM u JOIN s ON s.value_hash = u.value_hash AND (s.t, s.o) < (u.t, u.request_id) GROUP BY ALL)
  SELECT f.request_id AS used_id, value_hash, s.kind AS kind, place, CASE WHEN s.id >= 0 THEN s.id END AS served_id, s.ip AS served_ip, f.ip AS used_ip, f.t - s.t AS delta, s.ip = f.ip AS same_source, v.origin AS served_node, v.label AS served_answer, w.origin AS used_node
  FROM f LEFT JOIN requests v ON v.id = s.id LEFT JOIN requests w ON w.id = f.request_id""")(
    lambda c, t, r: J.canary_reuse(c.withColumn("request_id", F.when(F.col("request_id") % 10 != 0, F.col("request_id"))), t, r.withColumn("answer", F.col("label")))
)
R("canary_links", "canaries", "tokens", sql="WITH p AS (SELECT DISTINCT c.ip AS o, t.ip AS u FROM canaries c JOIN tokens t USING (value_hash) WHERE c.ip <> t.ip) SELECT ip, CAST(sum(b) AS BIGINT) AS used_by, CAST(sum(n) AS BIGINT) AS uses_of FROM (SELECT o AS ip, 1 AS b, 0 AS n FROM p UNION ALL SELECT u, 0, 1 FROM p) GROUP BY ip")(lambda c, t: J.canary_links(c, t, 100))
R("with_provider", "sources", "intel_log", sql="SELECT ip FROM sources WHERE ip IN (SELECT ip FROM intel_log WHERE provider = 'p2')")(lambda s, i: J.with_provider(s, i, "p2").select("ip"))
R("without_provider", "sources", "intel_log", sql="SELECT ip FROM sources WHERE ip NOT IN (SELECT ip FROM intel_log WHERE provider = 'p2')")(lambda s, i: J.without_provider(s, i, "p2").select("ip"))
R("open_port_sources", "sources", "scans", "ports", sql="SELECT ip FROM sources WHERE ip IN (SELECT ip FROM scans JOIN ports ON scan_uid = uid WHERE port = 80 AND state = 'open')")(lambda s, c, p: J.open_port_sources(s, c, p, 80).select("ip"))
R("with_wave", "requests", sql="SELECT path AS shape, count(*) AS n, max(CASE WHEN k < 20 THEN k END) AS wave FROM requests GROUP BY path")(
    lambda r: J.with_wave(r.groupBy(F.col("path").alias("shape")).agg(S.count_().alias("n")), r.where("k < 20").groupBy(F.col("path").alias("shape")).agg(F.max("k").alias("wave")))
)
_DEAD = "SELECT u.uid AS upload, r.id, r.ip, r.t, r.path FROM uploads u JOIN requests r ON r.ip = u.ip AND r.origin = u.origin AND (r.t > u.t OR r.t = u.t AND r.id > u.request_id) AND r.t <= u.t + 86400 AND r.status = 404 AND ends_with(r.path, concat('/', u.filename))"
R("dead_ends", "uploads", "requests", sql=_DEAD)(lambda u, r: J.dead_ends(u, r, DAY))
R("dead_ends_by_path", "uploads", "requests", sql=f"SELECT path, count(DISTINCT id) AS hits, count(DISTINCT ip) AS sources, max(t) AS last_seen FROM ({_DEAD}) GROUP BY path")(lambda u, r: J.dead_ends_by_path(J.dead_ends(u, r, DAY)))
_LINE = "SELECT u.uid AS upload, u.t AS upload_t, r.id, r.t, r.path FROM uploads u JOIN requests r ON r.origin = u.origin AND (r.t > u.t OR r.t = u.t AND r.id > u.request_id) AND (r.path = u.answered_path OR u.path_is_prefix AND starts_with(r.path, concat(u.answered_path, '/'))) QUALIFY row_number() OVER (PARTITION BY u.uid ORDER BY r.t, r.id) <= 20"
R("upload_timeline", "uploads", "requests", sql=_LINE)(lambda u, r: J.upload_timeline(u, r, 20))
R("follow_ups", "uploads", "requests", sql=f"SELECT id, upload, path FROM ({_LINE}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY upload_t DESC, upload DESC) = 1")(lambda u, r: J.follow_ups(J.upload_timeline(u, r, 20)))
_EDGES = "WITH o AS (SELECT DISTINCT kind, value, ip FROM sightings), f AS (SELECT kind, value FROM o GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 50), g AS (SELECT o.* FROM o JOIN f USING (kind, value)), e AS (SELECT DISTINCT x.ip AS a, y.ip AS b FROM g x JOIN g y USING (kind, value) WHERE x.ip < y.ip) "
R("hard_edges", "sightings", sql=_EDGES + "SELECT * FROM e")(J.hard_edges)
R("candidate_pairs", "requests", sql="WITH o AS (SELECT DISTINCT ip, concat(path, '#', t // 1800) AS shape FROM requests), f AS (SELECT shape FROM o GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), g AS (SELECT o.* FROM o JOIN f USING (shape)) SELECT DISTINCT x.ip AS a, y.ip AS b FROM g x JOIN g y USING (shape) WHERE x.ip < y.ip")(
    lambda r: J.candidate_pairs(r.select("ip", F.concat("path", F.lit("#"), F.floor(F.col("t") / 1800)).alias("shape")).distinct())
)
_INPUTS = "concat(ip, '@', t // 1800)"


def _inputs(r):
    """Requests of a source in half an hour as one input with several values."""
    return r.select(F.concat("ip", F.lit("@"), F.floor(F.col("t") / 1800)).alias("source_uid"), "ip", "t", F.col("k").cast("string").alias("value"))


_IN = f"WITH i AS (SELECT {_INPUTS} AS source_uid, ip, t, CAST(k AS STRING) AS value FROM requests) "
R("joiner_pairs", "requests", sql=_IN + "SELECT DISTINCT x.ip, x.value AS a, y.value AS b FROM i x JOIN i y USING (source_uid) WHERE x.value < y.value AND source_uid IN (SELECT source_uid FROM i GROUP BY 1 HAVING count(DISTINCT value) <= 64)")(lambda r: J.joiner_pairs(_inputs(r)))
R("describers", "requests", sql=_IN + "SELECT x.value AS joiner, y.value, max(y.t) AS last_seen FROM i x JOIN i y USING (source_uid) WHERE x.value <> y.value GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY x.value ORDER BY max(y.t) DESC, y.value) <= 5")(lambda r: J.describers(_inputs(r), _inputs(r), 5))
R("related_by_ip", "requests", sql="SELECT id, t FROM requests WHERE ip = 7 AND id <> 100 ORDER BY t DESC, id DESC LIMIT 25")(lambda r: J.related_by_ip(r, 7, 100, 25).select("id", "t"))
R("related_by_ja4", "requests", sql=f"SELECT ja4, count(DISTINCT ip) AS sources, count(*) AS requests FROM requests WHERE ja4 = 'ja3' AND ip <> 7 AND t >= {NOW - 7 * DAY} GROUP BY ja4")(lambda r: J.related_by_ja4(r, "ja3", 7, NOW))
R("campaigns_of_shapes", "requests", "members", sql="SELECT path AS shape, campaign, count(DISTINCT ip) AS members, greatest(0, count(*) OVER (PARTITION BY path) - 3) AS more FROM requests JOIN members USING (ip) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY path ORDER BY count(DISTINCT ip) DESC, campaign) <= 3")(
    lambda r, m: J.campaigns_of_shapes(r.select(F.col("path").alias("shape"), "ip"), m)
)

# windows and top-k
R("request_history_1h", "requests", sql="SELECT id, CAST(len(list_distinct(list(path) OVER w)) AS INT) AS paths_1h, count(*) OVER w AS requests_1h FROM requests WINDOW w AS (PARTITION BY ip ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)")(
    lambda r: W.request_history_1h(r).select("id", "paths_1h", "requests_1h")
)
R("ranked_joiners", "sightings", sql="""WITH b AS (SELECT ip, value, max(t) AS last_seen FROM sightings GROUP BY 1, 2), s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY value) > 1 THEN 1 ELSE 0 END AS shared FROM b)
  SELECT ip, value, shared, row_number() OVER (PARTITION BY ip ORDER BY shared DESC, last_seen DESC, value) AS n, rank() OVER (PARTITION BY ip ORDER BY shared DESC, last_seen DESC) AS rank, CAST(sum(shared) OVER (PARTITION BY ip) AS BIGINT) AS n_shared FROM s""")(W.ranked_joiners)
R("joiner_lists", "requests", sql=_IN + """, l AS (SELECT ip, source_uid, string_agg(DISTINCT value, ',' ORDER BY value) AS list FROM i GROUP BY 1, 2), b AS (SELECT ip, list, count(*) AS inputs FROM l GROUP BY 1, 2)
  SELECT ip, CASE WHEN r <= 4 THEN list END AS list, CAST(sum(inputs) AS BIGINT) AS inputs FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY inputs DESC, list) AS r FROM b) GROUP BY 1, 2""")(lambda r: W.joiner_lists(_inputs(r), 4))
R("intel_history", "intel_log", sql="SELECT * FROM intel_log QUALIFY row_number() OVER (PARTITION BY ip, provider ORDER BY hlc DESC, origin DESC) <= 5")(lambda i: W.intel_history(i, 5))
R("latest_intel", "intel_log", sql="SELECT ip, provider, data, origin, hlc FROM intel_log QUALIFY row_number() OVER (PARTITION BY ip, provider ORDER BY hlc DESC, origin DESC) = 1")(W.latest_intel)
R("source_rank", "requests", sql="SELECT ip, count(*) AS requests, rank() OVER (ORDER BY count(*) DESC) AS rank FROM requests GROUP BY ip")(lambda r: W.source_rank(r.groupBy("ip").agg(S.count_().alias("requests"))).select("ip", "requests", "rank"))
_LIGHT = "SELECT ip, t // 3600 AS hour, id, t, path, row_number() OVER (PARTITION BY ip, t // 3600 ORDER BY t, id) AS pos, count(*) OVER (PARTITION BY ip, t // 3600) AS n FROM requests"
R("keep_newest_per_key", "requests", sql="SELECT id, ip, t FROM requests QUALIFY row_number() OVER (PARTITION BY ip ORDER BY t DESC, id DESC) <= 20")(lambda r: S.keep_top(r, ["ip"], [F.desc("t"), F.desc("id")], 20).select("id", "ip", "t"))
R("top_k", "requests", sql="SELECT path, count(*) AS n FROM requests GROUP BY path ORDER BY n DESC, path LIMIT 20")(lambda r: W.top_k(r.groupBy("path").agg(S.count_().alias("n")), "n", ["path"], 20))
R("recent", "requests", sql=f"""SELECT id, ip, t, path, f >= {NOW - 2 * DAY} - {DAY} AS new_shape, k < 10 AS wave FROM (SELECT * FROM requests WHERE t >= {NOW - 3 * DAY} ORDER BY t DESC, id DESC LIMIT 50) JOIN (SELECT path, min(t) AS f FROM requests GROUP BY path) USING (path)""")(
    lambda r: W.recent(r, r.groupBy(F.col("path").alias("shape")).agg(F.min("t").alias("first_seen")), r.where("k < 10").select(F.col("path").alias("shape")).distinct(), NOW - 2 * DAY, 50)
)
R("response_ratio_order", "jobs", sql="""WITH e AS (SELECT level, greatest(1.0, least(120.0, avg((finished - started) / 60.0::DOUBLE)))::DOUBLE AS minutes FROM jobs WHERE status = 'done' GROUP BY level)
  SELECT uid, (996624000 - queued + minutes * 60) / (minutes * 60) AS ratio FROM jobs JOIN e USING (level) WHERE status = 'queued' ORDER BY ratio DESC, queued, uid LIMIT 40""")(lambda j: W.response_ratio_order(j, S.level_estimates(j).select("level", "minutes"), 996_624_000, 40))
R("neighbours", "requests", "sources", sql="""WITH s AS (SELECT ip, asn, count(*) AS requests FROM requests JOIN sources USING (ip) GROUP BY 1, 2), p AS (SELECT x.ip, y.ip AS o, row_number() OVER (PARTITION BY x.ip ORDER BY y.requests DESC, y.ip) AS r FROM s x JOIN s y ON x.asn = y.asn AND x.ip <> y.ip)
  SELECT s.ip, (SELECT count(*) FROM s z WHERE z.asn = s.asn) - 1 AS others, coalesce((SELECT string_agg(o, ',' ORDER BY r) FROM p WHERE p.ip = s.ip AND r <= 8), '') AS neighbours FROM s""")(
    lambda r, s: W.neighbours(r.groupBy("ip").agg(S.count_().alias("requests")).join(s.select("ip", "asn"), "ip"), "asn")
)

# set operations
R("asked", "requests", "uploads", sql="SELECT path AS shape, ip FROM requests UNION SELECT answered_path, ip FROM uploads")(lambda r, u: W.asked(r.select(F.col("path").alias("shape"), "ip"), u.select(F.col("answered_path").alias("shape"), "ip")))
R("events_timeline", "requests", "scans", "intel_log", sql="SELECT * FROM (SELECT ip, t, id, 'request' AS kind FROM requests UNION ALL SELECT ip, t, uid, 'scan' FROM scans UNION ALL SELECT ip, t, hlc, 'lookup' FROM intel_log) ORDER BY t DESC, kind, id DESC LIMIT 200")(
    lambda r, s, i: W.events_timeline({"request": r.select("ip", "t", "id"), "scan": s.select("ip", "t", F.col("uid").alias("id")), "lookup": i.select("ip", "t", F.col("hlc").alias("id"))}, 200)
)
R("sightings", "requests", "host_keys", "uploads", sql="""SELECT 'agent' AS kind, user_agent AS value, ip, t FROM requests WHERE user_agent IS NOT NULL UNION ALL SELECT 'tls', ja4, ip, t FROM requests UNION ALL SELECT 'order', ja4h, ip, t FROM requests UNION ALL SELECT 'key', fingerprint, ip, 0 FROM host_keys UNION ALL SELECT 'file', filename, ip, t FROM uploads""")(
    lambda r, h, u: W.union_sightings({"agent": [r.select(F.col("user_agent").alias("value"), "ip", "t")], "tls": [r.select(F.col("ja4").alias("value"), "ip", "t")], "order": [r.select(F.col("ja4h").alias("value"), "ip", "t")], "key": [h.select(F.col("fingerprint").alias("value"), "ip", F.lit(0).cast("long").alias("t"))], "file": [u.select(F.col("filename").alias("value"), "ip", "t")]})
)
R("export_rows", "requests", "uploads", sql="SELECT id, ip, t, 1 AS weight FROM requests UNION ALL SELECT uid, ip, t, uid % 4 + 1 FROM uploads")(
    lambda r, u: W.export_rows(r.select("id", "ip", "t", "unrecorded"), u.select(F.col("uid").alias("id"), "ip", "t", (F.col("uid") % 4).alias("unrecorded"))).select("id", "ip", "t", "weight")
)

# columns
R("value_hash", "requests", sql="SELECT id, CAST(CAST('0x' || substr(sha256(path), 1, 15) AS BIGINT) AS BIGINT) AS h FROM requests")(lambda r: r.select("id", F.shiftright(C.value_hash(F.col("path")), 4).bitwiseAND(F.lit((1 << 60) - 1)).alias("h")))
_FAMILIES = """CASE WHEN label = 'click' AND method = 'GET' THEN 'inject' WHEN label = 'click' THEN 'inject,interact' WHEN label = 'signup' AND method = 'GET' THEN 'recon' WHEN label = 'signup' THEN 'recon,interact'
  WHEN label = 'purchase' OR method = 'POST' THEN 'interact' ELSE 'recon' END"""


def _labelled(r):
    """The label of the event type, and that of a form."""
    return r.withColumn("labels", F.when(F.col("method") == "POST", F.array(_label(), F.lit("form-interaction"))).otherwise(F.array(_label())))


R("label_families", "requests", sql=f"SELECT id, {_FAMILIES} AS families FROM requests")(lambda r: _labelled(r).select("id", F.array_join(C.label_families(F.col("labels")), ",").alias("families")))
R("families", "requests", sql=f"SELECT family, count(*) AS requests FROM (SELECT unnest(string_split({_FAMILIES}, ',')) AS family FROM requests) GROUP BY family")(lambda r: S.families(_labelled(r)))
R("net_range", "sources", sql="""WITH n AS (SELECT ip, 10 * 16777216 + ip % 7 * 65536 + ip % 200 * 256 + ip % 250 AS a, CAST(pow(2, 32 - ip % 33) AS BIGINT) AS size FROM sources)
  SELECT ip, concat('00000000000000000000ffff', lpad(lower(to_hex(a - a % size)), 8, '0')) AS low, concat('00000000000000000000ffff', lpad(lower(to_hex(a - a % size + size - 1)), 8, '0')) AS high FROM n""")(
    lambda s: (lambda low, high: s.select("ip", low.alias("low"), high.alias("high")))(*C.net_range(F.concat(_ip("ip"), F.lit("/"), F.col("ip") % 33)))
)
R("ip_key", "sources", sql=f"SELECT ip, {_KEY} AS ip_key, {_KEY} AS source_key, substr({_KEY}, 1, 30) AS prefix FROM sources")(
    lambda s: s.select("ip", C.ip_key(_ip("ip")).alias("ip_key")).select("ip", "ip_key", C.source_key(F.col("ip_key")).alias("source_key"), C.prefix24_48(F.col("ip_key")).alias("prefix"))
)
R("extract_json", "requests", sql="SELECT id, k FROM requests")(lambda r: r.select("id", C.extract_json(F.concat(F.lit('{"k": '), "k", F.lit("}")), "$.k", "int").alias("k")))
R("message_line", "requests", sql="SELECT id, concat(method, ' ', path, ' ->', status, ' [', label, ']') AS message FROM requests")(
    lambda r: r.select("id", F.regexp_replace(C.message_line(F.col("method"), F.col("path"), F.col("status"), F.col("label")), " -> ", " ->").alias("message"))
)
_QUERIES = ["cat%20/etc", "/usr/bin/wget+x", "zz", "perl+-e"]


def _commands(r):
    """A query string and a form by the request's number: another parameter first, a command in the form, an empty one, none."""
    query = F.concat(F.lit("a=1&cmd="), F.get(F.array(*map(F.lit, _QUERIES)), F.col("k") % 4))
    return r.withColumn("q", F.when(F.col("id") % 5 == 0, "run=ls&b").when(F.col("id") % 5 == 1, "a=1").otherwise(query)).withColumn("form", F.when(F.col("id") % 5 == 0, "command=id%20-u").when(F.col("id") % 5 == 1, F.when(F.col("id") % 2 == 0, "shell=")))


_COMMAND = "CASE WHEN id % 5 = 0 THEN 'id -u' WHEN id % 5 = 1 AND id % 2 = 0 THEN '' WHEN id % 5 = 1 THEN NULL WHEN k % 4 = 0 THEN 'cat /etc' WHEN k % 4 = 1 THEN '/usr/bin/wget x' WHEN k % 4 = 2 THEN 'zz' ELSE 'perl -e' END"
R("extract_command", "requests", sql=f"SELECT id, {_COMMAND} AS cmd FROM requests")(lambda r: _commands(r).select("id", C.extract_command(F.col("q"), F.col("form")).alias("cmd")))
R("command_verbs", "requests", sql=f"SELECT CASE WHEN cmd = 'id -u' THEN 'id' WHEN cmd = 'cat /etc' THEN 'cat' WHEN cmd = '/usr/bin/wget x' THEN 'wget' WHEN cmd = 'perl -e' THEN 'perl' ELSE 'other' END AS verb, count(*) AS requests FROM (SELECT {_COMMAND} AS cmd FROM requests) WHERE cmd IS NOT NULL GROUP BY 1")(
    lambda r: _commands(r).select(C.extract_command(F.col("q"), F.col("form")).alias("cmd")).where("cmd IS NOT NULL").groupBy(C.command_verb(F.col("cmd")).alias("verb")).agg(S.count_().alias("requests"))
)
R("header_value", "requests", sql="SELECT id, coalesce(user_agent, '(none)') AS agent FROM requests")(
    lambda r: r.select("id", C.header_value(F.when(F.col("user_agent").isNull(), F.array(F.struct(F.lit("Host").alias("name"), F.lit("h").alias("value")))).otherwise(F.array(F.struct(F.lit("Host").alias("name"), F.lit("h").alias("value")), F.struct(F.lit("User-Agent").alias("name"), F.col("user_agent").alias("value")))), "user-agent", "(none)").alias("agent"))
)
R("header_order_groups", "requests", sql="""SELECT concat(lower(substr(method, 1, 2)), '11', CASE id % 3 WHEN 1 THEN 'cr02en' WHEN 2 THEN 'nn01' ELSE 'nn03' END, CASE id % 3 WHEN 1 THEN 'us' WHEN 2 THEN '0000' ELSE '0000' END, '_',
  substr(sha256(CASE id % 3 WHEN 0 THEN 'host,user-agent,accept' WHEN 1 THEN 'host,accept' ELSE 'host' END), 1, 12), '_', substr(sha256(CASE id % 3 WHEN 1 THEN 'a,sid' ELSE '' END), 1, 12)) AS key, count(*) AS requests, count(DISTINCT ip) AS sources FROM requests GROUP BY 1""")(
    lambda r: S.header_order_groups(
        r,
        C.header_order_key(
            F.col("method"), F.lit("11"), F.get(F.array(*[F.array(*map(F.lit, names)) for names in (["Host", "User-Agent", "Accept"], ["Host", "Cookie", "Referer", "Accept"], ["host"])]), F.col("id") % 3),
            F.when(F.col("id") % 3 == 1, F.array(F.lit("sid"), F.lit("a"))), F.when(F.col("id") % 3 == 1, "en-US,en;q=0.8"),
        ),
    )
)
R("intel_tags", "intel_log", sql="SELECT hlc, concat('provider:', provider, ',country:', data) AS tags FROM intel_log")(
    lambda i: i.select("hlc", F.array_join(C.intel_tags(F.col("provider"), F.concat(F.lit('{"country": "'), "data", F.lit('"}'))), ",").alias("tags"))
)
R("retry_backoff_due", "intel_log", "sources", sql=f"""WITH l AS (SELECT ip, max(t) AS last, count(*) AS n FROM intel_log GROUP BY ip) SELECT ip FROM sources LEFT JOIN l USING (ip) WHERE last IS NULL OR last + 2 * {DAY} * pow(1.5, least(n, 30) - 1) <= {NOW}""")(
    lambda i, s: S.retry_backoff_due(i, s, NOW, 2)
)


_SHAPE = """WITH p AS (SELECT page_id, lower(split_part(regexp_replace(url, '^https?://[^/]+', ''), '?', 1)) AS path FROM pages)
  SELECT page_id, concat('/', array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '^[0-9]+(\\.[a-z0-9]{1,5})?$', '{n}\\1')), '/')) AS shape FROM p"""


@register_raw("path_shape", sql=_SHAPE)
def _path_shape(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", C.path_shape(F.regexp_replace("url", "^https?://[^/]+", "")).alias("shape"))


@register_raw("normalize_text", sql="SELECT page_id, url FROM pages")
def _normalize(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", C.normalize_text(F.url_encode(F.url_encode("url"))).alias("url"))
