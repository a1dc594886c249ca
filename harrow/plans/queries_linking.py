"""Registered linking, evidence and rule queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harrow.functions import columns as C
from harrow.operators import evidence as E
from harrow.operators import joins as J
from harrow.operators import linking as L
from harrow.operators import stats as S
from harrow.operators import windows as W
from harrow.plans.registry import register, register_raw
from harrow.plans.standins import DAY, NOW
from harrow.sources import readers
from harrow.sources.scratch import materialize, scratch_dir

R = register
ALONE, SUPPORTED = 0.06, 0.03  # the stand-in's sources share few shapes


def shapes_of(requests):
    """Path and day as the shape of a request."""
    return requests.select("ip", "t", F.concat("path", F.lit("#"), F.floor(F.col("t") / DAY)).alias("shape"))


def prints_of(requests):
    return requests.select("ip", F.concat("ja4", F.lit("/"), "ja4h").alias("fingerprint"))


def soft_of(requests):
    return L.soft_edges(shapes_of(requests), prints_of(requests), ALONE, SUPPORTED)


def hard_groups(sightings):
    return L.groups_of(J.hard_edges(sightings))


def report_of(sightings, requests):
    """Hard edges are found once, for the groups and for the counts, and so are candidates. Soft edges are withheld by the groups as they are merged."""
    hard = materialize(J.hard_edges(sightings), "hard-edges")
    candidates = materialize(L.scored_pairs(shapes_of(requests), prints_of(requests), SUPPORTED), "soft-candidates")
    return L.campaign_report(hard, candidates, J.excluded_values(sightings), ALONE)


_SHAPES = f"WITH RECURSIVE sh AS (SELECT ip, t, concat(path, '#', t // {DAY}) AS shape FROM requests), w AS (SELECT shape, count(DISTINCT ip) AS df, round(ln(1 + (SELECT count(DISTINCT ip) FROM sh) / count(DISTINCT ip)::DOUBLE), 9) AS weight FROM sh GROUP BY shape)"
_ORDER = """, own AS (SELECT ip, shape, min(t) AS f, max(t) AS l FROM sh GROUP BY 1, 2), aw AS (SELECT own.*, weight, df FROM own JOIN w USING (shape)),
  rp AS (SELECT x.ip AS a, y.ip AS b, count(*) AS rare FROM aw x JOIN aw y USING (shape) WHERE x.ip < y.ip AND x.df BETWEEN 2 AND 50 GROUP BY 1, 2),
  cm AS (SELECT a, b, x.shape, x.weight, x.df, x.f AS ta, y.f AS tb FROM rp JOIN aw x ON x.ip = a JOIN aw y ON y.ip = b AND y.shape = x.shape),
  ra AS (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY df, shape) <= 500),
  tw AS (SELECT x.a, x.b, sign(x.ta - y.ta) * sign(x.tb - y.tb) AS s FROM ra x JOIN ra y ON x.a = y.a AND x.b = y.b AND x.shape < y.shape),
  od AS (SELECT a, b, CASE WHEN count(*) FILTER (s <> 0) >= 28 AND any_value(n) >= 8 THEN sum(s)::DOUBLE / count(*) FILTER (s <> 0) END AS o FROM tw JOIN (SELECT a, b, count(*) AS n FROM cm GROUP BY 1, 2) USING (a, b) GROUP BY 1, 2)"""
_SOFT = _SHAPES + _ORDER + f""", tot AS (SELECT ip, sum(weight) AS w, min(f) AS f, max(l) AS l FROM aw GROUP BY ip), ws AS (SELECT a, b, sum(weight) AS ws, count(*) AS shared FROM cm GROUP BY 1, 2),
  fp AS (SELECT DISTINCT ip, concat(ja4, '/', ja4h) AS p FROM requests), tl AS (SELECT DISTINCT x.ip AS a, y.ip AS b FROM fp x JOIN fp y USING (p) WHERE x.ip < y.ip),
  soft AS (SELECT ws.a, ws.b, ws / (ta.w + tb.w - ws) AS score, shared FROM ws JOIN rp ON rp.a = ws.a AND rp.b = ws.b JOIN tot ta ON ta.ip = ws.a JOIN tot tb ON tb.ip = ws.b LEFT JOIN od ON od.a = ws.a AND od.b = ws.b
    WHERE rare >= 3 AND greatest(ta.f, tb.f) - least(ta.l, tb.l) <= 30 * {DAY} AND ws / (ta.w + tb.w - ws) >= {SUPPORTED} AND coalesce(od.o > -0.3, true)
    AND (ws / (ta.w + tb.w - ws) >= {ALONE} OR coalesce(od.o, 0) >= 0.5 OR (ws.a, ws.b) IN (SELECT (a, b) FROM tl)))"""
_HARD = """ oo AS (SELECT DISTINCT kind, value, ip FROM sightings), ff AS (SELECT kind, value FROM oo GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 50), gg AS (SELECT oo.* FROM oo JOIN ff USING (kind, value)), ee AS (SELECT DISTINCT x.ip AS a, y.ip AS b FROM gg x JOIN gg y USING (kind, value) WHERE x.ip <> y.ip),
  reach AS (SELECT DISTINCT a AS ip, a AS g FROM ee UNION SELECT ee.b, reach.g FROM reach JOIN ee ON ee.a = reach.ip), grp AS (SELECT ip, min(g) AS grp FROM reach GROUP BY ip)"""

R("shape_weights", "requests", sql=_SHAPES + " SELECT shape, df, weight FROM w")(lambda r: L.shape_weights(shapes_of(r)))
R("order_agreement", "requests", sql=_SHAPES + _ORDER + ' SELECT a, b, o AS "order" FROM od')(lambda r: L.order_agreement(J.candidate_pairs(shapes_of(r).select("ip", "shape").distinct()), shapes_of(r)))
R("soft_edges", "requests", sql=_SOFT + " SELECT a, b, score, shared FROM soft")(soft_of)
R("components", "sightings", sql="WITH RECURSIVE" + _HARD + " SELECT ip, grp FROM grp")(hard_groups)
R("guarded_merge", "sightings", "requests")(lambda s, r: L.guarded_merge(hard_groups(s), soft_of(r)))
R("group_loose", "requests", "members")(lambda r, m: L.group_loose(r.select("ip", "t", F.concat("k", F.lit("-"), F.col("id") % 3).alias("value")), m.select("ip", F.col("campaign").alias("grp"))))
R("joiner_star_edges", "sightings", "members", sql="WITH o AS (SELECT value, ip, min(t) AS t FROM sightings GROUP BY 1, 2), g AS (SELECT o.*, campaign AS grp FROM o JOIN members USING (ip)), n AS (SELECT *, first_value(ip) OVER (PARTITION BY value, grp ORDER BY t, ip) AS a FROM g) SELECT value, grp, a, ip AS b FROM n WHERE ip <> a")(
    lambda s, m: L.joiner_star_edges(s, m.select("ip", F.col("campaign").alias("grp")))
)
R("campaigns", "sightings", "requests", sql="WITH RECURSIVE" + _HARD + """, seen AS (SELECT ip, min(t) AS f, max(t) AS l FROM requests GROUP BY ip) SELECT grp, arg_min(ip, (f, ip)) AS key, count(*) AS size, min(f) AS first_seen, max(l) AS last_seen, row_number() OVER (ORDER BY min(f), arg_min(ip, (f, ip))) AS number FROM grp JOIN seen USING (ip) GROUP BY grp""")(
    lambda s, r: L.campaigns(hard_groups(s), S.source_rollup(r))
)
# candidates with their orders, then the groups: of the pairs of groups with the most soft links one a step, until none has enough
_MERGE = f""", sc AS (SELECT ws.a, ws.b, od.o FROM ws JOIN rp ON rp.a = ws.a AND rp.b = ws.b JOIN tot ta ON ta.ip = ws.a JOIN tot tb ON tb.ip = ws.b LEFT JOIN od ON od.a = ws.a AND od.b = ws.b
    WHERE rare >= 3 AND greatest(ta.f, tb.f) - least(ta.l, tb.l) <= 30 * {DAY} AND ws / (ta.w + tb.w - ws) >= {SUPPORTED}),
  sg AS (SELECT a, b, coalesce(x.grp, a) AS ga, coalesce(y.grp, b) AS gb FROM soft LEFT JOIN grp x ON x.ip = a LEFT JOIN grp y ON y.ip = b),
  sl AS (SELECT least(ga, gb) AS ga, greatest(ga, gb) AS gb, count(*) AS n FROM sg WHERE ga <> gb GROUP BY 1, 2),
  hs AS (SELECT grp, count(*) AS n FROM grp GROUP BY grp),
  mg AS (SELECT g, g AS r, coalesce(n, 1) AS s, 0 AS step FROM (SELECT ga AS g FROM sl UNION SELECT gb FROM sl) LEFT JOIN hs ON grp = g
    UNION ALL SELECT g, CASE WHEN r = rb THEN ra ELSE r END, s, step + 1 FROM mg, (SELECT ra, rb FROM (SELECT least(x.r, y.r) AS ra, greatest(x.r, y.r) AS rb, sum(n) AS n FROM sl JOIN mg x ON x.g = ga JOIN mg y ON y.g = gb WHERE x.r <> y.r GROUP BY 1, 2)
      JOIN (SELECT r AS ra, sum(s) AS sa FROM mg GROUP BY r) USING (ra) JOIN (SELECT r AS rb, sum(s) AS sb FROM mg GROUP BY r) USING (rb) WHERE n >= least(sa, sb, 2) ORDER BY n DESC, ra, rb LIMIT 1)),
  me AS (SELECT g, r FROM mg WHERE step = (SELECT max(step) FROM mg)),
  al AS (SELECT 'hard' AS class, false AS held FROM ee WHERE a < b UNION ALL SELECT 'soft', ga <> gb AND x.r <> y.r FROM sg LEFT JOIN me x ON x.g = ga LEFT JOIN me y ON y.g = gb UNION ALL SELECT 'candidate', (a, b) NOT IN (SELECT (a, b) FROM soft) FROM sc
    UNION ALL SELECT 'ordered', o <= -0.3 FROM sc WHERE o IS NOT NULL UNION ALL SELECT 'excluded', true FROM oo GROUP BY kind, value HAVING count(ip) > 50)"""
R("campaign_report", "sightings", "requests", sql=_SOFT + "," + _HARD + _MERGE + " SELECT class, count(*) AS edges, count(*) FILTER (held) AS withheld FROM al GROUP BY class")(report_of)
R("excluded_values", "sightings", sql="SELECT kind, value, count(DISTINCT ip) AS sources FROM sightings GROUP BY 1, 2 HAVING count(DISTINCT ip) > 2")(lambda s: J.excluded_values(s, 2))
R("campaign_tuning", "requests", "sightings")(lambda r, s: L.campaign_tuning(shapes_of(r), prints_of(r), J.hard_edges(s), [(ALONE, SUPPORTED), (0.1, 0.05)]))


def inputs_of(requests):
    """Requests of a source in half an hour as one input; path and third of the hour as the values."""
    return requests.select(F.concat("ip", F.lit("@"), F.floor(F.col("t") / 1800)).alias("source_uid"), "ip", "t", F.concat("k", F.lit("-"), F.col("ip") % 2).alias("value"))


_CHAIN = """WITH RECURSIVE i AS (SELECT concat(ip, '@', t // 1800) AS source_uid, ip, t, concat(k, '-', ip % 2) AS value FROM requests), p AS (SELECT DISTINCT x.ip, x.value AS a, y.value AS b FROM i x JOIN i y USING (source_uid) WHERE x.value < y.value), n AS (SELECT value, count(DISTINCT ip) AS n FROM i GROUP BY value),
  ed AS (SELECT a, b FROM p JOIN n x ON x.value = a JOIN n y ON y.value = b GROUP BY a, b HAVING count(*) >= greatest(2, ceil(max(greatest(x.n, y.n)) / 10.0))), eb AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re AS (SELECT DISTINCT a AS value, a AS g FROM eb UNION SELECT eb.b, re.g FROM re JOIN eb ON eb.a = re.value), ch AS (SELECT value, min(g) AS chain FROM re GROUP BY value)"""


def chains_of(requests):
    return L.chains(J.joiner_pairs(inputs_of(requests)), inputs_of(requests))


R("chains", "requests", sql=_CHAIN + " SELECT chain, arg_min(value, (t, value)) AS key, count(DISTINCT value) AS pieces, count(DISTINCT ip) AS sources, count(DISTINCT source_uid) AS inputs, min(t) AS first_seen, max(t) AS last_seen FROM i JOIN ch USING (value) GROUP BY chain")(chains_of)
R("chains_list", "requests", "members", sql="SELECT k % 9 AS chain, count(DISTINCT k) AS pieces, count(DISTINCT campaign) AS campaigns FROM requests LEFT JOIN members USING (ip) GROUP BY 1")(
    lambda r, m: L.chains_list(r.groupBy((F.col("k") % 9).alias("chain")).agg(F.countDistinct("k").alias("pieces")), r.select((F.col("k") % 9).alias("chain"), "ip"), m)
)
_REST = lambda *done: " - ".join(["399", *(f"(SELECT count(*) FROM {d})" for d in done)])
R("neighbourhood", "sightings", sql=f"""WITH o AS (SELECT DISTINCT CAST(ip AS VARCHAR) AS ip, value FROM sightings), n AS (SELECT value, count(*) AS n FROM o GROUP BY value),
  k1 AS (SELECT DISTINCT value AS node FROM o WHERE ip = '3' ORDER BY 1 LIMIT 399),
  h2 AS (SELECT DISTINCT 'group' AS kind, node FROM k1 JOIN n ON value = node WHERE n > 25 UNION SELECT DISTINCT 'ip', o.ip FROM k1 JOIN n ON n.value = node JOIN o ON o.value = node WHERE n <= 25 AND o.ip <> '3'),
  k2 AS (SELECT * FROM h2 QUALIFY row_number() OVER (ORDER BY kind, node) <= {_REST("k1")}),
  h3 AS (SELECT DISTINCT o.value AS node FROM k2 JOIN o ON o.ip = node WHERE kind = 'ip' AND o.value NOT IN (SELECT node FROM k1)),
  k3 AS (SELECT * FROM h3 QUALIFY row_number() OVER (ORDER BY node) <= {_REST("k1", "k2")})
  SELECT 'ip' AS kind, '3' AS node, 0 AS hops FROM (SELECT 1 FROM o WHERE ip = '3' LIMIT 1) UNION ALL SELECT 'item', node, 1 FROM k1 UNION ALL SELECT kind, node, 2 FROM k2 UNION ALL SELECT 'item', node, 3 FROM k3""")(lambda s: L.neighbourhood(s, 3))
R("campaign_graph", "sightings", "requests", sql=_SOFT + "," + _HARD + ", gr AS (SELECT a, b, score, x.grp FROM soft JOIN grp x ON x.ip = a JOIN grp y ON y.ip = b WHERE x.grp = y.grp) SELECT a, b, score, grp FROM gr QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, a, b) <= 2000")(
    lambda s, r: L.campaign_graph(soft_of(r), hard_groups(s))
)
R("edge_detail", "requests", sql=_SOFT + ", ow AS (SELECT DISTINCT ip, shape FROM sh) SELECT a, b, x.shape, df FROM soft JOIN ow x ON x.ip = a JOIN ow y ON y.ip = b AND y.shape = x.shape JOIN w ON w.shape = x.shape QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY df, x.shape) <= 5")(
    lambda r: L.edge_detail(soft_of(r), shapes_of(r), 5)
)
_STAGES = {"exploit": "signup", "delivery": "click", "command": "view", "payload": "purchase"}
_MARK = "CASE WHEN status = 404 AND id % 2 = 0 THEN 'dead end' WHEN method = 'POST' THEN 'claimed' WHEN id % 5 = 0 THEN 'external' WHEN id % 3 = 0 THEN 'gap' ELSE 'seen' END"
_RANKED = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(L.MARKS))
R("chain_stages", "requests", sql=f"""SELECT chain, stage, label, count(DISTINCT id) AS requests, arg_min(mark, CASE mark {_RANKED} END) AS mark FROM (SELECT k % 9 AS chain, CASE label {" ".join(f"WHEN '{v}' THEN '{k}'" for k, v in _STAGES.items())} ELSE 'follow-up' END AS stage,
  path AS label, id, {_MARK} AS mark FROM requests) GROUP BY 1, 2, 3""")(
    lambda r: L.chain_stages(
        r.select(F.col("k").alias("value"), (F.col("k") % 9).alias("chain")).distinct(),
        {
            stage: r.where(F.col("label") == label if label else ~F.col("label").isin(*_STAGES.values())).select(F.col("k").alias("value"), F.col("path").alias("label"), "id", F.expr(_MARK).alias("mark"))
            for stage, label in {**_STAGES, "follow-up": None}.items()
        },
    )
)

# evidence: signatures and patterns for the stand-in's own strings
DEVICES = [
    {"id": "relay", "kind": "proxy", "service": "^svc0$"},
    {"id": "gateway", "kind": "cpe", "product": "^prod[01]$", "ports": list(range(60))},
    {"id": "box", "kind": "cpe", "service": "^svc[123]$"},
    {"id": "firmware", "kind": "cpe", "os_guess": "^os[34]$"},
    {"id": "socks", "kind": "proxy", "fact": "socks.method"},
]
NAMES = {"consumer": [{"id": "one", "pattern": "^name[0-9]$"}], "pool": [{"id": "ten", "pattern": "^name1[0-2]$"}, {"id": "more", "pattern": "^name1[0-4]$"}], "cgn": [{"id": "cgn", "pattern": "^name1[5-9]$"}], "mobile": [{"id": "cell", "pattern": "^name2"}], "scanner": [{"id": "scan", "pattern": "^name3[0-4]$"}]}
_FRESH = f"ls AS (SELECT ip, max(t) - 300 * {DAY} AS last_seen FROM scans GROUP BY ip), fs AS (SELECT scans.* FROM scans JOIN ls USING (ip) WHERE t >= last_seen - {DAY})"
_DEVICE = """SELECT ip, kind, value, min(uid) AS ref FROM (SELECT ip, uid, 'device.proxy' AS kind, 'relay' AS value FROM fs JOIN ports ON scan_uid = uid WHERE state = 'open' AND service = 'svc0'
  UNION ALL SELECT ip, uid, 'device.cpe', CASE WHEN product IN ('prod0', 'prod1') AND port < 60 THEN 'gateway' WHEN service IN ('svc1', 'svc2', 'svc3') THEN 'box' END FROM fs JOIN ports ON scan_uid = uid WHERE state = 'open'
  UNION ALL SELECT ip, uid, 'device.cpe', 'firmware' FROM fs WHERE os_guess IN ('os3', 'os4') UNION ALL SELECT ip, uid, 'device.proxy', 'socks' FROM fs WHERE uid % 50 = 0) WHERE value IS NOT NULL GROUP BY 1, 2, 3"""
_FRESH_NAMES = f"nf AS (SELECT names.* FROM names JOIN (SELECT ip, max(last_seen) AS last FROM names GROUP BY ip) USING (ip) WHERE last_seen >= last - 30 * {DAY})"
_NAME = """SELECT ip, kind, value, max(last_seen) AS ref FROM (SELECT ip, last_seen, unnest([{'kind': 'name.consumer', 'value': CASE WHEN length(name) = 5 THEN 'one' END}, {'kind': 'name.pool', 'value': CASE WHEN name IN ('name10', 'name11', 'name12') THEN 'ten' WHEN name IN ('name13', 'name14') THEN 'more' END},
  {'kind': 'name.cgn', 'value': CASE WHEN name BETWEEN 'name15' AND 'name19' THEN 'cgn' END}, {'kind': 'name.mobile', 'value': CASE WHEN name = 'name2' OR name BETWEEN 'name20' AND 'name29' THEN 'cell' END}, {'kind': 'name.scanner', 'value': CASE WHEN name BETWEEN 'name30' AND 'name34' THEN 'scan' END}], recursive := true) FROM nf) WHERE value IS NOT NULL GROUP BY 1, 2, 3"""
_KEYS = "SELECT ip, 'fleet.key' AS kind, fingerprint AS value, ref FROM (SELECT kind, fingerprint, ip, min(scan_uid) AS ref, count(*) OVER (PARTITION BY kind, fingerprint) - 1 AS others FROM host_keys GROUP BY kind, fingerprint, ip) WHERE others BETWEEN 2 AND 50"
_DENSE = "SELECT ip, 'fleet.dense' AS kind, CAST(asn AS STRING) AS value, n AS ref FROM (SELECT ip, asn, count(*) OVER (PARTITION BY asn) AS n FROM sources) WHERE n >= 16"
_NET = "SELECT ip, CASE WHEN asn % 4 = 0 THEN 'net.hosting' ELSE 'net.eyeball' END AS kind, CASE WHEN asn % 4 = 0 AND asn % 8 = 0 THEN 'list' WHEN asn % 4 = 0 THEN 'supplement' WHEN asn % 8 = 1 THEN 'mobile' ELSE 'fixed' END AS value, asn AS ref FROM sources WHERE asn % 4 < 2"
_EV = f" {_FRESH}, {_FRESH_NAMES}, ev AS ({_DEVICE} UNION ALL {_NAME} UNION ALL {_KEYS} UNION ALL {_DENSE} UNION ALL {_NET})"
_KINDS = ["device.cpe", "device.proxy", "name.consumer", "name.pool", "name.cgn", "name.mobile", "name.scanner", "fleet.key", "fleet.dense", "net.hosting", "net.eyeball"]
_FLAGS = ", k AS (SELECT ip, " + ", ".join(f"bool_or(kind = '{k}') AS {k.replace('.', '_')}" for k in _KINDS) + """, bool_or(kind = 'net.eyeball' AND coalesce(value = 'mobile', false)) AS cell_net, bool_or(kind = 'exit') AS x
  FROM (SELECT ip, kind, value FROM ev UNION ALL SELECT ip, 'exit', NULL FROM sources WHERE is_exit) GROUP BY ip)"""
_READING = """CASE WHEN x OR net_hosting OR name_scanner OR fleet_key THEN 'operator' WHEN device_cpe AND name_pool THEN 'subscriber-pooled' WHEN device_cpe THEN 'subscriber' WHEN name_cgn THEN 'shared-pool'
  WHEN name_mobile OR cell_net THEN 'shared-mobile' WHEN name_pool THEN 'pooled-line' WHEN name_consumer THEN 'consumer-line' ELSE 'insufficient' END"""


def devices_of(scans, ports):
    """The last scan of a source stands for its last request, 300 days later."""
    last = scans.groupBy("ip").agg((F.max("t") - 300 * DAY).alias("last_seen"))
    facts = scans.where("uid % 50 = 0").select(F.col("uid").alias("scan_uid"), F.lit(1080).alias("port"), F.lit("socks.method").alias("kind"))
    return E.device_evidence(scans, ports, facts, last, DEVICES)


def names_of(names):
    return E.name_evidence(names, names.groupBy("ip").agg(F.max("last_seen").alias("last_seen")), NAMES)


def net_types_of(sources):
    types = sources.where("asn % 4 < 2").select("asn").distinct()
    kind = F.when(F.col("asn") % 4 == 0, "hosting").otherwise("eyeball")
    value = F.when(F.col("asn") % 8 == 0, "list").when(F.col("asn") % 4 == 0, "supplement").when(F.col("asn") % 8 == 1, "mobile").otherwise("fixed")
    return E.net_type(sources, types.select("asn", kind.alias("type"), value.alias("value")))


def all_evidence(scans, ports, names, host_keys, sources):
    out = devices_of(scans, ports).unionByName(names_of(names)).unionByName(E.fleet_key(host_keys))
    return out.unionByName(E.fleet_dense(sources, "asn")).unionByName(net_types_of(sources))


def written_evidence(*tables):
    """The evidence, derived once for all that reads it."""
    return materialize(all_evidence(*tables), "evidence")


_ROLES = ("scans", "ports", "names", "host_keys", "sources")
R("device_evidence", "scans", "ports", sql=f"WITH {_FRESH} {_DEVICE}")(devices_of)
R("unmatched_devices", "scans", sql="SELECT 'os guess' AS what, os_guess AS value, count(DISTINCT ip) AS sources FROM scans WHERE os_guess NOT IN ('os3', 'os4') GROUP BY 2")(lambda s: E.unmatched_devices(s, s, DEVICES))
R("name_evidence", "names", sql=f"WITH {_FRESH_NAMES} {_NAME}")(names_of)
R("fleet_key", "host_keys", sql=_KEYS)(E.fleet_key)
R("fleet_canary", "canaries", "tokens", sql="""WITH u AS (SELECT value_hash, request_id, min(t) AS t, min(ip) AS ip, min(place) AS place FROM tokens GROUP BY 1, 2), f AS (SELECT u.request_id, u.ip, place, arg_max(c.ip, (c.t, c.request_id, c.ip)) AS owner FROM u JOIN canaries c ON c.value_hash = u.value_hash AND (c.t, c.request_id) < (u.t, u.request_id) GROUP BY ALL)
  SELECT ip, 'fleet.canary' AS kind, CAST(count(*) AS STRING) AS value, min(request_id) AS ref FROM f WHERE owner <> ip AND place IN ('header', 'body') GROUP BY ip""")(lambda c, t: E.fleet_canary(J.canary_reuse(c, t)))
R("fleet_dense", "sources", sql=_DENSE)(lambda s: E.fleet_dense(s, "asn"))
R("net_type", "sources", sql=_NET)(net_types_of)
R("verdict", *_ROLES, sql="WITH" + _EV + _FLAGS + """ SELECT ip, CASE WHEN x THEN 'declared' WHEN fleet_key OR net_hosting AND (fleet_dense OR name_scanner) THEN 'rented fleet' WHEN net_hosting THEN 'rented' WHEN device_cpe AND net_eyeball AND NOT name_scanner THEN 'consumer device'
  WHEN device_proxy AND net_eyeball THEN 'proxy on a consumer line' WHEN (device_cpe OR device_proxy) AND NOT net_eyeball THEN 'device only' ELSE 'unknown' END AS verdict FROM k""")(lambda *t: E.verdict(all_evidence(*t), t[4].where("is_exit")))
R("sharing_reading", *_ROLES, sql="WITH" + _EV + _FLAGS + f" SELECT ip, {_READING} AS reading FROM k")(lambda *t: E.sharing_reading(all_evidence(*t), t[4].where("is_exit")))
_SHOWN = """(reading = 'operator' AND kind IN ('net.hosting', 'name.scanner', 'fleet.key', 'fleet.canary') OR reading = 'subscriber-pooled' AND kind IN ('device.cpe', 'name.pool') OR reading = 'subscriber' AND kind = 'device.cpe' OR reading = 'consumer-line' AND kind = 'name.consumer'
  OR reading = 'shared-pool' AND kind IN ('name.cgn', 'name.mobile', 'name.pool') OR reading = 'shared-mobile' AND kind IN ('name.mobile', 'name.pool') OR reading IN ('shared-pool', 'shared-mobile') AND kind = 'net.eyeball' AND value = 'mobile' OR reading = 'pooled-line' AND kind = 'name.pool')"""
R("reading_rows", *_ROLES, sql="WITH" + _EV + _FLAGS + f", rd AS (SELECT ip, {_READING} AS reading FROM k) SELECT ip, reading, kind, value, ref FROM ev JOIN rd USING (ip) WHERE {_SHOWN}")(
    lambda *t: (lambda ev: E.reading_rows(ev, E.sharing_reading(ev, t[4].where("is_exit"))))(written_evidence(*t))
)
R("evidence_report", *_ROLES, sql="WITH" + _EV + " SELECT kind, count(*) AS rows, count(DISTINCT ip) AS sources FROM ev GROUP BY kind")(lambda *t: E.evidence_report(all_evidence(*t)))
R("source_props", *_ROLES, "jobs", "requests", sql="WITH" + _EV + _FLAGS + f""", n AS (SELECT ip, arg_max(substr(kind, 5), ref) AS net FROM ev WHERE starts_with(kind, 'net.') GROUP BY ip)
  SELECT ip, is_exit, {_READING} AS reading, net AS net_type, coalesce(device_cpe OR device_proxy, false) AS device, coalesce(fleet_key OR fleet_dense, false) AS fleet, ip IN (SELECT ip FROM requests WHERE label IN ('signup', 'purchase')) AS agent, ip IN (SELECT ip FROM scans) AS scanned, ip IN (SELECT ip FROM jobs WHERE status IN ('queued', 'running')) AS waiting FROM sources LEFT JOIN k USING (ip) LEFT JOIN n USING (ip)""".replace(f"{_READING} AS reading", f"CASE WHEN k.ip IS NOT NULL THEN {_READING} END AS reading"))(
    lambda s, p, n, h, o, j, r: (lambda ev: E.source_props(o, ev, E.sharing_reading(ev, o.where("is_exit")), s, j, r.where("label IN ('signup', 'purchase')")))(written_evidence(s, p, n, h, o))
)
_BLOCK = f"SELECT ip, max(severity) AS max_severity, max(t) AS last_seen FROM requests WHERE severity >= 1 AND t >= {NOW - 20 * DAY - 3600} AND t + 3600 <= {NOW} AND ip NOT IN (SELECT ip FROM sources WHERE is_exit OR ip % 17 = 0 OR ip % 7 * 65536 + ip % 200 * 256 + ip % 250 BETWEEN 66000 AND 70000 OR ip % 7 = 4 AND ip % 200 >= 128) AND ip % 13 <> 0 GROUP BY ip"


def blocked(r, s):
    key = lambda n: f"{C.V4}{167_772_160 + n:08x}"
    never = r.sparkSession.createDataFrame([(key(66_000), key(70_000)), (key(4 * 65_536 + 128 * 256), key(5 * 65_536 - 1))], "low string, high string")
    keys = s.select("ip", C.ip_key(F.concat(F.lit("10."), F.col("ip") % 7, F.lit("."), F.col("ip") % 200, F.lit("."), F.col("ip") % 250)).alias("ip_key"))
    return E.blocklist(r, s.where("is_exit"), s.where("ip % 13 = 0"), NOW, 20, 1, 3600, s.where("ip % 17 = 0"), keys, never)


R("blocklist", "requests", "sources", sql=_BLOCK)(blocked)
R("collapse_networks", "requests", "sources", sql=f"""WITH l AS (SELECT b.ip, asn FROM ({_BLOCK}) b JOIN sources USING (ip)), m AS (SELECT asn FROM l GROUP BY 1 HAVING count(*) >= 3 AND asn % 5 <> 0) SELECT CAST(ip AS STRING) AS entry, false AS is_network FROM l WHERE asn NOT IN (SELECT asn FROM m) UNION ALL SELECT CAST(asn AS STRING), true FROM m""")(
    lambda r, s: E.collapse_networks(blocked(r, s).join(s.select("ip", "asn"), "ip"), s.where("asn % 5 = 0"), "asn")
)
R("new_shapes", "requests", sql=f"SELECT path AS shape, min(t) AS first_seen, max(t) AS last_seen, count(DISTINCT ip) AS sources, count(*) FILTER (severity > 0) AS hits FROM requests GROUP BY path HAVING min(t) >= {NOW - 28 * DAY}")(
    lambda r: E.new_shapes(S.shape_rollup(r, r.limit(0), "path"), NOW - 28 * DAY)
)
R("rules_carried", "requests", sql="SELECT origin, arg_max(concat('v', t // 864000), (t, id)) AS newest, count(DISTINCT concat('v', t // 864000)) - 1 AS others FROM (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY origin ORDER BY t DESC, id DESC) <= 500) GROUP BY origin")(
    lambda r: E.rules_carried(r.withColumn("v", F.concat(F.lit("v"), F.floor(F.col("t") / 864_000))), "v")
)
RULES = """
[[rule]]
label = "php-probe"
weight = 1
target_regex = '\\.php\\b'
owasp = ["OAT-018"]
[[rule]]
label = "path-nine"
weight = 3
target_regex = '^/p/9'
methods = ["POST"]
owasp = ["A03:2021", "A08:2021"]
[[rule]]
label = "ai-agent-tooling"
weight = 1
ua_regex = '^AGENT3$'
unless_target_regex = '/p/5'
[[rule]]
label = "removed"
weight = 2
methods = ["DELETE"]
[[rule]]
label = "exact"
weight = 2
path_exact = "/p/7"
owasp = ["OAT-014"]
[[rule]]
label = "hidden"
weight = 4
body_regex = 'eval\\('
unless_target_regex = 'p/6'
"""


def rules_of(spark):
    """The rules above, written as a rule file and read as any other."""
    path = f"{scratch_dir(spark).rstrip('/')}/rules-{uuid.uuid4().hex}"
    spark.createDataFrame([(RULES,)], "value string").coalesce(1).write.text(path)
    return readers.load_rules(spark, f"{path}/*.txt")


def asked_of(requests):
    """Requests as the rules read them: some targets and bodies encoded, methods of all kinds."""
    n = F.col("id")
    method = F.when(n % 32 == 20, "DELETE").when(n % 16 == 4, "PUT").when(n % 16 == 8, "CONNECT").when(n % 16 == 12, "TRACE").otherwise(F.col("method"))
    target = F.when(n % 2 == 0, F.regexp_replace("path", "^/p/", "%2Fp%2F")).otherwise(F.col("path"))
    body = F.when(n % 31 == 0, "x=%65val%28").otherwise("")
    rows = requests.select("id", "ip", "t", "origin", "path", method.alias("method"), target.alias("target"), body.alias("body"), F.coalesce("user_agent", F.lit("")).alias("agent"), F.lit("").alias("headers"))
    return W.request_history_1h(rows)


def ruled(requests):
    return E.classify(asked_of(requests), rules_of(requests.sparkSession))


_RULED = """WITH h AS (SELECT *, len(list_distinct(list(path) OVER w)) AS p1, count(*) OVER w AS r1, CASE WHEN id % 32 = 20 THEN 'DELETE' WHEN id % 16 = 4 THEN 'PUT' WHEN id % 16 = 8 THEN 'CONNECT' WHEN id % 16 = 12 THEN 'TRACE' ELSE method END AS m FROM requests WINDOW w AS (PARTITION BY ip ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)),
  f AS (SELECT id, origin, t, m, contains(path, '.php') AS a, starts_with(path, '/p/9') AND m = 'POST' AS b, coalesce(user_agent = 'agent3', false) AND NOT contains(path, '/p/5') AS c, m = 'DELETE' AS d, path = '/p/7' AS e, id % 31 = 0 AND NOT contains(path, 'p/6') AS x, p1 >= 10 OR r1 >= 20 AS s FROM h),
  g AS (SELECT *, NOT s AND NOT (a OR b OR d OR e OR x) AS p FROM f),
  l AS (SELECT *, array_to_string(list_filter([CASE WHEN c THEN 'ai-agent-tooling' END, CASE WHEN e THEN 'exact' END, CASE WHEN m = 'POST' THEN 'form-interaction' END, CASE WHEN x THEN 'hidden' END, CASE WHEN b THEN 'path-nine' END, CASE WHEN s THEN 'path-scanner' END, CASE WHEN a THEN 'php-probe' END, CASE WHEN p THEN 'probe' END,
      CASE WHEN m = 'CONNECT' THEN 'proxy-probe' END, CASE WHEN d THEN 'removed' END, CASE WHEN m = 'TRACE' THEN 'unusual-method' END, CASE WHEN m IN ('PUT', 'DELETE') THEN 'write-method' END], lambda y: y IS NOT NULL), ',') AS labels,
    CASE WHEN x THEN 4 WHEN b OR m IN ('POST', 'PUT', 'DELETE') THEN 3 WHEN e OR s OR m IN ('CONNECT', 'TRACE') THEN 2 ELSE 1 END AS severity,
    array_to_string(list_filter([CASE WHEN b THEN 'A03:2021' END, CASE WHEN b THEN 'A08:2021' END, CASE WHEN e THEN 'OAT-014' END, CASE WHEN a THEN 'OAT-018' END], lambda y: y IS NOT NULL), ',') AS owasp FROM g) """
R("classify", "requests", sql=_RULED + "SELECT id, labels, severity, owasp, CASE WHEN b OR d OR e OR x OR m <> 'GET' THEN severity ELSE 1 END AS scan_level FROM l")(
    lambda r: ruled(r).select("id", F.array_join("rule_labels", ",").alias("labels"), F.col("rule_severity").alias("severity"), F.array_join("owasp", ",").alias("owasp"), "scan_level")
)
R("reclassify", "requests", sql=_RULED + "SELECT id, labels FROM l WHERE labels <> 'probe'")(
    lambda r: E.reclassify(asked_of(r).withColumn("stored", F.array(F.lit("probe"))), rules_of(r.sparkSession), "stored").select("id", F.array_join("rule_labels", ",").alias("labels"))
)
R("rules_agreement", "requests", sql=_RULED + """SELECT origin, count(*) AS checked, count(*) FILTER (other) AS differ, count(*) FILTER (other) * 100 / count(*)::DOUBLE AS percent
  FROM (SELECT *, labels <> 'form-interaction,probe' AND NOT (labels = 'probe' AND id % 3 = 0) AS other FROM l QUALIFY row_number() OVER (PARTITION BY origin ORDER BY t DESC, id DESC) <= 500) GROUP BY origin""")(
    lambda r: E.rules_agreement(
        ruled(r).withColumn("stored", F.array(F.lit("form-interaction"), F.lit("probe"))).withColumn("seen", F.when((F.col("id") % 3 == 0) & (F.array_join("rule_labels", ",") == "probe"), F.col("stored")).otherwise(F.col("rule_labels"))).withColumn("level", F.col("rule_severity")),
        "stored", ["rule_labels", "seen"], severities=("level", ["rule_severity", "rule_severity"]),
    )
)
R("load_rules", "requests", sql=_RULED + " UNION ALL ".join(f"SELECT {i} AS position, '{label}' AS label, {weight} AS weight, count(*) FILTER ({flag}) AS hits FROM l" for i, (label, weight, flag) in enumerate([("php-probe", 1, "a"), ("path-nine", 3, "b"), ("ai-agent-tooling", 1, "c"), ("removed", 2, "d"), ("exact", 2, "e"), ("hidden", 4, "x")])))(
    lambda r: readers.rules_table(r.sparkSession, rules_of(r.sparkSession)).join(ruled(r).select(F.explode("rule_labels").alias("label")).groupBy("label").agg(S.count_().alias("hits")), "label", "left").select("position", "label", "weight", F.coalesce("hits", F.lit(0)).alias("hits"))
)
R("registry_pick", "intel_log", sql="""WITH n AS (SELECT ip, origin, arg_max(data, hlc) AS data FROM intel_log GROUP BY 1, 2), v AS (SELECT ip, data, count(*) AS n FROM n GROUP BY 1, 2), m AS (SELECT ip, count(*) AS vals, arg_max(data, (n, data)) AS winner, max(n) AS top FROM v GROUP BY ip), t AS (SELECT v.ip, count(*) FILTER (v.n = m.top) AS tied FROM v JOIN m USING (ip) GROUP BY v.ip),
  h AS (SELECT m.*, tied, o.data AS own, CASE WHEN vals = 1 THEN 'agreed' WHEN o.data IS NOT NULL THEN 'own' WHEN tied = 1 THEN 'plurality' ELSE 'disputed' END AS how FROM m JOIN t USING (ip) LEFT JOIN (SELECT * FROM n WHERE origin = 'n0') o USING (ip)) SELECT ip, how, CASE how WHEN 'agreed' THEN winner WHEN 'own' THEN own WHEN 'plurality' THEN winner END AS data FROM h""")(
    lambda i: E.registry_pick(i, "n0")
)


@register_raw("extract_indicators")
def _indicators(spark, sf_dir):
    """Indicators of all kinds, with their roles, in whole documents and in whole pages with their addresses; exploits by the rules' patterns."""
    exploits = [(r["label"], r["target_regex"]) for r in rules_of(spark) if r.get("target_regex")]
    rows = None
    for source, key, texts in (("documents", "doc_id", ["text"]), ("pages", "page_id", ["url", "html"])):
        part = spark.read.parquet(f"{sf_dir}/{source}.parquet").select(F.lit(source).alias("source"), F.col(key).alias("id"), F.concat_ws("\n", *texts).alias("text"))
        rows = part if rows is None else rows.unionByName(part)
    return E.extract_indicators(rows, "text", ["source", "id"], (), exploits=exploits)


R("extract_tokens", "requests", sql="SELECT id, 'agent' AS place, CAST('0x' || substr(sha256(user_agent), 1, 15) AS BIGINT) AS h FROM requests WHERE length(user_agent) >= 6")(
    lambda r: E.extract_tokens(r, {"agent": F.coalesce("user_agent", F.lit(""))}, ["id"]).select("id", "place", F.shiftright("value_hash", 4).bitwiseAND(F.lit((1 << 60) - 1)).alias("h"))
)
