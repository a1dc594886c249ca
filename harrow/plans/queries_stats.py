"""Registered statistics queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harrow.operators import joins as J
from harrow.operators import stats as S
from harrow.plans.registry import register
from harrow.plans.standins import DAY, NOW

R = register
AGENTS = "('signup', 'purchase')"

#: Event types as labels of several families.
_LABELS = {"click": "sqli", "error": "path-scanner", "purchase": "webshell", "signup": "login-probe"}
_LABEL_FAMILIES = {"sqli": "inject", "path-scanner": "recon", "webshell": "postex", "login-probe": "recon", "form-interaction": "interact"}


def _labelled(requests):
    label = F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair])
    return requests.withColumn("labels", F.array_compact(F.array(F.coalesce(F.try_element_at(label, F.col("label")), F.col("label")), F.when(F.col("method") == "POST", "form-interaction"))))


_MIX = """fm AS (SELECT ip, persona, CASE label WHEN 'click' THEN 'inject' WHEN 'error' THEN 'recon' WHEN 'purchase' THEN 'postex' WHEN 'signup' THEN 'recon' ELSE 'other' END AS family FROM requests WHERE NOT (method = 'POST' AND label NOT IN ('click', 'purchase', 'signup'))
  UNION ALL SELECT ip, persona, 'interact' FROM requests WHERE method = 'POST')"""
_MIXED = "string_agg(family || ':' || n, ',' ORDER BY list_position(['recon', 'exposure', 'inject', 'impact', 'interact', 'postex', 'bot', 'other'], family)) AS families"


R("source_rollup", "requests", sql="SELECT ip, count(*) AS requests, max(severity) AS max_severity, min(t) AS first_seen, max(t) AS last_seen FROM requests GROUP BY ip")(S.source_rollup)
R("label_rollup", "requests", sql="SELECT ip, label, count(*) AS requests FROM (SELECT id, ip, label FROM requests UNION SELECT id, ip, concat('m-', method) FROM requests) GROUP BY ip, label")(
    lambda r: S.label_rollup(r.withColumn("labels", F.array("label", F.concat(F.lit("m-"), "method"), "label")))
)
R("headline_counts", "requests", "sources", sql="SELECT count(*) AS requests, count(DISTINCT ip) AS sources, count(DISTINCT country) AS countries, count(DISTINCT CASE WHEN is_exit THEN ip END) AS exits FROM requests LEFT JOIN sources USING (ip)")(S.headline_counts)
R("severity_distribution", "requests", sql="SELECT severity, count(*) AS requests FROM requests GROUP BY severity")(S.severity_distribution)
_SEVERITIES = ", ".join(f"count(*) FILTER (severity = {s}) AS severity_{s}" for s in range(5))
R("timeline", "requests", sql=f"SELECT t - t % 3600 AS bucket, {_SEVERITIES} FROM requests GROUP BY 1")(S.timeline)
R("heatmap", "requests", sql=f"SELECT CAST((t // {DAY} + 3) % 7 AS INT) AS weekday, CAST(t % {DAY} // 3600 AS INT) AS hour, count(*) AS requests FROM requests WHERE t >= {NOW - 7 * DAY} AND t < {NOW} GROUP BY 1, 2")(lambda r: S.heatmap(r, NOW))
R("previous_window", "requests", sql=f"SELECT count(*) AS requests, count(DISTINCT ip) AS sources FROM requests WHERE t >= {NOW - 14 * DAY} AND t < {NOW - 7 * DAY}")(lambda r: S.previous_window(r, 7 * DAY, NOW))
R("owasp", "requests", sql="SELECT tag, count(*) AS requests FROM (SELECT id, concat('A0', severity, ':2021') AS tag FROM requests UNION SELECT id, 'OAT-018' FROM requests WHERE method = 'POST') GROUP BY tag")(
    lambda r: S.owasp(r.withColumn("owasp", F.array_compact(F.array(F.concat(F.lit("A0"), "severity", F.lit(":2021")), F.when(F.col("method") == "POST", "OAT-018"), F.concat(F.lit("A0"), "severity", F.lit(":2021"))))))
)
R("countries_map", "requests", "sources", sql="SELECT country, n AS sources, max(n) OVER () AS most FROM (SELECT country, count(DISTINCT ip) AS n FROM requests JOIN sources USING (ip) GROUP BY country)")(S.countries_map)
R("asn_top", "requests", "sources", sql="SELECT asn, count(DISTINCT ip) AS sources, max(asn_org) AS org FROM requests JOIN sources USING (ip) GROUP BY asn ORDER BY sources DESC, asn LIMIT 15")(S.asn_top)
R("open_ports", "scans", "ports", sql="SELECT port, proto, count(DISTINCT ip) AS sources FROM ports JOIN scans ON uid = scan_uid WHERE state = 'open' GROUP BY port, proto HAVING count(DISTINCT ip) >= 3")(S.open_ports)
R("products", "scans", "ports", sql="SELECT concat(product, ' ', version) AS product, count(DISTINCT scan_uid) AS scans, count(DISTINCT ip) AS sources FROM ports JOIN scans ON uid = scan_uid GROUP BY 1")(S.products)
R("os_guesses", "scans", sql="SELECT os_guess, count(*) AS scans, count(DISTINCT ip) AS sources FROM scans GROUP BY os_guess")(S.os_guesses)
R("ranked_values", "requests", sql="SELECT path AS value, count(*) AS requests, count(DISTINCT ip) AS sources FROM requests GROUP BY path ORDER BY requests DESC, value LIMIT 15")(lambda r: S.ranked_values(r, "path"))
R("value_shares", "requests", sql="SELECT coalesce(user_agent, 'unknown') AS value, count(*) AS requests FROM requests GROUP BY 1")(lambda r: S.value_shares(r, "user_agent"))
R("host_key_top", "host_keys", "scans", sql="SELECT fingerprint, count(DISTINCT ip) AS sources FROM host_keys WHERE kind = 'ssh' GROUP BY fingerprint")(lambda h, s: S.host_key_top(h, s, "ssh"))
R("abuse_bands", "sources", sql="""SELECT position, count(*) AS sources, ['not looked up', '0', '1-24', '25-49', '50-74', '75-99', '100'][position + 1] AS band FROM (SELECT CASE WHEN abuse_score IS NULL THEN 0 WHEN abuse_score = 0 THEN 1
  WHEN abuse_score < 25 THEN 2 WHEN abuse_score < 50 THEN 3 WHEN abuse_score < 75 THEN 4 WHEN abuse_score < 100 THEN 5 ELSE 6 END AS position FROM sources) GROUP BY position""")(S.abuse_bands)
R("job_status", "jobs", sql="SELECT status, count(*) AS jobs FROM jobs GROUP BY status")(S.job_status)
R("scan_levels", "scans", sql="SELECT level, count(*) AS scans FROM scans GROUP BY level")(S.scan_levels)
_FIRST = f"SELECT persona, ip, bool_or(t > f AND t <= f + {DAY}) AS followed FROM (SELECT *, min(t) OVER (PARTITION BY persona, ip) AS f FROM requests) GROUP BY persona, ip"
R("first_contact_followed", "requests", sql=_FIRST)(S.first_contact_followed)
R("persona_stats", "requests", sql=f"""WITH {_MIX}, x AS (SELECT persona, {_MIXED} FROM (SELECT persona, family, count(*) AS n FROM fm GROUP BY 1, 2) GROUP BY persona)
  SELECT * FROM (SELECT persona, count(*) AS requests, count(DISTINCT ip) AS sources FROM requests GROUP BY persona) JOIN (SELECT persona, count(*) FILTER (followed) AS followed FROM ({_FIRST}) GROUP BY persona) USING (persona) JOIN x USING (persona)""")(lambda r: S.persona_stats(_labelled(r), "labels"))
R("agent_share", "requests", "members", sql=f"""SELECT t - t % {DAY} AS bucket, count(DISTINCT ip) AS sources, count(DISTINCT CASE WHEN label IN {AGENTS} THEN ip END) AS agent_sources, count(DISTINCT campaign) AS campaigns,
  count(DISTINCT CASE WHEN label IN {AGENTS} THEN campaign END) AS agent_campaigns FROM requests LEFT JOIN members USING (ip) GROUP BY ROLLUP (1)""".replace("ROLLUP (1)", f"ROLLUP (t - t % {DAY})"))(S.agent_share)
R("campaign_tile", "members", "sources", "requests", sql=f"""WITH {_MIX}, m AS (SELECT * FROM members WHERE ip IN (SELECT ip FROM requests)), x AS (SELECT {_MIXED} FROM (SELECT family, count(*) AS n FROM fm WHERE ip IN (SELECT ip FROM members) GROUP BY 1))
  SELECT * FROM (SELECT count(*) AS campaigns, CAST(sum(n) AS BIGINT) AS members, max(n) AS largest FROM (SELECT campaign, count(*) AS n FROM m GROUP BY campaign)), (SELECT count(DISTINCT asn) AS asns, count(DISTINCT country) AS countries FROM m JOIN sources USING (ip)), x""")(
    lambda m, s, r: S.campaign_tile(m, s, requests=_labelled(r))
)
R("agent_sources", "requests", sql=f"SELECT count(DISTINCT ip) AS sources FROM requests WHERE label IN {AGENTS}")(S.agent_sources)
#: Values that failed requests are served too, so that a session's value leads on to others.
_SERVED = "sv AS (SELECT request_id, value_hash, kind FROM canaries UNION ALL SELECT id, (k * 7 + 1) % 100, 'c1' FROM requests WHERE label = 'error' AND id % 5 = 0)"
_SESSIONS = _SERVED + ", st AS (SELECT DISTINCT value_hash AS session, request_id FROM sv WHERE kind = 'c0'), ca AS (SELECT DISTINCT value_hash AS session, request_id FROM tokens WHERE value_hash IN (SELECT session FROM st))"


def served(c, r):
    more = r.where("label = 'error' AND id % 5 = 0").select(F.col("id").alias("request_id"), ((F.col("k") * 7 + 1) % 100).alias("value_hash"), F.lit("c1").alias("kind"))
    return c.select("request_id", "value_hash", "kind").unionByName(more)


R("decoy_sessions", "requests", "canaries", "tokens", sql=f"""WITH {_SESSIONS} SELECT session, count(DISTINCT ip) AS sources, min(t) AS first, max(t) AS last, count(*) AS steps, coalesce(string_agg(DISTINCT 't' || severity, ',' ORDER BY 't' || severity), '') AS tools
  FROM (SELECT * FROM st UNION SELECT * FROM ca) x JOIN requests r ON r.id = x.request_id GROUP BY session""")(lambda r, c, t: S.decoy_sessions(r.withColumn("tool", F.concat(F.lit("t"), "severity")), served(c, r), t, "c0"))
R("mcp_funnel", "requests", "canaries", "tokens", sql=f"""WITH {_SESSIONS}, an AS (SELECT session, severity FROM ca JOIN requests r ON r.id = ca.request_id),
  us AS (SELECT DISTINCT session FROM ca JOIN sv ON sv.request_id = ca.request_id AND sv.kind <> 'c0' JOIN tokens t ON t.value_hash = sv.value_hash AND t.request_id <> ca.request_id)
  SELECT (SELECT count(DISTINCT session) FROM st) AS sessions, (SELECT count(DISTINCT session) FROM an WHERE severity = 1) AS listed, (SELECT count(DISTINCT session) FROM an WHERE severity = 2) AS called, (SELECT count(*) FROM us) AS reused""")(
    lambda r, c, t: S.mcp_funnel(r.withColumn("answer", F.col("severity").cast("string")), served(c, r), t, "c0", "1", "2")
)
#: A call's body and answer, from a request: some bodies are broken, some name no model.
_BODY = """CASE WHEN id % 17 = 0 THEN '{"api": ' WHEN id % 11 = 0 THEN concat('{"api": "', label, '"}') ELSE concat('{"model": "m', k % 7, '", "api": "', label, '", "i": "', origin, '", "p": "', persona, '"}') END"""
_ANSWER = "concat('decoy:', CASE WHEN id % 13 = 0 THEN 'mcp:' ELSE 'llm:' END, CASE k % 6 WHEN 0 THEN 'tags' WHEN 1 THEN 'models' WHEN 2 THEN 'chat' WHEN 3 THEN 'generate' WHEN 4 THEN 'pull' ELSE 'show' END)"


def _llm(requests):
    asked = requests.withColumn("decoy_in", F.expr(_BODY)).withColumn("answer", F.expr(_ANSWER))
    listed = asked.where("k % 7 < 3").select(F.col("origin").alias("ident"), "persona", F.concat(F.lit("m"), F.col("k") % 7).alias("model")).distinct()
    return S.llm_usage(asked, listed)


_SECTION = lambda section, name, api, rest: f"SELECT {section} AS section, {name} AS name, {api} AS api, count(*) AS requests, count(DISTINCT ip) AS sources FROM r {rest}"
_CALLED = "answer IN ('chat', 'generate')"
R("llm_usage", "requests", sql=f"""WITH b AS (SELECT id, ip, k, origin, persona, {_BODY} AS body, {_ANSWER} AS a FROM requests),
  j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS v FROM b WHERE starts_with(a, 'decoy:llm:')), l AS (SELECT DISTINCT origin AS ident, persona, concat('m', k % 7) AS model FROM requests WHERE k % 7 < 3),
  r AS (SELECT ip, a[11:] AS answer, v ->> '$.api' AS api, v ->> '$.model' AS model, v ->> '$.i' AS ident, v ->> '$.p' AS persona FROM j),
  {" , ".join(f"s{i} AS ({q})" for i, q in enumerate([
    _SECTION("'api'", "coalesce(api, 'unknown')", "NULL", "GROUP BY 2"), _SECTION("'listings'", "NULL", "NULL", "WHERE answer IN ('tags', 'models') AND model IS NULL HAVING count(*) > 0"), _SECTION("'calls'", "NULL", "NULL", f"WHERE {_CALLED} HAVING count(*) > 0"),
    _SECTION("'pulls'", "NULL", "NULL", "WHERE answer = 'pull' HAVING count(*) > 0"), _SECTION("CASE WHEN l.model IS NOT NULL THEN 'listed' ELSE 'unlisted' END", "NULL", "NULL", f"LEFT JOIN l USING (ident, persona, model) WHERE {_CALLED} GROUP BY 1"),
    _SECTION("'model'", "model", "coalesce(api, '')", "WHERE model IS NOT NULL GROUP BY 2, 3 ORDER BY 4 DESC, 2, 3 LIMIT 100")]))}
  {" UNION ALL ".join(f"SELECT section, CAST(name AS VARCHAR) AS name, CAST(api AS VARCHAR) AS api, requests, sources FROM s{i}" for i in range(6))}""")(_llm)
R("decoy_tiles", "requests", sql="SELECT status, method, count(*) AS requests FROM requests GROUP BY status, method HAVING count(*) >= 5")(S.decoy_tiles)
_TOP = lambda out, value, rows, n: f"(SELECT asn, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY n DESC, {value}) AS {out} FROM (SELECT asn, {value}, {n} AS n FROM {rows} GROUP BY asn, {value} QUALIFY row_number() OVER (PARTITION BY asn ORDER BY {n} DESC, {value}) <= 8) GROUP BY asn)"
R("network_rollup", "requests", "sources", "scans", "ports", "members", sql=f"""WITH r AS (SELECT requests.*, asn FROM requests JOIN sources USING (ip)), p AS (SELECT ip, port, asn FROM ports JOIN scans ON uid = scan_uid JOIN sources USING (ip) WHERE state = 'open'),
  b AS (SELECT asn, count(DISTINCT ip) AS sources, count(*) AS requests, max(severity) AS max_severity, min(t) AS first_seen, max(t) AS last_seen FROM r GROUP BY asn), c AS (SELECT asn, count(DISTINCT campaign) AS campaigns FROM members JOIN sources USING (ip) GROUP BY asn)
  SELECT b.*, top_labels, top_ports, coalesce(campaigns, 0) AS campaigns FROM b JOIN {_TOP("top_labels", "label", "r", "count(*)")} USING (asn) LEFT JOIN {_TOP("top_ports", "port", "p", "count(DISTINCT ip)")} USING (asn) LEFT JOIN c USING (asn)""")(
    lambda r, s, c, p, m: S.network_rollup(r, s, "asn", open_ports=p.where("state = 'open'").join(c.select(F.col("uid").alias("scan_uid"), "ip"), "scan_uid").select("ip", "port"), members=m)
)
_REGISTRY = """CASE WHEN hlc % 13 = 0 THEN '{"org": ' ELSE concat('{"org": " o', hlc % 5, ' ", "range": ', CASE WHEN hlc % 4 = 0 THEN '7' ELSE concat('"r', hlc % 3, '"') END, ', "abuse": "', CASE WHEN hlc % 6 = 0 THEN ' ' ELSE data END, '"}') END"""
R("network_facts", "sources", "intel_log", sql=f"""WITH j AS (SELECT ip, {_REGISTRY} AS d FROM intel_log WHERE provider = 'p2'), v AS (SELECT * FROM j WHERE json_valid(d)),
  f AS ({" UNION ALL ".join(f"SELECT ip, '{f}' AS field, trim(d ->> '$.{f}') AS value FROM v WHERE json_type(d, '$.{f}') = 'VARCHAR'" for f in ("org", "range", "abuse"))}),
  a AS (SELECT asn, field, value, ip FROM f JOIN sources USING (ip) WHERE value <> '' UNION ALL SELECT asn, 'country', country, ip FROM sources)
  SELECT asn, field, value, count(DISTINCT ip) AS sources FROM a GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY asn, field ORDER BY count(DISTINCT ip) DESC, value) <= 8""")(
    lambda s, i: S.network_facts(s, i.withColumn("data", F.expr(_REGISTRY)), "asn", "p2")
)
R("links_list", "sightings", sql="SELECT kind, value, count(DISTINCT ip) AS sources, count(*) AS sightings, min(t) AS first_seen, max(t) AS last_seen FROM sightings GROUP BY kind, value HAVING count(DISTINCT ip) > 1")(S.links_list)
R("link_item", "sightings", "sources", sql="SELECT value, ip, count(*) AS sightings, max(t) AS last_seen, any_value(country) AS country FROM sightings LEFT JOIN sources USING (ip) WHERE kind = 'key' GROUP BY value, ip")(lambda s, o: S.link_item(s, o, "key"))
R("campaign_index", "members", "sources", "requests", sql=f"SELECT campaign, count(DISTINCT ip) AS size, count(DISTINCT country) AS countries, count(DISTINCT asn) AS asns, coalesce(bool_or(label IN {AGENTS}), false) AS agent FROM members LEFT JOIN sources USING (ip) LEFT JOIN requests USING (ip) GROUP BY campaign")(S.campaign_index)
R("campaign_calendar", "members", "requests", sql=f"SELECT campaign, t // {DAY} AS day, count(*) AS requests FROM requests JOIN members USING (ip) WHERE t >= {NOW - 182 * DAY} GROUP BY 1, 2")(lambda m, r: S.campaign_calendar(m, r, NOW))
R("campaign_shapes", "members", "requests", sql="SELECT campaign, path, count(DISTINCT ip) AS members FROM requests JOIN members USING (ip) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY count(DISTINCT ip) DESC, path) <= 10")(S.campaign_shapes)
_RUN = "(SELECT ip, t, concat('cmd', k % 6) AS cmd FROM requests WHERE label = 'click')"
R("campaign_commands", "members", "requests", sql=f"SELECT campaign, cmd, count(*) AS runs, count(DISTINCT ip) AS sources, max(t) AS last_seen FROM {_RUN} JOIN members USING (ip) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY count(*) DESC, max(t) DESC, cmd) <= 4")(
    lambda m, r: S.campaign_commands(m, r.withColumn("cmd", F.when(F.col("label") == "click", F.concat(F.lit("cmd"), F.col("k") % 6))), 4)
)
R("campaign_uploads", "members", "uploads", sql="SELECT campaign, uid, ip, t, filename, size FROM uploads JOIN members USING (ip) QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY t DESC, uid DESC) <= 20")(S.campaign_uploads)
R("agent_campaigns", "members", "requests", sql=f"SELECT DISTINCT campaign FROM members JOIN requests USING (ip) WHERE label IN {AGENTS}")(S.agent_campaigns)
def _overview(requests):
    rows = S.source_overview(_labelled(requests), NOW, k=3)
    joined = lambda c: F.array_join(c, ",").alias(c)
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["label"], F.lit(":"), x["n"])), ",").alias(c)
    return rows.select("ip", "requests", "active_days", *map(joined, ("hours", "by_severity", "days", "day_severity")), *map(named, ("labels", "families")))


_CASE = lambda c, of: f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in of.items())
_SERIES = lambda m, n: f"array_to_string(list_transform(range(0, {n}), lambda i: coalesce({m}[i], 0)), ',')"
_ORDER = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(["recon", "exposure", "inject", "impact", "interact", "postex", "bot", "other"]))
R("source_overview", "requests", sql=f"""WITH l AS (SELECT id, ip, {_CASE("label", _LABELS)} ELSE label END AS label FROM requests UNION ALL SELECT id, ip, 'form-interaction' FROM requests WHERE method = 'POST'),
  w AS (SELECT ip, 167 - ({NOW // 3600} - t // 3600) AS h, severity, count(*) AS n FROM requests WHERE t // 3600 > {NOW // 3600 - 168} AND t // 3600 <= {NOW // 3600} GROUP BY ALL),
  fine AS (SELECT ip, map(list(h * 5 + severity), list(n)) AS m FROM w GROUP BY ip), hours AS (SELECT ip, map(list(h), list(n)) AS m FROM (SELECT ip, h, sum(n)::BIGINT AS n FROM w GROUP BY 1, 2) GROUP BY ip),
  d AS (SELECT ip, map(list(b), list(n)) AS m, map(list(b), list(s)) AS s FROM (SELECT ip, 181 - ({NOW // DAY} - t // {DAY}) AS b, count(*) AS n, max(severity) + 1 AS s FROM requests WHERE t // {DAY} > {NOW // DAY - 182} AND t // {DAY} <= {NOW // DAY} GROUP BY 1, 2) GROUP BY ip),
  b AS (SELECT ip, label, count(DISTINCT id) AS n FROM l GROUP BY 1, 2),
  top AS (SELECT ip, string_agg(label || ':' || n, ',' ORDER BY n DESC, label) AS labels FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY ip ORDER BY n DESC, label) <= 3) GROUP BY ip),
  f AS (SELECT ip, string_agg(family || ':' || n, ',' ORDER BY CASE family {_ORDER} END) AS families FROM (SELECT ip, {_CASE("label", _LABEL_FAMILIES)} ELSE 'other' END AS family, sum(n)::BIGINT AS n FROM b GROUP BY 1, 2) GROUP BY ip),
  base AS (SELECT ip, count(*) AS requests, count(DISTINCT t // {DAY}) AS active_days FROM requests GROUP BY ip)
  SELECT base.*, {_SERIES("hours.m", 168)} AS hours, {_SERIES("fine.m", 840)} AS by_severity, {_SERIES("d.m", 182)} AS days, {_SERIES("d.s", 182)} AS day_severity, labels, families
  FROM base LEFT JOIN hours USING (ip) LEFT JOIN fine USING (ip) LEFT JOIN d USING (ip) LEFT JOIN top USING (ip) LEFT JOIN f USING (ip)""")(_overview)
R("shape_rollup", "requests", "uploads", sql="SELECT shape, min(t) AS first_seen, max(t) AS last_seen, count(DISTINCT ip) AS sources, count(*) FILTER (hit) AS hits FROM (SELECT path AS shape, ip, t, severity > 0 AS hit FROM requests UNION ALL SELECT answered_path, ip, t, false FROM uploads) GROUP BY shape")(
    lambda r, u: S.shape_rollup(r, u.withColumnRenamed("answered_path", "path"), "path")
)
R("piece_rollup", "sightings", sql="SELECT value, count(DISTINCT ip) AS sources, count(DISTINCT source_uid) AS inputs, min(t) AS first_seen, max(t) AS last_seen FROM sightings GROUP BY value")(S.piece_rollup)
_JOBS_NOW = 996_624_000
_AGED = lambda c, more="": f"(SELECT string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY i) FROM range(24) h(i) LEFT JOIN (SELECT 23 - ({_JOBS_NOW} - {c}) // 3600 AS b, count(*) AS n FROM jobs WHERE {c} > {_JOBS_NOW - DAY} AND {c} <= {_JOBS_NOW}{more} GROUP BY 1) ON b = i)"
_ENDED = "status IN ('done', 'failed')"


def _queue(jobs):
    rows = S.queue_metrics(jobs, _JOBS_NOW)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("hourly_arrivals", "hourly_completions")})


R("queue_metrics", "jobs", sql=f"""SELECT count(*) FILTER (status = 'queued') AS backlog, count(*) FILTER (status = 'running' AND started > {_JOBS_NOW - 13 * 3600}) AS running, count(*) FILTER (queued > {_JOBS_NOW - 3600}) AS arrivals_1h, count(*) FILTER (queued > {_JOBS_NOW - DAY}) AS arrivals_24h,
  count(*) FILTER ({_ENDED} AND finished > {_JOBS_NOW - 3600}) AS completed_1h, count(*) FILTER ({_ENDED} AND finished > {_JOBS_NOW - DAY}) AS completed_24h, count(*) FILTER (status = 'failed' AND finished > {_JOBS_NOW - DAY}) AS failed_24h, 0::BIGINT AS refused_24h,
  count(*) FILTER (status = 'failed' AND starts_with(error, 'timeout') AND finished > {_JOBS_NOW - DAY}) AS timeouts_24h, count(*) FILTER (queued > {_JOBS_NOW - 6 * 3600}) AS arrivals_recent, count(*) FILTER ({_ENDED} AND finished > {_JOBS_NOW - 6 * 3600}) AS left_recent,
  least(greatest(({_JOBS_NOW} - min(queued)) / 3600, 1.0), 24.0)::DOUBLE AS observed_hours, avg(CASE WHEN {_ENDED} AND finished > {_JOBS_NOW - 7 * DAY} THEN finished - started END) AS avg_scan_s, max(CASE WHEN status = 'queued' THEN {_JOBS_NOW} - queued END) AS oldest_queued_s,
  {_AGED("queued")} AS hourly_arrivals, {_AGED("finished", " AND " + _ENDED)} AS hourly_completions FROM jobs""")(_queue)
_HOURS = 24_000  # the stand-in has few jobs a day
R("scanner_rates", "jobs", sql=f"""WITH b AS (SELECT level, scanner, count(*) FILTER (status = 'done') AS ok, count(*) FILTER (status = 'failed' AND coalesce(error NOT IN ('timeout', 'invalid target'), true)) AS failed FROM jobs
  WHERE status IN ('done', 'failed') AND finished >= {_JOBS_NOW} - {_JOBS_NOW % 3600} - {_HOURS} * 3600 AND finished < {_JOBS_NOW - _JOBS_NOW % 3600} GROUP BY 1, 2),
  r AS (SELECT *, (ok + 4) / (ok + failed + 4)::DOUBLE AS rate FROM b) SELECT *, greatest(0.1, least(1.0, coalesce(rate / (SELECT max(o.rate) FROM r o WHERE o.level = r.level AND o.scanner <> r.scanner AND o.ok + o.failed >= 5), 1.0)))::DOUBLE AS weight FROM r""")(lambda j: S.scanner_rates(j, _JOBS_NOW, _HOURS))
R("level_estimates", "jobs", sql="SELECT level, count(*) AS n, greatest(1.0, least(120.0, CASE WHEN count(*) >= 5 THEN avg((finished - started) / 60.0::DOUBLE) ELSE 10.0 END))::DOUBLE AS minutes FROM jobs WHERE status = 'done' GROUP BY level")(S.level_estimates)
R("scanner_capacity", "jobs", sql="SELECT scanner, count(*) FILTER (status = 'running') AS running, 600 AS slots, greatest(0, 600 - count(*) FILTER (status = 'running')) AS free FROM jobs GROUP BY scanner")(lambda j: S.scanner_capacity(j, 600))
R("granted_sales", "scans", "jobs", sql="SELECT s.ip, s.level, min(s.t) AS first_t, count(*) AS sales FROM scans s JOIN jobs j USING (uid) WHERE substr(s.origin, 2) <> substr(j.scanner, 2) GROUP BY s.ip, s.level")(
    lambda s, j: S.granted_sales(s, j)
)
_SPREAD = "SELECT good, hour, min(price_mc) AS low, quantile_disc(price_mc, 0.5) AS median, max(price_mc) AS high FROM prices GROUP BY good, hour"
R("price_spread", "prices", sql=_SPREAD)(S.price_spread)
R("price_series", "prices", sql=_SPREAD)(lambda p: S.price_series(p, 12_000, 12_000))
R("price_change", "prices", sql=f"SELECT good, arg_min(median, hour) AS first, arg_max(median, hour) AS last, 100.0::DOUBLE * (arg_max(median, hour) - arg_min(median, hour)) / arg_min(median, hour) AS percent FROM ({_SPREAD}) WHERE hour > 10000 AND hour <= 11000 GROUP BY good")(lambda p: S.price_change(p, 11000, 1000))
_UP = """WITH n AS (SELECT DISTINCT reporter, hour, member FROM reports), c AS (SELECT hour, count(DISTINCT reporter) AS reporters FROM reports GROUP BY hour), v AS (SELECT hour, member, count(*) AS votes FROM n WHERE reporter <> member GROUP BY 1, 2),
  u AS (SELECT v.member, v.hour FROM v JOIN c USING (hour) WHERE 2 * votes > reporters - (SELECT count(*) FROM (SELECT DISTINCT reporter, hour FROM reports) o WHERE o.hour = v.hour AND o.reporter = v.member)), up AS (SELECT member, hour // 24 AS day, count(*) AS up_hours FROM u GROUP BY 1, 2) """
R("uptime", "reports", sql=_UP + "SELECT * FROM up")(S.uptime)
R("verified_daily", "reports", sql=_UP + "SELECT member, day FROM up WHERE up_hours >= 2")(lambda r: S.verified_daily(S.uptime(r), 2))
R("pool_split", "reports", sql="""WITH d AS (SELECT DISTINCT reporter AS member, hour // 24 AS day FROM reports) SELECT day, member, 1000 // count(*) OVER (PARTITION BY day) + CASE WHEN row_number() OVER (PARTITION BY day ORDER BY member) <= 1000 % count(*) OVER (PARTITION BY day) THEN 1 ELSE 0 END AS share FROM d""")(
    lambda r: S.pool_split(r.select(F.col("reporter").alias("member"), F.floor(F.col("hour") / 24).alias("day")).distinct(), 1000)
)
R("quorum_tally", "answers", sql="SELECT question, value, count(DISTINCT node) AS votes, any_value(answered) AS answered, 2 * count(DISTINCT node) > any_value(answered) AS agreed FROM answers JOIN (SELECT question, count(DISTINCT node) AS answered FROM answers GROUP BY question) USING (question) GROUP BY question, value")(S.quorum_tally)
_PAIRS = "pr AS (SELECT max(uid) FILTER (n = 2) AS audit, max(uid) FILTER (n = 1) AS original FROM (SELECT ip, uid, row_number() OVER (PARTITION BY ip ORDER BY t, uid) AS n FROM scans) GROUP BY ip HAVING max(n) >= 2)"
_AUDIT = f"""WITH {_PAIRS}, op AS (SELECT DISTINCT scan_uid, port FROM ports WHERE state = 'open'), nn AS (SELECT scan_uid, count(*) AS n FROM op GROUP BY 1), ik AS (SELECT DISTINCT h.scan_uid, h.port, kind, fingerprint FROM host_keys h JOIN op ON op.scan_uid = h.scan_uid AND op.port = h.port),
  cm AS (SELECT audit, original, count(*) AS c FROM pr JOIN op x ON x.scan_uid = audit JOIN op y ON y.scan_uid = original AND y.port = x.port GROUP BY 1, 2), sk AS (SELECT DISTINCT audit, original FROM pr JOIN ik x ON x.scan_uid = audit JOIN ik y ON y.scan_uid = original AND y.port = x.port AND y.kind = x.kind AND y.fingerprint = x.fingerprint),
  al AS (SELECT pr.*, coalesce(a.n, 0) AS a, coalesce(o.n, 0) AS o, coalesce(c, 0) AS c, sk.audit IS NOT NULL AS s FROM pr LEFT JOIN nn a ON a.scan_uid = audit LEFT JOIN nn o ON o.scan_uid = original LEFT JOIN cm USING (audit, original) LEFT JOIN sk USING (audit, original)),
  v AS (SELECT audit, original, CASE WHEN a = 0 THEN 'inconclusive' WHEN s AND o <= 2 * a OR 2 * c >= a AND 2 * c >= o THEN 'agrees' ELSE 'differs' END AS verdict FROM al) """


def audits(scans):
    """Each source's second scan checks its first."""
    first = scans.withColumn("n", F.row_number().over(Window.partitionBy("ip").orderBy("t", "uid"))).where("n <= 2")
    return first.groupBy("ip").agg(F.max(F.when(F.col("n") == 2, F.col("uid"))).alias("audit"), F.max(F.when(F.col("n") == 1, F.col("uid"))).alias("original")).where("audit IS NOT NULL").select("audit", "original")


R("audit_compare", "scans", "ports", "host_keys", sql=_AUDIT + "SELECT * FROM v")(lambda s, p, k: S.audit_compare(audits(s), p, k))
R("audit_counts", "scans", "ports", "host_keys", sql=_AUDIT + """SELECT o.origin AS scanner, count(*) AS conclusive, count(*) FILTER (verdict = 'differs') AS differing, count(*) >= 5 AND 2 * count(*) FILTER (verdict = 'differs') >= count(*) AS fails
  FROM v JOIN scans a ON a.uid = audit JOIN scans o ON o.uid = original WHERE a.origin <> o.origin AND verdict <> 'inconclusive' GROUP BY 1""")(lambda s, p, k: S.audit_counts(S.audit_compare(audits(s), p, k), s))
R("volume", "requests", sql="SELECT CAST(sum(unrecorded + 1) AS BIGINT) AS weighted, count(*) AS rows FROM requests")(S.volume)
R("node_contributions", "requests", "uploads", "scans", "intel_log", sql="""SELECT origin, coalesce(a, 0) AS requests, coalesce(b, 0) AS skipped, coalesce(c, 0) AS fingerprints, coalesce(d, 0) AS claims, coalesce(e, 0) AS scans, coalesce(f, 0) AS looked_up FROM (SELECT origin, count(*) AS a FROM requests GROUP BY 1)
  FULL JOIN (SELECT origin, CAST(sum(n + h % 4) AS BIGINT) AS b FROM (SELECT origin, ip, t // 3600 AS h, count(*) AS n FROM requests GROUP BY 1, 2, 3) GROUP BY 1) USING (origin) FULL JOIN (SELECT origin, count(DISTINCT ja4) AS c FROM requests GROUP BY 1) USING (origin)
  FULL JOIN (SELECT origin, count(*) AS d FROM uploads GROUP BY 1) USING (origin) FULL JOIN (SELECT origin, count(*) AS e FROM scans GROUP BY 1) USING (origin) FULL JOIN (SELECT origin, count(DISTINCT ip) AS f FROM intel_log GROUP BY 1) USING (origin)""")(
    lambda r, u, s, i: S.node_contributions(r, r.groupBy("origin", "ip", F.floor(F.col("t") / 3600).alias("h")).agg(F.collect_list("id").alias("rows")).withColumn("dropped", F.col("h") % 4), r.select("origin", "ja4").distinct(), u, s, i)
)
R("provider_volume", "intel_log", sql="SELECT provider, count(*) AS lookups FROM intel_log GROUP BY provider")(S.provider_volume)
R("spot_check", "intel_log", sql="""WITH r AS (SELECT * FROM intel_log WHERE CAST('0x' || substr(sha256(concat('salt', ip)), 1, 4) AS INT) % 10 = 0) SELECT origin, count(*) AS checked, count(*) FILTER (data <> newest) AS disputed FROM r JOIN (SELECT ip, arg_max(data, hlc) AS newest FROM r GROUP BY ip) USING (ip) GROUP BY origin""")(S.spot_check)
R("host_key_sharing", "host_keys", sql="WITH o AS (SELECT DISTINCT ip, kind, fingerprint FROM host_keys) SELECT *, count(*) OVER (PARTITION BY kind, fingerprint) - 1 AS others FROM o")(S.host_key_sharing)
R("names_due", "names", sql="SELECT name, max(last_seen) AS last_seen FROM names GROUP BY name HAVING max(last_seen) < 1100000000 - 30 * 86400")(lambda n: S.names_due(n, 1_100_000_000, 30))
R("addresses_of_name", "names", sql="SELECT name, ip, 2 * votes > answered AS agreed, last_seen FROM names QUALIFY row_number() OVER (PARTITION BY name ORDER BY 2 * votes > answered DESC, last_seen DESC, ip) <= 20")(lambda n: S.addresses_of_name(n, 20))
_REUSE = "SELECT c.request_id AS served_id, c.kind, min(t.t - c.t) AS delta FROM canaries c JOIN tokens t ON t.value_hash = c.value_hash AND t.t > c.t GROUP BY 1, 2"
R("canary_summary", "canaries", "tokens", sql=f"""WITH f AS ({_REUSE}), u AS (SELECT kind, count(*) AS reused, list_sort(list(delta))[count(*) // 2 + 1] AS median_s, max(delta) AS max_s FROM f GROUP BY kind)
  SELECT kind, s.n AS served, coalesce(reused, 0) AS reused, CAST(round(100.0 * coalesce(reused, 0) / s.n) AS BIGINT) AS percent, median_s, max_s FROM (SELECT kind, count(*) AS n FROM canaries GROUP BY kind) s LEFT JOIN u USING (kind)""")(
    lambda c, t: S.canary_summary(J.first_reuse(c, t), c)
)
