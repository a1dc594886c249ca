"""Web-sensor tables derived from the driver's tables, as one SQL text for Spark and DuckDB.

The driver has no web-sensor tables; each role is played by a view on what it
has. Times are epoch seconds (``t``), as timestamps of the driver's tables have
no zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Just after the last event, and a day in seconds.
NOW, DAY = 1_706_659_200, 86_400

VIEWS = {
    "requests": """SELECT event_id AS id, user_id AS ip, {epoch:ts} AS t, event_type AS label,
        CAST(least(4, floor(value / 100)) AS INT) AS severity, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
        concat('/p/', regexp_extract(props, '[0-9]+', 0), CASE WHEN event_id % 7 = 0 THEN '/index.php' ELSE '' END) AS path,
        concat('n', event_id % 3) AS origin, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('agent', event_id % 13) END AS user_agent,
        concat('ja', event_id % 17) AS ja4, concat('jh', event_id % 19) AS ja4h, concat('persona', user_id % 3) AS persona,
        CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status, CAST(event_id % 5 AS BIGINT) AS unrecorded, value FROM events""",
    "sources": """SELECT c_custkey AS ip, n_name AS country, c_nationkey AS asn, concat('org', c_nationkey) AS asn_org, n_regionkey AS network,
        c_custkey % 10 = 0 AS is_exit, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS INT) END AS abuse_score FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "scans": """SELECT o_orderkey AS uid, o_custkey AS ip, CAST(substr(o_orderpriority, 1, 1) AS INT) AS level, o_orderstatus AS status, {epoch:o_orderdate} AS t,
        concat('os', o_orderkey % 6) AS os_guess, concat('n', o_orderkey % 3) AS origin FROM orders""",
    "ports": """SELECT l_orderkey AS scan_uid, CAST(l_partkey % 200 AS INT) AS port, 'tcp' AS proto, CASE WHEN l_returnflag = 'A' THEN 'closed' ELSE 'open' END AS state,
        concat('svc', l_suppkey % 7) AS service, concat('prod', l_suppkey % 5) AS product, concat('v', l_linenumber) AS version FROM lineitem""",
    "host_keys": """SELECT l_orderkey AS scan_uid, o_custkey AS ip, CAST(l_partkey % 200 AS INT) AS port, CASE WHEN l_linenumber % 2 = 0 THEN 'ssh' ELSE 'tls' END AS kind,
        concat('fp', l_partkey % 500) AS fingerprint FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "intel_log": """SELECT user_id AS ip, concat('p', event_id % 4) AS provider, concat('n', event_id % 3) AS origin, event_id AS hlc, {epoch:ts} AS t,
        concat('c', CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10) AS data FROM events WHERE event_type = 'signup'""",
    "jobs": """SELECT o_orderkey AS uid, o_custkey AS ip, CAST(substr(o_orderpriority, 1, 1) AS INT) AS level,
        CASE WHEN o_orderkey % 6 = 0 THEN 'queued' WHEN o_orderkey % 6 = 1 THEN 'running' WHEN o_orderkey % 6 = 2 THEN 'failed' ELSE 'done' END AS status,
        {epoch:o_orderdate} AS queued, {epoch:o_orderdate} + o_orderkey % 600 AS started, {epoch:o_orderdate} + o_orderkey % 600 + 30 + o_orderkey % 1700 AS finished,
        concat('s', o_orderkey % 5) AS scanner, CASE WHEN o_orderkey % 12 = 2 THEN 'timeout' WHEN o_orderkey % 24 = 8 THEN 'invalid target' END AS error FROM orders""",
    "sightings": """SELECT concat(regexp_extract(props, '[0-9]+', 0), '@', CAST(floor({epoch:ts} / 600) AS BIGINT)) AS value, CASE WHEN event_id % 3 = 0 THEN 'key' ELSE 'tag' END AS kind,
        user_id AS ip, {epoch:ts} AS t, event_id AS source_uid FROM events""",
    "canaries": """SELECT event_id AS request_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS value_hash, concat('c', event_id % 3) AS kind, user_id AS ip, {epoch:ts} AS t FROM events WHERE event_type = 'signup'""",
    "tokens": """SELECT event_id AS request_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS value_hash, CASE WHEN event_id % 2 = 0 THEN 'body' ELSE 'path' END AS place, user_id AS ip, {epoch:ts} AS t FROM events WHERE event_type = 'error'""",
    "uploads": """SELECT event_id AS uid, event_id AS request_id, user_id AS ip, concat('n', event_id % 3) AS origin, {epoch:ts} AS t, concat(regexp_extract(props, '[0-9]+', 0)) AS filename,
        concat('/p/', regexp_extract(props, '[0-9]+', 0)) AS answered_path, event_id % 2 = 0 AS path_is_prefix, CAST(floor(value) AS BIGINT) AS size, concat('t', event_id % 4) AS sniffed_type FROM events WHERE event_type = 'purchase'""",
    "answers": """SELECT l_orderkey AS question, l_suppkey AS node, l_returnflag AS value FROM lineitem""",
    "prices": """SELECT CAST(floor({epoch:o_orderdate} / 86400) AS BIGINT) AS hour, o_orderpriority AS good, concat('n', o_custkey % 7) AS node, CAST(round(o_totalprice * 1000) AS BIGINT) AS price_mc FROM orders""",
    "reports": """SELECT CAST(user_id % 12 AS BIGINT) AS reporter, CAST(floor({epoch:ts} / 3600) AS BIGINT) AS hour, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 12 AS member FROM events""",
    "names": """SELECT l_suppkey AS ip, concat('name', l_partkey % 40) AS name, max({epoch:l_shipdate}) AS last_seen, CAST(count(*) AS BIGINT) AS votes, CAST(count(*) + max(l_linenumber) AS BIGINT) AS answered FROM lineitem GROUP BY l_suppkey, concat('name', l_partkey % 40)""",
    "members": """SELECT c_custkey AS ip, c_custkey % 37 AS campaign FROM customer WHERE c_custkey % 3 = 0""",
    "changes": """SELECT user_id AS ip, event_type AS kind, event_id AS version, concat('n', event_id % 3) AS origin, value, event_id AS uid FROM events""",
}
NEEDS = {
    "requests": ["events"], "sources": ["customer", "nation"], "scans": ["orders"], "ports": ["lineitem"], "host_keys": ["lineitem", "orders"], "intel_log": ["events"], "jobs": ["orders"], "sightings": ["events"],
    "canaries": ["events"], "tokens": ["events"], "uploads": ["events"], "answers": ["lineitem"], "prices": ["orders"], "reports": ["events"], "names": ["lineitem"], "changes": ["events"], "members": ["customer"],
}


def _text(name: str, spark: bool) -> str:
    import re

    return re.sub(r"\{epoch:(\w+)\}", r"unix_timestamp(CAST(\1 AS TIMESTAMP))" if spark else r"CAST(floor(epoch(\1)) AS BIGINT)", VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One role as a DataFrame."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NEEDS[name]}
    text = _text(name, True)
    for t in NEEDS[name]:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **tables)


def with_views(sql: str) -> str:
    """DuckDB SQL with the roles that it names defined in front."""
    import re

    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = ", ".join(f"{n} AS ({_text(n, False)})" for n in used)
    sql = sql.strip()
    if not used:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {heads}, {sql[5:]}"
    return f"WITH {heads} {sql}"
