"""Aggregations: traffic statistics, ranked lists, job and market figures.

All take DataFrames and column names as documented in README; ``now`` is always
a parameter; distinct counts are exact; every ranking has a full tie-break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.columns import FAMILIES, label_families, label_family

HOUR, DAY = 3600, 86_400
#: Rows of a table that one task gets, about, where tables are dealt by count.
TASK_ROWS = 500_000
#: Labels that stand for an agent in the stand-in tables.
AGENT_LABELS = ("signup", "purchase")


def count_() -> Column:
    return F.count(F.lit(1))


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row, which is broadcast."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def source_rollup(requests: DataFrame) -> DataFrame:
    return requests.groupBy("ip").agg(count_().alias("requests"), F.max("severity").alias("max_severity"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


def label_rollup(requests: DataFrame, labels: str = "labels") -> DataFrame:
    """Each request counts once per distinct label."""
    return requests.select("ip", F.explode(F.array_distinct(labels)).alias("label")).groupBy("ip", "label").agg(count_().alias("requests"))


def headline_counts(requests: DataFrame, sources: DataFrame) -> DataFrame:
    seen = requests.groupBy("ip").agg(count_().alias("n"))  # one row per source before the join
    joined = seen.join(sources.select("ip", "country", "is_exit"), "ip", "left")
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), count_().alias("sources"), F.countDistinct("country").alias("countries"), F.count_if("is_exit").alias("exits"))


def severity_distribution(requests: DataFrame) -> DataFrame:
    return requests.groupBy("severity").agg(count_().alias("requests"))


def timeline(requests: DataFrame, step: int = HOUR) -> DataFrame:
    """Buckets by their start, split by severity 0 to 4."""
    bucket = (F.col("t") - F.pmod("t", F.lit(step))).alias("bucket")
    return requests.groupBy(bucket).agg(*[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in range(5)])


def heatmap(requests: DataFrame, now: int) -> DataFrame:
    """Weekday (Monday 0) and hour over the last seven days; 1970-01-01 was a Thursday."""
    recent = requests.where((F.col("t") >= now - 7 * DAY) & (F.col("t") < now))
    weekday, hour = F.pmod(F.floor(F.col("t") / DAY) + 3, F.lit(7)), F.floor(F.pmod("t", F.lit(DAY)) / HOUR)
    return recent.groupBy(weekday.cast("int").alias("weekday"), hour.cast("int").alias("hour")).agg(count_().alias("requests"))


def previous_window(requests: DataFrame, seconds: int, now: int) -> DataFrame:
    before = requests.where((F.col("t") >= now - 2 * seconds) & (F.col("t") < now - seconds))
    return before.agg(count_().alias("requests"), F.countDistinct("ip").alias("sources"))


def families(requests: DataFrame, labels: str = "labels") -> DataFrame:
    """Requests per label family, each once; grouped by the stored list before it is unpacked."""
    lists = requests.groupBy(labels).agg(count_().alias("n"))
    return lists.select(F.explode(label_families(F.col(labels))).alias("family"), "n").groupBy("family").agg(F.sum("n").alias("requests"))


def owasp(requests: DataFrame, tags: str = "owasp") -> DataFrame:
    """Requests per tag, each once; grouped by the stored list before it is unpacked."""
    lists = requests.groupBy(tags).agg(count_().alias("n"))
    return lists.select(F.explode(F.array_distinct(tags)).alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("requests"))


def countries_map(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct sources per country, and the largest such count."""
    by = requests.select("ip").distinct().join(sources.select("ip", "country"), "ip").groupBy("country").agg(count_().alias("sources"))
    return beside(by, by.agg(F.max("sources").alias("most")))


def asn_top(requests: DataFrame, sources: DataFrame, k: int = 15) -> DataFrame:
    name = F.coalesce(F.max("asn_org"), F.concat(F.lit("AS"), F.max("asn")), F.lit("unknown"))
    by = requests.select("ip").distinct().join(sources, "ip").groupBy("asn").agg(count_().alias("sources"), name.alias("org"))
    return by.orderBy(F.desc("sources"), "asn").limit(k)


def open_ports(scans: DataFrame, ports: DataFrame, least: int = 3) -> DataFrame:
    opened = ports.where("state = 'open'").join(scans.select(F.col("uid").alias("scan_uid"), "ip"), "scan_uid")
    return opened.groupBy("port", "proto").agg(F.countDistinct("ip").alias("sources")).where(F.col("sources") >= least)


def parts_for(df: DataFrame) -> int:
    """So many tasks that each gets about TASK_ROWS of the rows at most, however well they compress."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def products(scans: DataFrame, ports: DataFrame) -> DataFrame:
    n = parts_for(ports)
    named = ports.select("scan_uid", F.concat_ws(" ", "product", "version").alias("product")).repartition(n, "scan_uid")
    named = named.join(scans.select(F.col("uid").alias("scan_uid"), "ip").repartition(n, "scan_uid"), "scan_uid")
    # all rows of a scan are in one task already, so that only (product, source) is dealt anew
    scanned = named.select("product", "scan_uid").distinct().groupBy("product").agg(count_().alias("scans"))
    sources = named.select("product", "ip").distinct().repartition(n, "ip", "product").distinct().groupBy("product").agg(F.count("ip").alias("sources"))
    return scanned.join(sources, "product")


def os_guesses(scans: DataFrame) -> DataFrame:
    return scans.groupBy("os_guess").agg(count_().alias("scans"), F.countDistinct("ip").alias("sources"))


def ranked_values(requests: DataFrame, value: str, k: int = 15) -> DataFrame:
    by = requests.groupBy(F.col(value).alias("value")).agg(count_().alias("requests"), F.countDistinct("ip").alias("sources"))
    return by.where("value IS NOT NULL").orderBy(F.desc("requests"), "value").limit(k)


def value_shares(requests: DataFrame, value: str) -> DataFrame:
    return requests.groupBy(F.coalesce(F.col(value), F.lit("unknown")).alias("value")).agg(count_().alias("requests"))


def host_key_top(host_keys: DataFrame, scans: DataFrame, kind: str) -> DataFrame:
    own = host_keys.where(F.col("kind") == kind).join(scans.select(F.col("uid").alias("scan_uid")), "scan_uid", "left_semi")
    return own.groupBy("fingerprint").agg(F.countDistinct("ip").alias("sources"))


def abuse_bands(sources: DataFrame) -> DataFrame:
    s = F.col("abuse_score")
    band = F.when(s.isNull(), 0).when(s == 0, 1).when(s < 25, 2).when(s < 50, 3).when(s < 75, 4).when(s < 100, 5).otherwise(6)
    names = F.array(*map(F.lit, ["not looked up", "0", "1-24", "25-49", "50-74", "75-99", "100"]))
    return sources.groupBy(band.alias("position")).agg(count_().alias("sources")).withColumn("band", F.get(names, F.col("position")))


def job_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(count_().alias("jobs"))


def scan_levels(scans: DataFrame) -> DataFrame:
    return scans.groupBy("level").agg(count_().alias("scans"))


def first_contact_followed(requests: DataFrame) -> DataFrame:
    """Per persona and source: whether any later request of it came within 24 hours of the first.

    The first and last time of each of the source's days tell it, and these are combined before any shuffle.
    """
    days = requests.groupBy("persona", "ip", F.floor(F.col("t") / DAY).alias("_day")).agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    marked = days.withColumn("_first", F.min("_low").over(Window.partitionBy("persona", "ip")))
    within = lambda c: (F.col(c) > F.col("_first")) & (F.col(c) <= F.col("_first") + DAY)
    return marked.groupBy("persona", "ip").agg(F.bool_or(within("_low") | within("_high")).alias("followed"))


def family_mix(requests: DataFrame, keys: list[str], labels: str = "labels") -> DataFrame:
    """(keys, families): requests by family of their labels, ``family:n`` in the families' order, joined by commas. A request counts once for each of its families."""
    by = requests.select(*keys, F.explode(label_families(F.col(labels))).alias("family")).groupBy(*keys, "family").agg(count_().alias("n"))
    place = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("o"), "family", "n")))
    return by.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["family"], F.lit(":"), x["n"])), ",").alias("families"))


def persona_stats(requests: DataFrame, labels: str | None = None) -> DataFrame:
    """Per persona: requests, sources, first contacts that were followed, and with ``labels`` (an array column) the mix of families."""
    by = requests.groupBy("persona").agg(count_().alias("requests"), F.countDistinct("ip").alias("sources"))
    followed = first_contact_followed(requests).groupBy("persona").agg(F.count_if("followed").alias("followed"))
    both = by.join(followed, "persona")
    return both if labels is None else both.join(family_mix(requests, ["persona"], labels), "persona", "left")


def agent_share(requests: DataFrame, members: DataFrame, step: int = DAY) -> DataFrame:
    """Per bucket and in total (bucket null): sources and campaigns, and those with an agent label."""
    agent = F.col("label").isin(*AGENT_LABELS)
    rows = requests.select((F.col("t") - F.pmod("t", F.lit(step))).alias("bucket"), "ip", agent.alias("agent")).join(members.select("ip", "campaign"), "ip", "left")
    return rows.rollup("bucket").agg(
        F.countDistinct("ip").alias("sources"), F.countDistinct(F.when(F.col("agent"), F.col("ip"))).alias("agent_sources"),
        F.countDistinct("campaign").alias("campaigns"), F.countDistinct(F.when(F.col("agent"), F.col("campaign"))).alias("agent_campaigns"),
    )


def campaign_tile(members: DataFrame, sources: DataFrame, least: int = 3, requests: DataFrame | None = None, labels: str = "labels") -> DataFrame:
    """Campaigns, members, largest, networks and countries; with ``requests`` only members among their sources count, and the mix of their families is told; null where fewer than ``least`` campaigns."""
    active = members if requests is None else members.join(requests.select("ip").distinct(), "ip", "left_semi")
    size = active.groupBy("campaign").agg(count_().alias("size")).agg(count_().alias("campaigns"), F.sum("size").alias("members"), F.max("size").alias("largest"))
    spread = active.join(sources, "ip").agg(F.countDistinct("asn").alias("asns"), F.countDistinct("country").alias("countries"))
    both = beside(size, spread)
    if requests is not None:
        mix = family_mix(requests.join(members.select("ip").distinct(), "ip", "left_semi").withColumn("_all", F.lit(1)), ["_all"], labels)
        both = both.withColumn("_all", F.lit(1)).join(F.broadcast(mix), "_all", "left").drop("_all")  # one row
    return both.select(*[F.when(F.col("campaigns") >= least, F.col(c)).alias(c) for c in both.columns])


def agent_sources(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("label").isin(*AGENT_LABELS)).agg(F.countDistinct("ip").alias("sources"))


def upper_median(c: str) -> Column:
    """v[n / 2] of the ascending values: the lower median of the descending ones, from map-side combined counts."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


def canary_summary(reuse: DataFrame, canaries: DataFrame) -> DataFrame:
    """Per kind: served, reused, rounded percent, median (upper) and largest seconds to first reuse."""
    first = reuse.groupBy("served_id", "kind").agg(F.min("delta").alias("delta"))
    used = first.groupBy("kind").agg(count_().alias("reused"), upper_median("delta").alias("median_s"), F.max("delta").alias("max_s"))
    served = canaries.groupBy("kind").agg(count_().alias("served"))
    return served.join(used, "kind", "left").select("kind", "served", F.coalesce("reused", F.lit(0)).alias("reused"), F.round(100 * F.coalesce("reused", F.lit(0)) / F.col("served")).cast("long").alias("percent"), "median_s", "max_s")


def session_requests(canaries: DataFrame, tokens: DataFrame, session_kind: str) -> tuple[DataFrame, DataFrame]:
    """(session, request_id) of the requests that a session value was served by, and of those that carried it back."""
    started = canaries.where((F.col("kind") == session_kind) & F.col("request_id").isNotNull()).select(F.col("value_hash").alias("session"), "request_id").distinct()
    carried = tokens.select(F.col("value_hash").alias("session"), "request_id").distinct().join(started.select("session").distinct(), "session", "left_semi")
    return started, carried


def decoy_sessions(requests: DataFrame, canaries: DataFrame, tokens: DataFrame, session_kind: str) -> DataFrame:
    """Per session value: sources, first, last, steps and tools of the requests that started or carried it."""
    started, carried = session_requests(canaries, tokens, session_kind)
    rows = started.unionByName(carried).distinct().join(requests.select(F.col("id").alias("request_id"), "ip", "t", "tool"), "request_id")
    return rows.groupBy("session").agg(F.countDistinct("ip").alias("sources"), F.min("t").alias("first"), F.max("t").alias("last"), count_().alias("steps"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))


def mcp_funnel(requests: DataFrame, canaries: DataFrame, tokens: DataFrame, session_kind: str, listed: str, called: str) -> DataFrame:
    """Sessions served; of these carried into a listing, into a call, and with a value served in a carrying request that another request used."""
    started, carried = session_requests(canaries, tokens, session_kind)
    answers = carried.join(requests.select(F.col("id").alias("request_id"), "answer"), "request_id").groupBy("session").agg(F.bool_or(F.col("answer") == listed).alias("listed"), F.bool_or(F.col("answer") == called).alias("called"))
    users = tokens.groupBy("value_hash").agg(F.min("request_id").alias("low"), F.max("request_id").alias("high"))  # another request used it if one of the two is another
    spent = canaries.where(F.col("kind") != session_kind).select("request_id", "value_hash").distinct().join(users, "value_hash").where("low <> request_id OR high <> request_id").select("request_id").distinct()
    reused = carried.join(spent, "request_id", "left_semi").select("session").distinct().withColumn("reused", F.lit(True))
    flags = started.select("session").distinct().join(answers, "session", "left").join(reused, "session", "left")
    return flags.agg(count_().alias("sessions"), F.count_if("listed").alias("listed"), F.count_if("called").alias("called"), F.count_if("reused").alias("reused"))


def field(json: Column, path: str) -> Column:
    """A field of a JSON text as text; null if the text is no JSON or has no such field."""
    return F.try_variant_get(F.try_parse_json(json), path, "string")


#: Answers of a model's interface: those that list models, and those that are calls (fixed values).
LISTINGS, CALLS = ("tags", "models"), ("chat", "generate", "chat-completions", "completions", "responses", "messages", "complete")
MODEL_ANSWER = "decoy:llm:"


def llm_usage(requests: DataFrame, listed: DataFrame, top: int = 100) -> DataFrame:
    """(section, name, api, requests, sources): use of the model interface from raw call bodies (``decoy_in``, JSON text, bad ones tolerated).

    Sections: ``api`` by the interface, ``calls``, ``listings`` and ``pulls`` by the
    answer, ``listed`` and ``unlisted`` calls by whether the node that served
    (ident, persona) lists the model (``listed``: ident, persona, model), and
    ``model`` with the ``top`` models by requests. A listing that names a model is
    none. Counted per answer, model and node first, so the join meets few rows.
    """
    asked = requests.where(F.col("decoy_in").isNotNull() & F.col("answer").startswith(MODEL_ANSWER))
    rows = asked.select("ip", F.substring("answer", len(MODEL_ANSWER) + 1, 1 << 20).alias("answer"), *[field(F.col("decoy_in"), f"$.{k}").alias(n) for k, n in (("api", "api"), ("model", "model"), ("i", "ident"), ("p", "persona"))])
    counts = (count_().alias("requests"), F.countDistinct("ip").alias("sources"))
    out = lambda df, section, name=None, api=None: df.select(section.alias("section"), *[F.coalesce(c, F.lit(None).cast("string")).alias(n) for c, n in ((name, "name"), (api, "api"))], "requests", "sources")
    by_api = rows.groupBy(F.coalesce("api", F.lit("unknown")).alias("name")).agg(*counts)
    kind = F.when(F.col("answer").isin(*LISTINGS) & F.col("model").isNull(), "listings").when(F.col("answer").isin(*CALLS), "calls").when(F.col("answer") == "pull", "pulls")
    by_kind = rows.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("kind").agg(*counts)
    called = rows.where(F.col("answer").isin(*CALLS)).groupBy("ident", "persona", "model", "ip").agg(count_().alias("n"))
    known = listed.select("ident", "persona", "model").distinct().withColumn("known", F.lit(True))
    same = [called[c].eqNullSafe(known[c]) if c != "model" else called[c] == known[c] for c in ("ident", "persona", "model")]
    told = called.join(known, same, "left").select("n", "ip", F.when(F.col("known"), "listed").otherwise("unlisted").alias("kind"))
    by_list = told.groupBy("kind").agg(F.sum("n").alias("requests"), F.countDistinct("ip").alias("sources"))
    models = rows.where("model IS NOT NULL").groupBy("model", F.coalesce("api", F.lit("")).alias("api")).agg(*counts).orderBy(F.desc("requests"), "model", "api").limit(top)
    none = F.lit(None).cast("string")
    parts = [out(by_api, F.lit("api"), F.col("name"), none), out(by_kind, F.col("kind"), none, none), out(by_list, F.col("kind"), none, none), out(models, F.lit("model"), F.col("model"), F.col("api"))]
    return reduce(DataFrame.unionByName, parts)


def decoy_tiles(requests: DataFrame, least: int = 5) -> DataFrame:
    return requests.groupBy("status", "method").agg(count_().alias("requests")).where(F.col("requests") >= least)


def joined_top(counts: DataFrame, keys: list[str], value: str, n: str, k: int, out: str) -> DataFrame:
    """(keys, out): the k values with the largest ``n``, joined by commas; ties by value."""
    top = keep_top(counts, keys, [F.desc(n), F.col(value)], k).groupBy(*keys)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("o"), F.col(value).alias("v")))), lambda x: x["v"].cast("string")), ",").alias(out))


def network_rollup(requests: DataFrame, sources: DataFrame, key: str, k: int = 8, open_ports: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Per network: sources, requests, severity, span and its top labels; with ``open_ports`` (ip, port) its top ports by sources, with ``members`` (ip, campaign) how many campaigns its sources are in."""
    rows = requests.join(sources.select("ip", key), "ip")
    base = rows.groupBy(key).agg(F.countDistinct("ip").alias("sources"), count_().alias("requests"), F.max("severity").alias("max_severity"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))
    out = base.join(joined_top(rows.groupBy(key, "label").agg(count_().alias("n")), [key], "label", "n", k, "top_labels"), key)
    if open_ports is not None:
        by = open_ports.join(sources.select("ip", key), "ip").groupBy(key, "port").agg(F.countDistinct("ip").alias("n"))
        out = out.join(joined_top(by, [key], "port", "n", k, "top_ports"), key, "left")
    if members is not None:
        out = out.join(members.join(sources.select("ip", key), "ip").groupBy(key).agg(F.countDistinct("campaign").alias("campaigns")), key, "left").na.fill(0, ["campaigns"])
    return out


def keep_top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


#: Fields of a registry's answer that are told of a network (fixed values).
REGISTRY_FIELDS = ("org", "range", "abuse")


def network_facts(sources: DataFrame, intel: DataFrame, key: str, provider: str, k: int = 8) -> DataFrame:
    """(key, field, value, sources): per network the k commonest countries of its sources, and organisations, ranges and abuse contacts of the registry's answers (``data``, JSON text).

    Answers come from other nodes: what is no JSON, and a field that is not text,
    is passed over; text is trimmed, empty text is none. A source counts once a value.
    """
    at = lambda f: F.try_variant_get("_v", f"$.{f}", "variant")
    text = lambda f: F.when(F.schema_of_variant(at(f)) == "STRING", F.trim(F.try_variant_get("_v", f"$.{f}", "string")))
    known = intel.where(F.col("provider") == provider).select("ip", F.try_parse_json("data").alias("_v")).where("_v IS NOT NULL")
    each = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in REGISTRY_FIELDS])
    told = known.select("ip", F.inline(each)).where("value <> ''").join(sources.select("ip", key), "ip")
    places = sources.select("ip", key, F.lit("country").alias("field"), F.col("country").alias("value")).where("value <> ''")
    by = told.unionByName(places).groupBy(key, "field", "value").agg(F.countDistinct("ip").alias("sources"))
    return keep_top(by, [key, "field"], [F.desc("sources"), F.col("value")], k)


def links_list(sightings: DataFrame, shared_only: bool = True) -> DataFrame:
    by = sightings.groupBy("kind", "value").agg(F.countDistinct("ip").alias("sources"), count_().alias("sightings"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))
    return by.where("sources > 1") if shared_only else by


def link_item(sightings: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """Values of a kind by source, with its country."""
    by = sightings.where(F.col("kind") == kind).groupBy("value", "ip").agg(count_().alias("sightings"), F.max("t").alias("last_seen"))
    return by.join(sources.select("ip", "country"), "ip", "left")


def campaign_index(members: DataFrame, sources: DataFrame, requests: DataFrame) -> DataFrame:
    agent = requests.groupBy("ip").agg(F.bool_or(F.col("label").isin(*AGENT_LABELS)).alias("agent"))
    rows = members.join(sources, "ip", "left").join(agent, "ip", "left")
    return rows.groupBy("campaign").agg(count_().alias("size"), F.countDistinct("country").alias("countries"), F.countDistinct("asn").alias("asns"), F.coalesce(F.bool_or("agent"), F.lit(False)).alias("agent"))


def campaign_calendar(members: DataFrame, requests: DataFrame, now: int, days: int = 182) -> DataFrame:
    recent = requests.where(F.col("t") >= now - days * DAY).join(members.select("ip", "campaign"), "ip")
    return recent.groupBy("campaign", F.floor(F.col("t") / DAY).alias("day")).agg(count_().alias("requests"))


def campaign_shapes(members: DataFrame, requests: DataFrame, k: int = 10) -> DataFrame:
    by = requests.join(members.select("ip", "campaign"), "ip").groupBy("campaign", "path").agg(F.countDistinct("ip").alias("members"))
    return keep_top(by, ["campaign"], [F.desc("members"), F.col("path")], k)


def campaign_commands(members: DataFrame, requests: DataFrame, k: int = 20) -> DataFrame:
    """Per campaign its members' commands, most run first: runs, sources and the last time."""
    by = requests.where("cmd IS NOT NULL").join(members.select("ip", "campaign"), "ip").groupBy("campaign", "cmd").agg(count_().alias("runs"), F.countDistinct("ip").alias("sources"), F.max("t").alias("last_seen"))
    return keep_top(by, ["campaign"], [F.desc("runs"), F.desc("last_seen"), F.col("cmd")], k)


def campaign_uploads(members: DataFrame, uploads: DataFrame, k: int = 20) -> DataFrame:
    """Per campaign its members' newest uploads."""
    rows = uploads.join(members.select("ip", "campaign"), "ip")
    return keep_top(rows, ["campaign"], [F.desc("t"), F.desc("uid")], k).select("campaign", "uid", "ip", "t", "filename", "size")


def agent_campaigns(members: DataFrame, requests: DataFrame) -> DataFrame:
    return members.join(requests.where(F.col("label").isin(*AGENT_LABELS)).select("ip"), "ip", "left_semi").select("campaign").distinct()


def dense(counts: DataFrame, keys: list[str], bucket: str, values: list[str], size: int) -> DataFrame:
    """(keys, values): sparse rows by bucket as arrays of ``size`` numbers, 0 where there is no row. Buckets are few, so an array is small."""
    made = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(bucket).cast("int"), F.struct(*values)))).alias("_m"))
    each = lambda v: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i)[v], F.lit(0)))
    return made.select(*keys, *[each(v).alias(v) for v in values])


#: Hours and days of a source's series, severities, and labels that are given.
WEEK_HOURS, CALENDAR_DAYS, SEVERITIES, TOP_LABELS = 168, 182, 5, 20


def source_overview(requests: DataFrame, now: int, labels: str = "labels", k: int = TOP_LABELS) -> DataFrame:
    """Per source: requests by hour of the last week and by severity in it, by day of the last half year with the highest severity, families and top labels.

    ``hours`` has the oldest hour first and the running one last, ``by_severity``
    five numbers an hour, ``days`` ends with today; ``day_severity`` is one more than
    the highest of a day, 0 for a day without requests. ``labels`` names an array
    column; a label counts once a request. Sums come before arrays, which are of
    fixed length; all sources are made at once.
    """
    t, hour, today = F.col("t"), now // HOUR, now // DAY
    severity = F.least(F.greatest(F.coalesce("severity", F.lit(0)), F.lit(0)), F.lit(SEVERITIES - 1))
    age = WEEK_HOURS - 1 - (F.lit(hour) - F.floor(t / HOUR))
    week = requests.where(F.floor(t / HOUR).between(hour - WEEK_HOURS + 1, hour)).groupBy("ip", (age * SEVERITIES + severity).alias("b")).agg(count_().alias("by_severity"))
    fine = dense(week, ["ip"], "b", ["by_severity"], WEEK_HOURS * SEVERITIES)
    total = lambda i: F.aggregate(F.slice("by_severity", i * SEVERITIES + 1, SEVERITIES), F.lit(0).cast("long"), lambda a, b: a + b)
    fine = fine.withColumn("hours", F.transform(F.sequence(F.lit(0), F.lit(WEEK_HOURS - 1)), total))
    day = CALENDAR_DAYS - 1 - (F.lit(today) - F.floor(t / DAY))
    calendar = requests.where(F.floor(t / DAY).between(today - CALENDAR_DAYS + 1, today)).groupBy("ip", day.alias("b")).agg(count_().alias("days"), (F.max(severity) + 1).alias("day_severity"))
    coarse = dense(calendar, ["ip"], "b", ["days", "day_severity"], CALENDAR_DAYS)
    by = requests.select("ip", F.explode(F.array_distinct(labels)).alias("label")).groupBy("ip", "label").agg(count_().alias("n"))
    best = lambda order: F.transform(F.array_sort(F.collect_list(F.struct(order, "label", "n"))), lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n")))
    top = keep_top(by, ["ip"], [F.desc("n"), F.col("label")], k).groupBy("ip").agg(best((-F.col("n")).alias("o")).alias("labels"))
    place = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("label")).alias("o")
    families = by.withColumn("label", label_family(F.col("label"))).groupBy("ip", "label").agg(F.sum("n").alias("n")).groupBy("ip").agg(best(place).alias("families"))
    base = requests.groupBy("ip").agg(count_().alias("requests"), F.countDistinct(F.floor(t / DAY)).alias("active_days"))
    none = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    rows = base.join(fine, "ip", "left").join(coarse, "ip", "left").join(top, "ip", "left").join(families, "ip", "left")
    empty = {"hours": none(WEEK_HOURS), "by_severity": none(WEEK_HOURS * SEVERITIES), "days": none(CALENDAR_DAYS), "day_severity": F.array_repeat(F.lit(0), CALENDAR_DAYS)}
    return rows.withColumns({c: F.coalesce(c, v) for c, v in empty.items()})


def shape_rollup(recorded: DataFrame, light: DataFrame, shape: str) -> DataFrame:
    """Per shape over recorded and light rows: first and last seen, sources, rule hits (light rows never hit)."""
    both = recorded.select(F.col(shape).alias("shape"), "ip", "t", (F.col("severity") > 0).alias("hit")).unionByName(light.select(F.col(shape).alias("shape"), "ip", "t", F.lit(False).alias("hit")))
    return both.groupBy("shape").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.countDistinct("ip").alias("sources"), F.count_if("hit").alias("hits"))


def piece_rollup(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("value").agg(F.countDistinct("ip").alias("sources"), F.countDistinct("source_uid").alias("inputs"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


#: Hours after which a running job is dead, and of the window in which the queue's growth is read (fixed values).
STALE_HOURS, DRAIN_HOURS = 13, 6


def queue_metrics(jobs: DataFrame, now: int, stale_hours: int = STALE_HOURS, drain_hours: int = DRAIN_HOURS) -> DataFrame:
    """One row: backlog, what runs, arrivals and completions of the last hour, day and drain window, what failed, was refused or timed out, mean seconds of a week's scans, the oldest wait, and arrivals and completions of each of the last 24 hours, the oldest first."""
    s, left = F.col("status"), F.col("status").isin("done", "failed", "refused", "superseded")
    ended = s.isin("done", "failed")
    since = lambda c, hours: F.coalesce(F.col(c) > now - hours * HOUR, F.lit(False))
    sums = jobs.agg(
        F.count_if(s == "queued").alias("backlog"), F.count_if((s == "running") & since("started", stale_hours)).alias("running"),
        F.count_if(since("queued", 1)).alias("arrivals_1h"), F.count_if(since("queued", 24)).alias("arrivals_24h"),
        F.count_if(ended & since("finished", 1)).alias("completed_1h"), F.count_if(ended & since("finished", 24)).alias("completed_24h"),
        F.count_if((s == "failed") & since("finished", 24)).alias("failed_24h"), F.count_if((s == "refused") & since("finished", 24)).alias("refused_24h"),
        F.count_if((s == "failed") & F.coalesce(F.col("error").startswith("timeout"), F.lit(False)) & since("finished", 24)).alias("timeouts_24h"),
        F.count_if(since("queued", drain_hours)).alias("arrivals_recent"), F.count_if(left & since("finished", drain_hours)).alias("left_recent"),
        F.least(F.greatest(F.coalesce((now - F.min("queued")) / HOUR, F.lit(24.0)), F.lit(1.0)), F.lit(24.0)).alias("observed_hours"),
        F.avg(F.when(ended & since("finished", 168), F.col("finished") - F.col("started"))).alias("avg_scan_s"), F.max(F.when(s == "queued", now - F.col("queued"))).alias("oldest_queued_s"),
    )
    at = lambda c, counts: F.struct(F.col(c).alias("t"), F.when(counts, F.lit(1)).otherwise(0).alias("arrivals"), F.when(counts, F.lit(0)).otherwise(1).alias("completions"))
    times = F.array_compact(F.array(at("queued", F.lit(True)), F.when(ended, at("finished", F.lit(False)))))
    aged = jobs.select(F.inline(times)).withColumn("age", F.floor((now - F.col("t")) / HOUR)).where(F.col("age").between(0, 23) & (F.col("t") > now - 24 * HOUR))
    by = aged.groupBy(F.lit(1).alias("_one"), (23 - F.col("age")).alias("b")).agg(F.sum("arrivals").alias("hourly_arrivals"), F.sum("completions").alias("hourly_completions"))
    series = dense(by, ["_one"], "b", ["hourly_arrivals", "hourly_completions"], 24)
    none = F.array_repeat(F.lit(0).cast("long"), 24)
    both = sums.withColumn("_one", F.lit(1)).join(series, "_one", "left").drop("_one")  # one row each
    return both.withColumns({c: F.coalesce(c, none) for c in ("hourly_arrivals", "hourly_completions")})


def scanner_rates(jobs: DataFrame, now: int, hours: int = 24, least: int = 5) -> DataFrame:
    """Rate (ok + 4) / (ok + failed + 4) over the ``hours`` before ``now``'s hour; timeouts and invalid targets are nobody's failure.

    Weight: the rate against the best other scanner of the level with enough
    finished, from 0.1 to 1. The level's two best rates are enough to know it.
    """
    end = now - now % HOUR
    excused = F.coalesce(F.col("error").startswith("timeout") | (F.col("error") == "invalid target"), F.lit(False))
    day = jobs.where(F.col("status").isin("done", "failed") & (F.col("finished") >= end - hours * HOUR) & (F.col("finished") < end))
    by = day.groupBy("level", "scanner").agg(F.count_if(F.col("status") == "done").alias("ok"), F.count_if((F.col("status") == "failed") & ~excused).alias("failed"))
    by = by.withColumn("rate", (F.col("ok") + 4) / (F.col("ok") + F.col("failed") + 4))
    enough = by.where(F.col("ok") + F.col("failed") >= least)
    two = keep_top(enough, ["level"], [F.desc("rate"), F.col("scanner")], 2).groupBy("level").agg(F.max_by("scanner", F.struct("rate", "scanner")).alias("_who"), F.max("rate").alias("_first"), F.min("rate").alias("_second"), count_().alias("_n"))
    other = F.when(F.col("_who") != F.col("scanner"), F.col("_first")).when(F.col("_n") > 1, F.col("_second"))
    return by.join(two, "level", "left").withColumn("weight", F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(F.col("rate") / other, F.lit(1.0))))).drop("_who", "_first", "_second", "_n")


def level_estimates(jobs: DataFrame, default: float = 10.0, least: int = 5) -> DataFrame:
    """Mean minutes by level, the default below ``least`` samples, from 1 to 120."""
    by = jobs.where("status = 'done'").groupBy("level").agg(count_().alias("n"), F.avg((F.col("finished") - F.col("started")) / 60).alias("mean"))
    return by.select("level", "n", F.greatest(F.lit(1.0), F.least(F.lit(120.0), F.when(F.col("n") >= least, F.col("mean")).otherwise(default))).alias("minutes"))


def scanner_capacity(jobs: DataFrame, slots: int) -> DataFrame:
    """Per scanner: running jobs against its slots and what is free."""
    return jobs.groupBy("scanner").agg(F.count_if(F.col("status") == "running").alias("running")).select("scanner", "running", F.lit(slots).alias("slots"), F.greatest(F.lit(0), slots - F.col("running")).alias("free"))


def granted_sales(scans: DataFrame, jobs: DataFrame) -> DataFrame:
    """First finished scan per job of another origin."""
    rows = scans.join(jobs.select(F.col("uid"), "scanner"), "uid").where(F.substring("origin", 2, 9) != F.substring("scanner", 2, 9))
    return rows.groupBy("ip", "level").agg(F.min("t").alias("first_t"), count_().alias("sales"))


def price_spread(prices: DataFrame) -> DataFrame:
    """Lowest, lower median and highest price per good and hour."""
    return prices.groupBy("good", "hour").agg(F.min("price_mc").alias("low"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price_mc)").cast("long").alias("median"), F.max("price_mc").alias("high"))


def price_series(prices: DataFrame, now: int, hours: int = 8 * 24) -> DataFrame:
    """The spread of every good over the ``hours`` before ``now``'s."""
    return price_spread(prices.where((F.col("hour") > now - hours) & (F.col("hour") <= now)))


def price_change(prices: DataFrame, now_hour: int, window: int) -> DataFrame:
    """Percent from the first to the last median in the window."""
    recent = price_spread(prices).where((F.col("hour") > now_hour - window) & (F.col("hour") <= now_hour))
    ends = recent.groupBy("good").agg(F.min_by("median", "hour").alias("first"), F.max_by("median", "hour").alias("last"))
    return ends.withColumn("percent", 100.0 * (F.col("last") - F.col("first")) / F.col("first"))


def uptime(reports: DataFrame) -> DataFrame:
    """Up hours by member and day: over half of the other reporters of the hour named it."""
    named = reports.select("reporter", "hour", "member").distinct()
    reporters = reports.select("reporter", "hour").distinct()
    counted = reporters.groupBy("hour").agg(count_().alias("reporters"))
    votes = named.where("reporter <> member").groupBy("hour", "member").agg(count_().alias("votes"))
    own = reporters.select("hour", F.col("reporter").alias("member"), F.lit(1).alias("own"))
    rows = votes.join(counted, "hour").join(own, ["hour", "member"], "left")
    up = rows.where(2 * F.col("votes") > F.col("reporters") - F.coalesce("own", F.lit(0)))
    return up.groupBy("member", F.floor(F.col("hour") / 24).alias("day")).agg(count_().alias("up_hours"))


def verified_daily(up: DataFrame, least: int = 12) -> DataFrame:
    return up.where(F.col("up_hours") >= least).select("member", "day")


def pool_split(day_members: DataFrame, pool: int) -> DataFrame:
    """The day's pool split evenly; the remainder goes one unit each to the lowest keys."""
    day = Window.partitionBy("day")
    n, place = F.count(F.lit(1)).over(day), F.row_number().over(day.orderBy("member"))
    return day_members.select("day", "member", n.alias("n"), place.alias("place")).select("day", "member", (F.floor(F.lit(pool) / F.col("n")) + (F.col("place") <= F.lit(pool) % F.col("n")).cast("int")).alias("share"))


def quorum_tally(answers: DataFrame) -> DataFrame:
    """Votes per value among distinct answerers; agreed with over half of them."""
    one = answers.select("question", "node", "value").distinct()
    answered = one.groupBy("question").agg(F.countDistinct("node").alias("answered"))
    votes = one.groupBy("question", "value").agg(count_().alias("votes"))
    return votes.join(answered, "question").withColumn("agreed", 2 * F.col("votes") > F.col("answered"))


def audit_compare(audits: DataFrame, ports: DataFrame, keys: DataFrame) -> DataFrame:
    """(audit, original, verdict) for pairs of scans: how far their open ports and identity keys agree.

    A key or certificate on a port open in both settles it if the original claims
    at most twice the audit's ports; else at least half of each side's ports must
    be shared. Without an open port the audit says nothing.
    """
    side = lambda c, first: F.struct(F.col(c).alias("scan_uid"), F.lit(first).alias("first"))
    sides = audits.select("audit", "original", F.explode(F.array(side("audit", True), side("original", False))).alias("s")).select("s.*", "audit", "original").hint("shuffle_hash")
    # only rows of compared scans go on, without sorting any; then all of a pair's meet in one task
    open_ = ports.where("state = 'open' AND proto = 'tcp'").select("scan_uid", "port", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("fingerprint"))
    known = keys.where("port IS NOT NULL AND kind IS NOT NULL AND fingerprint IS NOT NULL").select("scan_uid", "port", "kind", "fingerprint")
    rows = open_.join(sides, "scan_uid").unionByName(known.join(sides, "scan_uid")).repartition(parts_for(ports), "audit", "original")
    pair = ["audit", "original"]
    met = rows.groupBy(*pair, "port", "kind", "fingerprint").agg(F.bool_or("first").alias("a"), F.bool_or(~F.col("first")).alias("o"))
    is_port = F.col("kind").isNull()
    by_port = met.groupBy(*pair, "port").agg(F.bool_or(is_port & F.col("a")).alias("a"), F.bool_or(is_port & F.col("o")).alias("o"), F.bool_or(~is_port & F.col("a") & F.col("o")).alias("key"))
    both = F.col("a") & F.col("o") & F.col("port").isNotNull()
    sums = by_port.groupBy(*pair).agg(F.count_if("a").alias("na"), F.count_if("o").alias("no"), F.count_if(both).alias("common"), F.bool_or(both & F.col("key")).alias("same"))
    x, y = audits.alias("x"), sums.alias("y")
    rows = x.join(y, F.col("x.audit").eqNullSafe(F.col("y.audit")) & F.col("x.original").eqNullSafe(F.col("y.original")), "left").select("x.audit", "x.original", "na", "no", "common", "same")
    a, o, both = F.coalesce("na", F.lit(0)), F.coalesce("no", F.lit(0)), F.coalesce("common", F.lit(0))
    agrees = (F.coalesce("same", F.lit(False)) & (o <= 2 * a)) | ((2 * both >= a) & (2 * both >= o))
    return rows.select("audit", "original", F.when(a == 0, "inconclusive").when(agrees, "agrees").otherwise("differs").alias("verdict"))


def audit_counts(compared: DataFrame, scans: DataFrame) -> DataFrame:
    """Per audited node: conclusive and differing audits by others, and whether it fails (at least 5, half of them differing)."""
    node = lambda uid, origin: scans.select(F.col("uid").alias(uid), F.col("origin").alias(origin))
    said = compared.where("verdict <> 'inconclusive'").hint("shuffle_hash")  # far fewer than scans, of which none is sorted
    rows = node("audit", "auditor").join(said, "audit").hint("shuffle_hash")
    rows = node("original", "scanner").join(rows, "original").where("auditor <> scanner")
    by = rows.groupBy("scanner").agg(count_().alias("conclusive"), F.count_if(F.col("verdict") == "differs").alias("differing"))
    return by.withColumn("fails", (F.col("conclusive") >= 5) & (2 * F.col("differing") >= F.col("conclusive")))


def skipped_counts(light: DataFrame) -> DataFrame:
    return light.groupBy("ip").agg(F.sum(F.col("dropped") + F.size("rows")).alias("skipped"))


def volume(requests: DataFrame) -> DataFrame:
    return requests.agg(F.sum(F.col("unrecorded") + 1).alias("weighted"), count_().alias("rows"))


def node_contributions(requests: DataFrame, batches: DataFrame, fingerprints: DataFrame, claims: DataFrame, scans: DataFrame, intel: DataFrame) -> DataFrame:
    """Per recording node: requests, light rows with drops, fingerprints, claims, scans and distinct addresses looked up."""
    counted = {"requests": requests, "fingerprints": fingerprints, "claims": claims, "scans": scans}
    parts = [df.groupBy("origin").agg(count_().alias(name)) for name, df in counted.items()]
    parts += [batches.groupBy("origin").agg(F.sum(F.col("dropped") + F.size("rows")).alias("skipped")), intel.groupBy("origin").agg(F.countDistinct("ip").alias("looked_up"))]
    out, *rest = parts
    for part in rest:
        out = out.join(part, "origin", "full")
    return out.na.fill(0)


def provider_volume(log: DataFrame) -> DataFrame:
    return log.groupBy("provider").agg(count_().alias("lookups"))


def spot_check(intel: DataFrame, salt: str = "salt") -> DataFrame:
    """A tenth of the addresses by a keyed hash; rows checked by node, and those that differ from the address's newest data."""
    chosen = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col("ip").cast("string")), 256), 1, 4), 16, 10).cast("int") % 10 == 0
    rows = intel.where(chosen)
    newest = rows.groupBy("ip").agg(F.max_by("data", "hlc").alias("newest"))
    return rows.join(newest, "ip").groupBy("origin").agg(count_().alias("checked"), F.count_if(F.col("data") != F.col("newest")).alias("disputed"))


def host_key_sharing(host_keys: DataFrame) -> DataFrame:
    """Per source and key: how many other sources have it."""
    own = host_keys.select("ip", "kind", "fingerprint").distinct()
    return own.join(own.groupBy("kind", "fingerprint").agg((count_() - 1).alias("others")), ["kind", "fingerprint"])


def names_due(names: DataFrame, now: int, days: int) -> DataFrame:
    """Names whose newest confirmation is older than ``days``."""
    return names.groupBy("name").agg(F.max("last_seen").alias("last_seen")).where(F.col("last_seen") < now - days * DAY)


def addresses_of_name(names: DataFrame, n: int = 200) -> DataFrame:
    """Per name its addresses, agreed ones first, then newest."""
    agreed = 2 * F.col("votes") > F.col("answered")
    return keep_top(names.withColumn("agreed", agreed), ["name"], [F.desc("agreed"), F.desc("last_seen"), F.col("ip")], n).select("name", "ip", "agreed", "last_seen")


def header_order_groups(requests: DataFrame, key: Column) -> DataFrame:
    """Requests and distinct sources by header-order key (``functions.columns.header_order_key``)."""
    return requests.groupBy(key.alias("key")).agg(count_().alias("requests"), F.countDistinct("ip").alias("sources"))


def retry_backoff_due(log: DataFrame, sources: DataFrame, now: int, days: float, factor: float = 1.5, most: int = 30) -> DataFrame:
    """Sources due for a lookup: none yet, or the last is older than ``days`` times ``factor`` for each lookup after the first."""
    done = log.groupBy("ip").agg(F.max("t").alias("last"), count_().alias("n"))
    wait = days * DAY * F.pow(F.lit(factor), F.least("n", F.lit(most)) - 1)
    return sources.join(done, "ip", "left").where(F.col("last").isNull() | (F.col("last") + wait <= now)).select("ip")
