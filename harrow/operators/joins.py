"""Joins: enrichment, as-of, ranges, reuse, intervals, capped pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.stats import DAY, keep_top
from harrow.sources.scratch import materialize

#: A value on more sources than this says nothing about two of them; a shape likewise.
SHARED_CAP, RARE_CAP, JOINERS_PER_INPUT, PER_JOINER, PER_UPLOAD = 50, 50, 64, 512, 500


def with_source(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests with their source's columns, null where no source row has come yet."""
    return requests.join(sources, "ip", "left")


def enrich_as_of(requests: DataFrame, log: DataFrame, value: str = "data", out: str = "data") -> DataFrame:
    """Newest lookup at or before the request, else the source's earliest.

    At equal times lookups come first, among them the last by hlc counts; a null
    value is no lookup. Both are dealt by source and day, so a source with very
    many rows is spread. Requests without a source or a time get null.
    """
    kind = dict(log.dtypes)[value]
    whole = "ip IS NOT NULL AND t IS NOT NULL"
    asked = requests.where(whole).select("ip", "t", F.lit(1).alias("_tag"), F.lit(0).cast("long").alias("_hlc"), F.lit(None).cast(kind).alias("_v"), F.struct(*requests.columns).alias("_row"))
    known = log.where(whole).select("ip", "t", F.lit(0).alias("_tag"), F.col("hlc").cast("long").alias("_hlc"), F.col(value).alias("_v"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    found = newest_before(asked.unionByName(known), ["ip"], ["t", "_tag", "_hlc"], "_v", "_found", earliest=True).where("_tag = 1")
    rest = requests.where(f"NOT ({whole})").withColumn(out, F.lit(None).cast(kind))
    return found.select("_row.*", F.col("_found").alias("_found")).withColumn(out, F.col("_found")).select(*rest.columns).unionByName(rest)


#: Prefixes that are broadcast at most; more are shuffled.
MOST_PREFIXES = 1_000_000


def prefix_key(key: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a 32-digit hexadecimal key, as text with their number."""
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    digit = F.conv(F.substr(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    return F.concat(bits.cast("string"), F.lit(":"), F.substr(key, F.lit(1), whole), F.when(rest > 0, F.call_function("shiftright", digit, (4 - rest).cast("int")).cast("string")).otherwise(F.lit("")))


def aligned_prefixes(low: Column, high: Column) -> Column:
    """array<struct<key, bits>>: the fewest aligned prefixes that make up the range of two keys; none if it is upside down."""
    digits = lambda key: F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.lpad(F.conv(F.substr(key, i, F.lit(1)), 16, 2), 4, "0"))
    bits_of = lambda key: F.array_join(digits(F.lower(key)), "")
    same = lambda e: F.array_position(F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.substr(e["lo"], i, F.lit(1)) == F.substr(e["hi"], i, F.lit(1))), F.lit(False)) - 1
    head = lambda text, n: F.substr(text, F.lit(1), n)

    def beside(start: Column, tail: Column, bit: str) -> Column:
        """What lies on the inner side of the path to an end of the range, and the end itself; what is behind the tail belongs to it whole."""
        other = "1" if bit == "0" else "0"
        turns = F.filter(F.sequence(F.lit(1), F.greatest(F.length(tail), F.lit(1))), lambda i: F.substr(tail, i, F.lit(1)) == bit)
        return F.concat(F.array(F.concat(start, tail)), F.transform(turns, lambda i: F.concat(start, head(tail, i - 1), F.lit(other))))

    def cut(e: Column) -> Column:
        left = F.regexp_replace(F.substr(e["lo"], e["n"] + 2, F.lit(128)), "0+$", "")
        right = F.regexp_replace(F.substr(e["hi"], e["n"] + 2, F.lit(128)), "1+$", "")
        both = F.concat(beside(head(e["lo"], e["n"] + 1), left, "0"), beside(head(e["hi"], e["n"] + 1), right, "1"))
        return F.when(e["n"] < 0, F.array(e["lo"])).when((left == "") & (right == ""), F.array(head(e["lo"], e["n"]))).otherwise(both)

    ends = F.transform(F.array(F.struct(bits_of(low).alias("lo"), bits_of(high).alias("hi"))), lambda e: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), same(e).cast("int").alias("n")))
    made = F.when(F.lower(low) <= F.lower(high), F.flatten(F.transform(ends, cut))).otherwise(F.array().cast("array<string>"))
    hexed = lambda bits: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.lower(F.conv(F.substr(F.rpad(bits, 128, "0"), 4 * k + 1, F.lit(4)), 2, 16))), "")
    return F.transform(made, lambda bits: F.struct(hexed(bits).alias("key"), F.length(bits).alias("bits")))


def geo_join(sources: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``sources`` (one row per ``ip_key``) with the other columns of the innermost range (low, high, ...) that holds their key; null if none does.

    Ranges are cut into aligned prefixes, at most 254 each, so that a key is met
    by equal prefixes of the lengths that occur and nothing is compared by order.
    Of several ranges the one that starts last counts, then the one that ends first.
    """
    values = [c for c in prefixes.columns if c not in ("low", "high")]
    place = F.struct(F.lower("low").alias("low"), F.translate(F.lower("high"), "0123456789abcdef", "fedcba9876543210").alias("high"))
    cut = prefixes.select(place.alias("_place"), F.struct(*values).alias("_values"), F.explode(aligned_prefixes(F.col("low"), F.col("high"))).alias("_p"))
    cut = materialize(cut.select(prefix_key(F.col("_p.key"), F.col("_p.bits")).alias("_prefix"), F.col("_p.bits").alias("_bits"), "_place", "_values"), "geo-prefixes")
    lengths = sorted(r["_bits"] for r in cut.select("_bits").distinct().collect())  # 129 at most
    each = F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: prefix_key(F.lower("ip_key"), n))
    asked = sources.where("ip_key IS NOT NULL").select("ip_key").distinct().select("ip_key", F.explode(each).alias("_prefix"))
    held = F.broadcast(cut) if cut.count() <= MOST_PREFIXES else cut
    found = asked.join(held.drop("_bits"), "_prefix").groupBy("ip_key").agg(F.max_by("_values", "_place").alias("_values"))
    return sources.join(found, "ip_key", "left").select(*sources.columns, *[F.col("_values")[c].alias(c) for c in values])


def newest_before(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, step: int = DAY, earliest: bool = False) -> DataFrame:
    """Add ``out``: the last ``value`` that is not null among the key's rows up to this one in ``order`` (its first column is a time in seconds); with ``earliest``, where there is none, the key's first.

    Rows are dealt by key and ``step`` seconds, so that a key with very many rows
    is spread; what earlier steps end with is carried in by a small table.
    """
    dealt = rows.withColumn("_step", F.floor(F.col(order[0]) / step))
    cell = Window.partitionBy(*keys, "_step")
    inside = F.last(value, ignorenulls=True).over(cell.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = dealt.where(F.col(value).isNotNull()).groupBy(*keys, "_step").agg(F.max_by(value, F.struct(*order)).alias("_end"), F.min_by(value, F.struct(*order)).alias("_start"))
    every = dealt.select(*keys, "_step").distinct().join(ends, [*keys, "_step"], "left")
    before = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("_start", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = every.select(*keys, "_step", F.coalesce(F.last("_end", ignorenulls=True).over(before), *([first] if earliest else [])).alias("_carried"), *([first.alias("_first")] if earliest else []))
    found = dealt.withColumn(out, inside).join(carried, [*keys, "_step"])
    return found.withColumn(out, F.coalesce(out, "_carried")).drop("_step", "_carried", "_first")


def canary_reuse(canaries: DataFrame, tokens: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """A served value seen in a later, other request; one row per use and value, with the newest serving before it.

    Servings by light rows have no ``request_id`` and count for every use. In one
    second, a serving is before a use if its request number is lower. With
    ``requests``, what the serving request answered and both ends' nodes are added.
    """
    kind_of = dict(canaries.dtypes)
    serving = F.struct(F.col("request_id").alias("served_id"), F.col("ip").alias("served_ip"), F.col("t").alias("served_t"), "kind")
    served = canaries.select("value_hash", "t", F.coalesce("request_id", F.lit(-1)).alias("_order"), F.lit(1).alias("_tag"), F.col("ip").alias("_ip"), serving.alias("_serving"))
    uses = tokens.groupBy("value_hash", "request_id").agg(F.min("t").alias("t"), F.min("ip").alias("ip"), F.min("place").alias("place"))
    used = uses.select("value_hash", "t", F.col("request_id").alias("_order"), F.lit(0).alias("_tag"), F.col("ip").alias("_ip"), F.struct("ip", "place").alias("_use"))
    rows = served.unionByName(used, allowMissingColumns=True)
    found = newest_before(rows, ["value_hash"], ["t", "_order", "_tag", "_ip"], "_serving", "_found").where("_use IS NOT NULL AND _found IS NOT NULL")
    out = found.select(
        F.col("_order").alias("used_id"), "value_hash", "_found.kind", "_use.place", F.col("_found.served_id").cast(kind_of["request_id"]).alias("served_id"), "_found.served_ip", F.col("_use.ip").alias("used_ip"),
        (F.col("t") - F.col("_found.served_t")).alias("delta"), (F.col("_found.served_ip") == F.col("_use.ip")).alias("same_source"),
    )
    if requests is None:
        return out
    node = lambda side, *more: requests.select(F.col("id").alias(f"{side}_id"), F.col("origin").alias(f"{side}_node"), *more)
    return out.join(node("served", F.col("answer").alias("served_answer")), "served_id", "left").join(node("used"), "used_id", "left")


def first_reuse(canaries: DataFrame, tokens: DataFrame) -> DataFrame:
    """(served_id, kind, delta): of each serving whose value is used at a later time, the seconds to its first use. Time runs backwards here, so that the first use after a serving is the newest one before it and no pairs are made."""
    row = lambda df, tag, use, *more: df.where("value_hash IS NOT NULL").select("value_hash", (-F.col("t")).alias("_back"), F.lit(tag).alias("_tag"), use.cast("long").alias("_use"), *more)
    rows = row(canaries, 0, F.lit(None), F.col("request_id").alias("served_id"), "kind").unionByName(row(tokens, 1, F.col("t")).distinct(), allowMissingColumns=True)
    found = newest_before(rows, ["value_hash"], ["_back", "_tag"], "_use", "_found").where("_tag = 0 AND _found IS NOT NULL")
    return found.select("served_id", "kind", (F.col("_found") + F.col("_back")).alias("delta"))


#: Pairs of servers and users of a value beyond which they are never written out; parts into which sets of values are dealt, and sets held at once in a task.
MOST_PAIRS, PARTS, SETS_AT_ONCE = 10_000, 64, 256


def count_holders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a part, sorted by part, bucket and kind: its sets of values (bucket -1), then of each bucket the values' bit maps and the pairs that are asked for.

    Gives (sid, -1, n), the bits that the maps of a set's values have together, and
    (-1, own, n), a source's asked pairs without a bit there. A bucket's maps are held at a time.
    """

    def cells() -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
        kept, at = [], None
        for batch in batches:
            for key, rows in batch.groupby(["part", "bucket"], sort=False):
                if key != at and kept:
                    yield at, pd.concat(kept)
                    kept = []
                kept.append(rows)
                at = key
        if kept:
            yield at, pd.concat(kept)

    def done() -> pd.DataFrame:
        return pd.DataFrame({"sid": sids, "own": np.full(len(sids), -1), "n": total})

    owner, sids, total, values, of = None, *[np.zeros(0, np.int64)] * 4
    for (part, bucket), rows in cells():
        if part != owner:
            yield done()
            owner, sids, total, values, of = part, *[np.zeros(0, np.int64)] * 4
        if bucket < 0:
            rows = rows.sort_values("sid")
            sids, total = rows["sid"].to_numpy(np.int64), np.zeros(len(rows), np.int64)
            values, of = np.concatenate([np.asarray(v, np.int64) for v in rows["vids"]]), np.repeat(np.arange(len(rows)), [len(v) for v in rows["vids"]])
            continue
        maps = rows[rows["kind"] == 1].sort_values("vid")
        vids, bits = maps["vid"].to_numpy(np.int64), np.frombuffer(b"".join(maps["bits"]), np.uint64).reshape(len(maps), -1)
        asked = rows[rows["kind"] == 2]
        place, bit = np.searchsorted(sids, asked["sid"].to_numpy(np.int64)), asked["bit"].to_numpy(np.int64)
        there = np.zeros(len(asked), bool)
        at = np.searchsorted(vids, values)
        held = np.flatnonzero(vids[np.minimum(at, len(vids) - 1)] == values) if len(vids) else at[:0]
        for low in range(0, len(sids), SETS_AT_ONCE):
            here = held[np.searchsorted(of[held], low) : np.searchsorted(of[held], low + SETS_AT_ONCE)]
            if not len(here):
                continue
            own, first = np.unique(of[here], return_index=True)
            joined = np.zeros((len(own), bits.shape[1]), np.uint64)
            for k, run in enumerate(np.split(at[here], first[1:])):
                np.bitwise_or.reduce(bits[run], axis=0, out=joined[k])
            total[own] += np.bitwise_count(joined).sum(axis=1, dtype=np.int64)
            k = np.searchsorted(own, place)
            mine = np.flatnonzero(own[np.minimum(k, len(own) - 1)] == place)
            there[mine] = joined.view(np.uint8)[k[mine], bit[mine] >> 3] >> (bit[mine] & 7) & 1 > 0
        if not there.all():
            asker, count = np.unique(asked["own"].to_numpy(np.int64)[~there], return_counts=True)
            yield pd.DataFrame({"sid": np.full(len(asker), -1), "own": asker, "n": count})
    yield done()


def distinct_partners(own: DataFrame, other: DataFrame, most: int = MOST_PAIRS, parts: int = PARTS) -> DataFrame:
    """(ip, n): per source in ``own`` how many other sources hold one of its values in ``other`` (both: distinct value_hash, ip), exactly.

    Values of few sources are joined. Of the others, whose pairs would grow with
    the square, each has a bit map of its holders by dense numbers. Sources with
    the same set of such values are one; the sets are dealt into ``parts``, the maps
    are sent to each of them, so what is moved grows with the rows, and the maps of
    a set's values are or-ed in the task, bucket after bucket, and never written.
    What the joined pairs add is what has no bit there.
    """
    n = lambda df, c: df.groupBy("value_hash").agg(F.count(F.lit(1)).alias(c))
    sizes = materialize(n(own, "n").join(n(other, "m"), "value_hash"), "value-sizes")
    crowded = materialize(sizes.where(F.col("n") * F.col("m") > most).select("value_hash", F.monotonically_increasing_id().alias("vid")), "crowded-values")
    few = sizes.where(F.col("n") * F.col("m") <= most).select("value_hash")
    side = lambda df, c: df.select("value_hash", F.col("ip").alias(c))
    pairs = side(own, "ip").join(few, "value_hash").join(side(other, "holder"), "value_hash").where("ip <> holder").select("ip", "holder").distinct()
    if crowded.isEmpty():
        return pairs.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
    from harrow.operators.linking import numbered

    many, held = materialize(own.join(crowded, "value_hash").select("vid", "ip"), "crowded-own"), materialize(other.join(crowded, "value_hash").select("vid", F.col("ip").alias("holder")), "crowded-other")
    ids = materialize(numbered(held.select("holder").distinct(), ["holder"], "id"), "holder-numbers")
    place = lambda df: df.withColumns({"bucket": F.bitmap_bucket_number("id"), "bit": F.bitmap_bit_position("id")})
    maps = place(held.join(ids, "holder")).groupBy("vid", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    named = many.groupBy("ip").agg(F.array_sort(F.collect_set("vid")).alias("vids"))
    named = materialize(named, "value-sets")
    sets = materialize(named.select("vids").distinct().withColumn("sid", F.monotonically_increasing_id()), "distinct-sets")
    of = materialize(named.join(sets, "vids").select("ip", "sid", F.monotonically_increasing_id().alias("own")), "set-numbers")
    part = lambda sid: F.pmod(F.xxhash64(sid), F.lit(parts)).cast("int").alias("part")
    told = place(pairs.join(of, "ip", "left").join(ids, "holder", "left"))
    both = F.col("sid").isNotNull() & F.col("bucket").isNotNull()
    shape = "part int, bucket long, kind int, sid long, own long, vid long, bit long, vids array<long>, bits binary"
    form = lambda df: df.select(*[F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(-1)).cast(t).alias(c) if t in ("int", "long") else (F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)) for c, t in (x.split() for x in shape.split(", "))])
    rows = form(sets.select(part("sid"), F.lit(-1).alias("bucket"), F.lit(0).alias("kind"), "sid", "vids"))
    rows = rows.unionByName(form(maps.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "bucket", F.lit(1).alias("kind"), "vid", "bits")))
    rows = rows.unionByName(form(told.where(both).select(part("sid"), "bucket", F.lit(2).alias("kind"), "sid", "own", "bit")))
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", "bucket", "kind")
    found = materialize(dealt.mapInPandas(count_holders, "sid long, own long, n long"), "holders-counted")
    whole = of.join(found.where("own < 0").select("sid", "n"), "sid").select("ip", "n")
    self_ = many.join(held.withColumnRenamed("holder", "ip"), ["vid", "ip"], "left_semi").select("ip").distinct().select("ip", F.lit(-1).cast("long").alias("n"))
    added = of.join(found.where("own >= 0").select("own", "n"), "own").select("ip", "n").unionByName(told.where(~both).select("ip", F.lit(1).cast("long").alias("n")))
    return whole.unionByName(self_).unionByName(added).groupBy("ip").agg(F.sum("n").alias("n")).where("n > 0")


def canary_links(canaries: DataFrame, tokens: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Per source: how many others used its values, and of how many others it used values."""
    served = materialize(canaries.where("value_hash IS NOT NULL AND ip IS NOT NULL").select("value_hash", "ip").distinct(), "values-served")
    used = materialize(tokens.where("value_hash IS NOT NULL AND ip IS NOT NULL").select("value_hash", "ip").distinct(), "values-used")
    by, of = distinct_partners(served, used, most), distinct_partners(used, served, most)
    ends = by.select("ip", F.col("n").alias("used_by")).join(of.select("ip", F.col("n").alias("uses_of")), "ip", "full")
    return ends.na.fill(0, ["used_by", "uses_of"])


def with_provider(sources: DataFrame, intel: DataFrame, provider: str) -> DataFrame:
    return sources.join(intel.where(F.col("provider") == provider), "ip", "left_semi")


def without_provider(sources: DataFrame, intel: DataFrame, provider: str) -> DataFrame:
    return sources.join(intel.where(F.col("provider") == provider), "ip", "left_anti")


def open_port_sources(sources: DataFrame, scans: DataFrame, ports: DataFrame, port: int, proto: str = "tcp") -> DataFrame:
    open_ = ports.where((F.col("port") == port) & (F.col("proto") == proto) & (F.col("state") == "open")).select(F.col("scan_uid").alias("uid"))
    return sources.join(scans.join(open_, "uid", "left_semi"), "ip", "left_semi")


def with_wave(shapes: DataFrame, waves: DataFrame) -> DataFrame:
    return shapes.join(waves, "shape", "left")


def file_name(filename: Column, answered_path: Column) -> Column:
    """What a client would ask for: the name that it sent, else the path's end, without directories; null if empty."""
    name = F.regexp_extract(F.coalesce(F.when(filename != "", filename), answered_path), r"([^/\\\\]*)$", 1)
    return F.when(name != "", name)


def dead_ends(uploads: DataFrame, requests: DataFrame, seconds: int = 60, cap: int = PER_UPLOAD) -> DataFrame:
    """404s of the uploader at the same node within ``seconds`` after the upload, whose path ends with / and the file's name.

    In the upload's own second, requests numbered above the upload's count. Both
    sides are dealt by source, node and time, so a busy source is spread.
    """
    step = lambda t: F.floor(F.col(t) / seconds)
    u = uploads.select(F.col("uid").alias("upload"), "request_id", "ip", "origin", F.col("t").alias("upload_t"), file_name(F.col("filename"), F.col("answered_path")).alias("_name")).where("_name IS NOT NULL")
    u = u.withColumn("_step", F.explode(F.array(step("upload_t"), step("upload_t") + 1)))
    r = requests.where("status = 404").select("id", "ip", "origin", "t", "path", step("t").alias("_step"))
    later = (F.col("t") > F.col("upload_t")) | ((F.col("t") == F.col("upload_t")) & (F.col("id") > F.col("request_id")))
    hits = u.join(r, ["ip", "origin", "_step"]).where(later & (F.col("t") <= F.col("upload_t") + seconds) & F.endswith("path", F.concat(F.lit("/"), "_name")))
    return keep_top(hits, ["upload"], [F.col("t"), F.col("id")], cap).select("upload", "id", "ip", "t", "path")


def dead_ends_by_path(hits: DataFrame) -> DataFrame:
    return hits.dropDuplicates(["id"]).groupBy("path").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("ip").alias("sources"), F.max("t").alias("last_seen"))


def upload_timeline(uploads: DataFrame, requests: DataFrame, cap: int = PER_UPLOAD) -> DataFrame:
    """Later requests at the same node to where an upload was said to be, or under it; the first ``cap`` of each.

    The requests of a place (the path itself, and each of its parents with and
    without a slash) are numbered in order and uploads find their position among
    them, by place and day. An upload's requests are the next ``cap`` numbers, in one
    or two blocks of as many; so an upload never meets all that is later.
    """
    place, order = ["origin", "at", "_under"], ["t", "_order", "_tag"]
    last = F.lit(2**63 - 1)  # without a request's number an upload comes after all of its second
    u = uploads.select(F.col("uid").alias("upload"), "origin", "t", F.col("answered_path").alias("at"), F.coalesce("path_is_prefix", F.lit(False)).alias("_under"), F.coalesce(F.col("request_id").cast("long"), last).alias("_order"), F.lit(1).alias("_tag"))
    u = u.where("t IS NOT NULL AND origin IS NOT NULL AND at IS NOT NULL")
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    places = F.concat(F.array("path"), F.filter(parents, lambda p: p != ""), F.transform(parents, lambda p: F.concat(p, F.lit("/"))))
    at = lambda p, under: F.struct(p.alias("at"), F.lit(under).alias("_under"))
    each = F.inline(F.concat(F.array(at(F.col("path"), False)), F.transform(F.array_distinct(places), lambda p: at(p, True))))
    r = requests.where("t IS NOT NULL").select("id", "origin", "t", "path", F.col("id").cast("long").alias("_order"), F.lit(0).alias("_tag"), each)
    r = r.join(u.select(*place).distinct(), place, "left_semi")
    rows = u.unionByName(r, allowMissingColumns=True).withColumn("_step", F.floor(F.col("t") / DAY))
    upto = Window.partitionBy(*place, "_step").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*place).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*place, "_step").agg(F.count_if(F.col("_tag") == 0).alias("_n"))
    carried = days.select(*place, "_step", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carried"))
    numbered = rows.withColumn("_n", F.count_if(F.col("_tag") == 0).over(upto)).join(carried, [*place, "_step"])
    numbered = materialize(numbered.withColumn("_n", F.col("_n") + F.col("_carried")).drop("_carried", "_step", "_order"), "upload-places")
    block = lambda n: F.floor(n / cap)
    asked = numbered.where("_tag = 0").select(*place, "id", "t", "path", F.col("_n"), block(F.col("_n") - 1).alias("_block"))
    sent = numbered.where("_tag = 1").select(*place, "upload", F.col("t").alias("upload_t"), F.col("_n").alias("_at"), F.explode(F.array_distinct(F.array(block(F.col("_n")), block(F.col("_n") + cap - 1)))).alias("_block"))
    hits = sent.join(asked, [*place, "_block"]).where((F.col("_n") > F.col("_at")) & (F.col("_n") <= F.col("_at") + cap))
    return keep_top(hits, ["upload"], [F.col("t"), F.col("id")], cap).select("upload", "upload_t", "id", "t", "path")


def follow_ups(timeline: DataFrame) -> DataFrame:
    """A request that two uploads share belongs to the newer one."""
    return keep_top(timeline, ["id"], [F.desc("upload_t"), F.desc("upload")], 1).select("id", "upload", "path")


def hard_edges(sightings: DataFrame, cap: int = SHARED_CAP) -> DataFrame:
    """Pairs of sources that share a value, unless more than ``cap`` do."""
    own = sightings.select("kind", "value", "ip").distinct()
    few = own.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= cap)).drop("n")
    own = own.join(few, ["kind", "value"])
    return own.alias("x").join(own.alias("y"), ["kind", "value"]).where("x.ip < y.ip").select(F.col("x.ip").alias("a"), F.col("y.ip").alias("b")).distinct()


def excluded_values(sightings: DataFrame, cap: int = SHARED_CAP) -> DataFrame:
    return sightings.groupBy("kind", "value").agg(F.countDistinct("ip").alias("sources")).where(F.col("sources") > cap)


def candidate_pairs(source_shapes: DataFrame, cap: int = RARE_CAP) -> DataFrame:
    """Pairs of sources that share a shape on 2 to ``cap`` sources."""
    rare = source_shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= cap)).select("shape")
    own = source_shapes.select("ip", "shape").join(rare, "shape")
    return own.alias("x").join(own.alias("y"), "shape").where("x.ip < y.ip").select(F.col("x.ip").alias("a"), F.col("y.ip").alias("b")).distinct()


def joiner_pairs(sightings: DataFrame, cap: int = JOINERS_PER_INPUT) -> DataFrame:
    """Two values named together in one input, once per source; inputs with more than ``cap`` values are skipped."""
    own = sightings.select("source_uid", "ip", "value").distinct()
    few = own.groupBy("source_uid").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= cap)).select("source_uid")
    own = own.join(few, "source_uid")
    return own.alias("x").join(own.alias("y"), "source_uid").where("x.value < y.value").select(F.col("x.ip").alias("ip"), F.col("x.value").alias("a"), F.col("y.value").alias("b")).distinct()


def describers(joiners: DataFrame, sightings: DataFrame, n: int = PER_JOINER) -> DataFrame:
    """Other values sighted in the inputs of a joiner, the newest n."""
    j = joiners.select(F.col("value").alias("joiner"), "source_uid").distinct()
    rows = j.join(sightings.select("source_uid", "value", "t"), "source_uid").where("joiner <> value").groupBy("joiner", "value").agg(F.max("t").alias("last_seen"))
    return keep_top(rows, ["joiner"], [F.desc("last_seen"), F.col("value")], n)


def related_by_ip(requests: DataFrame, ip, except_id, limit: int) -> DataFrame:
    return requests.where((F.col("ip") == ip) & (F.col("id") != except_id)).orderBy(F.desc("t"), F.desc("id")).limit(limit)


def related_by_ja4(requests: DataFrame, ja4: str, ip, now: int, days: int = 7) -> DataFrame:
    """Other sources with the fingerprint in the last days."""
    return requests.where((F.col("ja4") == ja4) & (F.col("ip") != ip) & (F.col("t") >= now - days * DAY)).groupBy("ja4").agg(F.countDistinct("ip").alias("sources"), F.count(F.lit(1)).alias("requests"))


def campaigns_of_shapes(asked: DataFrame, members: DataFrame, k: int = 3) -> DataFrame:
    """Per shape its k campaigns with most members, and how many more."""
    by = asked.select("shape", "ip").distinct().join(members, "ip").groupBy("shape", "campaign").agg(F.count(F.lit(1)).alias("members"))
    more = F.count(F.lit(1)).over(Window.partitionBy("shape")) - k
    return keep_top(by.withColumn("more", F.greatest(F.lit(0), more)), ["shape"], [F.desc("members"), F.col("campaign")], k)
