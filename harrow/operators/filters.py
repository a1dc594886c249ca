"""Filters, projections and predicates. All conditions are plain columns, so they reach the scan."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.columns import UNMATCHED_LABELS, V4, bound, is_v4, net_range

#: Networks whose addresses are not global (fixed values; documentation ranges are kept).
NOT_GLOBAL_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4")
NOT_GLOBAL_V6 = ("::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8")
#: IPv6 networks that hold an IPv4 address, and the first of its digits in the key (fixed values).
EMBEDDING = {"64:ff9b::/96": 25, "::ffff:0:0:0/96": 25, "2002::/16": 5}


def filter_requests(df: DataFrame, path: str | None = None, min_severity: int | None = None, start: int | None = None, end: int | None = None, **equal) -> DataFrame:
    """All given conditions hold; ``equal`` are column values."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    if path is not None:
        df = path_contains(df, path)
    if min_severity is not None:
        df = df.where(F.col("severity") >= min_severity)
    return time_bounds(df, start, end)


def filter_sources(df: DataFrame, with_: list[DataFrame] = (), without: list[DataFrame] = (), **equal) -> DataFrame:
    """Sources with a row in every ``with_`` table, none in any ``without`` table, and equal column values."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    for t in with_:
        df = df.join(t, "ip", "left_semi")
    for t in without:
        df = df.join(t, "ip", "left_anti")
    return df


def filter_ip_query(df: DataFrame, q: str, key: str = "ip_key", text: str = "ip") -> DataFrame:
    """Exact address, network of any prefix length (an IPv6 one holds no IPv4 address), or text prefix; no rows for anything else."""
    q = q.strip()
    try:
        address = ipaddress.ip_address(q)
        return df.where(F.col(text) == str(getattr(address, "ipv4_mapped", None) or address))
    except ValueError:
        pass
    try:
        network = ipaddress.ip_network(q, strict=False) if "/" in q else None
    except ValueError:
        network = None
    if network is not None:
        low, high = net_range(F.lit(q))
        found = df.where(F.col(key).between(low, high))
        return found if network.version == 4 else found.where(~is_v4(F.col(key)))
    if set(q.lower()) <= set("0123456789abcdef.:"):
        return df.where(F.lower(text).startswith(q.lower()))
    return df.where(F.lit(False))


def has_label(labels: str, label: str) -> Column:
    return F.coalesce(F.array_contains(labels, label), F.lit(False))


def path_contains(df: DataFrame, text: str, column: str = "path") -> DataFrame:
    """Literal substring without case. Spark folds all letters, not A-Z only."""
    return df.where(F.contains(F.lower(column), F.lit(text.lower())))


def time_bounds(df: DataFrame, start: int | None, end: int | None, cover: int = 1) -> DataFrame:
    """Inclusive bounds in seconds; the upper covers ``cover`` seconds (a minute, a day)."""
    if start is not None:
        df = df.where(F.col("t") >= start)
    return df if end is None else df.where(F.col("t") < end + cover)


def range_window(df: DataFrame, name: str, now: int) -> DataFrame:
    days = {"24h": 1, "7d": 7, "30d": 30}.get(name)
    return df if days is None else df.where(F.col("t") >= now - days * 86_400)


def publication(uid: Column, t: Column, delay: int, jitter: int) -> Column:
    """When a row is published: its time, the delay and a jitter from a hash of its id."""
    return t + delay + F.pmod(F.conv(F.substring(F.md5(uid.cast("string")), 1, 7), 16, 10).cast("bigint"), F.lit(jitter + 1))


def released(df: DataFrame, now: int, delay: int, jitter: int, uid: str = "id") -> DataFrame:
    """Rows whose publication time has passed."""
    return df.withColumn("public_at", publication(F.col(uid), F.col("t"), delay, jitter)).where(F.col("public_at") <= now)


def public_projection(df: DataFrame, columns=("id", "ip", "t", "label", "severity", "path", "method", "status")) -> DataFrame:
    return df.select(*columns)


def redistributable(df: DataFrame, provider: str = "provider", forbidden=("p1", "p3")) -> DataFrame:
    """Data of providers that forbid redistribution is masked."""
    return df.withColumn("data", F.when(~F.col(provider).isin(*forbidden), F.col("data")))


def unmatched(df: DataFrame, labels: str, weak: tuple[str, ...] = UNMATCHED_LABELS) -> DataFrame:
    """No rule matched: every label is one that no rule gives."""
    return df.where(F.forall(labels, lambda x: x.isin(*weak)))


def is_global(key: Column) -> Column:
    """Whether the address of a key is a global one; forms that hold an IPv4 address are as global as that. Null keys are not."""
    spans = lambda networks: [(f"{V4 if n.version == 4 else ''}{int(n[0]):0{8 if n.version == 4 else 32}x}", f"{V4 if n.version == 4 else ''}{int(n[-1]):0{8 if n.version == 4 else 32}x}") for n in map(ipaddress.ip_network, networks)]

    def inside(c: Column, networks) -> Column:
        out = F.lit(False)
        for low, high in spans(networks):
            out = out | c.between(low, high)
        return out

    def is_open(k: Column) -> Column:
        held = F.when(is_v4(k), k)
        for network, first in EMBEDDING.items():
            held = held.when(inside(k, [network]), F.concat(F.lit(V4), F.substring(k, first, 8)))
        return ~bound(held, lambda v4: F.when(v4.isNotNull(), inside(v4, NOT_GLOBAL_V4)).otherwise(inside(k, NOT_GLOBAL_V6)))

    return F.coalesce(bound(key, is_open), F.lit(False))


def routable_only(df: DataFrame, key: str = "ip_key") -> DataFrame:
    return df.where(is_global(F.col(key)))


def exclude(df: DataFrame, *gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in none of the tables."""
    for t in gone:
        df = df.join(t.select(key), key, "left_anti")
    return df
