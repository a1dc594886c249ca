"""Address keys, ranges and global addresses against Python's ipaddress."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from harrow.functions import columns as C
from harrow.operators import filters as P


def key(ip):
    a = ipaddress.ip_address(ip)
    return f"{'0' * 20}ffff{int(a):08x}" if a.version == 4 else f"{int(a):032x}"


def test_keys_of_any_address(spark):
    rng = random.Random(1)
    texts = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(100)]
    for _ in range(200):
        n = rng.getrandbits(128) & rng.choice([(1 << 128) - 1, 0xFFFF << 112 | 0xFFFF, 0xFFFFFFFF << 32, 0xF0F << 60])
        a = ipaddress.IPv6Address(n)
        texts += [str(a), a.exploded, str(a).upper()]
    texts += ["::", "::1", "1::", "::ffff:1.2.3.4", "::FFFF:1.2.3.4", "64:ff9b::10.1.2.3"]
    bad = ["", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", "1:2:3", "1::2::3", "::1.2.3", "1:2:3:4:5:6:7:8:9", "12345::", ":::", "1:", ":1", None, "1.2.3.4/8"]
    df = spark.createDataFrame([(t,) for t in texts + bad], "ip string").select("ip", C.ip_key(F.col("ip")).alias("k")).collect()
    assert {r["ip"]: r["k"] for r in df if r["ip"] in texts} == {t: key(t) for t in texts}
    assert [(r["ip"], r["k"]) for r in df if r["ip"] not in texts and r["k"] is not None] == []


def test_every_prefix_length(spark):
    rng = random.Random(2)
    nets = [f"{ipaddress.ip_address(rng.getrandbits(32))}/{n}" for n in range(33)] + [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{n}" for n in range(129)]
    nets += ["10.0.0.0/22", "10.0.0.0/9", "10.0.0.0/25", "2001:db8::/61"]
    bad = ["10.0.0.0/33", "1::/129", "10.0.0.0/", "10.0.0.0/x", "x/8", "10.0.0.0/-1", None]
    low, high = C.net_range(F.col("net"))
    for r in spark.createDataFrame([(n,) for n in nets + bad], "net string").select("net", low.alias("low"), high.alias("high")).collect():
        if r["net"] in bad:
            assert (r["low"], r["high"]) == (None, None), r["net"]
        else:
            n = ipaddress.ip_network(r["net"], strict=False)
            assert (r["low"], r["high"]) == (key(n[0]), key(n[-1])), r["net"]


@pytest.mark.parametrize(
    ("q", "found"),
    [
        ("10.0.0.0/22", {"10.0.1.1"}), ("10.0.9.1", {"10.0.9.1"}), ("::ffff:10.0.9.1", {"10.0.9.1"}), ("10.", {"10.0.1.1", "10.0.9.1"}), ("::/0", {"2001:db8::1", "::1"}),
        ("0.0.0.0/0", {"10.0.1.1", "10.0.9.1"}), ("2001:DB8:0::1", {"2001:db8::1"}), ("2001:DB", {"2001:db8::1"}), ("evil%", set()), ("10.0.0.0/99", set()), ("", {"10.0.1.1", "10.0.9.1", "2001:db8::1", "::1"}),
    ],
)
def test_ip_query(spark, q, found):
    df = spark.createDataFrame([("10.0.1.1",), ("10.0.9.1",), ("2001:db8::1",), ("::1",)], "ip string").withColumn("ip_key", C.ip_key(F.col("ip")))
    assert {r["ip"] for r in P.filter_ip_query(df, q).collect()} == found


def test_global_addresses(spark):
    closed = ["0.0.0.1", "10.1.1.1", "100.64.1.1", "100.127.255.255", "127.0.0.1", "169.254.169.254", "172.31.255.255", "192.0.0.1", "192.88.99.1", "192.168.0.1", "198.19.0.1", "224.0.0.1", "240.0.0.1", "255.255.255.255"]
    closed += ["::", "::1", "::8.8.8.8", "::ffff:10.0.0.1", "64:ff9b::10.0.0.1", "::ffff:0:127.0.0.1", "2002:a00:1::1", "64:ff9b:1::1", "100::1", "2001::1", "2001:1ff::1", "5f00::1", "fd00::1", "fe80::1", "fec0::1", "ff02::1", "nonsense", None]
    opened = ["1.1.1.1", "100.63.255.255", "100.128.0.1", "172.32.0.1", "192.0.1.1", "198.20.0.1", "203.0.113.5", "223.255.255.255", "2001:200::1", "2001:db8::1", "64:ff9b::8.8.8.8", "2002:808:808::1", "::ffff:0:8.8.8.8", "::ffff:8.8.8.8", "2a00::1"]
    df = spark.createDataFrame([(a,) for a in closed + opened], "ip string").withColumn("ip_key", C.ip_key(F.col("ip")))
    assert {r["ip"] for r in P.routable_only(df).collect()} == set(opened)
