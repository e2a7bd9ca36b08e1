"""Addresses and networks against the standard library's ipaddress."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from rankweave.operators import access_log

WRITTEN = [
    "2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "::", "::1", "1::", "::ffff:10.1.2.3", "2001:db8:0:1:1:1:1:1", "fe80::1:2", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "10.0.0.1", "255.255.255.255", "0.0.0.0",
    "1:2:3:4:5:6:7:8:9", "1::2::3", "1:2:3", "12345::", "g::", "10.0.0", "10.0.0.256", "10.0.0.01", "", ":", ":::", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4", "host", "1:2:3:4::5:6:7:8", ":1:2:3:4:5:6:7",
]


def plain(text):
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{int(found):0{8 if found.version == 4 else 32}x}"


def test_addresses_in_canonical_form(spark):
    got = spark.createDataFrame([(t,) for t in WRITTEN], "ip string").select("ip", access_log.address(F.col("ip")).alias("a")).collect()
    assert {r["ip"]: r["a"] for r in got} == {t: plain(t) for t in WRITTEN}


def test_networks_of_any_length(spark):
    rng = random.Random(6)
    near = int(ipaddress.ip_address("2001:db8:40::"))
    hits = [str(ipaddress.IPv6Address(near ^ rng.getrandbits(rng.randint(1, 100)))) for _ in range(200)]
    hits += [ipaddress.IPv6Address(near ^ rng.getrandbits(90)).exploded for _ in range(50)] + [str(ipaddress.IPv4Address(int(ipaddress.ip_address("10.32.0.0")) ^ rng.getrandbits(rng.randint(1, 26)))) for _ in range(200)]
    hits += ["nowhere", None, "::ffff:10.32.0.1"]
    nets = [f"2001:db8:40::/{n}" for n in (0, 12, 29, 30, 44, 47, 61, 100, 128)] + ["2001:0db8:0040:1::/44", "2001:DB8::/32"] + [f"10.32.0.0/{n}" for n in (0, 7, 9, 13, 22, 31, 32)] + ["10.32.99.7/11", "bad/8", "10.0.0.0/33", "10.0.0.0"]
    known = []
    for n in nets:
        try:
            if "/" in n:
                known.append((n, ipaddress.ip_network(n, strict=False)))
        except ValueError:
            continue
    want = {(k, n) for k, h in enumerate(hits) if plain(h) for n, net in known if ipaddress.ip_address(h).version == net.version and ipaddress.ip_address(h) in net}
    rows = spark.createDataFrame(list(enumerate(hits)), "k long, ip string")
    got = access_log.in_networks(rows, spark.createDataFrame([(n, n) for n in nets], "cidr string, name string"))
    assert got.columns == ["k", "ip", "name"]
    assert {(r["k"], r["name"]) for r in got.collect()} == want
    assert access_log.in_networks(rows, spark.createDataFrame([], "cidr string, name string")).count() == 0
