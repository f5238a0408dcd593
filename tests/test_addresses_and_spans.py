"""Addresses of both families against the standard library, and joins on spans of time against plain loops."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from netloom.functions import net
from netloom.operators import joins
from netloom.sources import payloads

FORMS = ["::", "::1", "1::", "fe80::1%em0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:0:0:2:0:0:0:3", "2001:DB8::A", "1::2::3", ":::", "1:2:3:4:5:6:7", "12345::", "::1.2.3.400", "64:ff9b::1.2.3.4", "g::", "10.0.0.1", "", " ", None, "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "ff02::1", "fd00::1", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "1:", "1.2.3.4.5", "::1.2.3", "1:2:3:4:5:6:1.2.3.4"]


def parsed(text):
    try:
        return ipaddress.ip_address((text or "x").partition("%")[0])
    except ValueError:
        return None


def made_addresses(n, seed=1):
    r = random.Random(seed)
    for _ in range(n):
        number = r.getrandbits(128)
        for k in range(8):
            number &= ~(0xFFFF << (16 * k)) if r.random() < 0.5 else -1
        address = ipaddress.IPv6Address(number)
        yield r.choice([str(address), address.exploded, str(address).upper()])


def test_keys_texts_and_prefixes(spark):
    r = random.Random(2)
    rows = [(a, r.randrange(129)) for a in [*FORMS, *made_addresses(150)]]
    a = F.col("a")
    got = spark.createDataFrame(rows, "a string, b int").select("a", "b", net.ip_key(a).alias("key"), net.ip_canonical(a).alias("text"), net.ip_network(a, F.col("b")).alias("network"), net.ip_in_prefix(a, F.lit("2000::"), F.lit(3)).alias("inside"), net.halves(a).alias("h")).collect()
    for row in got:
        x = parsed(row.a)
        assert row.key == (None if x is None else f"{int(x):032x}") and row.text == (None if x is None else str(x))
        if x is None or row.b > x.max_prefixlen:
            assert row.network is None
        else:
            assert row.network == str(ipaddress.ip_network((str(x), row.b), strict=False).network_address)
        assert row.inside == (None if x is None else x.version == 6 and x in ipaddress.ip_network("2000::/3"))
    six = sorted((r for r in got if r.h is not None and r.h.family == 6), key=lambda r: (r.h.high, r.h.low))
    assert [r.key for r in six] == sorted(r.key for r in six)


def test_longest_prefixes_of_both_families(spark):
    r = random.Random(3)
    nets = [(1, "2001:db8::", 32, "detected"), (2, "2001:db8:0:1::", 64, "operator"), (3, "2001:db8::1:0:0:0:5", 127, "detected"), (4, "::", 0, "detected"), (5, "0.0.0.0", 0, "detected"), (6, "10.0.0.0", 8, "operator"), (7, "10.1.0.0", 16, "detected"), (8, "10.2.0.0", 33, "detected"), (9, "nonsense", 8, "detected"), (0, "2001:db8::", 32, "detected")]
    texts = ["2001:db8::1", "2001:DB8:0:1::9", "2001:db8:0:0:1:0:0:4", "fe80::1", "10.1.2.3", "11.0.0.1", "::ffff:10.0.0.1", "", None, *(f"2001:db8:0:{r.randrange(3)}::{r.randrange(9)}" for _ in range(20))]
    got = joins.longest_prefix_match(spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "address string"), spark.createDataFrame(nets, "interface_id long, network_address string, prefix_length int, origin string"))
    for row in got.collect():
        x, best = parsed(row.address), None
        for interface, network, bits, origin in nets:
            if x is None or (x.version == 6 and x.is_link_local) or parsed(network) is None or bits > parsed(network).max_prefixlen:
                continue
            n = ipaddress.ip_network((network, bits), strict=False)
            if n.version == x.version and x in n:
                best = min(filter(None, [best, (origin != "operator", -bits, interface)]))
        assert (row.interface_id, row.prefix_length) == ((best[2], -best[1]) if best else (None, None)), row


def test_ranges_of_both_families(spark, tmp_path):
    (tmp_path / "r.csv").write_text("end,start,asn,latitude,country_code\n8.8.9.255,8.8.8.0,1,1.5,US\n2001:dff::ffff,2001:d00::,2,x,DE\n9000::,7fff::,3,,\n9.9.9.9,2001::,4,,\n8.8.8.8,x,5,,\n127.255.255.255,126.0.0.0,6,,\n")
    ranges = payloads.read_ip_ranges(spark, str(tmp_path / "r.csv"))
    assert sorted(r.asn for r in ranges.collect()) == [1, 2, 3, 6] and ranges.filter("asn = 1").first().latitude == 1.5
    texts = ["8.8.8.8", "8.8.10.0", "::ffff:8.8.9.1", "2001:d01::1", "2001:dff::1:0", "8000::", "9000::", "9000::1", "10.0.0.1", "fd00::1", "126.0.0.0", None]
    got = {r.address: (r.lookup_state, r.asn) for r in joins.ip_range_join(spark.createDataFrame([(t,) for t in texts], "address string"), ranges).collect()}
    assert got == {"8.8.8.8": ("resolved", 1), "8.8.10.0": ("miss", None), "::ffff:8.8.9.1": ("resolved", 1), "2001:d01::1": ("resolved", 2), "2001:dff::1:0": ("miss", None), "8000::": ("resolved", 3), "9000::": ("resolved", 3), "9000::1": ("miss", None), "126.0.0.0": ("resolved", 6)}


def test_networks_are_detected_in_both_families(spark):
    rows = [("em1", "2001:db8:1::5", 64), ("em1", "2001:db8:1::9", 64), ("em1", "fe80::1", 64), ("em1", "fe00::1", 8), ("em1", "::ffff:10.0.0.1", 120), ("em1", "2001:db8::7", 128), ("em2", "10.1.2.3", 24), ("em2", "10.1.2.3", 32), ("em2", "x", 24)]
    got = payloads.detect_networks(spark.createDataFrame(rows, "device string, address string, prefix_length int"), detected_at=1).collect()
    assert sorted((r.device, r.network_address, r.prefix_length, r.address_family) for r in got) == [("em1", "2001:db8:1::", 64, 6), ("em2", "10.1.2.0", 24, 4)]


@pytest.mark.parametrize("width", [1, 10, 3600])
def test_intervals_meet_points_once(spark, width):
    r = random.Random(width)
    at = [r.choice([r.randrange(-50, 50), r.randrange(0, 20_000), r.randrange(2**32), -(2**40), 2**40]) for _ in range(120)] + [None]
    ends = [(r.choice("ab"), *sorted((r.choice(at[:-1]), r.choice(at[:-1]) + r.randrange(90)))) for _ in range(60)]
    ends += [("a", None, None), ("b", 7, None), ("a", None, 0), ("b", 9, 8), (None, 0, 10), ("a", -(2**50), 2**50), ("b", 100, 100 + 17 * width)]
    points = spark.createDataFrame([(i, r.choice("ab"), t) for i, t in enumerate(at)], "p int, k string, at long")
    spans = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "s int, k string, low long, high long")
    got = [(x.p, x.s) for x in joins.binned_range_join(points, spans, at="at", low="low", high="high", width=width, on=["k"]).collect()]
    want = [(p.p, i) for p in points.collect() for i, (k, low, high) in enumerate(ends) if p["at"] is not None and p.k == k and (low is None or p["at"] >= low) and (high is None or p["at"] <= high)]
    assert sorted(got) == sorted(want) and len(got) > 500
    anyone = joins.binned_range_join(points, spans.drop("k"), at="at", low="low", high="high", width=width)
    assert anyone.count() == sum(1 for t in at for _, low, high in ends if t is not None and (low is None or t >= low) and (high is None or t <= high))
    assert joins.binned_range_join(points, spans.limit(0), at="at", low="low", high="high", width=width, on=["k"]).count() == 0


def test_long_intervals_are_few_rows(spark):
    ends = [(1400000000, 1715360000), (1400000000, None), (None, 1400000000), (None, None), (1400000123, 1400000124), (1400000000, 1400000000 + 3600 * 40)]
    size = F.size(joins.span_cover(F.col("a"), F.col("b"), width=3600)).alias("n")
    assert all(r.n < 64 for r in spark.createDataFrame(ends, "a long, b long").select(size).collect())


def test_evidence_is_joined_by_key_and_span(spark):
    q = spark.createDataFrame([(1, "pc", 5)], "key long, label string, at long")
    held = spark.createDataFrame([("pc", "10.0.0.1", None, None)], "hostname_label string, address string, starts_at long, expires_at long")
    found = joins.lease_at(q, held)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "resolved", "10.0.0.1")]
    on = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("_span" in line and "_level" in line and "label" in line for line in on)
