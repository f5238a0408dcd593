"""Rules of single operators on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from netloom.functions import names, net
from netloom.functions import time as t
from netloom.operators import derive, joins, reads, rollup, windows
from netloom.sources import payloads, sinks


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_iso_and_syslog_stamps(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("Dec 31 23:59:59",), ("nonsense",), (None,)], "v string")
    got = df.select(t.normalise_iso(F.col("v"), 3600).alias("iso"), t.normalise_syslog(F.col("v"), F.lit(1704067300).cast("bigint")).alias("log")).collect()
    assert [r.iso for r in got] == [1704164645, 1704161045, None, None, None]
    assert got[2].log == 1704067199 and got[3].log is None  # the year before, since it is nearer


def test_address_kit(spark):
    rows = [("10.1.2.3", 4, False), ("8.8.8.8", 4, True), ("2001:db8::1", 6, True), ("fe80::1", 6, False), ("256.1.1.1", None, False), ("", None, False), (None, None, False)]
    df = spark.createDataFrame([(a,) for a, _, _ in rows], "a string")
    got = df.select(net.ip_family(F.col("a")).alias("f"), net.is_public(F.col("a")).alias("p"), net.ip_key(F.col("a")).alias("k")).collect()
    assert [(r.f, r.p) for r in got] == [(f, p) for _, f, p in rows]
    assert got[0].k == f"{0x0A010203:032x}" and got[2].k == "20010db8000000000000000000000001" and got[4].k is None


def test_registrable_domain_classes(spark):
    rules = spark.createDataFrame([("com", "exact"), ("jp", "exact"), ("kobe.jp", "wildcard"), ("city.kobe.jp", "exception"), ("co.uk", "exact"), ("uk", "exact")], "rule string, kind string")
    want = {"example.com": "example.com", "a.b.example.com": "example.com", "com": None, "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "x.co.uk": "x.co.uk", "local": None, "a.local": "a.local"}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: r.registrable for r in names.registrable_domain(df, "n", rules).collect()} == want


LEG = "id long, observed_at long, direction string, action string, interface_device string, src_address string, src_port int, dst_address string, dst_port int, protocol string, ip_version int, ip_id int, tcp_seq long, src_is_this_firewall boolean, pair_outcome string, paired_flow_id long"


def leg(i, at, direction, device, src="10.0.0.1", fw=False, seq=7, action="pass"):
    return (i, at, direction, action, device, src, 1000, "203.0.113.9", 443, "tcp", 4, None, seq, fw, None, None)


@pytest.mark.parametrize(
    "legs, want",
    [
        ([leg(1, 10, "in", "em1"), leg(2, 11, "out", "em0")], {1: ("first_leg", 2), 2: ("second_leg", 1)}),
        ([leg(1, 10, "in", "em1"), leg(2, 12, "out", "em0")], {1: (None, None), 2: (None, None)}),
        ([leg(1, 10, "in", "em1"), leg(3, 10, "in", "em1"), leg(2, 10, "out", "em0")], {1: (None, None), 2: (None, None), 3: (None, None)}),
        ([leg(1, 10, "in", "em1"), leg(2, 9, "out", "em0", src="198.51.100.1", fw=True)], {1: ("first_leg", 2), 2: ("second_leg", 1)}),
        ([leg(2, 9, "out", "em0", src="198.51.100.1", fw=True)], {2: ("not_paired", None)}),
        ([leg(1, 10, "in", "em1", action="block"), leg(2, 10, "out", "em0")], {1: (None, None), 2: (None, None)}),
        ([leg(1, 10, "in", "em1", seq=None), leg(2, 10, "out", "em0", seq=None)], {1: ("first_leg", 2), 2: ("second_leg", 1)}),
    ],
)
def test_pairing(spark, legs, want):
    up = spark.createDataFrame([("em0",)], "device string")
    for order in (legs, legs[::-1]):
        got = joins.pair_legs(spark.createDataFrame(order, LEG), up)
        assert {r.id: (r.pair_outcome, r.paired_flow_id) for r in got.collect()} == want


RECORD = "held_in string, owner_name string, rrtype string, value string, address string, covered_from_at long, covered_until_at long"
LOOKUP = "lookup_key string, looked_up_at long, client_id long, client_address string, domain string, action string, answer_source string, client_resolution string"
FLOW = "id long, observed_at long, src_client_id long, src_address string, dst_address string, dst_interface_id long, dst_is_this_firewall boolean, pair_outcome string"


def attribute(spark, records, lookups, flows=((1, 1000, 5, "10.0.0.5", "203.0.113.1"),)):
    f = spark.createDataFrame([(*f, None, False, None) for f in flows], FLOW)
    look = spark.createDataFrame([(k, at, c, "10.0.0.5", d, "pass", s, "logged_address") for k, at, c, d, s in lookups], LOOKUP)
    return values(derive.attribute_sites(f, look, spark.createDataFrame(records, RECORD)), "flow_id", "site_name", "method", "delay_s")


def test_exact_through_an_alias(spark):
    records = [("cache", "edge.cdn.example", "A", "203.0.113.1", "203.0.113.1", 900, 2000), ("cache", "www.shop.example", "CNAME", "edge.cdn.example", None, 950, 2000)]
    assert attribute(spark, records, [("k", 960, 5, "www.shop.example", "Cache")]) == [(1, "www.shop.example", "resolver_cache_answer", 40)]
    assert attribute(spark, records, [("k", 940, 5, "www.shop.example", "Cache")]) == []  # before the path was covered


def test_two_exact_names_are_none(spark):
    records = [("cache", n, "A", "203.0.113.1", "203.0.113.1", 900, 2000) for n in ("a.example", "b.example")]
    assert attribute(spark, records, [("k", 990, 5, "a.example", "Cache"), ("l", 991, 5, "b.example", "Cache")]) == []


def test_timing_unless_contradicted(spark):
    look = [("k", 998, 5, "a.example", "Recursion")]
    assert attribute(spark, [], look) == [(1, "a.example", "lookup_timing", 2)]
    other = [("cache", "a.example", "A", "203.0.113.77", "203.0.113.77", 900, 2000)]
    assert attribute(spark, other, look) == []
    six = [("cache", "a.example", "AAAA", "2001:db8::1", "2001:db8::1", 900, 2000)]
    assert attribute(spark, six, look) == [(1, "a.example", "lookup_timing", 2)]
    assert attribute(spark, [], [*look, ("l", 999, 5, "b.example", "Recursion")]) == []


def test_intervals_extend_only_over_consecutive_polls(spark):
    rows = [(1, at, "h", "A", "x", 10) for at in (100, 200, 400)] + [(1, 300, "other", "A", "y", 10)]
    got = windows.record_intervals(spark.createDataFrame(rows, "provider_id long, read_at long, owner_name string, rrtype string, value string, ttl long")).filter("owner_name = 'h'")
    assert values(got, "first_seen_at", "last_seen_at", "covered_from_at", "covered_until_at") == [(100, 200, 100, 210), (400, 400, 300, 410)]


def test_counter_reset_has_no_rate(spark):
    rows = [("a", "m", 0, 10.0), ("a", "m", 10, 30.0), ("a", "m", 20, 5.0), ("a", "m", 20, 6.0)]
    got = windows.counter_rates(spark.createDataFrame(rows, "subject_key string, measure string, sampled_at long, value double"))
    assert values(got, "sampled_at", "rate", "reset") == [(10, 2.0, False), (20, None, True)]


def test_upsert_rules(spark):
    schema = "id long, name string, seen long, first long"
    old = spark.createDataFrame([(1, "a", 5, 5)], schema)
    new = spark.createDataFrame([(1, None, 4, 9, 1), (2, "c", 7, 7, 1), (2, "d", 6, 8, 2)], schema + ", at long")
    got = sinks.merge_upsert(old, new, keys=["id"], rules={"name": "coalesce", "seen": "max", "first": "keep"}, order="at")
    assert values(got, "id", "name", "seen", "first") == [(1, "a", 5, 5), (2, "d", 7, 7)]
    fresh = sinks.insert_if_new(old, new, keys=["id"], order="at", at="seen", horizon=5)
    assert values(fresh, "id", "name") == [(2, "c")]


def test_slots_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "slots")
    sinks.write_slots(spark.createDataFrame([(0, 1), (3600, 2)], "period_start_at long, bytes long"), path, period="1h")
    sinks.write_slots(spark.createDataFrame([(3600, 9)], "period_start_at long, bytes long"), path, period="1h")
    assert values(spark.read.parquet(path), "period_start_at", "bytes") == [(0, 1), (3600, 9)]
    for _ in range(2):
        sinks.write_snapshot(spark.createDataFrame([("x", "{}")], "item_key string, attributes string"), path + "-set", set_key="s", captured_at=5)
    assert spark.read.parquet(path + "-set").count() == 1


def test_flow_log_payload(spark, tmp_path):
    good = {"__digest__": "d1", "__timestamp__": "2024-01-02T03:04:05Z", "interface": "em1", "action": "Pass", "dir": "in", "ipversion": "4", "length": "60", "src": "10.0.0.1", "dst": "8.8.8.8", "protoname": "TCP", "rid": "r1"}
    rows = [good, good | {"__digest__": "d2", "length": "x"}, good | {"__digest__": ""}, good | {"__digest__": "d3", "action": "nat"}]
    (tmp_path / "log.json").write_text(json.dumps(rows))
    raw = payloads.read_enveloped_json(spark, str(tmp_path / "log.json"), payloads.FLOW_LOG)
    flow, rejected = payloads.parse_flow_log(raw, reference_at=F.lit(1704164645).cast("bigint"))
    assert values(flow, "log_digest", "action", "observed_at") == [("d1", "pass", 1704164645), ("d3", "unknown", 1704164645)]
    assert values(rejected, "log_digest", "reject_reason") == [("d2", "length")]
    rule = spark.createDataFrame([("r1", 4)], "pf_label string, id long")
    im = spark.createDataFrame([("em9",)], "device string")
    assert values(payloads.resolve_flow_keys(flow, im, rule), "rule_lookup_state", "interface_lookup_state")[0] == ("resolved", "not_found")


def test_other_payloads(spark, tmp_path):
    (tmp_path / "env.json").write_text(json.dumps({"rows": [{"client": "10.0.0.1", "domain": "a.example", "time": "5", "action": "Pass"}, {"client": "host", "domain": "b.example", "time": "6", "action": "Drop"}]}))
    look = payloads.parse_lookups(payloads.read_enveloped_json(spark, str(tmp_path / "env.json"), payloads.LOOKUP))
    assert values(look, "client_address", "client_hostname", "action", "looked_up_at") == [("10.0.0.1", None, "pass", 5), (None, "host", "drop", 6)]
    raw = spark.createDataFrame([("4.3.2.1.in-addr.arpa.", "PTR", "Host.Example.", "60"), ("a.example", "A", "1.2.3.4", "x"), ("a.example", "MX", "m", None), ("b.example", "AAAA", "2001:db8::1", None)], "host string, rrtype string, value string, ttl string")
    records, tally = payloads.parse_resource_records(raw, held_in="cache")
    assert values(records, "owner_name", "value", "address") == [("4.3.2.1.in-addr.arpa", "host.example", "1.2.3.4"), ("b.example", "2001:db8::1", "2001:db8::1")]
    assert values(tally, "reason", "skipped") == [("ttl", 1), ("type", 1)]
    leases = payloads.parse_leases(spark.createDataFrame([("10.0.0.9", "AA-BB-CC-00-11-22", "Pc.lan", None, None, None, "em1", "1000", "600", "0", None)], payloads.LEASE), backend="kea", observed_at=500)
    assert values(leases, "mac", "hostname_label", "starts_at", "generation_key", "lease_state") == [("aa:bb:cc:00:11:22", "pc", 400, "start:400", "active")]
    networks = payloads.detect_networks(spark.createDataFrame([("em1", "192.168.7.9", 24), ("em1", "169.254.1.1", 16)], "device string, address string, prefix_length int"), detected_at=1)
    assert values(networks, "network_address", "prefix_length") == [("192.168.7.0", 24)]
    samples = payloads.parse_counter_samples(spark.createDataFrame([("em1", "12.5 ms", None)], "name string, delay string, loss string"), subject_kind="gateway", subject=F.col("name"), sampled_at=F.lit(1), measures={"delay": ("ms", ["rtt", "delay"]), "loss": ("%", ["loss"])})
    assert values(samples, "measure", "value") == [("delay", 12.5)]


def test_what_cannot_be_read_is_rejected_with_its_reason(spark, tmp_path):
    files = {"a.json": '[{"domain": "a"}, 5, null, {"domain": "b"}]', "b.json": "[{", "c.json": " ", "d.json": "7", "e.json": '{"rows": [{"domain": "c"}]}', "f.json": '{"m1": {"domain": "d"}, "m2": [1]}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got, rejected = payloads.read_with_rejects(spark, str(tmp_path), payloads.LOOKUP)
    assert values(got, "member", "domain") == [("m1", "d"), (None, "a"), (None, "b"), (None, "c")]
    found = sorted((r.path.rpartition("/")[2], r.reason, r["at"]) for r in rejected.collect())
    assert found == [("a.json", "element", 1), ("a.json", "element", 2), ("b.json", "json", None), ("c.json", "empty", None), ("d.json", "shape", None), ("f.json", "element", 1)]


def test_repeated_dimensions_do_not_multiply_records(spark):
    flow = spark.createDataFrame([(1, "em1", "r1"), (2, None, "r2")], "id long, interface_device string, rid string")
    im = spark.createDataFrame([("em1",), ("em1",)], "device string")
    rule = spark.createDataFrame([("r1", 9), ("r1", 4)], "pf_label string, id long")
    got = payloads.resolve_flow_keys(flow, im, rule)
    assert values(got, "id", "rule_id", "interface_lookup_state", "rule_lookup_state") == [(1, 4, "resolved", "resolved"), (2, None, "pending", "not_found")]


def test_names_in_their_own_script(spark):
    rules = spark.createDataFrame([("com", "exact"), ("cn", "exact"), ("公司.cn", "exact"), ("xn--fiqs8s", "exact"), ("de", "exact")], "rule string, kind string")
    want = {"食狮.com.cn": "com.cn", "食狮.公司.cn": "食狮.公司.cn", "www.食狮.公司.cn": "食狮.公司.cn", "公司.cn": None, "www.xn--85x722f.xn--55qx5d.cn": "xn--85x722f.xn--55qx5d.cn", "食狮.中国": "食狮.中国", "中国": None, "www.bücher.de": "bücher.de"}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: r.registrable for r in names.registrable_domain(df, "n", rules).collect()} == want


def test_fractions_of_any_length(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z",), ("2024-01-02T03:04:05.1Z",), ("2024-01-02T03:04:05.123456789",)], "v string")
    assert [r[0] for r in df.select(t.normalise_iso(F.col("v"), 3600)).collect()] == [1704164645, 1704164645, 1704161045]


def test_rates_split_by_direction_only_where_peers_agree(spark):
    rows = [("interface_endpoint", "em1 10.0.0.1", "rate_bits_in", 5.0, 100), ("interface_endpoint", "em1 10.0.0.1", "rate_bits_out", 7.0, 100), ("interface_endpoint", "em1 10.0.0.1", "rate_bits_out", 99.0, 90),
            ("interface_endpoint", "em1 10.0.0.2", "rate_bits_in", 1.0, 100), ("interface_endpoint", "em0 203.0.113.1", "rate_bits_out", 8.0, 100), ("interface_endpoint", "em1 10.0.0.3", "rate_bits_out", 50.0, 10),
            ("interface_endpoint_pair", "em1 10.0.0.1 8.8.8.8", "rate_bits_in", 2.0, 100), ("interface_endpoint_pair", "em1 10.0.0.1 9.9.9.9", "rate_bits_in", 3.0, 90), ("interface_endpoint_pair", "em1 10.0.0.2 8.8.8.8", "rate_bits_in", 4.0, 100), ("interface_endpoint_pair", "em1 10.0.0.2 10.0.1.1", "rate_bits_in", 6.0, 100)]
    samples = spark.createDataFrame(rows, "subject_kind string, subject_key string, measure string, value double, sampled_at long")
    placed = spark.createDataFrame([("10.0.0.1", 1), ("10.0.0.2", 1), ("10.0.1.1", 2), ("8.8.8.8", None)], "address string, interface_id long")
    got = reads.current_rates_by(samples, placed=placed, client_of=spark.createDataFrame([("10.0.0.1", 4)], "address string, client_id long"), clients=spark.createDataFrame([(4, None)], "id long, owner_id long"), now=110, interval_s=30)
    assert values(got, "grouping", "key", "in_rate", "out_rate", "out_measured") == sorted([("client", "4", 5.0, 7.0, True), ("device", "em0", 0.0, 8.0, True), ("device", "em1", 6.0, 7.0, False), ("direction", "inbound", 6.0, None, False), ("direction", "inter_interface", 6.0, None, False), ("direction", "outbound", 0.0, 7.0, True), ("owner", None, 5.0, 7.0, True), ("unsplit", None, 0.0, None, False)], key=str)


def test_lost_files_are_one_gap_and_only_where_the_list_answered(spark):
    marks = spark.createDataFrame([(1, "0", 4096, 10, "rotated"), (1, "1", 7, 20, "current"), (1, "2", 5, 5, "lost"), (2, "0", 9, 10, "rotated")], "provider_id long, file_id string, byte_offset long, observed_at long, rotation_state string")
    listed = spark.createDataFrame([(1, "1"), (1, "1")], "provider_id long, file_id string")
    answered = spark.createDataFrame([(1,)], "provider_id long")
    gaps, after = derive.lost_files(marks, listed, answered, now=99)
    assert values(gaps, "provider_id", "file_id", "interval_start_at", "interval_end_at", "byte_offset") == [(1, "0", 10, 99, 4096)]
    assert values(after, "provider_id", "file_id", "byte_offset", "rotation_state") == [(1, "0", 4096, "lost"), (1, "1", 7, "current"), (1, "2", 5, "lost"), (2, "0", 9, "rotated")]
    assert derive.lost_files(after, listed, answered, now=100)[0].count() == 0


def test_order_at_the_sink(spark, tmp_path):
    sinks.write_ordered(spark.range(40).selectExpr("id % 7 as n", "id as k"), str(tmp_path / "o"), measure="n", key="k")
    got = [(r.n, r.k) for r in spark.read.parquet(str(tmp_path / "o")).withColumn("f", F.input_file_name()).collect()]
    assert sorted(got, key=lambda r: (-r[0], r[1])) == [(i % 7, i) for i in sorted(range(40), key=lambda i: (-(i % 7), i))]


def test_suffix_list_and_ranges(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// comment\n\ncom\n*.ck\n!www.ck extra\n")
    assert values(payloads.read_suffix_rules(spark, str(tmp_path / "list.dat")), "rule", "kind") == [("ck", "wildcard"), ("com", "exact"), ("www.ck", "exception")]
    (tmp_path / "r.csv").write_text("start,end,country_code,asn,operator,dataset_build_at\n8.8.8.0,8.8.9.255,US,15169,dns,1\n")
    found = joins.ip_range_join(spark.createDataFrame([("8.8.8.8",), ("9.9.9.9",), ("10.0.0.1",)], "address string"), payloads.read_ip_ranges(spark, str(tmp_path / "r.csv")))
    assert values(found, "address", "lookup_state", "asn") == [("8.8.8.8", "resolved", 15169), ("9.9.9.9", "miss", None)]


def test_refresh_rewrites_touched_slots_only(spark):
    from netloom.plans.inputs import Tables

    x = Tables(spark, "/root/testdata/sf0.001")
    hours = x.flow.orderBy("id").limit(3).select(t.slot_start(F.col("observed_at"), "1h").alias("period_start_at"))
    out = rollup.refresh(x.flow, x.client, x.attribution, hours)
    whole = rollup.periods(rollup.rule_1h(x.flow), "rule")
    for period in t.PERIODS:
        wanted = hours.select(t.slot_start(F.col("period_start_at"), period).alias("period_start_at")).distinct()
        a, b = out["rule", period], whole[period].join(wanted, "period_start_at", "left_semi")
        columns = sorted(b.columns)
        assert values(a, *columns) == values(b, *columns)


def test_range_join_with_open_bounds(spark):
    from netloom.operators.joins import binned_range_join

    points = spark.createDataFrame([(i,) for i in (-25, 0, 7, 30)], "at long")
    spans = spark.createDataFrame([("all", None, None), ("from", 7, None), ("until", None, 0), ("both", 1, 8), ("none", 9, 8), ("beyond", 99, None)], "name string, low long, high long")
    got = {(r.name, r["at"]) for r in binned_range_join(points, spans, at="at", low="low", high="high", width=10).collect()}
    assert got == {("all", -25), ("all", 0), ("all", 7), ("all", 30), ("from", 7), ("from", 30), ("until", -25), ("until", 0), ("both", 7)}
