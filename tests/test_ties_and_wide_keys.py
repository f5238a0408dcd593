"""Ties and identifiers that only larger tables have."""

from pyspark.sql import functions as F

from netloom.operators import derive, quality
from netloom.sources import payloads


def test_of_equal_leases_the_least_id_names_the_client(spark):
    rows = [(i, "c1", None, None, None, "10.0.0.1", f"h{i}", 1, 100) for i in (7, 3, 9)]
    leases = spark.createDataFrame(rows, "id long, dhcp_client_id string, duid string, iaid string, mac string, address string, hostname string, interface_id long, observed_at long")
    for given in (leases, leases.orderBy("id"), leases.orderBy(F.desc("id"))):
        assert [r.hostname for r in derive.client_identity(given.coalesce(1)).collect()] == ["h3"]


def test_the_newest_check_is_told_apart_from_the_last_in_order(spark):
    checks = spark.createDataFrame([(1, "reachable", 50, 9, 0), (1, "failed", 40, 12, -8), (1, "reachable", 30, 12, -9)], "provider_id long, state string, checked_at long, sequence long, first long")
    providers = spark.createDataFrame([(1, "a"), (2, "b")], "id long, provider_key string")
    got = quality.source_availability(providers, checks, order=("sequence", "first")).collect()
    assert sorted((r.id, r.state, r.checked_at or 0) for r in got) == [(1, "failed", 50), (2, "never_checked", 0)]


def test_a_source_has_its_own_rule_for_addresses(spark):
    raw = spark.createDataFrame([("10.0.0.584", "a"), ("h1", "a")], "client string, domain string")
    raw = raw.select("*", *(F.lit("1").alias(c) for c in payloads.LOOKUP.names if c not in raw.columns))
    own = payloads.parse_lookups(raw, logged=F.col("client").rlike(r"^\d+(\.\d+){3}$")).collect()
    assert sorted((r.client_address or "", r.client_hostname or "") for r in own) == [("", "h1"), ("10.0.0.584", "")]
    assert all(r.client_address is None for r in payloads.parse_lookups(raw).collect())
