"""Queries whose keys are larger than those of the given tables, against their statements."""

import duckdb
from pyspark.sql import functions as F

from netloom.functions import net
from netloom.registry import ORACLE_SQL, QUERIES


def test_groups_beyond_sixteen_bits_are_read_as_the_statement_does(spark, tmp_path):
    users = [1, 15, 16, 31, 32, 255, 4096, 65535, 65536, 65537, 0x15F8F, 131072, 539999, 0xFFFFFF]
    rows = [(i * 997 + e, u) for i, u in enumerate(users) for e in (1, 2, 3, 5, 10, 256, 996)]
    spark.createDataFrame(rows, "event_id long, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    columns = ["address", "key", "canonical", "network", "in_prefix", "public"]
    got = sorted(tuple(r) for r in QUERIES["f05_ip6_keys"](spark, str(tmp_path)).select(*columns).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['f05_ip6_keys']}) q").fetchall())
    assert len(got) == len(rows) and got == want


def test_to_the_functions_such_texts_are_no_addresses(spark):
    a = F.col("a")
    row = spark.createDataFrame([("2001:db8:15f8f::1",)], "a string").select(net.ip_key(a).alias("k"), net.ip_canonical(a).alias("c"), net.is_public(a).alias("p")).first()
    assert tuple(row) == (None, None, False)


def test_a_known_prefix_is_the_prefix_of_columns(spark):
    texts = ["2001:db8:1f::1", "2001:db8:20::", "2001:db8:f::ffff", "2001:db9::", "::1", "fe80::1", "8000::1", "::ffff:10.1.2.3", "10.1.2.3", "10.2.0.0", "203.0.1.255", "203.1.0.0", "255.255.255.255", "no", None]
    df, a = spark.createDataFrame([(t,) for t in texts], "a string"), F.col("a")
    for network, bits in (("2001:db8:1f::", 44), ("::", 0), ("8000::", 1), ("::1", 128), ("203.0.7.9", 16), ("10.1.2.3", 32), ("0.0.0.0", 0)):
        both = df.select(net.ip_in_prefix(a, network, bits).alias("known"), net.ip_in_prefix(a, F.lit(network), F.lit(bits)).alias("given")).collect()
        assert [r.known for r in both] == [r.given for r in both] and {True, None} <= {r.known for r in both}


def test_a_version_4_address_in_version_6_is_public_if_it_is(spark):
    mapped = {"::ffff:10.1.2.3": False, "::ffff:8.8.8.8": True, "::FFFF:7f00:1": False, "::ffff:a9fe:101": False, "8.8.8.8": True, "::1": False, "2001:db8::1": True, "ff02::1": False, "x": False}
    rows = spark.createDataFrame([(k,) for k in mapped], "a string").select("a", net.is_public(F.col("a")).alias("p")).collect()
    assert {r.a: r.p for r in rows} == mapped
