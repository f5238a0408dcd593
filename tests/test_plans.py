"""Plans keep their shape: no nested loops over growing inputs, filters and columns reach the scans."""

import re

import pytest

from netloom.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j05_longest_prefix_match", "j06_ip_range_join", "j07_pair_legs", "j08_match_lookups_by_time", "j14_gap_overlap", "h1_binned_range_join", "d01_place_addresses", "d02_mark_this_firewall", "d08_attribute_sites", "r01_volume_window", "r04_connection_tree_interface", "r17_screen_matrix", "r22_screen_map", "a09_refresh_month"])
def test_no_nested_loop_over_growing_inputs(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    from netloom.functions.time import in_window
    from netloom.operators import reads

    path = f"{FOLDER}/orders.parquet"
    rows = spark.read.parquet(path).selectExpr("o_orderkey as id", "o_custkey as observed_at", "o_orderstatus as action", "o_totalprice as packet_bytes")
    text = plan(rows.filter(in_window("observed_at", 10, 20)).groupBy("action").sum("packet_bytes"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_custkey,10\)", text)
    assert "o_orderkey" not in re.search(r"ReadSchema: (\S+)", text)[1]
    assert reads.spine(rows, start=0, end=86400, period="1h").count() == 24
