"""Peers of a slot are one row each in their family: regrouping must not aggregate them again by peer."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__
from netloom.operators import rollup


@pytest.mark.parametrize("period", ["1h", "30d"])
def test_peers_are_aggregated_once(spark, period):
    plan = __spark_entry__.queries()[f"a06_client_{period}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    per_period = {"1h": 1, "30d": 3}[period]
    # Twice (before and after an exchange) for each period on the way, and twice by client.
    assert plan.count("HashAggregate(") == 2 * per_period + 2


def test_a_missing_peer_is_not_counted(spark):
    sums = dict.fromkeys(("bytes", "allowed_bytes", "blocked_bytes", "unknown_bytes", "allowed_connections", "blocked_connections", "unknown_connections"), 1)
    rows = [dict(period_start_at=0, client_id=c, traffic_direction="outbound", peer_address=p, **sums) for c, p in ((1, "a"), (1, "b"), (1, None), (2, None))]
    peer = spark.createDataFrame(rows, "period_start_at long, client_id long, traffic_direction string, peer_address string, " + ", ".join(f"{m} long" for m in sums))
    assert {r.client_id: (r.distinct_peers, r.bytes) for r in rollup.regroup_client(peer).collect()} == {1: (2, 3), 2: (0, 1)}
