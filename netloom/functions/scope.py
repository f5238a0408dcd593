"""What a classified record says about itself: direction, inside end, other end, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKED = ("block", "reject")
SEVERITIES = ("informational", "low", "medium", "high", "critical")
_inside = lambda side: F.col(f"{side}_interface_id").isNotNull()
_firewall = lambda side: F.col(f"{side}_is_this_firewall")


def traffic_scope() -> Column:
    return F.when(_firewall("src") | _firewall("dst"), "this_firewall").when(_inside("src") & _inside("dst"), "east_west").otherwise("north_south")


def traffic_direction() -> Column:
    return F.when(_firewall("src"), "from_this_firewall").when(_firewall("dst"), "to_this_firewall").when(_inside("src") & _inside("dst"), "inter_interface").when(_inside("src") | (~_inside("dst") & (F.col("direction") == "out")), "outbound").otherwise("inbound")


def classify(flow: DataFrame) -> DataFrame:
    """flow with traffic_direction, local interface and client, peer_address and exit_leg_device."""
    by_source = ~_firewall("src") & _inside("src")
    by_target = ~_firewall("dst")
    outside_target = F.when(~_inside("dst"), F.col("dst_address"))
    outside_source = F.when(~_inside("src"), F.col("src_address"))
    peer = (
        F.when(_firewall("src") & _firewall("dst"), None)
        .when(_firewall("src"), outside_target)
        .when(_firewall("dst"), outside_source)
        .when(_inside("src") & _inside("dst"), None)
        .when(_inside("src"), F.col("dst_address"))
        .when(_inside("dst"), F.col("src_address"))
        .otherwise(F.when(F.col("direction") == "out", F.col("dst_address")).otherwise(F.col("src_address")))
    )
    return flow.withColumns(
        {
            "traffic_scope": traffic_scope(),
            "traffic_direction": traffic_direction(),
            "local_interface_id": F.when(by_source, F.col("src_interface_id")).when(by_target, F.col("dst_interface_id")),
            "local_client_id": F.when(by_source, F.col("src_client_id")).when(by_target & _inside("dst"), F.col("dst_client_id")),
            "peer_address": peer,
            "exit_leg_device": F.when(F.col("pair_outcome") == "second_leg", F.col("interface_device")),
        }
    )


def not_second_leg() -> Column:
    return F.coalesce(F.col("pair_outcome") != "second_leg", F.lit(True))


def allowed() -> Column:
    return F.col("action") == "pass"


def blocked() -> Column:
    return F.col("action").isin(*BLOCKED)


def unknown() -> Column:
    return F.col("action") == "unknown"


def decision_measures(bytes_: str = "packet_bytes", connections: Column | None = None) -> list[Column]:
    """Seven sums: bytes in all and by outcome, connections by outcome."""
    n = F.lit(1) if connections is None else connections
    kinds = (("allowed", allowed()), ("blocked", blocked()), ("unknown", unknown()))
    total = [F.sum(bytes_).alias("bytes")]
    return total + [F.sum(F.when(c, F.col(bytes_)).otherwise(0)).alias(f"{k}_bytes") for k, c in kinds] + [F.sum(F.when(c, n).otherwise(0)).cast("bigint").alias(f"{k}_connections") for k, c in kinds]


MEASURES = ("bytes", "allowed_bytes", "blocked_bytes", "unknown_bytes", "allowed_connections", "blocked_connections", "unknown_connections")


def summed_measures() -> list[Column]:
    return [F.sum(m).alias(m) for m in MEASURES]


def severity(event: Column, rule: Column) -> tuple[Column, Column]:
    """(state, severity): the event's own, else its rule's, else unknown."""
    found = F.coalesce(event, rule)
    return F.when(found.isNull(), "unknown").otherwise("resolved"), found


def severity_rank(value: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), value)


def json_attribute(attributes: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(attributes), f"$.{key}", "string")
