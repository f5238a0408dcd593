"""Retention: what goes, and what stays of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import scope
from netloom.functions.time import slot_end, slot_start

REMAINDER = ("src_interface_id", "dst_interface_id", "src_client_id", "local_client_id", "traffic_direction", "peer_address", "exit_leg_device", "rule_id", "site_name", "action")


def purge_to_hours(flow: DataFrame, attribution: DataFrame, *, horizon: int, now: int) -> tuple[DataFrame, DataFrame]:
    """(records kept, hourly remainder of those before the horizon)."""
    old = scope.classify(flow.filter(F.col("observed_at") < horizon)).join(attribution.select(F.col("flow_id").alias("id"), "site_name"), "id", "left")
    other = F.when(F.col("traffic_direction") == "inter_interface", F.col("dst_address")).otherwise(F.col("peer_address"))
    named = F.when(scope.not_second_leg(), F.col("site_name"))
    rows = old.withColumns({"hour_start_at": slot_start(F.col("observed_at"), "1h"), "peer_address": other, "site_name": named})
    rest = rows.groupBy("hour_start_at", *REMAINDER).agg(F.sum("packet_bytes").alias("bytes"), F.count(F.lit(1)).alias("connections")).withColumn("purged_at", F.lit(now).cast("bigint"))
    return flow.filter(F.col("observed_at") >= horizon), rest


def expire(df: DataFrame, at: str, horizon: int) -> DataFrame:
    """Rows from the horizon on; horizon 0 keeps all."""
    return df.filter(F.col(at) >= horizon) if horizon else df


def expire_referenced(df: DataFrame, at: str, horizon: int, *, key: str, refs: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows go only when old and not referred to by any of refs (table, column)."""
    old = df.filter(F.col(at) < horizon)
    for table, column in refs:
        old = old.join(table.select(F.col(column).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return df.join(old.select(key), key, "left_anti")


def slot_expired(start: Column, period: str, horizon: int) -> Column:
    """A slot goes when it ended; an hour or a day only when its week and its month have."""
    if period in ("1h", "24h"):
        return F.greatest(slot_end(slot_start(start, "7d"), "7d"), slot_end(slot_start(start, "30d"), "30d")) <= horizon
    return slot_end(start, period) <= horizon


def expire_slots(slots: DataFrame, period: str, horizon: int) -> DataFrame:
    return slots.filter(~slot_expired(F.col("period_start_at"), period, horizon)) if horizon else slots


def repoint_purged(remainder: DataFrame, mapping: DataFrame) -> DataFrame:
    """Weaker identities' remainder follows the stronger ones. mapping: old_client_id, new_client_id."""
    out = remainder
    for column in ("local_client_id", "src_client_id"):
        m = mapping.select(F.col("old_client_id").alias(column), F.col("new_client_id").alias("_new"))
        out = out.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    return out
