"""Six families of aggregates over four calendar periods, and which slots to compute again.

All slots of a family are one grouped aggregation with the slot as a key, never one job for each slot. Sums of a longer
period come from the next finer one; distinct counts come from the family whose key still has the entity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import scope
from netloom.functions.time import CHILD, PERIODS, slot_end, slot_start

VOLUME = ("src_interface_id", "dst_interface_id", "peer_address", "traffic_scope", "traffic_direction", "exit_leg_device")
RULE = ("rule_id", "src_interface_id", "dst_interface_id")
DOMAIN = ("site_name", "client_id")
PEER = ("client_id", "traffic_direction", "peer_address")
CLIENT = ("client_id", "traffic_direction")
OWNER = ("owner_id", "traffic_scope")
FAMILIES = {"volume": VOLUME, "rule": RULE, "domain": DOMAIN, "peer": PEER}


def _hourly(parts: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("period_start_at", *keys).agg(*scope.decision_measures("bytes", F.col("connections")))


def _records(flow: DataFrame) -> DataFrame:
    return flow.withColumns({"period_start_at": slot_start(F.col("observed_at"), "1h"), "bytes": F.col("packet_bytes"), "connections": F.lit(1).cast("bigint")})


def _purged(purged: DataFrame) -> DataFrame:
    return purged.withColumn("period_start_at", F.col("hour_start_at"))


def _scope_of_direction() -> Column:
    d = F.col("traffic_direction")
    return F.when(d.isin("to_this_firewall", "from_this_firewall"), "this_firewall").when(F.col("src_interface_id").isNotNull() & F.col("dst_interface_id").isNotNull(), "east_west").otherwise("north_south")


def volume_1h(classified: DataFrame, purged: DataFrame | None = None) -> DataFrame:
    columns = ["period_start_at", *(k for k in VOLUME if k != "traffic_scope"), "action", "bytes", "connections"]
    parts = [_records(classified).select(*columns)]
    if purged is not None:
        inner = F.when(F.col("traffic_direction") != "inter_interface", F.col("peer_address"))
        parts.append(_purged(purged).withColumn("peer_address", inner).select(*columns))
    rows = reduce(DataFrame.unionByName, parts).withColumn("traffic_scope", _scope_of_direction())
    return _hourly([rows], VOLUME)


def rule_1h(flow: DataFrame, purged: DataFrame | None = None) -> DataFrame:
    columns = ["period_start_at", *RULE, "action", "bytes", "connections"]
    return _hourly([_records(flow).select(*columns), *([] if purged is None else [_purged(purged).select(*columns)])], RULE)


def domain_1h(flow: DataFrame, attribution: DataFrame, purged: DataFrame | None = None) -> DataFrame:
    """attribution: flow_id, site_name."""
    columns = ["period_start_at", *DOMAIN, "action", "bytes", "connections"]
    named = _records(flow.filter(scope.not_second_leg())).join(attribution.select(F.col("flow_id").alias("id"), "site_name"), "id").withColumn("client_id", F.col("src_client_id"))
    parts = [named.select(*columns)]
    if purged is not None:
        parts.append(_purged(purged).filter("site_name is not null").withColumn("client_id", F.col("src_client_id")).select(*columns))
    return _hourly(parts, DOMAIN)


def peer_1h(classified: DataFrame, purged: DataFrame | None = None) -> DataFrame:
    columns = ["period_start_at", *PEER, "action", "bytes", "connections"]
    other = F.when(F.col("src_interface_id").isNotNull(), F.col("dst_address")).otherwise(F.col("src_address"))
    rows = classified.filter((F.col("traffic_scope") != "this_firewall") & F.col("local_client_id").isNotNull() & F.col("exit_leg_device").isNull())
    parts = [_records(rows).withColumn("peer_address", other).withColumn("client_id", F.col("local_client_id")).select(*columns)]
    if purged is not None:
        kept = (F.col("local_client_id").isNotNull()) & ~F.col("traffic_direction").isin("to_this_firewall", "from_this_firewall") & F.col("exit_leg_device").isNull()
        parts.append(_purged(purged).filter(kept).withColumn("client_id", F.col("local_client_id")).select(*columns))
    return _hourly(parts, PEER)


def compose_period(child: DataFrame, family: str, period: str) -> DataFrame:
    """A longer period's slots from the next finer one's."""
    return child.groupBy(slot_start(F.col("period_start_at"), period).alias("period_start_at"), *FAMILIES[family]).agg(*scope.summed_measures())


def periods(hourly: DataFrame, family: str) -> dict[str, DataFrame]:
    out = {"1h": hourly}
    for period, child in CHILD.items():
        out[period] = compose_period(out[child], family, period)
    return out


def regroup_client(peer: DataFrame, *more: str) -> DataFrame:
    """By client (and further keys), with the exact number of peers of each slot.

    peer is a family's table: a slot has one row for a peer, so its rows are counted. Counting them as distinct would keep
    every row twice more in the memory of the task that makes them.
    """
    return peer.groupBy("period_start_at", *more, *CLIENT).agg(*scope.summed_measures(), F.count("peer_address").alias("distinct_peers"))


def regroup_owner(client: DataFrame, clients: DataFrame, *more: str) -> DataFrame:
    """By owner and scope (and further keys), with the exact number of clients. clients: id, owner_id."""
    side = F.when(F.col("traffic_direction") == "inter_interface", "east_west").otherwise("north_south")
    owned = client.join(clients.select(F.col("id").alias("client_id"), "owner_id"), "client_id").withColumn("traffic_scope", side)
    return owned.groupBy("period_start_at", *more, *OWNER).agg(*scope.summed_measures(), F.count_distinct("client_id").alias("client_count"))


def dirty_slots(flow: DataFrame, *, since: int, now: int, period: str = "1h", purged: DataFrame | None = None, forced: DataFrame | None = None, computed: DataFrame | None = None) -> DataFrame:
    """Slots to compute again: those with records ingested since, those that derivations changed, and the current one.

    computed (period_start_at, computed_at) leaves out slots computed after their newest record came in; a tie is stale.
    """
    touched = flow.filter(F.col("ingested_at") >= since).groupBy(slot_start(F.col("observed_at"), period).alias("period_start_at")).agg(F.max("ingested_at").alias("newest"))
    if purged is not None:
        touched = touched.unionByName(purged.filter(F.col("purged_at") >= since).groupBy(slot_start(F.col("hour_start_at"), period).alias("period_start_at")).agg(F.max("purged_at").alias("newest")))
    touched = touched.groupBy("period_start_at").agg(F.max("newest").alias("newest"))
    if computed is not None:
        done = computed.groupBy("period_start_at").agg(F.max("computed_at").alias("computed_at"))
        touched = touched.join(done, "period_start_at", "left").filter("computed_at is null or computed_at <= newest")
    slots = touched.select("period_start_at")
    if forced is not None:
        slots = slots.unionByName(forced.select(slot_start(F.col("at"), period).alias("period_start_at")))
    current = flow.sparkSession.range(1).select(slot_start(F.lit(now).cast("bigint"), period).alias("period_start_at"))
    return slots.unionByName(current).distinct()


def refresh(flow: DataFrame, clients: DataFrame, attribution: DataFrame, hours: DataFrame, purged: DataFrame | None = None) -> dict[tuple[str, str], DataFrame]:
    """All families and periods of the slots that the given hours touch, by one batch for each, finest first.

    Records are restricted to the months and weeks touched by a join on their day; a caller whose records are stored by day
    prunes them first. ``refresh_from_hours`` needs the records of the hours alone.
    """
    spans = [F.sequence(slot_start(F.col("period_start_at"), p), slot_end(slot_start(F.col("period_start_at"), p), p) - 1, F.lit(86400).cast("bigint")) for p in ("30d", "7d")]
    days = hours.select(F.explode(F.flatten(F.array(*(F.transform(s, lambda t: slot_start(t, "24h")) for s in spans)))).alias("_day")).distinct()

    def touched(df: DataFrame, at: str) -> DataFrame:
        return df.withColumn("_day", slot_start(F.col(at), "24h")).join(days, "_day", "left_semi").drop("_day")

    records, rest = touched(scope.classify(flow), "observed_at"), None if purged is None else touched(purged, "hour_start_at")
    base = {"volume": volume_1h(records, rest), "rule": rule_1h(records, rest), "domain": domain_1h(records, attribution, rest), "peer": peer_1h(records, rest)}
    out: dict[tuple[str, str], DataFrame] = {}
    for family, hourly in base.items():
        for period, slots in periods(hourly, family).items():
            wanted = hours.select(slot_start(F.col("period_start_at"), period).alias("period_start_at")).distinct()
            out[family, period] = slots.join(wanted, "period_start_at", "left_semi")
    for period in PERIODS:
        out["client", period] = regroup_client(out["peer", period])
        out["owner", period] = regroup_owner(out["client", period], clients)
    return out


def refresh_from_hours(flow: DataFrame, clients: DataFrame, attribution: DataFrame, hours: DataFrame, stored: Callable[[str], DataFrame | None]) -> dict[str, DataFrame]:
    """Each family's slots of all periods that the given hours touch, with their period: hours from records, longer periods from hours.

    flow holds the records of those hours and need hold no others. ``stored`` gives a family's hours of the touched
    weeks and months as they were stored (None for none); those in ``hours`` are left out of them. So a late record
    costs the records of its hour and the hours of its month, never a month of records.
    """
    records = scope.classify(flow)
    base = {"volume": volume_1h(records), "rule": rule_1h(records), "domain": domain_1h(records, attribution), "peer": peer_1h(records)}
    slots = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), slot_start(F.col("period_start_at"), p).alias("start")) for p in PERIODS))).alias("_s")
    wanted = hours.select(slots).select("_s.period", F.col("_s.start").alias("period_start_at")).distinct()
    out: dict[str, DataFrame] = {}
    for family, hourly in base.items():
        others = stored(family)
        hourly = hourly.join(hours, "period_start_at", "left_semi")
        if others is not None:
            hourly = hourly.unionByName(others.join(hours, "period_start_at", "left_anti").select(*hourly.columns))
        # An hour is part of one slot of each period: one exchange serves all four.
        dealt = hourly.withColumn("_s", slots).withColumns({"period": F.col("_s.period"), "period_start_at": F.col("_s.start")}).join(wanted, ["period", "period_start_at"], "left_semi")
        out[family] = dealt.groupBy("period", "period_start_at", *FAMILIES[family]).agg(*scope.summed_measures())
    out["client"] = regroup_client(out["peer"], "period")
    out["owner"] = regroup_owner(out["client"], clients, "period")
    return out


def distinct_over_slots(slots: DataFrame, key: str, entity: str) -> DataFrame:
    """Distinct entities over all slots; never a sum of the slots' own counts."""
    return slots.groupBy(key).agg(F.count_distinct(entity).alias(f"distinct_{entity}"))
