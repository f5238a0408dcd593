"""What a dashboard asks: totals, series, trees, rankings and feeds. A figure that cannot be computed is null, never 0."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scope
from netloom.functions.names import registrable_domain
from netloom.functions.time import in_window, slot_end, slot_start, slots_between
from netloom.operators.joins import overlapping
from netloom.operators.rollup import VOLUME
from netloom.operators.windows import OTHER, latest_reading



def _n() -> Column:
    return F.count(F.lit(1))


def _blocked() -> Column:
    return F.count_if(scope.blocked())


def _allowed() -> Column:
    return F.count_if(scope.allowed())


def _label(df: DataFrame, dim: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    return df.join(dim.select(F.col("id").alias(key), *(c.alias(n) for n, c in columns.items())), key, "left")


def _interface_label() -> Column:
    return F.coalesce("user_label", "description")


# -- windows and totals ------------------------------------------------------------------------------------------------


def volume_window(slots_1h: DataFrame, classified: DataFrame, *, start: int, end: int) -> DataFrame:
    """Whole hours from slots, the two partial hours at the edges from records."""
    first, last = -(-start // 3600) * 3600, end // 3600 * 3600
    if first >= last:
        return classified.filter(in_window("observed_at", start, end)).groupBy(*VOLUME).agg(*scope.decision_measures())
    whole = slots_1h.filter(in_window("period_start_at", first, last)).groupBy(*VOLUME).agg(*scope.summed_measures())
    edges = classified.filter(in_window("observed_at", start, first) | in_window("observed_at", last, end)).groupBy(*VOLUME).agg(*scope.decision_measures())
    return whole.unionByName(edges).groupBy(*VOLUME).agg(*scope.summed_measures())


def volume_totals(volume: DataFrame) -> DataFrame:
    return volume.filter("exit_leg_device is null").groupBy("traffic_scope").agg(*scope.summed_measures())


def by_direction(volume: DataFrame) -> DataFrame:
    return volume.filter("exit_leg_device is null").groupBy("traffic_direction").agg(*scope.summed_measures())


def exit_legs(volume: DataFrame) -> DataFrame:
    return volume.filter("exit_leg_device is not null").groupBy("exit_leg_device").agg(*scope.summed_measures())


def spine(df: DataFrame, *, start: int, end: int, period: str) -> DataFrame:
    row = df.sparkSession.range(1).select(F.explode(slots_between(F.lit(start).cast("bigint"), F.lit(end).cast("bigint"), period)).alias("period_start_at"))
    return row.withColumn("period_end_at", slot_end(F.col("period_start_at"), period))


def volume_series(slots: DataFrame, gaps: DataFrame, *, start: int, end: int, period: str, covered_from: int) -> DataFrame:
    """Every bucket of the window: null where nothing was recorded and nothing covers it, 0 only where it was covered."""
    sums = slots.filter(in_window("period_start_at", start, end)).filter("exit_leg_device is null").groupBy("period_start_at").agg(F.sum("bytes").alias("_b"))
    out = overlapping(spine(slots, start=start, end=end, period=period), gaps, start="period_start_at", end="period_end_at").join(sums, "period_start_at", "left")
    covered = (F.col("period_start_at") >= covered_from) & ~F.col("in_gap")
    return out.select("period_start_at", "in_gap", F.coalesce(F.col("_b"), F.when(covered, F.lit(0))).alias("bytes"))


def traffic_over_time_by_scope(slots: DataFrame, *, start: int, end: int, period: str) -> DataFrame:
    band = F.col("traffic_direction").isin("inbound", "outbound", "inter_interface")
    sums = slots.filter(in_window("period_start_at", start, end) & band).filter("exit_leg_device is null").groupBy("period_start_at").pivot("traffic_direction", ["inbound", "outbound", "inter_interface"]).agg(F.sum("bytes"))
    return spine(slots, start=start, end=end, period=period).join(sums, "period_start_at", "left").select("period_start_at", "inbound", "outbound", "inter_interface")


# -- tree --------------------------------------------------------------------------------------------------------------


def connection_tree(classified: DataFrame, clients: DataFrame, geo: DataFrame, attribution: DataFrame, *, root: str) -> DataFrame:
    """side, level, parent_key, key and figures: who inside (by interface, client or owner), and what outside.

    Every record is in exactly one node of each level, so children add up to their parent: what has no value goes to a
    named node.
    """
    f = classified.filter("exit_leg_device is null").join(clients.select(F.col("id").alias("local_client_id"), "owner_id"), "local_client_id", "left")
    f = f.join(geo.select(F.col("address").alias("peer_address"), "lookup_state", "asn"), "peer_address", "left").join(attribution.select(F.col("flow_id").alias("id"), "site_name"), "id", "left")
    firewall = F.col("traffic_direction").isin("to_this_firewall", "from_this_firewall")
    text = lambda c: F.col(c).cast("string")
    inner = {
        "interface": F.coalesce(text("local_interface_id"), F.when(firewall, "this_firewall").otherwise("none")),
        "client": F.coalesce(text("local_client_id"), F.lit("unassigned")),
        "owner": F.coalesce(text("owner_id"), F.lit("unassigned")),
    }
    child = inner["client"] if root != "client" else inner["interface"]
    outer = F.when(F.col("peer_address").isNull(), "none").when(F.col("lookup_state").isNull(), "no_row").when(F.col("asn").isNull(), "unplaced").otherwise(text("asn"))
    site = F.coalesce("site_name", F.lit("none"))
    keyed = f.select(inner[root].alias("i1"), child.alias("i2"), outer.alias("o1"), site.alias("o2"), "packet_bytes", scope.blocked().alias("_b"))
    figures = [F.sum("packet_bytes").alias("bytes"), _n().alias("connections"), F.count_if("_b").alias("blocked")]
    # One pass over the joined records for the finest of both sides' levels; parents are sums of their children.
    node = lambda side, one, two: F.struct(F.lit(side).alias("side"), F.col(one).alias("parent_key"), F.col(two).alias("key"))
    fine = keyed.select(F.inline(F.array(node("inside", "i1", "i2"), node("outside", "o1", "o2"))), "packet_bytes", "_b").groupBy("side", "parent_key", "key").agg(*figures)
    top = fine.groupBy("side", F.col("parent_key").alias("key")).agg(*(F.sum(c).alias(c) for c in ("bytes", "connections", "blocked")))
    columns = ("side", "level", "parent_key", "key", "bytes", "connections", "blocked")
    return fine.withColumn("level", F.lit(2)).select(*columns).unionByName(top.withColumns({"level": F.lit(1), "parent_key": F.lit(None).cast("string")}).select(*columns))


# -- attribution -------------------------------------------------------------------------------------------------------


def _rated(flow: DataFrame) -> DataFrame:
    return flow.filter(F.col("dst_interface_id").isNull() & F.col("src_client_id").isNotNull() & ~F.col("src_is_this_firewall") & ~F.col("dst_is_this_firewall") & scope.not_second_leg())


def attribution_rate(flow: DataFrame, attribution: DataFrame, dns: DataFrame, *, start: int, end: int, by: Sequence[str] = ()) -> DataFrame:
    """Eligible and named records, by method, with the rate; without any lookup in the window the rate is null."""
    a = attribution.select(F.col("flow_id").alias("id"), "method", "delay_s", F.lit(1).alias("_a"))
    rows = _rated(flow.filter(in_window("observed_at", start, end))).join(a, "id", "left")
    out = rows.groupBy(*by).agg(_n().alias("eligible"), F.count("_a").alias("named"), F.avg("delay_s").alias("mean_delay_s"), F.max("delay_s").alias("max_delay_s"), F.count_if(F.col("method") == "resolver_cache_answer").alias("exact"), F.count_if(F.col("method") == "lookup_timing").alias("timed"))
    covered = dns.filter(in_window("looked_up_at", start, end, closed=True)).limit(1).agg((_n() > 0).alias("covered"))
    out = out.crossJoin(covered)  # one row
    return out.withColumn("rate", F.when(F.col("covered"), F.try_divide("named", "eligible")))


def site_totals(domain_slots: DataFrame, *, start: int, end: int) -> DataFrame:
    rows = domain_slots.filter(in_window("period_start_at", start, end))
    connections = F.col("allowed_connections") + F.col("blocked_connections") + F.col("unknown_connections")
    return rows.groupBy("site_name").agg(F.sum("bytes").alias("bytes"), F.sum(connections).alias("connections"), F.count_distinct("client_id").alias("clients"))


def group_by_registrable_domain(totals: DataFrame, rules: DataFrame) -> DataFrame:
    """Sums by registrable domain; names without one stay apart under themselves. No client count: it can't be summed."""
    named = registrable_domain(totals, "site_name", rules)
    return named.groupBy(F.coalesce("registrable", "site_name").alias("domain"), F.col("registrable").isNotNull().alias("is_registrable")).agg(F.sum("bytes").alias("bytes"), F.sum("connections").alias("connections"), _n().alias("names"))


def top_sites(flow: DataFrame, attribution: DataFrame, geo: DataFrame, *, start: int, end: int, min_flows: int) -> DataFrame:
    rows = flow.filter(in_window("observed_at", start, end) & scope.not_second_leg()).join(attribution.select(F.col("flow_id").alias("id"), "site_name"), "id").join(geo.select(F.col("address").alias("dst_address"), "country_code", "operator"), "dst_address", "left")
    return rows.groupBy("site_name").agg(_n().alias("flows"), F.sum("packet_bytes").alias("bytes"), F.count_distinct("src_client_id").alias("clients"), F.min("country_code").alias("first_country"), F.count_distinct("operator").alias("operators")).filter(F.col("flows") >= min_flows)


def owner_totals(owner_slots: DataFrame, client_slots: DataFrame, clients: DataFrame, *, start: int, end: int) -> DataFrame:
    """Sums by owner with the exact number of machines over all slots; no owner is a row of its own."""
    sums = owner_slots.filter(in_window("period_start_at", start, end)).groupBy("owner_id").agg(*scope.summed_measures())
    who = client_slots.filter(in_window("period_start_at", start, end)).join(clients.select(F.col("id").alias("client_id"), "owner_id"), "client_id").groupBy(F.col("owner_id").alias("_o")).agg(F.count_distinct("client_id").alias("clients"))
    return sums.join(who, F.col("owner_id").eqNullSafe(F.col("_o")), "left").drop("_o")


def owner_activity(client_slots: DataFrame, clients: DataFrame, *, start: int, end: int) -> DataFrame:
    """Each person's total, with how many machines were active and silent; machines of nobody under no owner."""
    used = client_slots.filter(in_window("period_start_at", start, end)).groupBy(F.col("client_id").alias("id")).agg(F.sum("bytes").alias("_b"))
    return clients.select("id", "owner_id").join(used, "id", "left").groupBy("owner_id").agg(F.sum("_b").alias("bytes"), F.count("_b").alias("active"), F.count_if(F.col("_b").isNull()).alias("silent"))


# -- inventories -------------------------------------------------------------------------------------------------------


def interface_clients(classified: DataFrame, clients: DataFrame, interfaces: DataFrame, *, start: int, end: int, known_since: int) -> DataFrame:
    """Clients seen and known by interface; silent interfaces stay."""
    seen = classified.filter(in_window("observed_at", start, end)).filter("local_client_id is not null").groupBy(F.col("local_interface_id").alias("id")).agg(F.count_distinct("local_client_id").alias("seen"))
    known = clients.filter(F.col("last_seen_at") >= known_since).groupBy(F.col("interface_id").alias("id")).agg(_n().alias("known"))
    return interfaces.select("id", "device").join(seen, "id", "left").join(known, "id", "left").na.fill(0, ["seen", "known"])


def rule_logging(rules: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Rules by interface and by whether they log: floating, unresolved and unreported ones counted apart."""
    listed = rules.withColumn("identifier", F.explode_outer(F.split("interface", ",")))
    where = listed.join(interfaces.select("identifier", F.col("id").alias("_i")), "identifier", "left")
    kind = F.when(F.col("interface").isNull(), "floating").when(F.col("_i").isNull(), "unresolved").otherwise("interface")
    return where.withColumn("placement", kind).groupBy("placement", F.col("_i").alias("interface_id")).agg(_n().alias("rules"), F.count_if(~F.col("logs_matches")).alias("silent"), F.count_if(F.col("logs_matches").isNull()).alias("not_reported"))


def public_addresses(holdings: DataFrame, interfaces: DataFrame) -> DataFrame:
    up = interfaces.filter("is_upstream").select(F.col("id").alias("interface_id"))
    return holdings.join(up, "interface_id", "left_semi").select("interface_id", "source_field", "address", "first_seen_at", "last_seen_at")


def blocked_counts(decisions: DataFrame, *, start: int, end: int) -> DataFrame:
    return decisions.filter(in_window("occurred_at", start, end)).groupBy("engine_kind").agg(_n().alias("decisions"))


def blocked_feed(decisions: DataFrame, *, start: int, end: int, group: str) -> DataFrame:
    return decisions.filter(in_window("occurred_at", start, end)).groupBy(F.col(group).cast("string").alias("grp")).agg(_n().alias("decisions"), F.max("occurred_at").alias("newest_at"), F.count_distinct("engine_kind").alias("engines"))


def blocked_by_rule(flow: DataFrame, rules: DataFrame, *, start: int, end: int) -> DataFrame:
    """Every rule with its refusals, 0 too; records of rules that no longer exist under no rule."""
    hit = flow.filter(in_window("observed_at", start, end) & scope.blocked()).groupBy("rule_id").agg(_n().alias("blocked"), F.sum("packet_bytes").alias("bytes"))
    both = rules.select("id", "description").join(hit, rules["id"].eqNullSafe(hit["rule_id"]), "full")
    return both.select("id", "description", F.when(F.col("id").isNull(), "rule_gone").otherwise("rule").alias("state"), F.coalesce("blocked", F.lit(0)).alias("blocked"), "bytes")


def blocked_lookups_by_list(dns: DataFrame, lists: DataFrame) -> DataFrame:
    rows = dns.filter(F.col("action").isin("block", "drop")).join(lists.select(F.col("id").alias("blocklist_id"), "name", "purpose"), "blocklist_id", "left")
    state = F.when(F.col("blocklist_id").isNull(), "not_recorded").when(F.col("name").isNull(), "unknown_list").otherwise("recorded")
    return rows.groupBy(state.alias("list_state"), "name", "purpose").agg(_n().alias("lookups"), F.count_distinct("domain").alias("domains"))


def clients_per_owner(owners: DataFrame, clients: DataFrame) -> DataFrame:
    counted = clients.groupBy(F.col("owner_id").alias("id")).agg(_n().alias("clients"), F.count_if("unstable_identity").alias("unstable"))
    return owners.join(counted, "id", "left").na.fill(0, ["clients", "unstable"])


def leases_per_client(leases: DataFrame, clients: DataFrame) -> DataFrame:
    counted = leases.groupBy("client_id").agg(_n().alias("leases"), F.count_distinct("address").alias("addresses"), F.max("observed_at").alias("newest_at"))
    return counted.join(clients.select(F.col("id").alias("client_id"), "hostname", "identity_kind"), "client_id", "left")


# -- samples -----------------------------------------------------------------------------------------------------------


def no_domains(df: DataFrame, *names: str) -> DataFrame:
    """df for readers who may not see site names: those columns (site_name and domain, if none are named) are null."""
    hidden = {c.lower() for c in names or ("site_name", "domain")}
    return df.select(*(F.lit(None).cast(kind).alias(c) if c.lower() in hidden else F.col(f"`{c}`") for c, kind in df.dtypes))


def current_rates(samples: DataFrame, *, now: int, interval_s: int) -> DataFrame:
    """Newest rates by measure; a measure nobody reported is no row."""
    return latest_reading(samples, now=now, interval_s=interval_s).groupBy("measure").agg(F.sum("value").alias("rate"), _n().alias("subjects"), F.max("sampled_at").alias("sampled_at"))


def current_rates_by(samples: DataFrame, *, placed: DataFrame, client_of: DataFrame, clients: DataFrame, now: int, interval_s: int) -> DataFrame:
    """Current rates by device, client, owner and direction, and the outbound part that can't be split: grouping, key,
    in_rate, out_rate, out_measured, oldest_at, sampled_at.

    samples: subject_kind (interface_endpoint: "device local"; interface_endpoint_pair: "device local peer"),
    subject_key, measure (rate_bits_in, rate_bits_out), value, sampled_at. placed: address, interface_id (null:
    outside). client_of: address, client_id. clients: id, owner_id.

    A subject counts with its newest instant, if it is at most two intervals old. Endpoints are summed by device; those
    inside also by client and owner (null: unassigned). Inbound figures go by where the peer is. An endpoint's outbound
    total goes to outbound if all peers of that instant are outside, to inter_interface if all are inside, else to
    ``unsplit``. out_rate sums what was reported; it is measured only where every reading had such a figure.
    """
    recent = samples.filter((F.col("sampled_at") >= now - 2 * interval_s) & (F.col("sampled_at") <= now) & F.col("measure").isin("rate_bits_in", "rate_bits_out"))
    of = lambda m: F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m[-3:].strip("_"))
    instants = recent.groupBy("subject_kind", "subject_key", "sampled_at").agg(of("rate_bits_in"), of("rate_bits_out"))
    newest = instants.groupBy("subject_kind", "subject_key").agg(F.max(F.struct("sampled_at", "in", "out")).alias("_n")).select("subject_kind", F.split("subject_key", " ").alias("_p"), "_n.*")
    inside = placed.filter("interface_id is not null").select("address").distinct()
    held = lambda c: inside.select(F.col("address").alias(c), F.lit(True).alias(f"_{c}"))
    part = lambda i, c: F.get("_p", F.lit(i)).alias(c)
    ends = newest.filter("subject_kind = 'interface_endpoint' and size(_p) = 2").select(part(0, "device"), part(1, "local"), "sampled_at", "in", "out").join(held("local"), "local", "left")
    pairs = newest.filter("subject_kind = 'interface_endpoint_pair' and size(_p) = 3").select(part(0, "device"), part(1, "local"), part(2, "peer"), "sampled_at", "in")
    with_peers = pairs.join(ends.filter("_local").select("device", "local", "sampled_at"), ["device", "local", "sampled_at"], "left_semi").join(held("peer"), "peer", "left")
    sides = with_peers.groupBy("device", "local").agg(F.count_if("_peer").alias("_between"), F.count_if(F.col("_peer").isNull()).alias("_outside"))
    who = client_of.select(F.col("address").alias("local"), "client_id").join(clients.select(F.col("id").alias("client_id"), "owner_id"), "client_id", "left")
    known = ends.join(sides, ["device", "local"], "left").join(who, "local", "left")
    way = F.when((F.col("_outside") > 0) & (F.col("_between") == 0), "outbound").when((F.col("_between") > 0) & (F.col("_outside") == 0), "inter_interface")
    share = lambda grouping, key, took: F.struct(grouping.alias("grouping"), key.cast("string").alias("key"), took.alias("in"), F.lit(True).alias("asked"))
    total, none = F.coalesce("in", F.lit(0.0)), F.lit(0.0)
    mine = F.col("_local") & F.col("client_id").isNotNull()
    shares = F.array(
        share(F.lit("device"), F.col("device"), total),
        F.when(F.col("_local"), share(F.when(way.isNull(), "unsplit").otherwise("direction"), way, none)),
        F.when(mine, share(F.lit("client"), F.col("client_id"), total)),
        F.when(mine, share(F.lit("owner"), F.col("owner_id"), total)),
    )
    spread = known.select("sampled_at", "out", F.explode(F.filter(shares, lambda x: x.isNotNull())).alias("_s")).select("_s.*", "out", "sampled_at")
    came = with_peers.filter(F.col("in").isNotNull()).select(F.lit("direction").alias("grouping"), F.when(F.col("_peer"), "inter_interface").otherwise("inbound").alias("key"), "in", F.lit(False).alias("asked"), F.lit(None).cast("double").alias("out"), "sampled_at")
    rates = spread.unionByName(came).groupBy("grouping", "key")
    measured = (F.count("out") > 0) & (F.count_if(F.col("asked") & F.col("out").isNull()) == 0)
    return rates.agg(F.sum("in").alias("in_rate"), F.sum("out").alias("out_rate"), measured.alias("out_measured"), F.min("sampled_at").alias("oldest_at"), F.max("sampled_at").alias("sampled_at"))


def sampled_bytes(samples: DataFrame, *, start: int, end: int, seconds_each: int = 2) -> DataFrame:
    rows = samples.filter(in_window("sampled_at", start, end)).groupBy("subject_key").agg(F.sum("value").alias("bytes"), F.count_distinct("sampled_at").alias("instants"))
    return rows.withColumn("seconds_covered", F.col("instants") * seconds_each)


def health_overview(samples: DataFrame, *, now: int, interval_s: int) -> DataFrame:
    """Newest reading of every subject ever seen; stale ones keep their stamp and lose their value."""
    last = samples.groupBy("subject_key", "measure").agg(F.max(F.struct("sampled_at", "value")).alias("_l"))
    return last.select("subject_key", "measure", F.col("_l.sampled_at").alias("sampled_at"), F.when(F.col("_l.sampled_at") >= now - 2 * interval_s, F.col("_l.value")).alias("value"))


def chart_series(specs: Sequence[tuple[str, DataFrame, Column]], *, at: str, start: int, end: int, period: str) -> DataFrame:
    """Several series on one spine: (name, rows, aggregate) each; nothing is interpolated."""
    out = []
    for name, rows, aggregate in specs:
        sums = rows.filter(in_window(at, start, end)).groupBy(slot_start(F.col(at), period).alias("period_start_at")).agg(aggregate.cast("double").alias("value"))
        out.append(spine(rows, start=start, end=end, period=period).join(sums, "period_start_at", "left").select(F.lit(name).alias("series"), "period_start_at", "value"))
    return reduce(DataFrame.unionByName, out)


# -- screens -----------------------------------------------------------------------------------------------------------


def screen_overview(flow: DataFrame, *, start: int, end: int) -> DataFrame:
    return flow.filter(in_window("observed_at", start, end)).groupBy("traffic_scope").agg(_n().alias("flow_count"), _blocked().alias("blocked_count"), _allowed().alias("allowed_count"), F.sum("packet_bytes").alias("observed_bytes"), F.count_distinct("src_interface_id").alias("source_interface_count"), F.count_distinct("src_client_id").alias("source_client_count"))


def screen_matrix(flow: DataFrame, interfaces: DataFrame, rules: DataFrame, *, start: int, end: int) -> DataFrame:
    """Interface by interface. Records are reduced to (cell, rule) before rules and labels are joined."""
    cell = ["src_interface_id", "dst_interface_id", "traffic_scope"]
    rows = flow.filter(in_window("observed_at", start, end)).filter("src_interface_id is not null")
    small = rows.groupBy(*cell, "rule_id").agg(F.sum("packet_bytes").alias("b"), _allowed().alias("a"), _blocked().alias("k"), F.count_if(F.col("rule_lookup_state") == "not_found").alias("u"))
    named = small.join(rules.select(F.col("id").alias("rule_id"), F.col("description").alias("_rule")), "rule_id", "left")
    out = named.groupBy(*cell).agg(F.sum("b").alias("observed_bytes"), F.sum("a").alias("allowed_connections"), F.sum("k").alias("blocked_connections"), F.array_join(F.array_sort(F.collect_set("_rule")), ",").alias("matching_rules"), F.sum("u").alias("unknown_rule_connections"))
    for side in ("src", "dst"):
        out = _label(out, interfaces, f"{side}_interface_id", {f"{side}_interface_label": _interface_label()})
    return out


def screen_interface(flow: DataFrame, clients: DataFrame, *, interface_id: int, start: int, end: int) -> DataFrame:
    rows = flow.filter((F.col("src_interface_id") == interface_id) & in_window("observed_at", start, end))
    sums = rows.groupBy(F.col("src_client_id").alias("client_id")).agg(_n().alias("flow_count"), F.sum("packet_bytes").alias("observed_bytes"), _blocked().alias("blocked_count"), F.count_distinct("dst_address").alias("distinct_destinations"), F.count_if(F.col("traffic_scope") == "east_west").alias("east_west_count"), F.max("observed_at").alias("last_seen_at"))
    return _label(sums, clients, "client_id", {c: F.col(c) for c in ("hostname", "last_address", "identity_kind", "unstable_identity")})


def screen_client(flow: DataFrame, geo: DataFrame, attribution: DataFrame, devices: DataFrame, *, client_id: int, start: int, end: int) -> DataFrame:
    rows = flow.filter((F.col("src_client_id") == client_id) & in_window("observed_at", start, end))
    out = rows.join(geo.select(F.col("address").alias("dst_address"), F.col("lookup_state").alias("geo_lookup_state"), "country_code", "operator", "dataset_build_at"), "dst_address", "left").join(attribution.select(F.col("flow_id").alias("id"), "site_name", F.col("delay_s").alias("correlation_delay_seconds")), "id", "left").join(devices.select(F.col("device").alias("interface_device"), "description"), "interface_device", "left")
    return out.select(F.col("id").alias("flow_id"), "observed_at", "dst_address", "dst_port", "protocol", "action", "traffic_scope", "packet_bytes", "geo_lookup_state", "country_code", "operator", "dataset_build_at", "site_name", "correlation_delay_seconds", "interface_lookup_state", F.when(F.col("interface_lookup_state") == "resolved", F.col("description")).alias("interface_description"))


def screen_blocked(flow: DataFrame, rules: DataFrame, devices: DataFrame, *, start: int, end: int) -> DataFrame:
    rows = flow.filter(scope.blocked() & in_window("observed_at", start, end)).join(rules.select(F.col("id").alias("rule_id"), F.col("description").alias("_rule")), "rule_id", "left").join(devices.select(F.col("device").alias("interface_device"), F.col("description").alias("_device")), "interface_device", "left")
    return rows.select(F.col("id").alias("flow_id"), "observed_at", "src_interface_id", "src_client_id", "src_address", "dst_address", "dst_port", "action", "rid", "rule_lookup_state", F.when(F.col("rule_lookup_state") == "resolved", F.col("_rule")).alias("rule_description"), "interface_device", F.when(F.col("interface_lookup_state") == "resolved", F.col("_device")).alias("interface_description"))


def screen_alerts(events: DataFrame, rule_info: DataFrame, clients: DataFrame, interfaces: DataFrame, *, start: int, end: int) -> DataFrame:
    info = rule_info.select("rule_identity", F.col("normalised_severity").alias("_s"), "category")
    rows = events.filter(in_window("occurred_at", start, end)).join(info, "rule_identity", "left")
    state, severity = scope.severity(F.col("normalised_severity"), F.col("_s"))
    out = rows.withColumns({"severity_state": state, "severity": severity, "client_id": F.col("src_client_id"), "interface_id": F.col("src_interface_id")})
    out = _label(_label(out, clients, "client_id", {"hostname": F.col("hostname")}), interfaces, "interface_id", {"interface_label": _interface_label()})
    return out.select("id", "occurred_at", "rule_identity", "signature", "event_action", "severity_state", "severity", "category", "src_address", "dst_address", "client_id", "hostname", "interface_id", "interface_label")


def screen_map(flow: DataFrame, geo: DataFrame, *, start: int, end: int) -> DataFrame:
    """Countries and operators by interface, of addresses that were looked up."""
    rows = flow.filter(in_window("observed_at", start, end) & (F.col("traffic_scope") == "north_south")).groupBy("src_interface_id", "dst_address").agg(F.sum("packet_bytes").alias("b"), _n().alias("n"))
    return rows.join(geo.select(F.col("address").alias("dst_address"), "lookup_state", "country_code", "operator"), "dst_address").groupBy("src_interface_id", "lookup_state", "country_code", "operator").agg(F.sum("b").alias("observed_bytes"), F.sum("n").alias("flow_count"), _n().alias("addresses"))


# -- catalogue ---------------------------------------------------------------------------------------------------------


def world_map(flow: DataFrame, geo: DataFrame, *, start: int, end: int) -> DataFrame:
    """Like the map, but what was not looked up or not placed is a row, so totals add up."""
    rows = flow.filter(in_window("observed_at", start, end) & (F.col("traffic_scope") == "north_south")).groupBy("dst_address").agg(F.sum("packet_bytes").alias("b"))
    placed = rows.join(geo.select(F.col("address").alias("dst_address"), "country_code"), "dst_address", "left")
    return placed.groupBy(F.coalesce("country_code", F.lit("unplaced")).alias("country")).agg(F.sum("b").alias("bytes"), _n().alias("addresses"))


def alerts_over_time(events: DataFrame, *, start: int, end: int, period: str) -> DataFrame:
    band = F.coalesce("normalised_severity", F.lit("unknown"))
    return events.filter(in_window("occurred_at", start, end)).groupBy(slot_start(F.col("occurred_at"), period).alias("period_start_at"), band.alias("severity")).agg(_n().alias("alerts"))


def alerts_by_signature(events: DataFrame, rule_info: DataFrame) -> DataFrame:
    info = rule_info.select("rule_identity", F.col("normalised_severity").alias("_s"))
    sums = events.join(info, "rule_identity", "left")
    _, severity = scope.severity(F.col("normalised_severity"), F.col("_s"))
    return sums.groupBy("rule_identity", "signature", F.coalesce(severity, F.lit("unknown")).alias("severity")).agg(_n().alias("alerts"), F.count_if(F.col("event_action") == "blocked").alias("blocked"))


def alerts_by_client(events: DataFrame, clients: DataFrame) -> DataFrame:
    """Alerts by client with the worst severity; those of no known client stay as a row."""
    worst = F.max(scope.severity_rank(F.col("normalised_severity"))).alias("_w")
    sums = events.groupBy(F.col("src_client_id").alias("client_id")).agg(_n().alias("alerts"), worst)
    named = _label(sums, clients, "client_id", {"hostname": F.col("hostname")})
    name = F.try_element_at(F.array(*(F.lit(s) for s in scope.SEVERITIES)), F.nullif("_w", F.lit(0)).cast("int"))
    return named.select("client_id", "hostname", "alerts", name.alias("worst_severity"))


def sankey(classified: DataFrame, *, left: str, right: str, measure: str = "packet_bytes", min_share: float = 0.01) -> DataFrame:
    """Flows between two keys; links below the share go to the remainder, so totals are kept."""
    links = classified.groupBy(F.coalesce(F.col(left).cast("string"), F.lit("none")).alias("src"), F.coalesce(F.col(right).cast("string"), F.lit("none")).alias("dst")).agg(F.sum(measure).alias("v"))
    small = F.col("v") < min_share * F.col("_t")
    return links.crossJoin(links.agg(F.sum("v").alias("_t"))).groupBy(F.when(small, OTHER).otherwise(F.col("src")).alias("src"), F.when(small, OTHER).otherwise(F.col("dst")).alias("dst")).agg(F.sum("v").alias("value"), _n().alias("links"))


def composition(classified: DataFrame, *, group: str) -> DataFrame:
    """Parts of a whole with their shares."""
    parts = classified.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("none")).alias("part")).agg(F.sum("packet_bytes").alias("bytes"), _n().alias("connections"))
    return parts.crossJoin(parts.agg(F.sum("bytes").alias("_t"))).select("part", "bytes", "connections", F.try_divide("bytes", "_t").alias("share"))


def sites_by_client(flow: DataFrame, attribution: DataFrame, clients: DataFrame, *, n: int) -> DataFrame:
    """Each client's n largest sites; clients without any are kept."""
    sums = flow.filter("src_client_id is not null").join(attribution.select(F.col("flow_id").alias("id"), "site_name"), "id").groupBy(F.col("src_client_id").alias("client_id"), "site_name").agg(F.sum("packet_bytes").alias("bytes"))
    ranked = sums.withColumn("place", F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("bytes"), "site_name"))).filter(F.col("place") <= n)
    return clients.select(F.col("id").alias("client_id")).join(ranked, "client_id", "left").select("client_id", "place", "site_name", "bytes")


def interface_volume_ranking(classified: DataFrame, interfaces: DataFrame) -> DataFrame:
    sums = classified.filter("exit_leg_device is null").groupBy(F.col("local_interface_id").alias("id")).agg(F.sum("packet_bytes").alias("bytes"), F.count_distinct("local_client_id").alias("clients"), _blocked().alias("blocked"))
    return interfaces.select("id", _interface_label().alias("label")).join(sums, "id", "left")


def client_volume_ranking(classified: DataFrame, clients: DataFrame) -> DataFrame:
    sums = classified.filter("exit_leg_device is null").groupBy(F.col("local_client_id").alias("id")).agg(F.sum("packet_bytes").alias("bytes"), F.count_distinct("peer_address").alias("peers"), _blocked().alias("blocked"), F.sum(F.when(F.col("traffic_direction") == "inter_interface", F.col("packet_bytes")).otherwise(0)).alias("inner_bytes"))
    return clients.select("id", "hostname", "unstable_identity").join(sums, "id", "left").withColumn("inner_share", F.try_divide("inner_bytes", "bytes"))


def aggregate_freshness(slots: DataFrame, flow: DataFrame, *, period: str) -> DataFrame:
    """Slots with whether records came in since they were computed (a tie counts as since)."""
    newest = flow.groupBy(slot_start(F.col("observed_at"), period).alias("period_start_at")).agg(F.max("ingested_at").alias("newest_ingest_at"))
    done = slots.groupBy("period_start_at").agg(F.max("computed_at").alias("computed_at"))
    return done.join(newest, "period_start_at", "full").withColumn("stale", F.coalesce(F.col("computed_at") <= F.col("newest_ingest_at"), F.col("computed_at").isNull()))


def state_items_at(items: DataFrame, *, set_key: str, at: int) -> DataFrame:
    return items.filter((F.col("set_key") == set_key) & (F.col("captured_at") == at))


def client_at_address(addresses: DataFrame, clients: DataFrame, holdings: DataFrame) -> DataFrame:
    """For each address: its address-level client, that client's owner, and whether the firewall holds it."""
    level = clients.filter("identity_kind = 'address_in_interface'").groupBy(F.col("last_address").alias("address")).agg(F.max(F.struct("last_seen_at", "id", "owner_id")).alias("_l"))
    held = holdings.filter(F.col("source_field").isin("addr4", "addr6", "ipv4", "ipv6")).select("address").distinct().withColumn("_h", F.lit(True))
    return addresses.select("address").distinct().join(level, "address", "left").join(held, "address", "left").select("address", F.col("_l.id").alias("client_id"), F.col("_l.owner_id").alias("owner_id"), F.coalesce("_h", F.lit(False)).alias("is_firewall"))
