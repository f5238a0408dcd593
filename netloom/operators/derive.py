"""Derivations: who and what stands behind an address, a record, a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import net, scope
from netloom.functions.names import dns_name, host_label
from netloom.operators import joins
from netloom.operators.windows import changed
from netloom.session import checkpointed

STRONG = ("dhcp_client_id", "mac")

# Reasons with which the packet filter refuses without a rule.
NO_RULE_REASONS = ("bad-offset", "fragment", "short", "normalize", "memory", "bad-timestamp", "congestion", "ip-option", "proto-cksum", "state-mismatch", "state-insert", "state-limit", "src-limit", "synproxy")
PURPOSES = ("advertising", "tracking", "threat", "parental")
HELD_FIELDS = ("addr4", "addr6", "ipv4", "ipv6")


def networks_in_force(networks: DataFrame) -> DataFrame:
    """Not removed, and an operator's or in its interface's latest detection."""
    latest = F.max("last_detected_at").over(Window.partitionBy("interface_id"))
    return networks.withColumn("_latest", latest).filter("removed_at is null and (origin = 'operator' or last_detected_at = _latest)").drop("_latest")


def place_addresses(addresses: DataFrame, *, lease: DataFrame, client: DataFrame, networks: DataFrame, sightings: DataFrame, interface: DataFrame) -> DataFrame:
    """address, interface_id, evidence: by lease, else identity, else network, else sighting; never by upstream evidence.

    lease: address, interface_id, observed_at. client: last_address, interface_id, identity_kind, last_seen_at, id.
    sightings: address, interface_id, observed_at. Link-local addresses are placed only by interfaces that may hold such.
    Each evidence is reduced to one row for an address before it is joined.
    """
    inside = interface.filter(~F.col("is_upstream")).select(F.col("id").alias("interface_id"), "link_local_evidence")
    wanted = addresses.select("address").filter("address is not null").distinct()

    def best(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
        kept = rows.join(inside, "interface_id").filter(~net.is_link_local(F.col("address")) | F.col("link_local_evidence"))
        return joins.latest_by(kept, ["address"], order).select("address", F.col("interface_id").alias(name))

    leases = best(lease, [F.desc("observed_at"), F.asc("interface_id")], "_lease")
    strong = client.filter(F.col("identity_kind").isin(*STRONG)).withColumn("address", F.col("last_address"))
    identities = best(strong, [F.desc("last_seen_at"), F.asc("id")], "_identity")
    seen = best(sightings, [F.desc("observed_at"), F.asc("interface_id")], "_sighting")
    inner = networks.join(inside.select("interface_id"), "interface_id", "left_semi")
    out = joins.longest_prefix_match(wanted, inner).withColumnRenamed("interface_id", "_network").drop("prefix_length")
    for rows in (leases, identities, seen):
        out = out.join(rows, "address", "left")
    kinds = ("_lease", "_identity", "_network", "_sighting")
    evidence = F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(k[1:])) for k in kinds))
    return out.select("address", F.coalesce(*(F.col(k) for k in kinds)).alias("interface_id"), evidence.alias("evidence"))


def mark_this_firewall(rows: DataFrame, holdings: DataFrame, *, address: str, at: str, margin_s: int = 300) -> DataFrame:
    """rows with is_this_firewall and firewall_interface_id, each as of its own instant.

    holdings: address, interface_id, source_field, first_seen_at, last_seen_at, is_current. A holding counts from
    margin_s before it was first seen to margin_s after it was last, or for ever if current; the most recent one names
    the interface, ties by id. Loopback is always the firewall.
    """
    until = F.when(~F.col("is_current"), F.col("last_seen_at") + margin_s)
    h = holdings.filter(F.col("source_field").isin(*HELD_FIELDS)).select(F.col("address").alias(address), F.col("interface_id").alias("_i"), "last_seen_at", (F.col("first_seen_at") - margin_s).alias("_from"), until.alias("_until"))
    # Repeated pairs do no harm to a minimum; telling them apart first would send every record's pair over the network.
    key = rows.select(address, at)
    held = joins.binned_range_join(key, h, at=at, low="_from", high="_until", width=86400, on=[address])
    newest = held.groupBy(address, at).agg(F.min(F.struct((-F.col("last_seen_at")).alias("o"), "_i"))["_i"].alias("firewall_interface_id"))
    out = rows.join(newest, [address, at], "left")
    return out.withColumn("is_this_firewall", net.is_loopback(F.col(address)) | F.col("firewall_interface_id").isNotNull())


def assign_client(rows: DataFrame, client: DataFrame, *, address: str, stored: str, at: str, idle_s: int = 86400) -> DataFrame:
    """rows with client_id: the stored one unless address-level, else the strongest identity at the address, else the
    stored one, else a recent address-level one; else null."""
    c = client.select("id", "identity_kind", F.col("last_address").alias("_a"), "last_seen_at")
    rank = F.when(F.col("identity_kind") == "dhcp_client_id", 0).otherwise(1)
    strong = c.filter(F.col("identity_kind").isin(*STRONG)).groupBy("_a").agg(F.min(F.struct(rank.alias("k"), (-F.col("last_seen_at")).alias("t"), "id"))["id"].alias("_strong"))
    level = c.filter("identity_kind = 'address_in_interface'").groupBy("_a").agg(F.max(F.struct("last_seen_at", "id")).alias("_l"))
    kinds = c.select(F.col("id").alias("_stored"), F.col("identity_kind").alias("_kind"))
    out = rows.join(kinds, F.col(stored) == F.col("_stored"), "left").join(strong.withColumnRenamed("_a", "_sa"), F.col(address) == F.col("_sa"), "left").join(level, F.col(address) == F.col("_a"), "left")
    kept = F.when(F.col(stored).isNotNull() & (F.col("_kind") != "address_in_interface"), F.col(stored))
    fresh = F.when(F.abs(F.col(at) - F.col("_l.last_seen_at")) <= idle_s, F.col("_l.id"))
    chosen = F.coalesce(kept, F.col("_strong"), F.col(stored), fresh)
    return out.withColumn("client_id", chosen).drop("_stored", "_kind", "_strong", "_sa", "_a", "_l")


def classify_end(rows: DataFrame, *, side: str, at: str, placed: DataFrame, holdings: DataFrame, client: DataFrame, margin_s: int = 300) -> DataFrame:
    """rows with new_<side>_interface_id, new_<side>_client_id, new_<side>_is_this_firewall and whether they changed."""
    address = f"{side}_address"
    marked = mark_this_firewall(rows, holdings, address=address, at=at, margin_s=margin_s)
    where = placed.select(F.col("address").alias(address), F.col("interface_id").alias("_placed"))
    out = assign_client(marked.join(where, address, "left"), client, address=address, stored=f"{side}_client_id", at=at)
    interface = F.when(F.col("is_this_firewall"), F.col("firewall_interface_id")).otherwise(F.col("_placed"))
    who = F.when(~F.col("is_this_firewall") & F.col("_placed").isNotNull(), F.col("client_id"))
    out = out.withColumns({f"new_{side}_interface_id": interface, f"new_{side}_client_id": who, f"new_{side}_is_this_firewall": F.col("is_this_firewall")})
    differs = changed(F.col(f"{side}_interface_id"), F.col(f"new_{side}_interface_id")) | changed(F.col(f"{side}_client_id"), F.col(f"new_{side}_client_id"))
    return out.withColumn(f"{side}_changed", differs).drop("is_this_firewall", "firewall_interface_id", "_placed", "client_id")


def classify_flows(flow: DataFrame, *, placed: DataFrame, holdings: DataFrame, client: DataFrame) -> DataFrame:
    """Both ends of records; ``src_changed`` and ``dst_changed`` give the instants to aggregate again."""
    common = {"at": "observed_at", "placed": placed, "holdings": holdings, "client": client}
    return classify_end(classify_end(flow, side="src", **common), side="dst", **common)


def client_identity(leases: DataFrame) -> DataFrame:
    """One client for each identity: DHCP id, else DUID, else IAID, else MAC, else interface, address and day.

    The latest lease tells its address, name and interface; ties by address, then by least id where leases have one.
    """
    fallback = F.concat_ws("|", F.col("interface_id").cast("string"), F.col("address"), F.floor(F.col("observed_at") / 86400).cast("string"))
    kinds = (("dhcp_client_id", F.col("dhcp_client_id")), ("duid", F.col("duid")), ("iaid", F.col("iaid")), ("mac", net.mac_normalise(F.col("mac"))), ("address_in_interface", fallback))
    named = leases.withColumns({"identity_kind": F.coalesce(*(F.when(v.isNotNull(), F.lit(k)) for k, v in kinds)), "identity_key": F.coalesce(*(v for _, v in kinds))})
    order = F.struct("observed_at", "address", *((-F.col("id")).alias(k) for k in ("id",) if k in leases.columns))
    latest = lambda c: F.max_by(c, order).alias(c)
    return named.groupBy("identity_kind", "identity_key").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), latest("address"), latest("hostname"), latest("interface_id"))


def clients_seen(leases: DataFrame, neighbours: DataFrame) -> DataFrame:
    """One client for each identity over all servers and neighbour tables, with what was last known of it.

    leases: server, dhcp_client_id, duid, iaid, mac, address, hostname, interface_id, observed_at; the first of the
    three ids that is there is the identity, else the MAC, else interface, address and day. neighbours (as
    ``parse_neighbours`` gives them: without upstream entries and those the firewall holds): mac, address, interface_id,
    observed_at; an entry without a MAC or an address is none. A column's last value that is there counts, ties by
    address; servers are those that knew the client. Identities are not merged across levels.
    """
    address_day = F.concat_ws("|", F.col("interface_id").cast("string"), F.col("address"), F.floor(F.col("observed_at") / 86400).cast("string"))
    given = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("dhcp_client_id", "duid", "iaid")))
    mac = net.mac_normalise(F.col("mac"))
    kind = F.when(given.isNotNull(), "dhcp_client_id").when(mac.isNotNull(), "mac").otherwise("address_in_interface")
    last = ["address", "hostname", "interface_id", "mac"]
    held = leases.select("server", kind.alias("identity_kind"), F.coalesce(given, mac, address_day).alias("identity_key"), "observed_at", "address", "hostname", "interface_id", mac.alias("mac"))
    seen = neighbours.filter(mac.isNotNull() & F.col("address").isNotNull()).select(F.lit(None).cast("string").alias("server"), F.lit("mac").alias("identity_kind"), mac.alias("identity_key"), "observed_at", "address", F.lit(None).cast("string").alias("hostname"), "interface_id", mac.alias("mac"))
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("observed_at", F.col("address").alias("_a"), F.col(c).alias("_v"))))["_v"].alias(c)
    both = held.unionByName(seen).groupBy("identity_kind", "identity_key")
    return both.agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), *(newest(c) for c in last), F.array_join(F.array_sort(F.collect_set("server")), ",").alias("servers"))


def _eligible(flow: DataFrame) -> DataFrame:
    return flow.filter(F.col("dst_interface_id").isNull() & ~F.col("dst_is_this_firewall") & scope.not_second_leg())


def _usable(lookups: DataFrame) -> DataFrame:
    return lookups.filter((F.col("action") == "pass") & F.col("answer_source").isin("Recursion", "Cache", "Local-data") & F.col("client_resolution").isin("logged_address", "lease_hostname", "local_data_hostname"))


def names_held(points: DataFrame, records: DataFrame) -> DataFrame:
    """origin, held_in, name, at, covered_from: names whose answers held the target (dst_address) at an instant.

    Of one name's answers with that target the earliest that holds counts, so a target is met once for each name.
    """
    answers = records.filter(F.col("rrtype").isin("A", "AAAA")).select(F.col("address").alias("dst_address"), "held_in", F.col("owner_name").alias("name"), F.col("covered_from_at").alias("covered_from"), "covered_until_at")
    pieces = joins.earliest_pieces(answers, ["dst_address", "held_in", "name"], low="covered_from", high="covered_until_at")
    met = joins.binned_range_join(points, pieces, at="at", low="_from", high="_until", width=joins.SPAN_S, on=["dst_address"])
    return met.select("origin", "held_in", "name", "at", "covered_from")


def exact_evidence(flow: DataFrame, lookups: DataFrame, records: DataFrame, *, cap_s: int = 3600, max_links: int = 11) -> DataFrame:
    """For records that cached answers lead to a lookup: origin, at, names (how many), latest (looked_up_at, lookup_key, domain).

    Names are climbed from the target over aliases, each held at the record's instant; local data isn't climbed.
    """
    eligible = _eligible(flow)
    span = {"covered_from": F.col("covered_from_at"), "covered_until": F.col("covered_until_at")}
    frontier = names_held(eligible.select(F.col("id").alias("origin"), F.col("observed_at").alias("at"), "dst_address"), records)
    aliases = records.filter("rrtype = 'CNAME' and held_in = 'cache'").select(F.col("value").alias("from_name"), F.col("owner_name").alias("to_name"), *(c.alias(k) for k, c in span.items()))
    cached = joins.expand_paths(frontier.filter("held_in <> 'local_data'").withColumn("terminal", F.lit("cache")).drop("held_in"), aliases, max_links=max_links).withColumn("held_in", F.lit("cache"))
    local = frontier.filter("held_in = 'local_data'").withColumns({"terminal": F.lit("local_data"), "links": F.lit(0)})
    paths = cached.unionByName(local.select(*cached.columns))
    who = eligible.select(F.col("id").alias("origin"), "src_client_id", "src_address")
    exact = joins.exact_candidates(paths.join(who, "origin"), _usable(lookups), cap_s=cap_s)
    return exact.groupBy("origin", "at").agg(F.count_distinct("name").alias("names"), F.max(F.struct("looked_up_at", "lookup_key", "domain")).alias("latest"))


def timing_evidence(flow: DataFrame, lookups: DataFrame, records: DataFrame, exact: DataFrame, *, timing_s: int = 5) -> DataFrame:
    """id, domain, lookup_key, delay_s of records without exact evidence, by the one domain their client looked up just before.

    A name is dropped if answers held at the lookup's instant, of the record's address family, exist and none is its target.
    """
    undecided = _eligible(flow).join(exact.select(F.col("origin").alias("id")), "id", "left_anti")
    timed = joins.match_lookups_by_time(undecided, _usable(lookups), delay_s=timing_s)
    family = net.ip_family(F.col("address"))
    answers = records.filter(F.col("rrtype").isin("A", "AAAA")).select(F.col("owner_name").alias("_n"), F.col("address").alias("dst_address"), family.alias("_family"), "covered_from_at", "covered_until_at").filter("_family is not null")
    asked = timed.join(undecided.select("id", "observed_at", "dst_address"), "id").withColumns({"_looked": F.col("observed_at") - F.col("delay_s"), "_n": dns_name(F.col("domain")), "_family": net.ip_family(F.col("dst_address"))})

    def answered(key: str) -> DataFrame:
        """Records whose name had an answer of that target or family then; pieces don't overlap, so each is met once."""
        pieces = joins.earliest_pieces(answers, ["_n", key], low="covered_from_at", high="covered_until_at").drop("covered_from_at")
        return joins.binned_range_join(asked.select("id", "_looked", "_n", key), pieces, at="_looked", low="_from", high="_until", width=joins.SPAN_S, on=["_n", key]).select("id")

    contradicted = answered("_family").join(answered("dst_address"), "id", "left_anti")
    return timed.join(contradicted, "id", "left_anti")


def attribute_sites(flow: DataFrame, lookups: DataFrame, records: DataFrame, *, timing_s: int = 5, cap_s: int = 3600, max_links: int = 11, exact: DataFrame | None = None) -> DataFrame:
    """flow_id, site_name, method, delay_s: by exact evidence if that leaves one name, by timing if it leaves none.

    exact: what ``exact_evidence`` found of these records, where that is known already.

    records: held_in, owner_name, rrtype, value, address, covered_from_at, covered_until_at.
    """
    if exact is None:
        # Met twice below; one row for each record that has such evidence.
        exact = checkpointed(exact_evidence(flow, lookups, records, cap_s=cap_s, max_links=max_links))
    by_name = exact.filter("names = 1").select(F.col("origin").alias("flow_id"), F.col("latest.domain").alias("site_name"), F.lit("resolver_cache_answer").alias("method"), (F.col("at") - F.col("latest.looked_up_at")).alias("delay_s"))
    timed = timing_evidence(flow, lookups, records, exact, timing_s=timing_s)
    return by_name.unionByName(timed.select(F.col("id").alias("flow_id"), F.col("domain").alias("site_name"), F.lit("lookup_timing").alias("method"), "delay_s"))


def resolve_hostnames(lookups: DataFrame, leases: DataFrame, local_data: DataFrame) -> DataFrame:
    """id, address and client_resolution of lookups that came with a host name: by lease, else local data."""
    asked = lookups.select(F.col("id").alias("key"), host_label(F.col("client_hostname")).alias("label"), F.col("looked_up_at").alias("at"))
    by_lease = joins.lease_at(asked, leases)
    local = joins.lease_at(asked, local_data).select("key", F.col("state").alias("_s"), F.col("address").alias("_a"))
    unknown = F.col("state") == "unknown"
    both = by_lease.join(local, "key", "left").withColumns({"_s": F.when(unknown, F.col("_s")), "_a": F.when(unknown, F.col("_a"))})
    state = F.when(F.col("state") == "resolved", "lease_hostname").when(F.col("state") == "this_firewall", "this_firewall").when((F.col("state") == "ambiguous") | (F.col("_s") == "ambiguous"), "ambiguous_hostname").when(F.col("_s") == "resolved", "local_data_hostname").otherwise("unknown_hostname")
    return both.select(F.col("key").alias("id"), F.coalesce("address", "_a").alias("address"), state.alias("client_resolution"))


def blocked_decisions(flow: DataFrame, dns: DataFrame, blocklist: DataFrame, events: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row for each refusal of the packet filter, the resolver and the intrusion engine."""
    held = addresses.filter(F.col("source_field").isin(*HELD_FIELDS)).select(F.col("address").alias("target")).distinct().withColumn("_held", F.lit(True))
    reason = F.col("log_reason")
    engine = F.when(reason == "match", "firewall_rule").when(reason.isin(*NO_RULE_REASONS), "firewall_no_rule").otherwise("firewall_reason_not_recorded")
    own = lambda df: df.join(held, "target", "left").withColumn("target_is_this_firewall", F.coalesce("_held", F.lit(False))).drop("_held")
    flows = own(flow.filter(scope.blocked()).select(F.lit("flow").alias("source_table"), F.col("id").alias("source_id"), F.col("observed_at").alias("occurred_at"), engine.alias("engine_kind"), F.col("rid").alias("engine_reference"), F.col("src_client_id").alias("client_id"), F.col("src_interface_id").alias("interface_id"), F.col("dst_address").alias("target"), F.lit("address").alias("target_kind")))
    purpose = F.col("purpose")
    kind = F.when(F.col("blocklist_id").isNull(), "dns_list_not_recorded").when(purpose.isNull(), "dns_unassigned_list").when(purpose.isin(*PURPOSES), F.concat(F.lit("dns_"), purpose, F.lit("_list"))).otherwise("dns_other_list")
    lists = blocklist.select(F.col("id").alias("blocklist_id"), "name", "purpose")
    names = dns.filter(F.col("action").isin("block", "drop")).join(lists, "blocklist_id", "left").select(F.lit("dns_resolution").alias("source_table"), F.col("id").alias("source_id"), F.col("looked_up_at").alias("occurred_at"), kind.alias("engine_kind"), F.col("name").alias("engine_reference"), "client_id", "interface_id", F.col("domain").alias("target"), F.lit("domain").alias("target_kind"), F.lit(False).alias("target_is_this_firewall"))
    alerts = own(events.filter("event_action = 'blocked'").select(F.lit("security_event").alias("source_table"), F.col("id").alias("source_id"), "occurred_at", F.lit("security_engine").alias("engine_kind"), F.col("rule_identity").alias("engine_reference"), F.col("src_client_id").alias("client_id"), F.col("src_interface_id").alias("interface_id"), F.col("dst_address").alias("target"), F.lit("address").alias("target_kind")))
    return flows.unionByName(names).unionByName(alerts)


def pair_volume_daily(flow: DataFrame) -> DataFrame:
    """Unordered end pairs by day, service port and protocol; direction and device of the first record."""
    ends = {"endpoint_low": F.least("src_address", "dst_address"), "endpoint_high": F.greatest("src_address", "dst_address"), "service_port": F.coalesce("dst_port", F.lit(0)), "day_start_at": F.expr("observed_at - observed_at % 86400")}
    rows = flow.filter(scope.not_second_leg()).withColumns(ends)
    first = F.min(F.struct("id", "direction", "interface_device"))
    out = rows.groupBy("day_start_at", "endpoint_low", "endpoint_high", "service_port", "protocol").agg(F.sum("packet_bytes").alias("octets"), F.count(F.lit(1)).alias("packets"), first.alias("_f"), F.max("observed_at").alias("last_seen_at"))
    return out.withColumns({"observed_direction": F.col("_f.direction"), "observed_interface_device": F.col("_f.interface_device")}).drop("_f")


def detect_gaps(pages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Intervals missing between one poll's page and all before it. pages: provider_id, polled_at, oldest_at, newest_at.

    stored (provider_id, newest_at) is what was stored before the first page. The running maximum is taken in two
    levels, over a provider's days and within a day, so that a provider with a long history is not one task's rows.
    """
    day = F.expr("polled_at div 86400")
    by_day = pages.groupBy("provider_id", day.alias("_day")).agg(F.max("newest_at").alias("_most"))
    before_day = F.max("_most").over(Window.partitionBy("provider_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = by_day.select("provider_id", "_day", before_day.alias("_days"))
    if stored is not None:
        first = stored.groupBy("provider_id").agg(F.max("newest_at").alias("_stored"))
        days = days.join(first, "provider_id", "left").withColumn("_days", F.greatest("_days", "_stored")).drop("_stored")
    within = F.max("newest_at").over(Window.partitionBy("provider_id", "_day").orderBy("polled_at").rowsBetween(Window.unboundedPreceding, -1))
    known = pages.withColumn("_day", day).withColumn("_w", within).join(days, ["provider_id", "_day"]).withColumn("_b", F.greatest("_w", "_days"))
    return known.filter(F.col("oldest_at") > F.col("_b")).select("provider_id", F.col("_b").alias("interval_start_at"), F.col("oldest_at").alias("interval_end_at"), F.lit("page_overrun").alias("reason"), F.col("polled_at").alias("detected_at"))


def lost_files(watermarks: DataFrame, listed: DataFrame, answered: DataFrame, *, now: int) -> tuple[DataFrame, DataFrame]:
    """(gaps, watermarks): a file that was read from and that its provider no longer lists is lost, once and for good.

    watermarks: provider_id, file_id, byte_offset, observed_at, rotation_state. listed: provider_id, file_id. answered:
    provider_id of those whose list could be read; of others nothing is concluded. A lost file keeps its offset, and a
    file that is lost already gives no further gap.
    """
    could = answered.select("provider_id").distinct()
    there = listed.select("provider_id", "file_id").distinct().withColumn("_there", F.lit(True))
    judged = watermarks.join(could.withColumn("_asked", F.lit(True)), "provider_id", "left").join(there, ["provider_id", "file_id"], "left")
    gone = F.col("_asked").isNotNull() & F.col("_there").isNull()
    new = gone & (F.col("rotation_state") != "lost")
    gaps = judged.filter(new).select("provider_id", F.col("observed_at").alias("interval_start_at"), F.lit(now).cast("bigint").alias("interval_end_at"), F.lit("eve_rotation_lost").alias("reason"), F.lit(now).cast("bigint").alias("detected_at"), "file_id", "byte_offset")
    return gaps, judged.withColumn("rotation_state", F.when(gone, "lost").otherwise(F.col("rotation_state"))).drop("_asked", "_there")


def unclassified_due(flow: DataFrame, *, horizon: int) -> DataFrame:
    """Addresses not yet placed on records about to expire."""
    old = flow.filter(F.col("observed_at") < horizon)
    src = old.filter("src_interface_id is null").select(F.col("src_address").alias("address"))
    return src.union(old.filter("dst_interface_id is null").select("dst_address")).distinct()
