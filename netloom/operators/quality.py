"""Data-quality jobs: contracts, coverage, unresolved joins, and invariants that must come out empty or 0."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import scope
from netloom.operators import joins
from netloom.operators.derive import HELD_FIELDS



def _n() -> Column:
    return F.count(F.lit(1))


def _bounded(answers: DataFrame) -> DataFrame:
    """What lacks an instant on either side covers nothing."""
    return answers.filter("covered_from_at is not null and covered_until_at is not null")


def _answers(records: DataFrame) -> DataFrame:
    """Address records by the target they name."""
    return _bounded(records.filter(F.col("rrtype").isin("A", "AAAA"))).withColumn("dst_address", F.col("address"))


def _covered(points: DataFrame, answers: DataFrame, on: Sequence[str], *, at: str) -> DataFrame:
    """points once for each key of answers that holds at their instant, however many answers of that key do.

    Keys beyond ``on`` come with the point.
    """
    keys = [c for c in answers.columns if c not in ("covered_from_at", "covered_until_at")]
    pieces = joins.earliest_pieces(_bounded(answers), keys, low="covered_from_at", high="covered_until_at").drop("covered_from_at")
    return joins.binned_range_join(points, pieces, at=at, low="_from", high="_until", width=joins.SPAN_S, on=on).drop("_from", "_until")


def flow_contract() -> dict[str, Column]:
    """What holds for every classified record."""
    return {
        "instant_in_range": F.col("observed_at").between(0, 4102444799),
        "bytes_not_negative": F.col("packet_bytes") >= 0,
        "known_action": F.col("action").isin("pass", "block", "reject", "unknown"),
        "known_direction": F.col("direction").isin("in", "out"),
        "scope_follows_membership": F.col("traffic_scope") == scope.traffic_scope(),
        "firewall_source_has_no_client": ~(F.col("src_is_this_firewall") & F.col("src_client_id").isNotNull()),
        "firewall_target_has_no_client": ~(F.col("dst_is_this_firewall") & F.col("dst_client_id").isNotNull()),
    }


def validate_rows(df: DataFrame, contract: Mapping[str, Column]) -> DataFrame:
    """rule, violations: one pass; a rule that can't be judged is violated."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(r) for r, c in contract.items()))
    pairs = ", ".join(f"'{r}', `{r}`" for r in contract)
    return counts.selectExpr(f"stack({len(contract)}, {pairs}) as (rule, violations)")


def aggregate_coverage(slots: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count_distinct("period_start_at").alias("slots"), F.min("period_start_at").alias("earliest"), F.max("period_start_at").alias("latest")).withColumn("family", F.lit(name)) for name, df in slots.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unresolved_joins(flow: DataFrame, geo: DataFrame) -> DataFrame:
    known = geo.select(F.col("address").alias("dst_address"), F.lit(1).alias("_g"))
    return flow.join(known, "dst_address", "left").agg(_n().alias("records"), F.count_if(F.col("interface_lookup_state") != "resolved").alias("interface"), F.count_if(F.col("rule_lookup_state") != "resolved").alias("rule"), F.count_if(F.col("src_interface_id").isNotNull() & F.col("src_client_id").isNull() & ~F.col("src_is_this_firewall")).alias("client"), F.count_if((F.col("traffic_scope") == "north_south") & F.col("_g").isNull()).alias("geo"))


def source_availability(providers: DataFrame, checks: DataFrame, *, order: Sequence[str] = ("checked_at",)) -> DataFrame:
    """providers: id, provider_key. checks: provider_id, state, checked_at. The last check's state by ``order``, and when the newest was; or none."""
    last = checks.groupBy(F.col("provider_id").alias("id")).agg(F.max(F.struct(*order, "state")).alias("_l"), F.max("checked_at").alias("checked_at"))
    return providers.join(last, "id", "left").select("id", "provider_key", F.coalesce("_l.state", F.lit("never_checked")).alias("state"), "checked_at")


def unresolved_hostnames_by_cause(lookups: DataFrame, leases: DataFrame) -> DataFrame:
    """lookups: id, label, at. The first cause that holds: no lease ever, none yet, none any more, several at once.

    The first two need a label's earliest start alone; leases in force are counted along each label's time, not paired.
    """
    held = leases.select(F.col("hostname_label").alias("label"), "starts_at", "expires_at", "address")
    earliest = held.groupBy("label").agg(F.min(F.coalesce("starts_at", F.lit(0))).alias("_begins"))
    met = joins.values_held(lookups, held, at="at", low="starts_at", high="expires_at", on=["label"], value="address")
    flags = lookups.join(earliest, "label", "left").join(met.groupBy("id").agg(F.max("values").alias("_values")), "id", "left")
    cause = F.when(F.col("_begins").isNull(), "no_lease").when(F.col("_begins") > F.col("at"), "lease_later").when(F.col("_values").isNull(), "lease_over").when(F.col("_values") > 1, "several_addresses").otherwise("resolvable")
    return flags.groupBy(cause.alias("cause")).agg(_n().alias("lookups"))


def unmarked_firewall_ends(flow: DataFrame, holdings: DataFrame, *, margin_s: int = 300) -> DataFrame:
    """Records whose target the firewall held at their instant, by whether they are marked."""
    until = F.when(~F.col("is_current"), F.col("last_seen_at") + margin_s)
    h = holdings.filter(F.col("source_field").isin(*HELD_FIELDS)).select(F.col("address").alias("dst_address"), (F.col("first_seen_at") - margin_s).alias("_from"), until.alias("_until"))
    rows = flow.select("id", "observed_at", "dst_address", "dst_is_this_firewall")
    held = joins.binned_range_join(rows, h, at="observed_at", low="_from", high="_until", width=86400, on=["dst_address"]).select("id", "dst_is_this_firewall").distinct()
    return held.groupBy("dst_is_this_firewall").agg(_n().alias("records"))


def anonymous_north_south(flow: DataFrame) -> DataFrame:
    rows = flow.filter((F.col("traffic_scope") == "north_south") & scope.not_second_leg())
    return rows.groupBy(F.col("src_client_id").isNull().alias("anonymous")).agg(_n().alias("records"), F.sum("packet_bytes").alias("bytes"))


def pairing_outcomes(flow: DataFrame) -> DataFrame:
    return flow.groupBy(F.coalesce("pair_outcome", F.lit("unpaired")).alias("outcome")).agg(_n().alias("records"))


def counted_twice(paired: DataFrame) -> DataFrame:
    """Pairs that don't point at each other or whose legs are alike: must be 0."""
    partner = paired.select(F.col("id").alias("paired_flow_id"), F.col("paired_flow_id").alias("_back"), F.col("pair_outcome").alias("_o"))
    bad = paired.filter("paired_flow_id is not null").join(partner, "paired_flow_id", "left").filter(~F.col("_back").eqNullSafe(F.col("id")) | (F.col("_o") == F.col("pair_outcome")))
    return bad.agg(_n().alias("violations"))


def unattributed_with_one_candidate(candidates: DataFrame, attribution: DataFrame) -> DataFrame:
    """candidates: flow_id, domain. Records with exactly one candidate domain and no attribution: must be 0."""
    one = candidates.groupBy("flow_id").agg(F.count_distinct("domain").alias("n")).filter("n = 1")
    return one.join(attribution.select("flow_id"), "flow_id", "left_anti").agg(_n().alias("violations"))


def unattributed_with_one_answer(flow: DataFrame, records: DataFrame, attribution: DataFrame) -> DataFrame:
    """Records whose target the answers of exactly one name held at their instant, and no attribution: must be 0.

    flow: flow_id, observed_at, dst_address. Names are counted along each target's time, so a record isn't paired with every answer that holds.
    """
    answers = _answers(records).select("dst_address", F.col("owner_name").alias("domain"), "covered_from_at", "covered_until_at")
    points = flow.select("flow_id", "observed_at", "dst_address")
    met = joins.values_held(points, answers, at="observed_at", low="covered_from_at", high="covered_until_at", on=["dst_address"], value="domain").filter("values > 0")
    one = met.groupBy("flow_id").agg(F.max("values").alias("n"), F.min("domain").alias("first"), F.max("domain").alias("last")).filter("n = 1 and first = last")
    return one.join(attribution.select("flow_id"), "flow_id", "left_anti").agg(_n().alias("violations"))


def exact_left_out(exact: DataFrame, attribution: DataFrame) -> DataFrame:
    """Records whose exact evidence (``derive.exact_evidence``) leaves one name but that have none: must be 0."""
    return exact.filter("names = 1").select(F.col("origin").alias("flow_id")).join(attribution.select("flow_id"), "flow_id", "left_anti").agg(_n().alias("violations"))


def timing_left_out(timed: DataFrame, attribution: DataFrame) -> DataFrame:
    """Records that ``derive.timing_evidence`` names but that have no name: must be 0."""
    return timed.select(F.col("id").alias("flow_id")).join(attribution.select("flow_id"), "flow_id", "left_anti").agg(_n().alias("violations"))


def evidence_mismatch(attribution: DataFrame, flow: DataFrame, answers: DataFrame) -> DataFrame:
    """Exact attributions whose name's answers, held at the record's instant, lack its target: must be 0.

    answers: name, address, covered_from_at, covered_until_at, as forward expansion gives them.
    """
    exact = attribution.filter("method = 'resolver_cache_answer'").join(flow.select(F.col("id").alias("flow_id"), "observed_at", "dst_address"), "flow_id")
    held = answers.select(F.col("name").alias("site_name"), F.col("address").alias("dst_address"), "covered_from_at", "covered_until_at")
    good = _covered(exact.select("flow_id", "site_name", "dst_address", "observed_at"), held, ["site_name", "dst_address"], at="observed_at")
    return exact.join(good.select("flow_id"), "flow_id", "left_anti").agg(_n().alias("violations"))


def other_family_only(timed: DataFrame, answers: DataFrame) -> DataFrame:
    """Timing attributions whose name had answers only of the other address family. timed: flow_id, name, at, family."""
    held = _covered(timed.select("flow_id", "name", "at", "family"), answers.select("name", "answer_family", "covered_from_at", "covered_until_at"), ["name"], at="at")
    flags = held.groupBy("flow_id").agg(F.max((F.col("answer_family") == F.col("family")).cast("int")).alias("same"))
    return flags.filter("same = 0").agg(_n().alias("records"))


def cache_coverage(flow: DataFrame, records: DataFrame) -> DataFrame:
    """Share of records whose target had a covering address record."""
    r = _answers(records).select("dst_address", "covered_from_at", "covered_until_at")
    covered = _covered(flow.select("dst_address", "observed_at"), r, ["dst_address"], at="observed_at").agg(_n().alias("covered"))
    return flow.agg(_n().alias("records")).crossJoin(covered).withColumn("percent", F.round(F.try_divide(100.0 * F.col("covered"), F.col("records")), 2))


def observations_per_hour(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy(F.expr("first_seen_at - first_seen_at % 3600").alias("hour_at")).agg(_n().alias("started"))


def lookups_by_resolution(dns: DataFrame) -> DataFrame:
    return dns.groupBy("client_resolution").agg(_n().alias("lookups"), F.min("looked_up_at").alias("earliest"), F.max("looked_up_at").alias("latest"))
