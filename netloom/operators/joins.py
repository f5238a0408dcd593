"""Joins on more than equality: ranges, prefixes, unique matches, bounded paths, as-of lookups.

Every range condition is carried by an equality: a key the semantics have, a time bin, or a network prefix. The exact
condition is then a residual filter, so Spark plans shuffled hash or sort-merge joins and can split skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import net
from netloom.functions.names import dns_name
from netloom.session import checkpointed

#: Bins of the intervals over which cached answers hold.
SPAN_S = 3600


#: Instants beyond which an interval is open.
_FAR = 1 << 60

#: Spans have so many children, as a power of two.
_STEP = 3


def _levels(width: int, reach: int) -> int:
    """Levels of spans above the bins, so that the largest holds ``reach``."""
    n = 0
    while width << (_STEP * n) < reach:
        n += 1
    return n


def _bin(value: Column, width: int, top: int) -> Column:
    """The bin of an instant; what lies beyond the largest spans counts as their first or last bin."""
    most = 1 << (_STEP * top)
    at = F.floor(value / F.lit(width)).cast("bigint")
    return F.when(at.isNotNull(), F.greatest(F.least(at, F.lit(most - 1).cast("bigint")), F.lit(-most).cast("bigint")))


def span_cover(low: Column, high: Column, *, width: int, reach: int = 1 << 33, plain: int = 16) -> Column:
    """(level, span) of aligned spans that an interval is made of, as an array; a null bound is open.

    A span of level n holds 8**n bins of ``width``. An interval of up to ``plain`` bins is its bins; a longer one, or an
    open one, is the few largest spans inside it: up to 14 on each level and 7 for an open side, however long it is.
    """
    top = _levels(width, reach)
    most = 1 << (_STEP * top)
    none = F.array().cast("array<struct<level:int,span:bigint>>")
    down = lambda x, n: F.call_function("shiftright", x, n * _STEP)

    def run(level: Column, a: Column, z: Column) -> Column:
        return F.when(a < z, F.transform(F.sequence(a, z - 1), lambda i: F.struct(level.alias("level"), i.alias("span")))).otherwise(none)

    def on_level(ends: Column, n: Column) -> Column:
        """Spans of this level that are whole, less those whose parents are."""
        above, beyond = -down(-ends["a"], n + 1), down(ends["z"], n + 1)
        whole = F.struct((-down(-ends["a"], n)).alias("a"), down(ends["z"], n).alias("z"), (above * 8).alias("above"), (beyond * 8).alias("beyond"), ((n < top) & (above < beyond)).alias("split"))
        return net.let(whole, lambda w: F.when(w["split"], F.concat(run(n, w["a"], w["above"]), run(n, w["beyond"], w["z"]))).otherwise(run(n, w["a"], w["z"])))

    def cover(ends: Column) -> Column:
        bins = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda n: on_level(ends, n)))
        return F.when(ends["z"] - ends["a"] <= plain, run(F.lit(0), ends["a"], ends["z"])).otherwise(bins)

    first = F.coalesce(_bin(low, width, top), F.lit(-most).cast("bigint"))
    last = F.coalesce(_bin(high, width, top), F.lit(most - 1).cast("bigint"))
    return net.let(F.struct(first.alias("a"), (last + 1).alias("z")), cover)


def binned_range_join(points: DataFrame, intervals: DataFrame, *, at: str, low: str, high: str, width: int, on: Sequence[str] = (), reach: int = 1 << 33) -> DataFrame:
    """Points within closed intervals; a null bound is open on that side.

    Intervals are cut into aligned spans (``span_cover``): a long or open one is a few rows, not one for each bin. Points
    ask for the span that holds them on each level that the longest interval can reach, so every pair meets once and every join has the span as
    a key besides those of ``on``. Rows whose key or instant is null meet nothing.
    """
    top = _levels(width, reach)
    spread = intervals.filter(F.coalesce(F.col(low) <= F.col(high), F.lit(True))).withColumn("_s", F.explode(span_cover(F.col(low), F.col(high), width=width, reach=reach)))
    spread = spread.withColumns({"_level": F.col("_s.level"), "_span": F.col("_s.span")}).drop("_s")
    size = (F.col(high) - F.col(low)) / width
    deepest = F.when(size <= 14, 0).when(size.isNotNull(), F.ceil(F.log(8.0, size + 2)).cast("int")).otherwise(top)
    levels = F.sequence(F.lit(0), F.coalesce(intervals.agg(F.max(F.least(deepest, F.lit(top)))).scalar(), F.lit(0)))
    asked = points.filter(F.col(at).isNotNull()).withColumn("_level", F.explode(levels))
    asked = asked.withColumn("_span", F.call_function("shiftright", _bin(F.col(at), width, top), F.col("_level") * _STEP))
    inside = (F.col(at) >= F.coalesce(F.col(low), F.col(at))) & (F.col(at) <= F.coalesce(F.col(high), F.col(at)))
    return asked.join(spread, ["_level", "_span", *on]).filter(inside).drop("_level", "_span")


def earliest_pieces(intervals: DataFrame, keys: Sequence[str], *, low: str, high: str) -> DataFrame:
    """Closed intervals of each key (whole seconds) cut so that none overlap: keys, low, and the piece [_from, _until].

    A piece belongs to the interval that began first of those that hold its instants, so a point meets one piece of a
    key at most, however many intervals hold it, and low is the earliest of theirs. A null bound is open.
    """
    first, last = F.coalesce(F.col(low), F.lit(-_FAR)), F.coalesce(F.col(high), F.lit(_FAR))
    widest = intervals.select(*keys, first.cast("bigint").alias("_a"), last.cast("bigint").alias("_z")).filter("_a <= _z").groupBy(*keys, "_a").agg(F.max("_z").alias("_z"))
    reached = F.max("_z").over(Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1))
    cut = widest.withColumn("_from", F.greatest(F.col("_a"), reached + 1)).filter("_from <= _z")
    bound = lambda c: F.when(F.abs(F.col(c)) < _FAR, F.col(c))
    return cut.select(*keys, bound("_a").alias(low), bound("_from").alias("_from"), bound("_z").alias("_until"))


def values_held(points: DataFrame, intervals: DataFrame, *, at: str, low: str, high: str, on: Sequence[str], value: str, width: int = 86400) -> DataFrame:
    """Points at whose instant an interval of their key holds, with values (how many distinct ones hold) and that value if it is one.

    What is in force is counted along the starts and ends of a key's intervals, which gives stretches that don't overlap:
    a point meets one at most, however many intervals hold it. A key's history is cut into bins of ``width``, each begun
    with the sums of those before it, so a hot key is many groups. The one value is known by the exclusive or of two
    hashes of all in force. An interval without a value holds but adds no value.
    """
    known = intervals.filter(" and ".join(f"`{k}` is not null" for k in on))
    marks = {"_x": F.xxhash64(value), "_y": F.xxhash64(F.lit(1), value)}
    there, zero = F.col(value).isNotNull(), F.lit(0).cast("bigint")
    step = lambda t, n: F.struct(t.alias("_at"), F.lit(n).cast("bigint").alias("_held"), F.when(there, n).otherwise(0).cast("bigint").alias("_known"))
    both = F.explode(F.array(step(F.coalesce("_from", F.lit(-_FAR)), 1), step(F.col("_until") + 1, -1)))
    steps = earliest_pieces(known, [*on, value], low=low, high=high).select(*on, *(F.when(there, v).otherwise(zero).alias(k) for k, v in marks.items()), both.alias("_e"))
    sums = {"_held": F.sum, "_known": F.sum, "_x": F.bit_xor, "_y": F.bit_xor}
    steps = steps.select(*on, "_e.*", "_x", "_y").filter("_at is not null").groupBy(*on, "_at").agg(*(fn(c).alias(c) for c, fn in sums.items()))
    steps = steps.withColumn("_bin", F.floor(F.col("_at") / width).cast("bigint"))
    bins = steps.groupBy(*on, "_bin").agg(*(fn(c).alias(c) for c, fn in sums.items()), F.min("_at").alias("_first"))
    order = Window.partitionBy(*on).orderBy("_bin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*on, "_bin", F.lead("_first").over(order).alias("_next"), *(F.coalesce(fn(c).over(before), zero).alias(f"{c}_before") for c, fn in sums.items()))
    within = Window.partitionBy(*on, "_bin").orderBy("_at")
    along = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = {c: (F.col(f"{c}_before") + fn(c).over(along)) if fn is F.sum else F.col(f"{c}_before").bitwiseXOR(fn(c).over(along)) for c, fn in sums.items()}
    until = F.coalesce(F.lead("_at").over(within), F.col("_next")) - 1
    stretches = steps.join(bins, [*on, "_bin"]).select(*on, F.when(F.col("_at") > -_FAR, F.col("_at")).alias("_from"), until.alias("_until"), *(v.alias(c) for c, v in now.items())).filter("_held > 0")
    named = known.select(*on, value).filter(there).distinct().withColumns(marks)
    one = F.when(F.col("_known") == 1, F.col(value)).alias(value)
    stretches = stretches.join(named, [*on, "_x", "_y"], "left").select(*on, "_from", "_until", F.col("_known").alias("values"), one)
    return binned_range_join(points, stretches, at=at, low="_from", high="_until", width=width, on=on).drop("_from", "_until")


def _in_blocks(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """points (with _at, halves of an address) and the blocks (_block: a prefix) that hold them.

    One equality for each family and length that occurs, on the masked address: a point isn't compared with blocks it
    lies outside. There are 162 lengths of both families at most.
    """
    b = blocks.filter("_block is not null").withColumns({f"_{k}": F.col(f"_block.{k}") for k in ("family", "width", "high", "low")}).drop("_block")
    lengths = b.select("_family", "_width").distinct()
    asked = points.filter("_at is not null").withColumn("_family", F.col("_at.family")).join(F.broadcast(lengths), "_family")
    high, low = net.masked(F.col("_at.high"), F.col("_at.low"), F.col("_width"))
    return asked.withColumns({"_high": high, "_low": low}).join(b, ["_family", "_width", "_high", "_low"]).drop("_family", "_width", "_high", "_low")


def longest_prefix_match(addresses: DataFrame, networks: DataFrame, *, address: str = "address") -> DataFrame:
    """addresses with interface_id of the network that holds them: operator's before detected, then longest, then lowest id.

    networks: interface_id, network_address, prefix_length, origin, of either family; bits beyond the length don't count.
    Link-local addresses and what is no address lie in no network.
    """
    n = networks.select(F.col("interface_id").alias("_interface"), F.col("prefix_length").alias("_bits"), F.col("origin").alias("_origin"), net.prefix(F.col("network_address"), F.col("prefix_length")).alias("_block"))
    distinct = addresses.select(address).filter(~net.is_link_local(F.col(address))).distinct().withColumn("_at", net.halves(F.col(address)))
    order = F.struct((F.col("_origin") != "operator").alias("o"), (-F.col("_bits")).alias("b"), F.col("_interface").alias("i"))
    best = _in_blocks(distinct, n).groupBy(address).agg(F.min(order).alias("_best"))
    return addresses.join(best.select(address, F.col("_best.i").alias("interface_id"), (-F.col("_best.b")).alias("prefix_length")), address, "left")


def ip_range_join(addresses: DataFrame, ranges: DataFrame, *, address: str = "address") -> DataFrame:
    """Each distinct public address with its range's columns and lookup_state resolved or miss.

    ranges: range_start, range_end (addresses of either family, or numbers of version 4 ones) and what is known of them.
    A range lies in one block, that of the leading bits its ends share; of ranges that don't overlap, one block has one
    at most, however large or small they are. A version 4 address written as version 6 is looked up as version 4.
    """
    end = lambda c: net.halves(net.v4_text(F.col(c)) if dict(ranges.dtypes)[c] in ("bigint", "int") else F.col(c))
    known = ranges.withColumns({"_first": end("range_start"), "_last": end("range_end")}).filter("_first.family = _last.family").drop("range_start", "range_end")
    width = net.shared_width(F.col("_first"), F.col("_last"))
    high, low = net.masked(F.col("_first.high"), F.col("_first.low"), width)
    known = known.withColumn("_block", F.struct(F.col("_first.family").alias("family"), width.cast("int").alias("width"), high.alias("high"), low.alias("low")))
    points = addresses.select(address).filter(net.is_public(F.col(address))).distinct().withColumn("_u", net.unmapped(F.col(address))).withColumn("_at", net.halves(F.col("_u"))).drop("_u")
    held = _in_blocks(points, known).filter(net.not_after(F.col("_first"), F.col("_at")) & net.not_after(F.col("_at"), F.col("_last")))
    held = held.drop("_at", "_first", "_last").withColumn("lookup_state", F.lit("resolved"))
    return points.select(address).join(held, address, "left").withColumn("lookup_state", F.coalesce("lookup_state", F.lit("miss")))


def pair_legs(flow: DataFrame, upstream_devices: DataFrame, *, window_s: int = 1) -> DataFrame:
    """flow with pair_outcome and paired_flow_id: the two records of one connection on its way through the firewall.

    An out record and a passed in record on another device pair if target, protocol, version, port, packet id and
    sequence agree (null with null), they are at most window_s apart, the source is the same unless the out leg's is the
    firewall, and each is the other's only candidate. The in record is the first leg. A lone out record of the firewall
    on an upstream device is not_paired. Out records meet in records in three time bins around theirs.
    """
    key = ["dst_address", "protocol", "ip_version", "dst_port", "ip_id", "tcp_seq"]
    columns = ["id", "observed_at", "interface_device", "src_address", "src_port", "src_is_this_firewall", *key]
    width = max(window_s, 1)
    out = flow.filter("direction = 'out'").select(*(F.col(c).alias(f"o_{c}") for c in columns)).withColumn("_bin", F.explode(F.array(*(F.expr(f"o_observed_at div {width}") + d for d in (-1, 0, 1)))))
    into = flow.filter((F.col("direction") == "in") & (F.col("action") == "pass") & ~F.col("src_is_this_firewall")).select(*(F.col(c).alias(f"i_{c}") for c in columns)).withColumn("_bin", F.expr(f"i_observed_at div {width}"))
    same = [F.col(f"o_{c}").eqNullSafe(F.col(f"i_{c}")) for c in key]
    near = F.abs(F.col("o_observed_at") - F.col("i_observed_at")) <= window_s
    source = F.col("o_src_is_this_firewall") | ((F.col("o_src_address") == F.col("i_src_address")) & F.col("o_src_port").eqNullSafe(F.col("i_src_port")))
    candidates = out.join(into, [out["_bin"] == into["_bin"], *same, near, source, F.col("o_interface_device") != F.col("i_interface_device")]).select("o_id", "i_id")
    only_out = candidates.groupBy("o_id").agg(F.min("i_id").alias("i_id")).join(candidates.groupBy("o_id").count().filter("count = 1").select("o_id"), "o_id")
    only_in = candidates.groupBy("i_id").count().filter("count = 1").select("i_id")
    pairs = only_out.join(only_in, "i_id")
    legs = pairs.select(F.col("i_id").alias("id"), F.lit("first_leg").alias("_o"), F.col("o_id").alias("_p")).unionByName(pairs.select(F.col("o_id").alias("id"), F.lit("second_leg").alias("_o"), F.col("i_id").alias("_p")))
    # The firewall's own record on an upstream device, with no inside record it could belong to.
    lone = (F.col("direction") == "out") & F.col("src_is_this_firewall") & F.col("_upstream").isNotNull() & F.col("_candidate").isNull()
    marked = flow.drop("pair_outcome", "paired_flow_id").join(legs, "id", "left").join(candidates.select(F.col("o_id").alias("_candidate")).distinct(), F.col("id") == F.col("_candidate"), "left")
    marked = marked.join(upstream_devices.select(F.col("device").alias("_upstream")).distinct(), F.col("interface_device") == F.col("_upstream"), "left")
    return marked.withColumn("pair_outcome", F.coalesce("_o", F.when(lone, "not_paired"))).withColumnRenamed("_p", "paired_flow_id").drop("_o", "_candidate", "_upstream")


def match_lookups_by_time(flows: DataFrame, lookups: DataFrame, *, delay_s: int = 5) -> DataFrame:
    """id, lookup and domain for flows whose client looked up exactly one domain in the delay_s before them.

    By client id where both sides have one, by address where either lacks one: two equi-joins, so the rows without a
    client are not one hot key. The latest lookup counts, ties by key.
    """
    width = max(delay_s, 1)
    f = flows.select(F.col("id").alias("_f"), F.col("observed_at").alias("_t"), F.col("src_client_id").alias("_c"), F.col("src_address").alias("_a"))
    f = f.withColumn("_bin", F.explode(F.array(F.expr(f"_t div {width}"), F.expr(f"_t div {width}") - 1)))
    look = lookups.withColumn("_bin", F.expr(f"looked_up_at div {width}"))
    inside = F.col("looked_up_at").between(F.col("_t") - delay_s, F.col("_t"))
    by_id = f.filter("_c is not null").join(look, [f["_bin"] == look["_bin"], F.col("_c") == F.col("client_id"), inside])
    by_address = f.join(look, [f["_bin"] == look["_bin"], F.col("_a") == F.col("client_address"), inside, F.col("client_id").isNull() | F.col("_c").isNull()])
    chosen = ["_f", "_t", "domain", "looked_up_at", "lookup_key"]
    found = by_id.select(*chosen).unionByName(by_address.select(*chosen))
    latest = F.max(F.struct("looked_up_at", "lookup_key", "domain"))
    one = found.groupBy("_f", "_t").agg(F.min("domain").alias("_d1"), F.max("domain").alias("_d2"), latest.alias("_l")).filter("_d1 = _d2")
    return one.select(F.col("_f").alias("id"), F.col("_l.domain").alias("domain"), F.col("_l.lookup_key").alias("lookup_key"), (F.col("_t") - F.col("_l.looked_up_at")).alias("delay_s"))


def expand_paths(frontier: DataFrame, edges: DataFrame, *, max_links: int = 11, covering: bool = True) -> DataFrame:
    """Names reachable over at most max_links edges: origin, terminal, name, links, covered_from.

    frontier: origin (what the walk is for), terminal, name, at, covered_from. edges: from_name, to_name and, if
    covering, covered_from and covered_until, which must hold ``at``; a path's coverage starts when its last link's
    does. A name is kept once for each origin and terminal, with the earliest coverage. Rounds end when nothing is new.
    """
    reached = checkpointed(frontier.withColumn("links", F.lit(0)))
    step, links = reached, 0
    # Of the edges of one pair of names that hold an instant only the first to begin counts, so the others are left out before the join.
    if covering:
        edges = earliest_pieces(edges, ["from_name", "to_name"], low="covered_from", high="covered_until").select(F.col("from_name").alias("name"), "to_name", F.col("covered_from").alias("_starts"), "_from", "_until")
    else:
        edges = edges.select(F.col("from_name").alias("name"), "to_name").distinct()
    key = ["origin", "terminal", "name"]
    while links < max_links:
        links += 1
        if covering:
            met = binned_range_join(step, edges, at="at", low="_from", high="_until", width=SPAN_S, on=["name"])
        else:
            met = step.join(edges, "name")
        start = F.greatest("covered_from", "_starts") if covering else F.col("covered_from")
        walked = met.select("origin", "terminal", F.col("to_name").alias("name"), "at", start.alias("covered_from"))
        walked = walked.groupBy("origin", "terminal", "name", "at").agg(F.min("covered_from").alias("covered_from"))
        known = reached.select(*key, F.col("covered_from").alias("_known"))
        step = walked.join(known.groupBy(*key).agg(F.min("_known").alias("_known")), key, "left").filter("_known is null or covered_from < _known").drop("_known").withColumn("links", F.lit(links))
        step = checkpointed(step)
        if step.isEmpty():
            break
        reached = reached.unionByName(step)
    best = reached.groupBy(*key, "at").agg(F.min("covered_from").alias("covered_from"), F.min("links").alias("links"))
    return best.select("origin", "terminal", "name", "at", "covered_from", "links")


def answer_addresses(names: DataFrame, records: DataFrame, *, max_links: int = 11) -> DataFrame:
    """origin, name, address: what a name answered at an instant, by address records and over aliases held in cache.

    names: origin, name, at. Local data answers without aliases only.
    """
    span = {"covered_from": F.col("covered_from_at"), "covered_until": F.col("covered_until_at")}
    aliases = records.filter("rrtype = 'CNAME' and held_in = 'cache'").select(F.col("owner_name").alias("from_name"), F.col("value").alias("to_name"), *(c.alias(k) for k, c in span.items()))
    start = names.select("origin", F.col("name").alias("terminal"), "name", "at", F.lit(0).cast("bigint").alias("covered_from"))
    reached = expand_paths(start, aliases, max_links=max_links)
    held = records.filter(F.col("rrtype").isin("A", "AAAA")).withColumn("name", F.col("owner_name"))
    held = earliest_pieces(held, ["name", "address", "held_in"], low="covered_from_at", high="covered_until_at").drop("covered_from_at")
    found = binned_range_join(reached, held, at="at", low="_from", high="_until", width=SPAN_S, on=["name"]).filter((F.col("held_in") == "cache") | (F.col("links") == 0))
    return found.select("origin", F.col("terminal").alias("name"), "address").distinct()


def exact_candidates(paths: DataFrame, lookups: DataFrame, *, cap_s: int = 3600) -> DataFrame:
    """Lookups of a path's name by the same client inside [max(covered_from, at - cap_s), at].

    Local data answers only lookups answered from it, and is matched without climbing (links = 0).
    """
    p = paths.withColumn("_low", F.greatest("covered_from", F.col("at") - cap_s))
    look = lookups.withColumn("name", dns_name(F.col("domain"))).drop("held_in")

    def met(asked: DataFrame, walked: DataFrame) -> DataFrame:
        return binned_range_join(asked, walked, at="looked_up_at", low="_low", high="at", width=max(cap_s, 1), on=["name", "_who"])

    # The client is part of the key: a name that all look up isn't paired with everyone's records.
    by_id = met(look.filter("client_id is not null").withColumn("_who", F.col("client_id")), p.filter("src_client_id is not null").withColumn("_who", F.col("src_client_id")))
    by_address = met(look.withColumn("_who", F.col("client_address")), p.withColumn("_who", F.col("src_address"))).filter("client_id is null or src_client_id is null")
    local = F.when(F.col("held_in") == "local_data", (F.col("answer_source") == "Local-data") & (F.col("links") == 0)).otherwise(True)
    return by_id.drop("_who").unionByName(by_address.drop("_who")).filter(local).drop("_low")


def lease_at(questions: DataFrame, leases: DataFrame) -> DataFrame:
    """key, address and state of host names at instants: resolved, ambiguous, unknown, or this_firewall for localhost.

    questions: key, label, at. leases: hostname_label, address, starts_at and expires_at, either of which may be open.
    """
    held = leases.select(F.col("hostname_label").alias("label"), "address", "starts_at", "expires_at")
    met = values_held(questions.select("key", "label", "at"), held, at="at", low="starts_at", high="expires_at", on=["label"], value="address")
    none = questions.select("key", "label", F.lit(0).cast("bigint").alias("values"), F.lit(None).cast("string").alias("address"))
    found = met.select(*none.columns).unionByName(none).groupBy("key", "label").agg(F.max("values").alias("n"), F.min("address").alias("first"), F.max("address").alias("_last"))
    found = found.withColumn("n", F.when(F.col("first") != F.col("_last"), 2).otherwise(F.col("n"))).drop("_last")
    state = F.when(F.col("label") == "localhost", "this_firewall").when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return found.select("key", state.alias("state"), F.when((F.col("n") == 1) & (F.col("label") != "localhost"), F.col("first")).alias("address"))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in an order that leaves no ties."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def overlapping(buckets: DataFrame, gaps: DataFrame, *, start: str, end: str) -> DataFrame:
    """buckets with in_gap: whether a known gap [interval_start_at, interval_end_at] meets [start, end).

    Gaps are cut into days, buckets reach over the days they meet; a bucket counts once.
    """
    days = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div 86400"), F.expr(f"{b} div 86400")))
    g = gaps.withColumn("_day", days("interval_start_at", "interval_end_at"))
    b = buckets.select(start, end).distinct().withColumn("_day", days(start, f"({end} - 1)"))
    hit = b.join(g, [b["_day"] == g["_day"], F.col("interval_start_at") < F.col(end), F.col("interval_end_at") >= F.col(start)], "left_semi").select(start, end).distinct().withColumn("in_gap", F.lit(True))
    return buckets.join(hit, [start, end], "left").withColumn("in_gap", F.coalesce("in_gap", F.lit(False)))
