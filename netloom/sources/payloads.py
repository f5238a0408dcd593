"""Raw payloads into canonical tables: JSON files of a firewall's interfaces, read as text fields and cast by rule.

Readers never infer schemas. What cannot be read is a null or a rejected row with a reason, never a neighbouring value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import net
from netloom.functions.names import dns_name, host_label, leading_number
from netloom.functions.time import normalise_epoch, normalise_iso, normalise_syslog


def read_enveloped_json(spark: SparkSession, path: str, schema: T.StructType, *, rows: str | None = "rows") -> DataFrame:
    """One row for each object of a bare array, of an envelope's list, or of a map keyed by member (then with member)."""
    return read_with_rejects(spark, path, schema, rows=rows)[0]


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType, *, rows: str | None = "rows") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): rows as ``read_enveloped_json`` gives them, and what could not be read.

    rejected: path, reason, at, content. A file that isn't JSON (``json``), is empty (``empty``) or is neither list,
    envelope nor map (``shape``) is rejected whole; an element that isn't an object (``element``) alone, with its place.
    """
    name = rows or "rows"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value"))
    parsed = raw.withColumn("_json", F.try_parse_json("value"))
    as_list = F.try_variant_get("_json", "$", "array<variant>")
    enveloped = F.try_variant_get("_json", f"$.{name}", "array<variant>")
    as_map = F.try_variant_get("_json", "$", "map<string,variant>")
    shaped = parsed.withColumns({"_list": F.coalesce(as_list, enveloped), "_map": F.when(as_list.isNull() & enveloped.isNull(), as_map)})
    reason = F.when(F.coalesce(F.col("value"), F.lit("")) == "", "empty").when(F.col("_json").isNull(), "json").when(F.col("_list").isNull() & F.col("_map").isNull(), "shape")
    judged = shaped.withColumn("_reason", reason)
    listed = judged.filter("_reason is null and _list is not null").select("path", F.posexplode("_list").alias("at", "_v")).withColumn("member", F.lit(None).cast("string"))
    keyed = judged.filter("_reason is null and _list is null").select("path", F.posexplode("_map").alias("at", "member", "_v"))
    objects = listed.select("path", "at", "member", "_v").unionByName(keyed.select("path", "at", "member", "_v"))
    objects = objects.withColumns({"_is": F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)), "o": F.from_json(F.to_json("_v"), schema)})
    whole = judged.filter("_reason is not null").select("path", F.col("_reason").alias("reason"), F.lit(None).cast("int").alias("at"), F.col("value").alias("content"))
    single = objects.filter(~F.col("_is")).select("path", F.lit("element").alias("reason"), "at", F.to_json("_v").alias("content"))
    return objects.filter("_is").select("member", "o.*"), whole.unionByName(single)


def text_fields(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


FLOW_LOG = text_fields("__digest__", "__timestamp__", "interface", "action", "dir", "reason", "rid", "ipversion", "protoname", "length", "src", "dst", "srcport", "dstport", "id", "seq")


def _known(value: Column, *words: str, otherwise: str = "unknown") -> Column:
    return F.when(F.lower(value).isin(*words), F.lower(value)).otherwise(otherwise)


def parse_flow_log(raw: DataFrame, *, reference_at: Column, offset_seconds: int = 0) -> tuple[DataFrame, DataFrame]:
    """(flow, rejected): records without a digest or an instant are dropped; without version or length, rejected."""
    stamp = F.coalesce(normalise_iso(F.col("__timestamp__"), offset_seconds), normalise_syslog(F.col("__timestamp__"), reference_at, offset_seconds), normalise_epoch(F.col("__timestamp__")))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = raw.select(
        F.xxhash64("__digest__").alias("id"), text("__digest__").alias("log_digest"), stamp.alias("observed_at"), F.col("interface").alias("interface_device"),
        _known(F.col("action"), "pass", "block", "reject").alias("action"), _known(F.col("dir"), "in", "out").alias("direction"), text("reason").alias("log_reason"), text("rid").alias("rid"),
        F.col("ipversion").try_cast("int").alias("ip_version"), F.lower("protoname").alias("protocol"), F.col("length").try_cast("bigint").alias("packet_bytes"), F.col("src").alias("src_address"), F.col("dst").alias("dst_address"),
        F.col("srcport").try_cast("int").alias("src_port"), F.col("dstport").try_cast("int").alias("dst_port"), F.col("id").try_cast("int").alias("ip_id"), F.col("seq").try_cast("bigint").alias("tcp_seq"),
    ).filter("log_digest is not null and observed_at is not null")
    reason = F.when(~F.coalesce(F.col("ip_version").isin(4, 6), F.lit(False)), "ip_version").when(F.coalesce(F.col("packet_bytes") < 0, F.lit(True)), "length")
    judged = rows.withColumn("reject_reason", reason)
    return judged.filter("reject_reason is null").drop("reject_reason"), judged.filter("reject_reason is not null")


def resolve_flow_keys(flow: DataFrame, interface_map: DataFrame, rule: DataFrame) -> DataFrame:
    """Device to interface and label to rule, each with its state: resolved, not_found, or pending where none is given.

    Of a label given twice the least id counts, so records stay as many as they were.
    """
    im = interface_map.select(F.col("device").alias("interface_device")).distinct().withColumn("_i", F.lit(True))
    r = rule.groupBy(F.col("pf_label").alias("rid")).agg(F.min("id").alias("rule_id"))
    state = lambda given, found: F.when(given.isNull(), "pending").when(found.isNotNull(), "resolved").otherwise("not_found")
    out = flow.join(im, "interface_device", "left").join(r, "rid", "left")
    return out.withColumns({"interface_lookup_state": state(F.col("interface_device"), F.col("_i")), "rule_lookup_state": state(F.col("rid"), F.col("rule_id"))}).drop("_i")


LOOKUP = text_fields("client", "domain", "time", "action", "source", "rcode", "dnssec_status", "blocklist", "uuid")


def parse_lookups(raw: DataFrame, *, logged: Column | None = None) -> DataFrame:
    """Resolver lookups; the key is a digest of what tells them apart, since the source has none.

    logged: whether the client is an address rather than a host name, where the source has its own rule.
    """
    key = F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("time", "client", "domain", "action", "source", "rcode"))), 256)
    address = F.when(net.is_v4(F.col("client")) | F.col("client").contains(":") if logged is None else logged, F.col("client"))
    return raw.select(key.alias("lookup_key"), address.alias("client_address"), F.when(address.isNull(), F.col("client")).alias("client_hostname"), F.when(address.isNotNull(), "logged_address").otherwise("unknown_hostname").alias("client_resolution"), "domain", _known(F.col("action"), "pass", "block", "drop").alias("action"), F.col("source").alias("answer_source"), "rcode", "dnssec_status", F.nullif("blocklist", F.lit("")).alias("blocklist"), normalise_epoch(F.col("time")).alias("looked_up_at"))


LEASE = text_fields("address", "hwaddr", "hostname", "client_id", "duid", "iaid", "if_name", "expire", "valid_lifetime", "state", "starts")


def lease_generation_key(starts: Column, expires: Column, observed: Column) -> Column:
    return F.when(starts.isNotNull(), F.concat(F.lit("start:"), starts.cast("string"))).when(expires.isNotNull(), F.concat(F.lit("expiry:"), expires.cast("string"))).otherwise(F.concat(F.lit("observed_day:"), F.floor(observed / 86400).cast("string")))


def parse_leases(raw: DataFrame, *, backend: str, observed_at: int) -> DataFrame:
    """Three servers' leases in one shape; with a lifetime the start follows from the expiry."""
    expires = normalise_epoch(F.col("expire"))
    starts = F.coalesce(normalise_epoch(F.col("starts")), expires - F.col("valid_lifetime").try_cast("bigint"))
    # How the servers name a lease's state.
    state = F.when(F.col("state").isin("0", "active", "default", ""), "active").when(F.col("state").isin("1", "declined"), "declined").when(F.col("state").isin("2", "expired", "expired-reclaimed"), "expired").otherwise(F.when(F.col("state").isNull(), "active").otherwise("unknown"))
    seen = F.lit(observed_at).cast("bigint")
    return raw.filter(F.col("address") != "").select(F.lit(backend).alias("backend"), "address", net.mac_normalise(F.col("hwaddr")).alias("mac"), F.nullif("hostname", F.lit("")).alias("hostname"), host_label(F.col("hostname")).alias("hostname_label"), F.nullif("client_id", F.lit("")).alias("dhcp_client_id"), F.nullif("duid", F.lit("")).alias("duid"), F.nullif("iaid", F.lit("")).alias("iaid"), state.alias("lease_state"), starts.alias("starts_at"), expires.alias("expires_at"), seen.alias("observed_at"), lease_generation_key(starts, expires, seen).alias("generation_key"))


def parse_neighbours(raw: DataFrame, *, upstream: DataFrame, firewall_held: DataFrame) -> DataFrame:
    """mac, address and device of neighbours that are neither on an upstream device nor the firewall itself."""
    rows = raw.select(net.mac_normalise(F.col("mac")).alias("mac"), F.col("ip").alias("address"), F.col("intf").alias("device")).filter("mac is not null")
    return rows.join(upstream.select("device"), "device", "left_anti").join(firewall_held.select("address"), "address", "left_anti")


def parse_security_events(raw: DataFrame) -> DataFrame:
    """Alerts; file and position are the key. raw: fileid, filepos, alert_sid, alert, alert_action, timestamp, ends."""
    key = F.concat_ws(":", "fileid", F.col("filepos").cast("string"))
    action = F.when(F.lower("alert_action").isin("blocked", "drop", "reject"), "blocked").when(F.lower("alert_action").isin("allowed", "pass", "alert"), "allowed").otherwise("unknown")
    return raw.select(key.alias("provider_event_key"), normalise_iso(F.col("timestamp")).alias("occurred_at"), F.col("alert_sid").cast("string").alias("rule_identity"), F.col("alert").alias("signature"), action.alias("event_action"), F.col("src_ip").alias("src_address"), F.col("src_port").try_cast("int").alias("src_port"), F.col("dest_ip").alias("dst_address"), F.col("dest_port").try_cast("int").alias("dst_port"), F.lower("proto").alias("protocol"))


def _reverse_name(name: Column) -> Column:
    """The address that a reverse name spells."""
    four = F.regexp_extract(name, r"^((?:\d{1,3}\.){4})in-addr\.arpa$", 1)
    octets = F.array_join(F.reverse(F.filter(F.split(four, r"\."), lambda x: x != "")), ".")
    six = F.regexp_extract(name, r"^((?:[0-9a-f]\.){32})ip6\.arpa$", 1)
    digits = F.reverse(F.regexp_replace(six, r"\.", ""))
    groups = F.concat_ws(":", *(F.substring(digits, 1 + 4 * i, 4) for i in range(8)))
    return F.when(four != "", octets).when(six != "", groups)


def parse_resource_records(raw: DataFrame, *, held_in: str, name: str = "host") -> tuple[DataFrame, DataFrame]:
    """(records, tally): address, alias and reverse records of a resolver, and how many were skipped for which reason.

    Addresses are in their shortest form; one of the other family than its record's, or with a zone, is none.
    """
    owner, kind = dns_name(F.col(name)), F.upper("rrtype")
    given = F.when(~F.col("value").contains("%"), F.trim("value"))
    own = F.when((kind == "A") & net.is_v4(given) | (kind == "AAAA") & ~net.is_v4(given), net.ip_canonical(given))
    address = F.when(kind.isin("A", "AAAA"), own).when(kind == "PTR", net.ip_canonical(_reverse_name(owner)))
    ttl = F.when(F.col("ttl").rlike(r"^\d+$"), F.col("ttl").try_cast("bigint"))
    reason = F.when(~kind.isin("A", "AAAA", "CNAME", "PTR"), "type").when(F.coalesce(owner, F.lit("")) == "", "owner").when(F.col("ttl").isNotNull() & ttl.isNull(), "ttl").when(kind.isin("A", "AAAA", "PTR") & address.isNull(), "address").when(kind.isin("CNAME", "PTR") & (F.coalesce(dns_name(F.col("value")), F.lit("")) == ""), "value")
    value = F.when(kind.isin("CNAME", "PTR"), dns_name(F.col("value"))).otherwise(address)
    judged = raw.select(F.lit(held_in).alias("held_in"), owner.alias("owner_name"), kind.alias("rrtype"), value.alias("value"), address.alias("address"), ttl.alias("ttl"), reason.alias("reason"))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("skipped"))


INTERFACE = T.StructType([*text_fields("identifier", "device", "description", "status", "enabled", "link_type", "addr4", "addr6", "vlan_tag"), *(T.StructField(c, T.ArrayType(text_fields("ipaddr"))) for c in ("ipv4", "ipv6")), T.StructField("gateways", T.ArrayType(T.StringType()))])


def parse_interfaces(raw: DataFrame) -> DataFrame:
    upstream = F.coalesce(F.size("gateways") > 0, F.lit(False))
    return raw.filter("coalesce(device, '') <> ''").select("identifier", "device", "description", F.coalesce("link_type", F.lit("unknown")).alias("link_kind"), F.col("vlan_tag").try_cast("int").alias("vlan_tag"), upstream.alias("is_upstream"))


def explode_interface_addresses(raw: DataFrame) -> DataFrame:
    """device, source_field, address and prefix_length of every address an interface reports."""
    one = lambda field: F.array(F.struct(F.lit(field).alias("source_field"), F.col(field).alias("a")))
    many = lambda field: F.transform(F.coalesce(F.col(field), F.array().cast("array<struct<ipaddr:string>>")), lambda x: F.struct(F.lit(field).alias("source_field"), x["ipaddr"].alias("a")))
    all_ = F.concat(one("addr4"), one("addr6"), many("ipv4"), many("ipv6"))
    rows = raw.select("device", F.explode(all_).alias("x")).select("device", "x.source_field", "x.a").filter("coalesce(a, '') <> ''")
    return rows.select("device", "source_field", F.substring_index("a", "/", 1).alias("address"), F.regexp_extract("a", r"/(\d+)$", 1).try_cast("int").alias("prefix_length"))


def detect_networks(addresses: DataFrame, *, detected_at: int) -> DataFrame:
    """Masked prefixes by interface from its addresses of either family.

    Hosts, link-local prefixes (and shorter ones around them) and version 4 addresses written as version 6 are not
    proposed.
    """
    six = F.col("address").contains(":")
    most = F.when(six, 127).otherwise(31)
    rows = addresses.filter(F.col("prefix_length").between(1, most) & (net.unmapped(F.col("address")) == F.col("address")) & ~net.is_link_local(F.col("address")))
    rows = rows.filter(~six | ~F.coalesce(net.ip_in_prefix(F.lit("fe80::"), F.col("address"), F.col("prefix_length")), F.lit(False)))
    found = rows.select("device", net.ip_network(F.col("address"), F.col("prefix_length")).alias("network_address"), "prefix_length").filter("network_address is not null").distinct()
    return found.withColumns({"address_family": net.ip_family(F.col("network_address")), "origin": F.lit("detected"), "first_detected_at": F.lit(detected_at).cast("bigint"), "last_detected_at": F.lit(detected_at).cast("bigint")})


def parse_rules(raw: DataFrame) -> DataFrame:
    """Rules; a raw field (its name with a percent sign) is preferred to the localised one."""
    columns = set(raw.columns)
    pick = lambda c: F.coalesce(F.col(f"`%{c}`"), F.col(c)) if f"%{c}" in columns else F.col(c)
    flag = lambda c: F.when(F.col(c).isin("1", "true"), True).when(F.col(c).isin("0", "false"), False)
    return raw.select(F.col("uuid").alias("pf_label"), "description", F.lower(pick("action")).alias("action"), F.lower(pick("direction")).alias("direction"), F.nullif(pick("interface"), F.lit("")).alias("interface"), flag("log").alias("logs_matches"), flag("legacy").alias("legacy"), flag("is_automatic").alias("is_automatic"))


def parse_counter_samples(raw: DataFrame, *, subject_kind: str, subject: Column, sampled_at: Column, measures: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Tall samples. measures: name -> (unit, candidate fields, the first present counts); a missing one is no row."""
    present = set(raw.columns)
    cells = []
    for name, (unit, fields) in measures.items():
        values = [leading_number(F.col(f"`{f}`").cast("string")) for f in fields if f in present]
        if values:
            cells.append(F.struct(F.lit(name).alias("measure"), F.lit(unit).alias("unit"), F.coalesce(*values).alias("value")))
    if not cells:
        cells = [F.struct(F.lit("").alias("measure"), F.lit("").alias("unit"), F.lit(None).cast("double").alias("value"))]
    rows = raw.select(F.lit(subject_kind).alias("subject_kind"), subject.alias("subject_key"), sampled_at.alias("sampled_at"), F.explode(F.array(*cells)).alias("c"))
    return rows.select("subject_kind", "subject_key", "sampled_at", "c.*").filter("value is not null")


def busy_share(events: DataFrame, *, keys: list[str]) -> DataFrame:
    """Busy share of a processor from the second event of a stream (the first sums up since boot). events: seq, total, idle."""
    second = events.filter("seq = 2")
    return second.select(*keys, F.try_divide("total", F.col("total") + F.col("idle")).alias("busy"))


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """A public suffix list's rules: text before white space, without comments."""
    line = F.regexp_extract("value", r"^(\S+)", 1)
    rows = spark.read.text(path).select(line.alias("line")).filter("line <> '' and not startswith(line, '//')")
    kind = F.when(F.col("line").startswith("!"), "exception").when(F.col("line").startswith("*."), "wildcard").otherwise("exact")
    return rows.select(F.regexp_replace("line", r"^(!|\*\.)", "").alias("rule"), kind.alias("kind")).distinct()


#: Columns of a range table and their types.
RANGES = {"country_code": "string", "asn": "bigint", "operator": "string", "latitude": "double", "longitude": "double", "dataset_build_at": "bigint"}


def read_ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """A range table of either family (CSV with a header): start, end and the columns of RANGES; one that is missing is null.

    Rows whose ends aren't addresses of one family are left out.
    """
    rows = spark.read.csv(path, header=True)
    known = [(F.col(c) if c in rows.columns else F.lit(None)).try_cast(kind).alias(c) for c, kind in RANGES.items()]
    ends = rows.select(F.trim("start").alias("range_start"), F.trim("end").alias("range_end"), *known)
    return ends.filter(net.halves(F.col("range_start"))["family"] == net.halves(F.col("range_end"))["family"])
