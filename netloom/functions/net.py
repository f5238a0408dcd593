"""Addresses: sortable keys, prefixes and classes of both families, in columns only.

A key is 32 hexadecimal digits (a version 4 address has 24 zeros before its eight); the family is kept apart, so that
text order is numeric order within a family. Joins use the same number as two longs, ``halves``: their top bits are
flipped, so that signed order is numeric order, and prefixes are masks over both.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
_TOP = -(2**63)


def is_v4(address: Column) -> Column:
    return F.coalesce(address.rlike(_V4), F.lit(False))


def v4_number(address: Column) -> Column:
    octets = F.split(address, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + octets[i].try_cast("bigint")
    return F.when(is_v4(address), number)


def v4_key(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 32, "0")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: expressions hold what they are made of, so naming it would repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def v6_groups(address: Column, *, widest: int = 4) -> Column:
    """The eight groups of a version 6 address in any of its forms, its zone aside; null for what is none.

    A group has four digits at most; a source that writes wider ones says how wide.
    """
    groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    def in_hex(text: Column) -> Column:
        """A version 4 address at the end as two groups; a wrong one leaves no address."""
        two = lambda n: F.concat(F.hex(F.call_function("div", n, F.lit(65536))), F.lit(":"), F.hex(F.pmod(n, F.lit(65536))))
        four = let(v4_number(F.regexp_extract(text, r"([0-9.]*)$", 1)), two)
        return F.when(text.contains("."), F.concat(F.regexp_replace(text, r"[0-9.]*$", ""), F.lower(four))).otherwise(text)

    def filled(sides: Column) -> Column:
        """Eight groups, those that two colons stand for among them; null where there aren't eight."""
        left, right = groups(sides[0]), F.when(F.size(sides) == 2, groups(F.get(sides, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        sound = (F.size(sides) == 1) & (missing == 0) | (F.size(sides) == 2) & (missing > 0)
        return F.when(sound, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    def checked(whole: Column) -> Column:
        return F.when(F.forall(whole, lambda g: g.rlike(f"^[0-9a-f]{{1,{widest}}}$")), whole)

    text = lambda a: let(F.lower(F.substring_index(a, "%", 1)), in_hex)
    return let(address, lambda a: F.when(a.contains(":"), let(let(F.split(text(a), "::"), filled), checked)))


def _v6_key(address: Column) -> Column:
    """The 32 digits of a version 6 address; null for what is none."""
    return let(v6_groups(address), lambda whole: F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def ip_key(address: Column, *, v6: bool = True) -> Column:
    """The key of either family; null for what is no address."""
    four = v4_key(v4_number(address))
    return F.coalesce(four, _v6_key(address)) if v6 else four


def ip_family(address: Column) -> Column:
    return F.when(is_v4(address), 4).when(address.contains(":"), 6)


def v6_shortest(groups: Column) -> Column:
    """Eight groups without leading zeros as one text: the first of the longest runs of zero groups (two at least) left out."""

    def shortest(text: Column) -> Column:
        short = F.regexp_replace(text, "^:|:$", "")
        for n in range(2, 9):
            run = ":0" * n + ":"
            before = F.substring_index(text, run, 1)
            after = F.substring(text, F.length(before) + len(run) + 1, F.lit(64))
            short = F.when(text.contains(run), F.concat(F.substring(before, F.lit(2), F.lit(64)), F.lit("::"), F.regexp_replace(after, ":$", ""))).otherwise(short)
        return short

    return let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), shortest)


def _v6_text(key: Column) -> Column:
    """The shortest form of a key."""

    def written(k: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(k, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
        mapped = F.concat(F.lit("::ffff:"), v4_text(F.conv(F.substring(k, 25, 8), 16, 10).cast("bigint")))
        return F.when(k.startswith("0" * 20 + "ffff"), mapped).when(k.isNotNull(), v6_shortest(groups))

    return let(key, written)


def ip_canonical(address: Column) -> Column:
    """Version 4 as it is, version 6 in its shortest form without a zone; null for what is no address."""
    return F.when(is_v4(address), address).otherwise(_v6_text(_v6_key(address)))


def unmapped(address: Column) -> Column:
    """A version 4 address written as one of version 6, as version 4; others as they are."""
    four = lambda k: F.when(k.startswith("0" * 20 + "ffff"), v4_text(F.conv(F.substring(k, 25, 8), 16, 10).cast("bigint")))
    return F.coalesce(let(_v6_key(address), four), address)


def v4_text(number: Column) -> Column:
    return F.concat_ws(".", *(F.pmod(F.call_function("shiftright", number, F.lit(s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))


def halves(address: Column) -> Column:
    """family, high and low of an address, as longs whose signed order is the address's; null for what is none.

    Give it a column rather than an expression: it is named several times. Version 4 needs no more than its number.
    """

    def split(key: Column) -> Column:
        word = lambda at: F.conv(F.substring(key, at, 8), 16, 10).cast("bigint")
        half = lambda at: F.call_function("shiftleft", word(at), F.lit(32)).bitwiseOR(word(at + 8)).bitwiseXOR(F.lit(_TOP))
        return F.when(key.isNotNull(), F.struct(F.lit(6).alias("family"), half(1).alias("high"), half(17).alias("low")))

    four = F.struct(F.lit(4).alias("family"), F.lit(_TOP).alias("high"), v4_number(address).bitwiseXOR(F.lit(_TOP)).alias("low"))
    return F.when(is_v4(address), four).otherwise(let(_v6_key(address), split))


def key_of(high: Column, low: Column) -> Column:
    """The key of both halves."""
    digits = lambda half: F.lpad(F.lower(F.hex(half.bitwiseXOR(F.lit(_TOP)))), 16, "0")
    return F.concat(digits(high), digits(low))


def text_of(family: Column, high: Column, low: Column) -> Column:
    return F.when(family == 4, v4_text(low.bitwiseXOR(F.lit(_TOP)))).otherwise(_v6_text(key_of(high, low)))


def width_of(family: Column, bits: Column) -> Column:
    """A prefix's length in 128 bits; null for a length that the family doesn't have."""
    return F.when((bits >= 0) & (bits <= F.when(family == 4, 32).otherwise(128)), F.when(family == 4, bits + 96).otherwise(bits))


def _masks(width: Column) -> tuple[Column, Column]:
    left = lambda by: F.call_function("shiftleft", F.lit(-1).cast("bigint"), by.cast("int"))
    none, all_ = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    return F.when(width >= 64, all_).when(width <= 0, none).otherwise(left(64 - width)), F.when(width >= 128, all_).when(width <= 64, none).otherwise(left(128 - width))


def masked(high: Column, low: Column, width: Column) -> tuple[Column, Column]:
    """Both halves of the first address with the same leading bits (out of 128)."""
    flip = lambda half, mask: half.bitwiseXOR(F.lit(_TOP)).bitwiseAND(mask).bitwiseXOR(F.lit(_TOP))
    one, two = _masks(width)
    return flip(high, one), flip(low, two)


def shared_width(a: Column, b: Column) -> Column:
    """How many leading bits (out of 128) two addresses, given as ``halves``, have in common."""
    bits = lambda x: F.when(x == 0, 0).otherwise(F.length(F.bin(x)))
    high, low = a["high"].bitwiseXOR(b["high"]), a["low"].bitwiseXOR(b["low"])
    return F.when(high != 0, 64 - bits(high)).otherwise(128 - bits(low))


def not_after(a: Column, b: Column) -> Column:
    """Whether an address, as ``halves``, is at most another."""
    return (a["high"] < b["high"]) | (a["high"] == b["high"]) & (a["low"] <= b["low"])


def prefix(network: Column, bits: Column) -> Column:
    """family, width (out of 128), high and low of a prefix; null for what is none. Bits beyond the length don't count."""

    def cut(at: Column) -> Column:
        width = width_of(at["family"], bits)
        high, low = masked(at["high"], at["low"], width)
        return F.when(at.isNotNull() & width.isNotNull(), F.struct(at["family"].alias("family"), width.cast("int").alias("width"), high.alias("high"), low.alias("low")))

    return let(halves(network), cut)


def ip_network(address: Column, bits: Column) -> Column:
    """First address of the prefix that holds an address."""
    return let(prefix(address, bits), lambda p: F.when(p.isNotNull(), text_of(p["family"], p["high"], p["low"])))


def network_bounds(network: Column, bits: Column) -> tuple[Column, Column]:
    """First and last number of a version 4 prefix."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(32) - bits).cast("int"))
    number = v4_number(network)
    low = number - F.pmod(number, size)
    return low, low + size - 1


def _known_prefix(network: str, bits: int) -> Column:
    """``prefix`` of a network known beforehand, so that rows don't take it apart again."""
    block = ipaddress.ip_network((network, bits), strict=False)
    first = int(block.network_address)
    half = lambda n: F.lit(n + _TOP).cast("bigint")
    return F.struct(F.lit(block.version).alias("family"), F.lit(bits if block.version == 6 else bits + 96).alias("width"), half(first >> 64).alias("high"), half(first % 2**64).alias("low"))


def ip_in_prefix(address: Column, network: Column | str, bits: Column | int) -> Column:
    """Whether a prefix, of columns or known beforehand, holds an address of its family; null if either is none."""

    def holds(p: Column) -> Column:
        def inside(at: Column) -> Column:
            high, low = masked(at["high"], at["low"], p["width"])
            return F.when(at.isNotNull() & p.isNotNull(), (at["family"] == p["family"]) & (high == p["high"]) & (low == p["low"]))

        return let(halves(address), inside)

    return let(_known_prefix(network, bits) if isinstance(network, str) else prefix(network, bits), holds)


def is_loopback(address: Column) -> Column:
    return F.coalesce(address.startswith("127.") & is_v4(address) | (F.lower(address) == "::1"), F.lit(False))


def is_link_local(address: Column) -> Column:
    return F.coalesce(address.startswith("169.254.") & is_v4(address) | F.lower(address).rlike("^fe[89ab][0-9a-f]:"), F.lit(False))


def is_public(address: Column) -> Column:
    """Neither private, shared, loopback, link-local, multicast nor unspecified, in either family."""

    def four(n: Column) -> Column:
        # Reserved version 4 ranges.
        reserved = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 3)]
        out = n.isNotNull()
        for network, bits in reserved:
            low = int(ipaddress.IPv4Address(network))
            out = out & ~n.between(low, low + 2 ** (32 - bits) - 1)
        return out

    def six(key: Column) -> Column:
        """A version 4 address written as one of version 6 is judged as version 4."""
        mapped = let(F.conv(F.substring(key, 25, 8), 16, 10).cast("bigint"), four)
        return F.when(key.startswith("0" * 20 + "ffff"), mapped).otherwise(~key.rlike("^(0{31}[01]$|f[cd]|fe[89a-f]|ff)"))

    return F.coalesce(F.when(is_v4(address), let(v4_number(address), four)), let(_v6_key(address), six), F.lit(False))


def mac_normalise(mac: Column) -> Column:
    tidy = F.lower(F.regexp_replace(F.trim(mac), "-", ":"))
    return F.when(tidy.rlike("^[0-9a-f]{2}(:[0-9a-f]{2}){5}$") & ~tidy.isin("00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff"), tidy)


def mac_is_randomised(mac: Column) -> Column:
    """The second digit marks a locally administered address."""
    return F.substring(mac, 2, 1).isin("2", "6", "a", "e")
