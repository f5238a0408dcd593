"""Instants as UTC epoch seconds: calendar slots and the clocks of raw payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = {"1h": "hour", "24h": "day", "7d": "week", "30d": "month"}
CHILD = {"24h": "1h", "7d": "24h", "30d": "24h"}
LATEST = 4102444800

# The layouts in which sources write instants.
ISO_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
_ZONED = 4


def slot_start(at: Column, period: str) -> Column:
    """Start of the UTC hour, day, ISO week or calendar month that holds an instant. Hours and days need no calendar."""
    if period in ("1h", "24h"):
        return at - F.pmod(at, F.lit(3600 if period == "1h" else 86400))
    if period == "7d":
        return at - F.pmod(at - 345600, F.lit(604800))  # the first Monday was four days after the epoch
    return F.unix_seconds(F.date_trunc("month", F.timestamp_seconds(at)))


def slot_end(start: Column, period: str) -> Column:
    fixed = {"1h": 3600, "24h": 86400, "7d": 604800}
    if period in fixed:
        return start + fixed[period]
    return F.unix_seconds(F.add_months(F.timestamp_seconds(start).cast("date"), 1).cast("timestamp"))


def slots_between(start: Column, end: Column, period: str) -> Column:
    """Starts of all slots that meet [start, end), as an array."""
    first = F.timestamp_seconds(slot_start(start, period))
    step = F.expr(f"interval 1 {PERIODS[period]}")
    return F.transform(F.sequence(first, F.timestamp_seconds(end - 1), step), lambda t: F.unix_seconds(t))


def normalise_epoch(value: Column) -> Column:
    """A number or numeric text as whole seconds, cut towards zero; anything else, or out of range, is null."""
    seconds = value.cast("string").try_cast("double").cast("bigint")
    return F.when((seconds >= 0) & (seconds < LATEST), seconds)


def normalise_iso(value: Column, offset_seconds: int = 0) -> Column:
    """An ISO instant as epoch seconds; those without a zone are on a clock ahead of UTC by the offset.

    A fraction may have any number of digits; what it says beyond the second doesn't count.
    """
    value = F.regexp_replace(value, r"\.(\d{1,6})\d*", ".$1")
    zoned = [F.unix_seconds(F.try_to_timestamp(value, F.lit(p))) for p in ISO_LAYOUTS[:_ZONED]]
    local = [F.unix_seconds(F.try_to_timestamp(value, F.lit(p))) - offset_seconds for p in ISO_LAYOUTS[_ZONED:]]
    return F.coalesce(*zoned, *local)


def normalise_syslog(value: Column, reference: Column, offset_seconds: int = 0) -> Column:
    """A stamp without a year, like "Jan  5 13:04:05": of the three years around the reference, the nearest."""
    tidy = F.regexp_replace(value, r"\s+", " ")
    year = F.year(F.timestamp_seconds(reference))
    at = [F.unix_seconds(F.try_to_timestamp(F.concat((year + d).cast("string"), F.lit(" "), tidy), F.lit("yyyy MMM d HH:mm:ss"))) - offset_seconds for d in (-1, 0, 1)]
    candidates = F.filter(F.array(*at), lambda t: t.isNotNull())
    nearest = F.array_sort(F.transform(candidates, lambda t: F.struct(F.abs(t - reference).alias("far"), t.alias("at"))))
    return F.try_element_at(nearest, F.lit(1))["at"]


def clock_offset(wall: Column, read_at: Column) -> Column:
    """How far a wall clock is ahead of UTC, to a quarter of an hour; null beyond 14 hours."""
    offset = (F.round((wall - read_at) / 900) * 900).cast("bigint")
    return F.when(F.abs(offset) <= 14 * 3600, offset)


def in_window(at: str, start: int, end: int, *, closed: bool = False) -> Column:
    """[start, end) for reads, [start, end] for derivations."""
    return (F.col(at) >= start) & (F.col(at) <= end if closed else F.col(at) < end)
