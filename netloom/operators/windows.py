"""Windows over time series and snapshots, and ranked lists with a remainder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "__other__"


def counter_rates(samples: DataFrame, *, keys: Sequence[str] = ("subject_key", "measure")) -> DataFrame:
    """Rate between consecutive samples; a counter that fell was reset and has no rate, steps of no length are skipped."""
    w = Window.partitionBy(*keys).orderBy("sampled_at", "value")
    step = samples.withColumns({"prev_value": F.lag("value").over(w), "prev_at": F.lag("sampled_at").over(w)}).filter("prev_at is not null and sampled_at > prev_at")
    reset = F.col("value") < F.col("prev_value")
    rate = F.when(~reset, (F.col("value") - F.col("prev_value")) / (F.col("sampled_at") - F.col("prev_at")))
    return step.select(*keys, "prev_at", "sampled_at", rate.alias("rate"), reset.alias("reset"))


def latest_reading(samples: DataFrame, *, now: int, interval_s: int, keys: Sequence[str] = ("subject_key", "measure")) -> DataFrame:
    """The newest sample of each subject, if it is at most two intervals old."""
    recent = samples.filter((F.col("sampled_at") >= now - 2 * interval_s) & (F.col("sampled_at") <= now))
    return recent.groupBy(*keys).agg(F.max(F.struct("sampled_at", "value")).alias("_l")).select(*keys, F.col("_l.value").alias("value"), F.col("_l.sampled_at").alias("sampled_at"))


def departures(items: DataFrame, *, set_key: str = "set_key") -> DataFrame:
    """Items of each set's previous snapshot that its latest lacks. items: set_key, captured_at, item_key."""
    instants = items.select(set_key, "captured_at").distinct()
    ranked = instants.withColumn("_r", F.row_number().over(Window.partitionBy(set_key).orderBy(F.desc("captured_at"))))
    both = ranked.filter("_r <= 2").groupBy(set_key).agg(F.max(F.when(F.col("_r") == 1, F.col("captured_at"))).alias("absent_since_at"), F.max(F.when(F.col("_r") == 2, F.col("captured_at"))).alias("last_present_at")).filter("last_present_at is not null")
    previous = items.join(both, set_key).filter("captured_at = last_present_at").select(set_key, "item_key", "last_present_at", "absent_since_at")
    latest = items.select(set_key, "item_key", F.col("captured_at").alias("absent_since_at"))
    return previous.join(latest, [set_key, "item_key", "absent_since_at"], "left_anti")


def top_n_with_remainder(df: DataFrame, *, key: str, measure: str, n: int, min_share: float = 0.0) -> DataFrame:
    """The n largest keys with at least min_share of the total, and one row for all others with how many they are.

    The n largest are found by Spark's top-k, and only these few are joined back; the remainder is a difference of sums.
    """
    sums = df.groupBy(key).agg(F.sum(measure).alias(measure))
    total = sums.agg(F.sum(measure).alias("_t"), F.count(F.lit(1)).alias("_n"))
    top = sums.orderBy(F.desc(measure), key).limit(n).crossJoin(total).filter(F.col(measure) >= min_share * F.col("_t"))
    kept = top.select(F.col(key).cast("string").alias(key), measure, F.lit(1).cast("bigint").alias("members"))
    rest = total.crossJoin(kept.agg(F.coalesce(F.sum(measure), F.lit(0)).alias("_k"), F.count(F.lit(1)).alias("_m")))
    return kept.unionByName(rest.filter("_n > _m").select(F.lit(OTHER).alias(key), (F.col("_t") - F.col("_k")).alias(measure), (F.col("_n") - F.col("_m")).alias("members")))


def downsample(samples: DataFrame, *, bucket_s: int, keys: Sequence[str] = ("subject_key", "measure"), share: float = 0.5) -> DataFrame:
    """Mean, least, largest, sum, last and median (or another quantile) of each bucket, all exact.

    Equal values are counted first, in each task, then a bucket's values are walked in order: the quantile is where the
    running count passes its place, with a straight line between two values. No bucket's values are held at once.
    """
    rows = samples.filter("value is not null").withColumn("bucket_at", F.expr(f"sampled_at - sampled_at % {bucket_s}"))
    group = [*keys, "bucket_at"]
    values = rows.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_sum"), F.max("sampled_at").alias("_at"))
    whole = Window.partitionBy(*group)
    walked = values.withColumns({"_all": F.sum("_n").over(whole), "_upto": F.sum("_n").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))})
    place = (F.col("_all") - 1) * share
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("value")))
    low, high = at(F.floor(place)), at(F.ceil(place))
    part = F.max(place - F.floor(place))
    return walked.groupBy(*group).agg((F.sum("_sum") / F.sum("_n")).alias("mean"), F.min("value").alias("least"), F.max("value").alias("largest"), F.sum("_sum").alias("total"), F.max(F.struct("_at", "value"))["value"].alias("last"), (low + (high - low) * part).alias("median"))


def sessionise(sightings: DataFrame, *, keys: Sequence[str], at: str, idle_s: int = 86400) -> DataFrame:
    """Spells of sightings no more than idle_s apart: keys, spell, first_seen_at, last_seen_at, sightings."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > idle_s).cast("int"), F.lit(0))
    numbered = sightings.withColumn("_new", new).withColumn("spell", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "spell").agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count(F.lit(1)).alias("sightings"))


def record_intervals(polls: DataFrame, *, provider: str = "provider_id", record: Sequence[str] = ("owner_name", "rrtype", "value")) -> DataFrame:
    """Runs of consecutive polls that saw a record: first and last sight, and what they cover.

    polls: provider, read_at, record columns, ttl. A run's coverage starts at the poll before its first (or there, if
    none) and ends when the longest lifetime seen does.
    """
    w = Window.partitionBy(provider).orderBy("read_at")
    reads = polls.select(provider, "read_at").distinct().withColumns({"_poll": F.row_number().over(w), "_before": F.lag("read_at").over(w)})
    seen = polls.groupBy(provider, "read_at", *record).agg(F.max("ttl").alias("ttl")).join(reads, [provider, "read_at"])
    island = F.col("_poll") - F.row_number().over(Window.partitionBy(provider, *record).orderBy("_poll"))
    runs = seen.withColumn("_island", island).groupBy(provider, *record, "_island")
    out = runs.agg(F.min("read_at").alias("first_seen_at"), F.max("read_at").alias("last_seen_at"), F.min(F.struct("read_at", "_before"))["_before"].alias("_b"), F.max(F.col("read_at") + F.col("ttl")).alias("covered_until_at"))
    return out.withColumn("covered_from_at", F.coalesce("_b", "first_seen_at")).drop("_b", "_island")


def changed(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new)


def record_rate(df: DataFrame, *, source_at: str, ingest_at: str, start: int, end: int, bucket_s: int = 60, gaps: DataFrame | None = None) -> DataFrame:
    """How many records, over which spans of both clocks, at which mean rates, and the busiest bucket; null over nothing."""
    rows = df.filter((F.col(source_at) >= start) & (F.col(source_at) < end))
    per = rows.groupBy(F.expr(f"{source_at} div {bucket_s}").alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min(source_at).alias("a"), F.max(source_at).alias("z"), F.min(ingest_at).alias("ia"), F.max(ingest_at).alias("iz"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), (F.max("z") - F.min("a")).alias("source_span_s"), (F.max("iz") - F.min("ia")).alias("ingest_span_s"), F.max("n").alias("busiest_bucket"))
    out = out.withColumns({"source_rate": F.try_divide("records", "source_span_s"), "ingest_rate": F.try_divide("records", "ingest_span_s")})
    if gaps is None:
        return out
    cut = gaps.filter((F.col("interval_start_at") < end) & (F.col("interval_end_at") >= start))
    missed = cut.agg(F.count(F.lit(1)).alias("gap_count"), F.coalesce(F.sum(F.least(F.col("interval_end_at"), F.lit(end)) - F.greatest(F.col("interval_start_at"), F.lit(start))), F.lit(0)).alias("missed_s"))
    return out.crossJoin(missed)
