"""Structured Streaming jobs over record files. Each ends in the same tables as its batch operator over all files.

Late records are never dropped by ``refresh_sink``: they reopen exactly their slots, which a batch of the stream writes
again. The watermark bounds only the state of the windows on arrival, which find repeats within it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from netloom.functions.time import slot_end, slot_start
from netloom.operators import derive, joins, rollup
from netloom.operators.windows import changed
from netloom.session import checkpointed
from netloom.sources.sinks import write_periods, write_slots


def stream_flows(spark: SparkSession, path: str, schema: StructType, *, delay: str = "1 day", files_per_batch: int = 100) -> DataFrame:
    """Records of new files, late and repeated ones too, with event_at as event time.

    The source's checkpoint is the offset: files already read are not read again.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("event_at", F.timestamp_seconds("observed_at")).withWatermark("event_at", delay)


def once(stream: DataFrame) -> DataFrame:
    """Each digest once within the delay, for windows on arrival; records behind the watermark are dropped."""
    return stream.dropDuplicatesWithinWatermark(["log_digest"])


def hourly(stream: DataFrame) -> DataFrame:
    """Tumbling hours on arrival, for sinks in update or append mode."""
    return once(stream).groupBy(F.window("event_at", "1 hour").alias("w"), "action").agg(F.sum("packet_bytes").alias("bytes"), F.count(F.lit(1)).alias("connections")).select(F.unix_seconds("w.start").alias("period_start_at"), "action", "bytes", "connections")


def rolling_day(stream: DataFrame) -> DataFrame:
    """24 hours, every hour."""
    return once(stream).groupBy(F.window("event_at", "24 hours", "1 hour").alias("w")).agg(F.sum("packet_bytes").alias("bytes")).select(F.unix_seconds("w.end").alias("end_at"), "bytes")


def sessions(stream: DataFrame, *, keys: list[str], gap: str = "1 day") -> DataFrame:
    """Spells of sightings of a key, closed when none comes for the gap."""
    return once(stream).groupBy(F.session_window("event_at", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("sightings"), F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at")).drop("w")


def _read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """A stored table, or None before anything was stored."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _runs(starts: Iterable[int], size: int) -> list[tuple[int, int]]:
    """Intervals [start, start + size) joined where they touch."""
    out: list[tuple[int, int]] = []
    for start in sorted(set(starts)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + size))
        else:
            out.append((start, start + size))
    return out


def _within(at: Column, runs: list[tuple[int, int]]) -> Column:
    """Whether an instant lies in one of the intervals, as literals: on a partition column, they choose directories."""
    return reduce(or_, ((at >= a) & (at < z) for a, z in runs), F.lit(False))


def _days(rows: DataFrame, at: str = "observed_at") -> list[int]:
    """The days of some rows: what the driver holds of a batch, a number for each day of history at most."""
    return [r["day"] for r in rows.select(slot_start(F.col(at), "24h").alias("day")).distinct().collect()]


def _keep(batch: DataFrame, batch_id: int, store: str, at: str = "observed_at") -> None:
    """Write a batch's rows by batch and day; a repeated batch replaces itself."""
    rows = batch.withColumns({"day": slot_start(F.col(at), "24h"), "batch": F.lit(batch_id)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(store)


class Commits:
    """What refreshes have done, by batch: when each began, up to which ingest it may be relied on, and the slots it computed.

    A batch begins once: repeated, it finds the instant it began first and writes the same rows again. The watermark is
    that instant or the oldest ingest in the batch, whichever is earlier, as records with that stamp were still on their
    way before; ``dirty_slots(since=watermark, computed=computed)`` then finds what came in later, ties included.
    """

    def __init__(self, path: str):
        self.path = path

    def _write(self, rows: DataFrame, table: str, batch_id: int) -> None:
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{table}")

    def begin(self, spark: SparkSession, batch_id: int, now: int) -> int:
        known = _read(spark, f"{self.path}/begun")
        first = None if known is None else known.filter(F.col("batch") == batch_id).first()
        if first is not None:
            return first["began_at"]
        self._write(spark.range(1).select(F.lit(now).cast("bigint").alias("began_at")), "begun", batch_id)
        return now

    def finish(self, hours: DataFrame, batch_id: int, *, began_at: int, oldest: int | None) -> None:
        slots = hours.select("period_start_at", F.lit(began_at).cast("bigint").alias("computed_at"))
        self._write(slots.coalesce(1), "slots", batch_id)
        mark = began_at if oldest is None else min(began_at, oldest)
        self._write(hours.sparkSession.range(1).select(F.lit(mark).cast("bigint").alias("watermark")), "marks", batch_id)

    def computed(self, spark: SparkSession) -> DataFrame | None:
        """period_start_at and computed_at of every hour that was computed."""
        rows = _read(spark, f"{self.path}/slots")
        return None if rows is None else rows.groupBy("period_start_at").agg(F.max("computed_at").alias("computed_at"))

    def watermark(self, spark: SparkSession) -> int:
        """Of the last batch that finished; 0 before."""
        rows = _read(spark, f"{self.path}/marks")
        last = None if rows is None else rows.orderBy(F.desc("batch")).first()
        return 0 if last is None else last["watermark"]


def refresh_sink(store: str, out: str, *, attribution: Callable[[DataFrame], DataFrame] | None = None, clients: DataFrame | None = None, clock: Callable[[], float] = time.time) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keep the batch's records, then write again every slot they touch.

    A digest kept by another batch is not kept again; records without one all are. Records are kept by batch and day, so
    a repeated batch replaces itself, and digests are compared with those of the batch's own days only. Touched hours
    are computed from their records, which are read once; days, weeks and months from the stored hours around them.
    Each family is one write of all periods, over its touched slots alone. What was computed when is in ``Commits``
    under out/commits. Owners come from clients (id, owner_id).
    """
    commits = Commits(f"{out}/commits")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        began_at = commits.begin(spark, batch_id, int(clock()))
        once_each = batch.filter("log_digest is null").unionByName(batch.filter("log_digest is not null").dropDuplicates(["log_digest"]))
        days = _days(batch)
        schema = batch.withColumns({"day": F.lit(0).cast("bigint"), "batch": F.lit(batch_id)}).schema
        kept = _read(spark, store, schema)
        if kept is not None:
            known = kept.filter(_within(F.col("day"), _runs(days, 86400)) & (F.col("batch") != batch_id)).select("day", "log_digest")
            once_each = once_each.withColumn("day", slot_start(F.col("observed_at"), "24h")).join(known, ["day", "log_digest"], "left_anti").select(*batch.columns)
        _keep(once_each, batch_id, store)
        stored = spark.read.schema(schema).parquet(store)
        own = stored.filter(F.col("batch") == batch_id)
        hours = own.select(slot_start(F.col("observed_at"), "1h").alias("period_start_at")).distinct().persist()
        oldest = own.agg(F.min("ingested_at")).first()[0] if "ingested_at" in batch.columns else None
        write_touched(stored.drop("batch"), hours, out, days=_days(own), attribution=attribution, clients=clients)
        commits.finish(hours, batch_id, began_at=began_at, oldest=oldest)
        hours.unpersist()

    return run


def write_touched(stored: DataFrame, hours: DataFrame, out: str, *, days: list[int], attribution: Callable[[DataFrame], DataFrame] | None = None, clients: DataFrame | None = None) -> None:
    """Write again, in all families and periods, the slots of the given hours, which lie on the given days.

    stored: all records, with the day they are kept by.
    """
    if not days:
        return
    spark = stored.sparkSession
    hour = slot_start(F.col("observed_at"), "1h").alias("period_start_at")
    records = stored.filter(_within(F.col("day"), _runs(days, 86400))).drop("day").join(hours, hour == hours["period_start_at"], "left_semi").persist()
    names = records.select(F.col("id").alias("flow_id"), F.lit(None).cast("string").alias("site_name")).limit(0) if attribution is None else attribution(records)
    known = records.select(F.col("src_client_id").alias("id"), F.lit(None).cast("bigint").alias("owner_id")).limit(0) if clients is None else clients
    ends = spark.createDataFrame([(d,) for d in days], "day long").select(*(F.struct(slot_start(F.col("day"), p).alias("a"), slot_end(slot_start(F.col("day"), p), p).alias("z")).alias(p) for p in ("7d", "30d"))).collect()
    around = [(x["a"], x["z"]) for r in ends for x in r]
    merged = _runs((t for a, z in around for t in range(a, z, 86400)), 86400)

    def hours_around(family: str) -> DataFrame | None:
        slots = _read(spark, f"{out}/{family}/period=1h")
        return None if slots is None else slots.filter(_within(F.col("period_start_at"), merged)).withColumn("period_start_at", F.col("period_start_at").cast("bigint"))

    found = rollup.refresh_from_hours(records, known, names, hours, hours_around)
    # Jobs of a few rows each: they run beside each other. Clients and owners are counted from the peers' stored hours,
    # so these are replaced last.
    peer = found.pop("peer")
    with ThreadPoolExecutor(len(found)) as pool:
        list(pool.map(lambda x: write_periods(x[1], f"{out}/{x[0]}"), found.items()))
    write_periods(peer, f"{out}/peer")
    records.unpersist()


def pair_streams(out: DataFrame, into: DataFrame, *, window_s: int = 1, delay: str = "1 minute") -> DataFrame:
    """Candidate pairs of legs as they arrive: an interval join whose state the watermarks bound. Uniqueness, which may
    change when a late leg arrives, is decided again over the touched span by ``repair_sink``."""
    o = out.filter("direction = 'out'").select(*(F.col(c).alias(f"o_{c}") for c in ("id", "event_at", "dst_address", "protocol", "ip_id", "tcp_seq", "interface_device"))).withWatermark("o_event_at", delay)
    i = into.filter("direction = 'in' and action = 'pass'").select(*(F.col(c).alias(f"i_{c}") for c in ("id", "event_at", "dst_address", "protocol", "ip_id", "tcp_seq", "interface_device"))).withWatermark("i_event_at", delay)
    span = F.expr(f"i_event_at between o_event_at - interval {window_s} seconds and o_event_at + interval {window_s} seconds")
    same = (F.col("o_dst_address") == F.col("i_dst_address")) & (F.col("o_protocol") == F.col("i_protocol")) & F.col("o_ip_id").eqNullSafe(F.col("i_ip_id")) & F.col("o_tcp_seq").eqNullSafe(F.col("i_tcp_seq"))
    return o.join(i, same & span & (F.col("o_interface_device") != F.col("i_interface_device"))).select("o_id", "i_id")


def repair_sink(store: str, out: str, upstream: DataFrame, *, window_s: int = 1) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: pair again all kept records of the hours around the batch's, and overwrite those hours."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)
        kept = spark.read.parquet(store)
        hour = slot_start(F.col("observed_at"), "1h")
        touched = kept.filter(F.col("batch") == batch_id).select(F.explode(F.array(*(hour + d for d in (-3600, 0, 3600)))).alias("_h")).distinct()
        wide = touched.select(F.explode(F.array(*(F.col("_h") + d for d in (-3600, 0, 3600)))).alias("_h")).distinct()
        near = kept.drop("batch").withColumn("_h", hour).join(wide, "_h", "left_semi").drop("_h")
        paired = joins.pair_legs(near, upstream, window_s=window_s).withColumn("period_start_at", hour)
        write_slots(paired.join(touched.withColumnRenamed("_h", "period_start_at"), "period_start_at", "left_semi"), out, period="1h")

    return run


def attribution_span(batch: DataFrame, *, reach_s: int = 3600) -> tuple[int, int] | None:
    """The span of records that a batch of lookups can give another name: from its first to reach_s after its last."""
    r = batch.agg(F.min("looked_up_at").alias("a"), F.max("looked_up_at").alias("z")).first()
    return None if r["a"] is None else (r["a"], r["z"] + reach_s)


def reattribute_sink(flows: str, lookups: str, names: str, reopened: str, answers: Callable[[SparkSession], DataFrame], *, timing_s: int = 5, cap_s: int = 3600) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over lookups, late ones too: name again the records they can concern, and reopen the hours that changed.

    A lookup reaches records up to the longer of timing_s and cap_s after it, so the batch's span is widened by that, and
    both methods run on the kept records of that span alone, over the kept lookups that reach it. Stored names (by day
    of their record: flow_id, observed_at, site_name, method, delay_s; a null site_name is a name that is gone) are
    compared null with null; days with a difference are written again, and the hours of records whose name changed go to ``reopened`` by batch, for
    ``write_touched``. Paths: flows as ``refresh_sink`` keeps them.
    """
    reach = max(timing_s, cap_s)
    columns = ["site_name", "method", "delay_s"]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        span = attribution_span(batch, reach_s=reach)
        _keep(batch, batch_id, lookups, "looked_up_at")
        kept = None if span is None else _read(spark, flows)
        if kept is None:
            return
        start, end = span
        day_of = lambda t: t - t % 86400
        near = kept.filter(F.col("day").between(day_of(start), end) & F.col("observed_at").between(start, end))
        asked = spark.read.parquet(lookups).filter(F.col("day").between(day_of(start - reach), end) & F.col("looked_up_at").between(start - reach, end)).drop("day", "batch").dropDuplicates(["lookup_key"])
        found = derive.attribute_sites(near, asked, answers(spark), timing_s=timing_s, cap_s=cap_s)
        new = near.select(F.col("id").alias("flow_id"), "observed_at", slot_start(F.col("observed_at"), "24h").alias("day")).join(found, "flow_id")
        stored = _read(spark, names)
        old = new.limit(0) if stored is None else stored.filter(F.col("day").between(day_of(start), end)).filter("site_name is not null").withColumn("day", F.col("day").cast("bigint")).select(*new.columns)
        inside = F.col("observed_at").between(start, end)
        keys = ["flow_id", "observed_at", "day"]
        both = new.select(*keys, F.struct(*columns).alias("_new")).join(old.filter(inside).select(*keys, F.struct(*columns).alias("_old")), keys, "full_outer")
        differ = checkpointed(both.filter(changed(F.col("_old"), F.col("_new"))))
        days = [r["day"] for r in differ.select("day").distinct().collect()]
        hours = differ.select(slot_start(F.col("observed_at"), "1h").alias("period_start_at")).distinct().withColumn("batch", F.lit(batch_id))
        hours.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(reopened)
        if days:
            # What the span doesn't hold stays; what it holds is as found now. A name that is gone stays as one without a site.
            there = F.col("day").isin(days)
            gone = differ.filter("_new is null").select(*keys, *(F.lit(None).cast(new.schema[c].dataType).alias(c) for c in columns))
            whole = checkpointed(old.filter(there & ~inside).unionByName(new.filter(there)).unionByName(gone))
            whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(names)

    return run


class RecordIntervals(StatefulProcessor):
    """Keyed by provider and record: one open interval, extended while each poll of the provider sees the record.

    Rows have read_at, previous_at (the poll before) and ttl. Polls wait until the watermark has passed them and are then
    taken by their time, so late ones within the delay are merged as if they had come in order. An interval is put out
    when it ends: at the first poll that doesn't follow its last one, or when two more polls could have come
    (``expire_s``) and none did. After that the key has no state.
    """

    def __init__(self, expire_s: int):
        self.expire_s = expire_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_seen_at long, last_seen_at long, covered_from_at long, covered_until_at long")
        self.waiting = handle.getMapState("waiting", "read_at long", "previous_at long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for p in frame.itertuples(index=False):
                at, until = int(p.read_at), int(p.read_at + p.ttl)
                before = -1 if pd.isna(p.previous_at) else int(p.previous_at)
                if self.waiting.containsKey((at,)):
                    until = max(until, self.waiting.getValue((at,))[1])
                self.waiting.updateValue((at,), (before, until))
                self.handle.registerTimer(at * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        state = tuple(self.open.get()) if self.open.exists() else None
        out = []
        if self.waiting.containsKey((now,)):
            before, until = self.waiting.getValue((now,))
            self.waiting.removeKey((now,))
            if state is not None and state[1] == before:
                state = (state[0], now, state[2], max(state[3], until))
            else:
                if state is not None:
                    out.append((*key, *state))
                state = (now, now, now if before < 0 else before, until)
            self.open.update(state)
            self.handle.registerTimer((now + self.expire_s) * 1000)
        elif state is not None and state[1] + self.expire_s <= now:
            out.append((*key, *state))
            self.open.clear()
        names = ["provider_id", "owner_name", "rrtype", "value", "first_seen_at", "last_seen_at", "covered_from_at", "covered_until_at"]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


INTERVALS = "provider_id long, owner_name string, rrtype string, value string, first_seen_at long, last_seen_at long, covered_from_at long, covered_until_at long"


def stream_intervals(polls: DataFrame, *, delay: str = "1 hour", expire_s: int = 7200) -> DataFrame:
    """Intervals of record sightings, each once, when it has ended. expire_s: two polls' time.

    Polls that come later than the delay are left to ``windows.record_intervals`` over all of them.
    """
    timed = polls.withColumn("event_at", F.timestamp_seconds("read_at")).withWatermark("event_at", delay)
    keyed = timed.groupBy("provider_id", "owner_name", "rrtype", "value")
    return keyed.transformWithStateInPandas(RecordIntervals(expire_s), INTERVALS, "Append", "EventTime")
