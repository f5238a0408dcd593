"""A stream over files ends in the tables of the batch operators, late and repeated records included."""

from pyspark.sql import functions as F

from netloom.functions import scope
from netloom.operators import rollup, windows
from netloom.plans.inputs import Tables
from netloom.streaming import jobs


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_late_and_repeated_files_equal_the_batch(spark, tmp_path):
    x = Tables(spark, "/root/testdata/sf0.001")
    flow = x.flow.dropDuplicates(["id"]).filter("id % 7 = 0 and observed_at < 800000000").withColumn("log_digest", F.col("id").cast("string")).persist()
    source, store, out = (str(tmp_path / n) for n in ("in", "store", "out"))
    # Newest first, so that the rest comes late; one part twice.
    for part in ("observed_at >= 794000000", "observed_at < 794000000", "observed_at < 794000000 and id % 2 = 0"):
        flow.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_flows(spark, source, flow.schema, delay="3650 days")
        query = stream.drop("event_at").writeStream.foreachBatch(jobs.refresh_sink(store, out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    want = rollup.periods(rollup.volume_1h(scope.classify(flow)), "volume")
    for period in ("1h", "7d", "30d"):
        got = spark.read.parquet(f"{out}/volume").filter(F.col("period") == period).drop("period").select(*want[period].columns)
        assert rows(got.withColumn("period_start_at", F.col("period_start_at").cast("bigint"))) == rows(want[period])


def test_records_behind_the_watermark_reach_all_families(spark, tmp_path):
    x = Tables(spark, "/root/testdata/sf0.001")
    flow = x.flow.dropDuplicates(["id"]).orderBy("id").limit(12).withColumn("log_digest", F.col("id").cast("string")).persist()
    source, store, out = (str(tmp_path / n) for n in ("in", "store", "out"))
    named = lambda records: records.select(F.col("id").alias("flow_id"), F.lit("s1.example").alias("site_name"))
    middle = flow.agg(F.percentile_approx("observed_at", 0.5)).first()[0]
    for part in (f"observed_at >= {middle}", "true"):
        flow.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_flows(spark, source, flow.schema, delay="1 minute", files_per_batch=1)
        query = stream.drop("event_at").writeStream.foreachBatch(jobs.refresh_sink(store, out, attribution=named, clients=x.client)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.read.parquet(store).count() == flow.count()
    hours = flow.select((F.col("observed_at") - F.col("observed_at") % 3600).alias("period_start_at")).distinct()
    want = rollup.refresh(flow, x.client, named(flow), hours)
    for family in ("volume", "rule", "domain", "peer", "client", "owner"):
        slots = want[family, "1h"]
        got = spark.read.parquet(f"{out}/{family}").filter("period = '1h'").select(*slots.columns)
        assert rows(got.withColumn("period_start_at", F.col("period_start_at").cast("bigint"))) == rows(slots), family


def test_a_batch_prunes_the_store_and_replays_change_nothing(spark, tmp_path, capsys):
    x = Tables(spark, "/root/testdata/sf0.001")
    flow = x.flow.dropDuplicates(["id"]).withColumn("log_digest", F.col("id").cast("string")).persist()
    store, out = (str(tmp_path / n) for n in ("store", "out"))
    first = flow.filter("observed_at between 802700000 and 803500000")
    late = flow.filter("observed_at between 803000000 and 803200000").limit(3).withColumns({"id": F.col("id") + 1, "log_digest": F.concat("log_digest", F.lit("x"))})
    clock = iter([900000000, 900000100, 900000200])
    run = jobs.refresh_sink(store, out, clients=x.client, clock=lambda: next(clock))
    run(first, 0)
    read = lambda family: rows(spark.read.parquet(f"{out}/{family}"))
    commits = jobs.Commits(f"{out}/commits")
    began = commits.computed(spark).agg(F.min("computed_at"), F.max("computed_at")).first()
    assert tuple(began) == (900000000, 900000000) and commits.watermark(spark) == first.agg(F.min("ingested_at")).first()[0]
    run(late, 1)
    whole = first.unionByName(late)
    hours = whole.select((F.col("observed_at") - F.col("observed_at") % 3600).alias("period_start_at")).distinct()
    want = rollup.refresh(whole, x.client, whole.select(F.col("id").alias("flow_id"), F.lit(None).cast("string").alias("site_name")).limit(0), hours)
    for family in ("volume", "peer", "client", "owner"):
        for period in ("1h", "24h", "7d", "30d"):
            slots = want[family, period]
            got = spark.read.parquet(f"{out}/{family}").filter(F.col("period") == period).select(*slots.columns)
            assert rows(got.withColumn("period_start_at", F.col("period_start_at").cast("bigint"))) == rows(slots), (family, period)
    before = {f: read(f) for f in ("volume", "rule", "peer", "client", "owner")}
    state = rows(commits.computed(spark)), commits.watermark(spark)
    run(late, 1)
    assert {f: read(f) for f in before} == before and (rows(commits.computed(spark)), commits.watermark(spark)) == state
    # The store is pruned by the batch's days, as literals.
    days = jobs._days(late)
    plan = spark.read.parquet(store).filter(jobs._within(F.col("day"), jobs._runs(days, 86400)))._jdf.queryExecution().executedPlan().toString()
    assert f"{min(days)}" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_ties_are_stale_and_computed_slots_are_not(spark):
    flow = spark.createDataFrame([(0, 100), (3600, 100), (7200, 100), (7300, 90), (10800, 100), (14400, 5)], "observed_at long, ingested_at long")
    computed = spark.createDataFrame([(0, 100), (3600, 101), (7200, 99), (7200, 100), (14400, 1)], "period_start_at long, computed_at long")
    got = rollup.dirty_slots(flow, since=50, now=18000, computed=computed)
    assert rows(got) == [(0,), (10800,), (18000,), (7200,)]


def test_a_late_lookup_names_an_old_record_and_reopens_its_hour(spark, tmp_path):
    flows, lookups, names, reopened, out = (str(tmp_path / n) for n in ("flows", "lookups", "names", "reopened", "out"))
    x = Tables(spark, "/root/testdata/sf0.001")
    flow = x.flow.dropDuplicates(["id"]).filter("dst_interface_id is null and not dst_is_this_firewall and coalesce(pair_outcome, '') <> 'second_leg' and src_client_id is not null").orderBy("observed_at").limit(4).withColumn("log_digest", F.col("id").cast("string")).persist()
    jobs.refresh_sink(flows, out)(flow, 0)
    answers = lambda s: s.createDataFrame([], "held_in string, owner_name string, rrtype string, value string, address string, covered_from_at long, covered_until_at long")
    old = flow.orderBy("observed_at").first()
    schema = "lookup_key string, looked_up_at long, client_id long, client_address string, domain string, action string, answer_source string, client_resolution string"
    row = lambda key, at, domain: (key, at, old.src_client_id, old.src_address, domain, "pass", "Cache", "logged_address")
    run = jobs.reattribute_sink(flows, lookups, names, reopened, answers)
    run(spark.createDataFrame([row("k1", old.observed_at - 3, "a.example")], schema), 0)
    named = lambda: rows(spark.read.parquet(names).select("flow_id", "site_name", "method", "delay_s"))
    assert named() == [(3, old.id, "lookup_timing", "a.example")]
    hour = old.observed_at - old.observed_at % 3600
    assert rows(spark.read.parquet(reopened)) == [(0, hour)]
    # The same lookup again changes nothing; a second name makes the record ambiguous, and its hour is reopened.
    run(spark.createDataFrame([row("k1", old.observed_at - 3, "a.example")], schema), 1)
    assert spark.read.parquet(reopened).filter("batch = 1").count() == 0
    kept = spark.read.parquet(flows)
    sites = lambda records: spark.read.parquet(names).filter("site_name is not null").select("flow_id", "site_name")
    hours = spark.read.parquet(reopened).filter("batch = 0").select("period_start_at")
    jobs.write_touched(kept.drop("batch"), hours, out, days=jobs._days(hours, "period_start_at"), attribution=sites)
    assert spark.read.parquet(f"{out}/domain").filter("period = '1h'").select("site_name", "bytes").collect() == [("a.example", old.packet_bytes)]
    run(spark.createDataFrame([row("k2", old.observed_at - 1, "b.example")], schema), 2)
    assert named() == [(None, old.id, None, None)] and rows(spark.read.parquet(reopened).filter("batch = 2")) == [(2, hour)]


def test_windows_on_arrival(spark, tmp_path):
    """Hours, rolling days and sessions of a stream equal those of the batch."""
    x = Tables(spark, "/root/testdata/sf0.001")
    flow = x.flow.dropDuplicates(["id"]).filter("observed_at between 800000000 and 800600000").withColumn("log_digest", F.col("id").cast("string")).persist()
    source = str(tmp_path / "in")
    flow.coalesce(1).write.parquet(source)

    def drained(make, name):
        stream = make(jobs.stream_flows(spark, source, flow.schema, delay="3650 days"))
        query = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return rows(spark.table(name))

    hour = (F.col("observed_at") - F.col("observed_at") % 3600).alias("period_start_at")
    want = flow.groupBy(hour, "action").agg(F.sum("packet_bytes").alias("bytes"), F.count(F.lit(1)).alias("connections"))
    assert drained(jobs.hourly, "on_hours") == rows(want)
    ends = flow.withColumn("end_at", F.explode(F.sequence(hour + 3600, hour + 86400, F.lit(3600).cast("bigint"))))
    assert drained(jobs.rolling_day, "on_days") == rows(ends.groupBy("end_at").agg(F.sum("packet_bytes").alias("bytes")))
    spells = windows.sessionise(flow.select("src_address", "observed_at"), keys=["src_address"], at="observed_at", idle_s=86399).drop("spell")
    assert drained(lambda s: jobs.sessions(s, keys=["src_address"]), "on_spells") == rows(spells)


def test_stateful_intervals_equal_the_batch(spark, tmp_path):
    """Files out of order; a last poll of another provider moves the watermark, after which nothing is left open."""
    from pyspark.sql import Window

    x = Tables(spark, "/root/testdata/sf0.001")
    polls = x.poll
    before = polls.select("provider_id", "read_at").distinct().withColumn("previous_at", F.lag("read_at").over(Window.partitionBy("provider_id").orderBy("read_at")))
    fed = polls.join(before, ["provider_id", "read_at"]).persist()
    path = str(tmp_path / "polls")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    last = fed.agg(F.max("read_at")).first()[0]
    end, after = (spark.createDataFrame([(99, last + days * 86400, "end", "A", "x", 60, None)], "provider_id long, read_at long, owner_name string, rrtype string, value string, ttl long, previous_at long").select(*fed.columns) for days in (90, 200))
    for part in (fed.filter("read_at % 172800 = 0"), fed.filter("read_at % 172800 <> 0"), end, after):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(fed.schema).parquet(path)
        query = jobs.stream_intervals(stream, delay="1 day" if any(part is p for p in (end, after)) else "3650 days", expire_s=30 * 86400).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).filter("provider_id <> 99")
    assert rows(got) == rows(windows.record_intervals(polls).select(*got.columns))
