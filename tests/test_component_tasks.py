"""A driver keeps a record of every task: small tables of a loop must not be dealt over all shuffle partitions."""

from netloom.llm.components import components


def test_rounds_over_few_edges_run_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = components(spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 60)], "a long, z long"))
        labels = {r.id: r.label for r in got.collect()}
        parts = got.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert labels == {i: 1 for i in range(1, 31)} | {50: 50, 60: 50}
    assert parts == 1


def test_no_round_over_few_edges_is_dealt_over_all_partitions(spark):
    """A round joined its one partition over all shuffle partitions when Spark broadcast one side of it."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    context = spark.sparkContext
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 60)], "a long, z long").repartition(40).checkpoint()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("rounds", "")
        got = {r.id: r.label for r in components(edges).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    told = context.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("rounds") for s in told.getJobInfo(j).stageIds]
    assert got == {i: 1 for i in range(1, 31)} | {50: 50, 60: 50}
    assert sum(s.numCompletedTasks for s in stages if s) < 60


def test_few_documents_are_not_dealt_over_all_partitions_in_each_round(spark):
    """Each way of dealing a bucket's members into blocks shuffled all entries five times, and the names of classes twice."""
    from netloom.llm import op7_bagminhash as op7

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    context = spark.sparkContext
    plain = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(plain[:i] + [f"x{i}"] + plain[i:])) for i in range(12)] + [(20 + i, " ".join(f"y{i * 100 + k}" for k in range(30))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("classes", "")
        got = {r.doc_id: r.class_id for r in op7.near_duplicates(docs, block=2).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    told = context.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("classes") for s in told.getJobInfo(j).stageIds]
    assert got == {i: 0 for i in range(12)} | {i: i for i in range(20, 25)}
    tasks = sum(s.numCompletedTasks for s in stages if s)
    assert tasks < 350, tasks


def test_slices_of_short_texts_are_bounded_in_rows(spark):
    """Signatures take a fixed size for each row: a slice of 4 MB of short texts had thousands of rows."""
    import pyarrow as pa

    from netloom.llm import arrowio

    texts = pa.RecordBatch.from_pydict({"text": ["a b c"] * 3000 + ["x" * 700_000] * 3})
    got = [p.num_rows for p in arrowio.slices(texts, "text", arrowio.SMALL_BYTES, arrowio.SMALL_ROWS)]
    assert sum(got) == 3003 and max(got) <= arrowio.SMALL_ROWS and got[-2:] == [1, 1]
    df = spark.createDataFrame([(i, "a b c") for i in range(3000)], "doc_id long, text string").coalesce(1)
    sizes = arrowio.add_columns(df, "n int", lambda piece: [pa.array([piece.num_rows] * piece.num_rows, pa.int32())], small=True)
    assert max(r.n for r in sizes.collect()) <= arrowio.SMALL_ROWS
