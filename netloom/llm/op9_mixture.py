"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Texts are cut into blocks of ``block_words`` words. Sizes, sources' totals and targets are exact sums. A source's target
is served by whole passes over its blocks and one partial pass; the number of blocks it draws is its quota. The quotas
of all sources are split among the output shards by a binary tree: at each node the left half's share of every source is
drawn from the multivariate hypergeometric distribution, so shards have exact sizes and quotas add up exactly. A keyed
Feistel permutation of each source's blocks then gives every shard a run of permuted positions of its own: draws are
disjoint, need no state, and agree between runs. Inside a shard draws are ordered by a keyed hash. A shard holds about
``shard_words`` words, so their number grows with the sizes' sum; there are ``LEAST_SHARDS`` at least, and where sources
x shards would pass ``MOST_QUOTAS`` (what the driver and a broadcast hold, 32 MB) shards are larger instead of more.

Blocks get their numbers in two levels, so that a source with most of the rows is spread: (source, cell) groups number
their own documents, and small sums of cells offset them. What the driver handles is one row for each source and the
tree's quotas (sources x shards, bounded); documents, blocks and draws stay distributed. ``mixed`` gives each document its draws
with shard and place; ``mix`` writes documents, each in the shard and at the place of one of its drawn blocks, chosen by a
keyed hash; only the document of a shard's first draw opens that shard (the lowest, where it has several).

Defined cases: null texts and texts without words have size 0 and are never drawn; a null source is a source of its own
and comes last; a row without an id is numbered like the others; rows that repeat another in all columns are numbered
and drawn one by one, and one id in several sources counts in each; an empty table gives an empty result; further
columns, whatever their names, are kept by ``mix`` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import textvec as tv
from netloom.llm.arrowio import add_columns, column, unused
from netloom.llm.permute import feistel
from netloom.llm.session import checkpointed

WEIGHTS = (5, 2, 1)
LEAST_SHARDS = 16
MOST_QUOTAS = 1 << 22


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size and target: shares of all sizes by weight, at most ``most`` times a source's size.

    Sources that reach their limit are those with the smallest limit for their weight; what remains is shared by weight
    among the rest. One row for each source, so its windows may meet in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (rank % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    table = table.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after))
    full = F.col("limit") < F.col("weight") * F.col("level")
    table = table.withColumn("common", F.max(F.when(~full, F.col("level"))).over(everything))
    free = F.coalesce(F.col("weight") * F.col("common"), F.col("limit").cast("double"))
    return table.select("source", "source_size", F.least(F.col("limit").cast("double"), free).alias("target"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from an urn are good, at any size.

    A binomial proposal is accepted in proportion to the ratio of the two probabilities, which is largest at ``top``; at
    most half of the urn is drawn (else what stays in it), so seven in ten proposals are accepted. The ratio's logarithm
    is a sum over the values between the proposal and ``top``, about the square root of the draws.
    """
    if not good or not bad or not draws:
        return draws if not bad else 0
    if 2 * draws > good + bad:
        return good - hypergeometric(rng, good, bad, good + bad - draws)
    top = min((draws - 1) * good // (good + bad) + 1, good)
    between = lambda x, a, z: float(np.log1p(-np.arange(a, z, dtype=np.float64) / x).sum()) if z > a else 0.0
    while True:
        k = int(rng.binomial(draws, good / (good + bad)))
        if k > good or draws - k > bad:
            continue
        low, high = min(k, top), max(k, top)
        change = between(good, low, high) - between(bad, draws - high, draws - low)
        if np.log(rng.random()) <= (change if k > top else -change):
            return k


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Each shard's number of draws from each source: a tree of multivariate-hypergeometric splits."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            out[low] = have
            continue
        mid, total = (low + high) // 2, int(have.sum())
        left = np.zeros_like(have)
        need, rest = total * (mid - low) // (high - low), total
        for i, n in enumerate(have.tolist()):  # one source after another: the marginal of a hypergeometric is one too
            rest -= n
            left[i] = hypergeometric(rng, n, rest, need)
            need -= int(left[i])
        nodes += [(low, mid, left), (mid, high, have - left)]
    return out


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits of what makes a row: all of its columns, so that rows of one key are alike and it doesn't matter which is which."""
    plain = lambda c, kind: F.to_json(F.struct(f"`{c}`")) if kind == "variant" or "map<" in kind or "variant" in kind else F.col(f"`{c}`")
    parts = [plain(c, kind) for c, kind in docs.dtypes]
    return F.xxhash64(*parts), F.xxhash64(F.lit(9), *reversed(parts), *(p.isNull() for p in parts))


def sized(docs: DataFrame) -> DataFrame:
    """Each row with its size and key, rows of one key numbered: doc_id, source, size, k1, k2, copy."""
    k1, k2 = _keys(docs)
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), k1.alias("k1"), k2.alias("k2"))
    counted = rows.groupBy("doc_id", "source", "size", "k1", "k2").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def draw(docs: DataFrame, *, block_words: int = 32, shards: int | None = None, shard_words: int = 1 << 20, seed: int = 9, cells_per_partition: int = 4) -> tuple[DataFrame, DataFrame, int]:
    """(documents with key, size, source_size and target; draws; number of shards).

    A draw is a row's key (k1, k2, copy), block (its place in the document), words, shard and place (in the shard, in
    the order of a keyed hash). A block is drawn at most once more than another of its source.
    """
    spark = docs.sparkSession
    cells = int(spark.conf.get("spark.sql.shuffle.partitions")) * cells_per_partition
    key = ["k1", "k2", "copy"]
    rows = checkpointed(sized(docs).withColumn("blocks", F.ceil(F.col("size") / block_words).cast("long")).withColumn("cell", F.pmod(F.xxhash64(*key), F.lit(cells)).cast("int")))
    by_cell = rows.groupBy("source", "cell").agg(F.sum("blocks").alias("blocks"), F.sum("size").alias("size"))
    sizes = by_cell.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("blocks").alias("source_blocks"))
    target = targets(sizes.select("source", "source_size"))
    plan = target.withColumnRenamed("source", "s").join(sizes, F.col("s").eqNullSafe(F.col("source"))).select("source", target.source_size, "target", "source_blocks").orderBy(F.col("source").isNull(), "source").collect()
    n = np.array([p.source_blocks for p in plan], np.int64)
    size = np.array([p.source_size for p in plan], np.float64)
    wanted = np.array([p.target for p in plan], np.float64)
    quotas = np.minimum(np.round(wanted * n / np.maximum(size, 1)).astype(np.int64), 3 * n)
    # As many shards as the sizes ask for, within what the table of quotas (sources x shards) may hold.
    shards = shards or max(LEAST_SHARDS, min(-(-int(wanted.sum()) // shard_words), MOST_QUOTAS // max(len(plan), 1)))
    shares = split_quotas(quotas, shards, seed)
    # Runs of all sources one after another; those of a source begin at its base.
    ends = np.cumsum(shares.T.reshape(-1))
    shared = spark.sparkContext.broadcast(ends)
    # From Arrow it becomes a local relation of known size: broadcast below Spark's own threshold and shuffled above.
    columns = {"s": pa.array([p.source for p in plan], pa.string()), "source_size": pa.array([p.source_size for p in plan], pa.int64()), "target": pa.array(wanted), "source_blocks": pa.array(n), "quota": pa.array(shares.sum(axis=0)), "nth": pa.array(np.arange(len(plan), dtype=np.int64)), "run": pa.array(np.cumsum(quotas) - quotas)}
    table = spark.createDataFrame(pa.table(columns))
    base = F.coalesce(F.sum("blocks").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_cell.select("source", "cell", base.alias("base")).withColumnsRenamed({"source": "s", "cell": "c"})
    inner = Window.partitionBy("source", "cell").orderBy(*key)
    numbered = rows.withColumn("own", F.sum("blocks").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks"))
    numbered = numbered.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c").join(table.drop("source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    block = numbered.filter("blocks > 0").select(*key, "source", "size", "source_blocks", "quota", "nth", "run", (F.col("base") + F.col("own")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    block = block.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("source_blocks")) - 1)))
    place = feistel(F.col("first") + F.col("block"), F.col("source_blocks"), F.xxhash64("source", "pass", F.lit(seed)))
    drawn = block.withColumn("position", F.col("pass") * F.col("source_blocks") + place).filter(F.col("position") < F.col("quota"))
    drawn = drawn.select(*key, "block", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("words"), "nth", (F.col("run") + F.col("position")).alias("at"), F.xxhash64(*key, "block", "pass", F.lit(seed)).alias("order"))

    def leaf(piece: pa.RecordBatch) -> list:
        """The shard whose run holds a draw: the first of its source that ends beyond it."""
        run = np.searchsorted(shared.value, np.asarray(column(piece, "at")), "right")
        return [pa.array((run - np.asarray(column(piece, "nth")) * shards).astype(np.int32))]

    drawn = add_columns(drawn, "shard int", leaf, text=None, keep=[*key, "block", "words", "at", "order"])
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("order", "at")) - 1).drop("order", "at")
    known = table.select("s", "source_size", "target")
    return rows.join(known, F.col("source").eqNullSafe(F.col("s"))).select(*key, "doc_id", "source", "size", "source_size", "target"), drawn, shards


def mixed(docs: DataFrame, *, block_words: int = 32, shards: int | None = None, shard_words: int = 1 << 20, seed: int = 9) -> DataFrame:
    """Each document with size, source_size, target, taken (the words that the mix takes of it, repeats counted) and draws.

    Draws are (shard, place, block), in order.
    """
    rows, drawn, _ = draw(docs, block_words=block_words, shards=shards, shard_words=shard_words, seed=seed)
    key = ["k1", "k2", "copy"]
    taken = drawn.groupBy(*key).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "place", "block"))).alias("draws"))
    none = F.array().cast("array<struct<shard:int,place:int,block:bigint>>")
    return rows.join(taken, key, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("draws", none).alias("draws"))


def mix(docs: DataFrame, *, block_words: int = 32, shards: int | None = None, shard_words: int = 1 << 20, seed: int = 9) -> DataFrame:
    """The mixture as documents with the columns of docs: what the mix takes of a document, in a row for each pass.

    A row's text is the document's drawn blocks of that pass in their order; a document drawn whole keeps its text. Rows
    are dealt to one partition for each shard and ordered by place: those of a shard's first draw, else of a block by a
    keyed hash, so that shards have about equal bytes however long documents are.
    """
    rows, drawn, shards = draw(docs, block_words=block_words, shards=shards, shard_words=shard_words, seed=seed)
    k1, k2, shard, place, picked = unused(docs.columns, "k1", "k2", "shard", "place", "blocks")
    # One exchange by key and copy serves the numbering of a block's draws and the list of each pass.
    nth_draw = F.row_number().over(Window.partitionBy("k1", "k2", "copy", "block").orderBy("shard", "place"))
    passes = drawn.repartition("k1", "k2", "copy").withColumn("turn", nth_draw)
    lists = passes.groupBy("k1", "k2", "copy", "turn").agg(F.array_sort(F.collect_list(F.struct("block", "shard", "place"))).alias("drawn"))
    # Placing all by their first blocks would gather long documents in the lowest shards.
    spot = lambda d: F.struct(d["shard"].alias("shard"), d["place"].alias("place"))
    chance = F.pmod(F.xxhash64("k1", "k2", "copy", F.col("turn").cast("long"), F.lit(seed)), F.size("drawn").cast("long")).cast("int")
    first_draw = F.array_min(F.transform(F.filter("drawn", lambda d: d["place"] == 0), spot))
    placed = lists.withColumn("at", F.coalesce(first_draw, spot(F.element_at("drawn", chance + 1))))
    todo = placed.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.transform("drawn", lambda d: d["block"].cast("int")).alias(picked), F.col("at.shard").alias(shard), F.col("at.place").alias(place))
    first, second = _keys(docs)
    # Rows of one key are alike: each pass of each copy takes its blocks of one of them, so a row repeated n times meets
    # n lists once, not n times. Repeats are dropped in each task before anything is exchanged.
    got = docs.withColumns({k1: first, k2: second})
    if not rows.filter("copy > 1").isEmpty():
        got = got.dropDuplicates([k1, k2])
    got = got.join(todo, [k1, k2])

    def cut(piece: pa.RecordBatch) -> list:
        """Texts of the drawn blocks; where all blocks are drawn, the text as it was."""
        data, offsets = tv.as_bytes(column(piece, "text"))
        starts, ends, at = tv.words(data, offsets)
        lists = column(piece, picked)
        doc = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        blocks = -(-np.diff(at) // block_words)
        base = np.cumsum(blocks) - blocks
        drawn = np.zeros(int(blocks.sum()), bool)
        drawn[base[doc] + np.asarray(lists.flatten())] = True
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        keep = drawn[base[of] + (np.arange(len(starts)) - at[of]) // block_words]
        made = tv.join_words(data, starts, ends, at, keep)
        whole = np.bincount(doc, minlength=len(blocks)) == blocks
        return [pc.if_else(pa.array(whole), column(piece, "text").cast(pa.string()), made)]

    got = add_columns(got.select(*docs.columns, picked, shard, place), "text string", cut, keep=[*docs.columns, shard, place], small=True)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast("long"))
    return got.repartitionById(shards, F.col(shard)).sortWithinPartitions(place).select(*docs.columns)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "draws")
