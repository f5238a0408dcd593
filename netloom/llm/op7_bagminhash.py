"""Near-duplicate documents by BagMinHash signatures of word 5-grams, banding, and verified multiset overlap.

A document is a multiset of shingles (five consecutive words, lower case, of letters and digits; a shorter text is one
shingle). Each shingle's weight axis is cut into dyadic intervals of whole counts, and each interval of each shingle has
a Poisson process of its own, seeded by its hash, whose points fall on the signature's components and on whole weight
levels. A component's value is the first point at or below the document's weight; two documents agree on a component
with probability equal to their weighted Jaccard similarity. Only points early enough to win are made: up to a bound at
which almost all components are filled, doubled for the documents that need more.

Documents with equal multisets are one content from the start and are never paired. Contents that share a band meet in
a bucket. A bucket isn't expanded into pairs: first all members are compared with its first member, which joins most
(Spark splits the join where one leader has many). Where a bucket still holds several components, its members meet in
blocks of at most about ``block``: members of different components are compared until a link joins the two, so that one
link stands for all. Larger buckets are dealt into blocks twice, each time in another way, which joins what is dense;
then the members outside a bucket's largest component are dealt into parts of about ``block``, and each part meets each
block of the bucket, so that no group holds more than two blocks. Every comparison is the exact weighted Jaccard of the
texts, and members of a bucket that end in different components have all been compared; components of the links are the
groups. What is compared in a bucket grows with its members outside the largest component times all its members.

With 20 bands of 6 components, texts of similarity 0.8 share a band with chance 0.997, of 0.85 with 0.9999.

Defined cases: texts without words (null and empty too) are alone; a row without an id gets its text's class and never
names it unless all members lack one (class_id is then null, class_key tells groups apart); repeated rows share a class;
several texts of one id are compared each on its own, and their groups bear the same class_id if it is the smallest in
both; an empty table gives an empty result; further columns, whatever their names, are kept by ``drop_near_duplicates``
and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import textvec as tv
from netloom.llm.arrowio import SMALL_BYTES, add_columns, column, slices, unused
from netloom.llm.components import components
from netloom.llm.session import checkpointed, gathered, small, stored

#: Entries (bucket, rep) that one task takes, 16 bytes each. Tables with fewer rows than those few entries are broadcast.
ENTRIES = 1 << 17

_SHINGLE, _POINT = 0xBA6, 0x9015
_M64 = np.uint64(2**64 - 1)


def shingles(texts, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingle hashes and their documents; a text of fewer words, but not none, is one shingle."""
    data, offsets = tv.as_bytes(texts)
    starts, ends, at = tv.words(data, offsets, tv.NOT_ALNUM)
    hashes = tv.word_hashes(tv.LOWER[data], starts, ends)
    hasher = tv.WindowHasher(hashes, _SHINGLE)
    first, doc = tv.windows(at, width)
    out, of = [hasher.of(first, width)], [doc]
    sizes = np.diff(at)
    for n in range(1, width):
        short = np.flatnonzero(sizes == n)
        out.append(hasher.of(at[short], n))
        of.append(short)
    return np.concatenate(out), np.concatenate(of), len(sizes)


def _counted(shingle: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, ordered by document, with their counts."""
    order = np.lexsort((shingle, doc))
    s, d = shingle[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    head = np.flatnonzero(new)
    return s[head], d[head], np.diff(np.append(head, len(s)))


def bagminhash(shingle: np.ndarray, doc: np.ndarray, count: np.ndarray, docs: int, m: int) -> np.ndarray:
    """docs x m signatures of multisets; rows without shingles are 0."""
    weight = np.bincount(doc, count, docs)
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(int) + 1, 1)
    item = np.repeat(np.arange(len(shingle)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2 ** np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    of, most = doc[item], count[item]
    seed = tv.mix(shingle[item] + tv.mix(level.astype(np.uint64), _POINT))
    bound = (np.log(m) + 2.5) / np.maximum(weight, 1)
    out = np.zeros((docs, m), np.uint64)
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[of])
        x, k = np.zeros(len(live)), 0
        cells, when, what = [], [], []
        while len(live):
            h = tv.mix(seed[live] + np.uint64(k), _POINT + 1)
            x = x - np.log(tv.unit(h)) / (m * width[live])
            early = x <= bound[of[live]]
            live, x, h = live[early], x[early], h[early]
            g = tv.mix(h, _POINT + 2)
            height = low[live] + 1 + ((g >> np.uint64(32)) % width[live].astype(np.uint64)).astype(np.int64)
            fits = height <= most[live]
            cells.append((of[live] * m + ((g & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64))[fits])
            when.append(x[fits])
            what.append(tv.mix(g, _POINT + 3)[fits])
            k += 1
        cell, when, what = np.concatenate(cells), np.concatenate(when), np.concatenate(what)
        order = np.lexsort((when, cell))
        cell, what = cell[order], what[order]
        head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        out.reshape(-1)[cell[head]] = what[head] | np.uint64(1)
        filled = np.bincount(cell[head] // m, minlength=docs)
        todo &= filled < m
        bound = bound * 2
    return out


def _features(docs: DataFrame, *, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a 128-bit key of the row (its id and text), one of its multiset (0 without words) and its bands' hashes."""

    def fn(piece: pa.RecordBatch) -> list:
        shingle, doc, n = shingles(column(piece, "text"), width)
        s, d, c = _counted(shingle, doc)
        keys = []
        for salt in (1, 2):
            sums = np.zeros(len(s) + 1, np.uint64)
            np.cumsum(tv.mix(s, salt) * c.astype(np.uint64), out=sums[1:])
            at = np.searchsorted(d, np.arange(n + 1))
            keys.append(np.where(np.diff(at) > 0, (sums[at[1:]] - sums[at[:-1]]) | np.uint64(1), 0))
        signature = bagminhash(s, d, c, n, bands * rows)
        of_band = np.zeros((n, bands), np.uint64)
        for b in range(bands):
            h = np.full(n, b + 1, np.uint64)
            for r in range(rows):
                h = tv.mix(h * np.uint64(31) + signature[:, b * rows + r])
            of_band[:, b] = h
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(of_band.reshape(-1).view(np.int64)))
        return [pa.array(k.view(np.int64)) for k in map(np.ascontiguousarray, keys)] + [lists]

    t1, t2 = _row_key()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", t1.alias("t1"), t2.alias("t2"))
    return add_columns(keyed, "k1 long, k2 long, bands array<long>", fn, keep=["doc_id", "t1", "t2"], small=True)


def _row_key() -> tuple[Column, Column]:
    return F.xxhash64(F.col("doc_id").cast("long"), "text"), F.xxhash64(F.lit(7), F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull())


def _similarities(pairs: DataFrame, contents: DataFrame, width: int) -> DataFrame:
    """a, z and the weighted Jaccard similarity of their texts, for each pair (a, z)."""
    left = contents.withColumnsRenamed({"id": "a", "text": "text_a"})
    right = contents.withColumnsRenamed({"id": "z", "text": "text_z"})
    joined = pairs.join(left, "a").join(right, "z").select("a", "z", "text_a", "text_z")

    def run(batches):
        for batch in batches:
            for half in slices(batch, "text_a", SMALL_BYTES):
                for piece in slices(half, "text_z", SMALL_BYTES):
                    sides = []
                    for name in ("text_a", "text_z"):
                        shingle, doc, n = shingles(column(piece, name), width)
                        s, d, c = _counted(shingle, doc)
                        sides.append((tv.mix(s) ^ tv.mix(d.astype(np.uint64), 3), d, c))
                    (ka, da, ca), (kz, dz, cz) = sides
                    _, ia, iz = np.intersect1d(ka, kz, assume_unique=True, return_indices=True)
                    both = np.bincount(da[ia], np.minimum(ca[ia], cz[iz]), n)
                    either = np.bincount(da, ca, n) + np.bincount(dz, cz, n) - both
                    yield pa.RecordBatch.from_arrays([column(piece, "a"), column(piece, "z"), pa.array(both / np.maximum(either, 1))], names=["a", "z", "similarity"])

    return joined.mapInArrow(run, "a long, z long, similarity double")


def _connect(entries: DataFrame, contents: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links (a, z) that join components within each block. entries: bucket, block, rep, label, seeks.

    Members are compared across labels until a link joins two components; those that end apart have all been compared,
    if one of the two seeks.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        shingle, doc, n = shingles(table.column("text"), width)
        s, d, c = _counted(shingle, doc)
        at = np.searchsorted(d, np.arange(n + 1))
        sizes = np.bincount(d, c, n)
        ids, seeks = table.column("rep").to_pylist(), table.column("seeks").to_pylist()
        groups: dict[int, list[int]] = {}
        for i, label in enumerate(table.column("label").to_pylist()):
            groups.setdefault(label, []).append(i)

        def near(i: int, j: int) -> bool:
            if not (seeks[i] or seeks[j]) or min(sizes[i], sizes[j]) < threshold * max(sizes[i], sizes[j]):
                return False
            _, ia, ij = np.intersect1d(s[at[i] : at[i + 1]], s[at[j] : at[j + 1]], assume_unique=True, return_indices=True)
            both = np.minimum(c[at[i] : at[i + 1]][ia], c[at[j] : at[j + 1]][ij]).sum()
            return both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9

        apart: list[list[int]] = []
        links = []
        for group in sorted(groups.values(), key=len, reverse=True):
            whole, rest = list(group), []
            for other in apart:
                link = next(((i, j) for i in group for j in other if near(i, j)), None)
                if link is None:
                    rest.append(other)
                else:
                    links.append((ids[link[0]], ids[link[1]]))
                    whole += other
            apart = [*rest, whole]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "z": pa.array([x[1] for x in links], pa.int64())})

    rows = contents.withColumnRenamed("id", "rep").join(small(entries), "rep").select("bucket", "block", "rep", "label", "seeks", "text")
    return rows.groupBy("bucket", "block").applyInArrow(run, "a long, z long")


def _classes(docs: DataFrame, *, threshold: float = 0.8, width: int = 5, bands: int = 20, rows: int = 6, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, t1, t2, k1, k2; contents: k1, k2, first row as (no_id, doc_id, t1, t2) and label of its group)."""
    features = stored(_features(docs, width=width, bands=bands, rows=rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("first")
    # Written before it is read again, so a content's number stays.
    copies = stored(features.filter("k1 <> 0").groupBy("k1", "k2").agg(first, F.first("bands").alias("bands")).withColumn("rep", F.monotonically_increasing_id()))
    entries = copies.select("rep", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    open_entries = checkpointed(entries.join(shared, "bucket"))
    # A driver remembers every task: few entries aren't dealt over all partitions again and again, but lie in one and meet
    # what is broadcast. Members, labels and buckets are never more than entries.
    parts = gathered(open_entries).count() // ENTRIES + 1
    open_entries = open_entries.coalesce(parts)
    few = F.broadcast if parts == 1 else lambda df: df
    members = copies.join(few(open_entries.select("rep").distinct()), "rep").select(F.col("rep").alias("id"), "first.t1", "first.t2")
    t1, t2 = _row_key()
    contents = stored(docs.select(t1.alias("t1"), t2.alias("t2"), "text").join(few(members), ["t1", "t2"]).groupBy("id").agg(F.min("text").alias("text")))
    leaders = open_entries.groupBy("bucket").agg(F.min("rep").alias("leader"))
    pairs = open_entries.join(leaders, "bucket").filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("z")).distinct()
    near = lambda pairs: _similarities(pairs, contents, width).filter(F.col("similarity") >= threshold - 1e-9).select("a", "z")
    links = checkpointed(near(pairs))
    labels = components(links)
    least = 0
    for step in range(3):
        named = open_entries.join(few(labels.withColumnRenamed("id", "rep")), "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
        by_label = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
        open_buckets = by_label.groupBy("bucket").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("k", "label")).alias("largest"), F.max("k").alias("most")).filter((F.col("labels") > 1) & (F.col("n") > least))
        dealt = named.join(few(open_buckets), "bucket").withColumns({"blocks": F.ceil(F.col("n") / block).cast("long"), "parts": F.ceil((F.col("n") - F.col("most")) / block).cast("long")})
        mine = F.pmod(F.xxhash64("rep", F.lit(step)), F.col("blocks"))
        dealt = dealt.withColumns({"seeks": F.lit(True), "block": mine})
        if step == 2:
            # What two ways of dealing left outside the largest component is dealt into parts; every part meets every block.
            # A member goes with its block to every part and, where it is outside, with its part to every block.
            outside, part = F.col("label") != F.col("largest"), F.pmod(F.xxhash64("rep", F.lit("part")), F.col("parts"))
            each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
            with_block = F.transform(each("parts"), lambda p: p * F.col("blocks") + F.col("block"))
            with_part = F.when(outside, F.transform(each("blocks"), lambda b: F.col("part") * F.col("blocks") + b)).otherwise(F.array().cast("array<long>"))
            dealt = dealt.repartition("bucket", "rep").withColumn("part", part).withColumn("cell", F.explode(F.array_union(with_block, with_part)))
            dealt = dealt.withColumns({"seeks": outside & (F.expr("cell div blocks") == F.col("part")), "block": F.col("cell")})
        dealt = checkpointed(dealt.select("bucket", "block", "rep", "label", "seeks"))
        if gathered(dealt).isEmpty():
            break
        more = checkpointed(_connect(dealt, contents, threshold, width))
        if not gathered(more).isEmpty():
            links = links.union(more)
            labels = components(links)
        least = block  # smaller buckets are settled
    named = copies.join(few(labels.withColumnRenamed("id", "rep")), "rep", "left").select("k1", "k2", "first", F.coalesce("label", "rep").alias("label"))
    return features.select("doc_id", "t1", "t2", "k1", "k2"), named


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (the smallest id in its group of near copies) and class_key (one number for each group) of every row."""
    features, contents = _classes(docs, **how)
    groups = contents.groupBy("label").agg(F.min("first.doc_id").alias("class_id"), F.min("k1").alias("class_key"))
    named = contents.select("k1", "k2", "label").join(groups, "label").select("k1", "k2", "class_id", "class_key")
    keyed = features.filter("k1 <> 0").join(named, ["k1", "k2"]).select("doc_id", "class_id", "class_key")
    return keyed.union(features.filter("k1 = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("t1").alias("class_key")))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row of each group: of its smallest id, if any has one; and the texts without words, without exact repeats."""
    features, contents = _classes(docs, **how)
    firsts = contents.groupBy("label").agg(F.min("first").alias("first")).select("first.t1", "first.t2", F.lit(False).alias("alone"))
    wordless = features.filter("k1 = 0").select("t1", "t2", F.col("doc_id").isNull().alias("alone")).distinct()
    t1, t2, nth, alone = unused(docs.columns, "t1", "t2", "nth", "alone")
    kept = firsts.union(wordless).withColumnsRenamed({"t1": t1, "t2": t2, "alone": alone})
    first, second = _row_key()
    rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    found = docs.withColumns({t1: first, t2: second}).join(kept, [t1, t2])
    found = found.withColumn(nth, F.row_number().over(Window.partitionBy(t1, t2).orderBy(F.xxhash64(*rest))))
    return found.filter(F.col(alone) | (F.col(nth) == 1)).select(*docs.columns)


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")
