"""Ranked lexical search over classes of documents that look alike to the items.

A document's score depends on its terms among the items' terms, their numbers, and its length class m alone. Documents
are therefore read once, restricted to the items' vocabulary, and documents with the same vector of term counts and the
same m form a class: rows meet by a hash of both and are told apart by the values themselves. A class is scored once for
all items; of its members only the k with the smallest ids can be among an item's k best, and no more of them are kept
before anything is shuffled, so that a class of a third of all documents costs each task k rows. Tasks keep each item's
k best classes; k classes suffice for k documents, since every class ranked higher holds a document ranked higher. These
are then expanded to their members by ascending id.

Items are taken in blocks whose terms go to every executor: at most ``block_items`` items and ``block_bytes`` of their
text (an item is not cut; one beyond that is a block of its own, and one beyond ``item_bytes`` is an error), so no
broadcast grows with the number of items; each block scans the documents once. Scores are exact 64-bit integers.

Defined cases: null texts and texts without terms are not counted and never ranked; rows of documents are ranked one by
one, also where they repeat an id; rows without an id come after the others of their score; rows of items that repeat id
and text count once, and texts of one item_id are one item; a null item_id is an item of its own; items without terms,
or without documents, give no rows; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import textvec as tv
from netloom.llm.arrowio import add_columns, column
from netloom.llm.session import stored

_WORDS = 1 << 17
_OUT = "item_id {}, rank int, doc_id long, score long"


class Vocabulary:
    """The terms of a block of items, and each item's terms with repeats."""

    def __init__(self, texts: list[list[str]]):
        counts = []
        for own in texts:
            data, starts, ends = _terms(pa.array(own, pa.large_string()))[:3]
            raw = data.tobytes()
            counts.append(Counter(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)))
        terms = list(dict.fromkeys(t for c in counts for t in c))
        hashes = _terms(pa.array([t.decode() for t in terms], pa.large_string()))[4]
        order = np.argsort(hashes, kind="stable")
        self.terms = [terms[i] for i in order]
        self.hashes = hashes[order]
        self.data = np.frombuffer(b"".join(self.terms), np.uint8)
        self.ends = np.cumsum([0, *map(len, self.terms)])
        #: Terms of one hash are neighbours; so many at most.
        self.alike = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))
        number = {t: i for i, t in enumerate(self.terms)}
        held = [(number[t], i, n) for i, c in enumerate(counts) for t, n in c.items()]
        term, item, times = np.array(sorted(held), np.int64).reshape(-1, 3).T
        self.items, self.times = item, times
        self.of_term = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.longest = max((sum(c.values()) for c in counts), default=0)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Each word's term, -1 where it is none. Words are compared byte by byte after their hashes."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        left = np.searchsorted(self.hashes, hashes)
        for step in range(self.alike):
            at = np.minimum(left + step, len(self.hashes) - 1)
            found = np.flatnonzero((self.hashes[at] == hashes) & (np.diff(self.ends)[at] == ends - starts) & (out < 0))
            for low in range(0, len(found), _WORDS):
                maybe = found[low : low + _WORDS]
                size = (ends - starts)[maybe]
                first = np.cumsum(size) - size
                within = np.arange(int(size.sum())) - np.repeat(first, size)
                same = data[np.repeat(starts[maybe], size) + within] == self.data[np.repeat(self.ends[at[maybe]], size) + within]
                sound = maybe[np.logical_and.reduceat(same, first)]
                out[sound] = at[sound]
        return out


def _terms(texts) -> tuple[np.ndarray, ...]:
    data, offsets = tv.as_bytes(texts)
    data = tv.LOWER[data]
    starts, ends, at = tv.words(data, offsets, tv.NOT_ALNUM)
    return data, starts, ends, at, tv.word_hashes(data, starts, ends)


def bags(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row, doc_id, n, terms and times of documents with terms: what each holds of the vocabulary, in order of terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def fn(piece: pa.RecordBatch) -> list:
        known = shared.value
        data, starts, ends, at, hashes = _terms(column(piece, "text"))
        term = known.numbers(data, starts, ends, hashes)
        hit = np.flatnonzero(term >= 0)
        doc = np.searchsorted(at, hit, "right") - 1
        keys, times = np.unique(doc * len(known.terms) + term[hit], return_counts=True)
        docs_of, terms_of = np.divmod(keys, max(len(known.terms), 1))
        ends_of = pa.array(np.searchsorted(docs_of, np.arange(len(at))), pa.int32())
        lists = [pa.ListArray.from_arrays(ends_of, pa.array(x)) for x in (terms_of.astype(np.int32), times.astype(np.int64))]
        return [pa.array(np.diff(at)), *lists]

    found = add_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "n long, terms array<int>, times array<long>", fn, keep=["doc_id"]).filter("n > 0")
    return stored(found.withColumn("row", F.monotonically_increasing_id()))


def weights(held: DataFrame, vocabulary: Vocabulary, documents: int) -> np.ndarray:
    """Each term's weight, from the number of documents that hold it."""
    df = np.zeros(len(vocabulary.terms))
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def classes(held: DataFrame, documents: int, terms: int, *, k: int) -> DataFrame:
    """The k members of smallest id of each class: class (its first member's row), m, doc_id, row and, for the first, terms and times."""
    m = F.expr(f"25L + (75L * n * {documents}L) div {terms}L")
    rows = held.filter(F.size("terms") > 0).select("row", "doc_id", m.alias("m"), "terms", "times").withColumn("hash", F.xxhash64("m", "terms", "times"))
    order = Window.partitionBy("hash", "m", "terms", "times").orderBy(F.asc_nulls_last("doc_id"), "row")
    few = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)  # cut in each task before the exchange
    first = F.first("row").over(order)
    return stored(few.withColumn("class", first).select("class", "m", "doc_id", "row", "nth", *(F.when(F.col("nth") == 1, F.col(c)).alias(c) for c in ("terms", "times"))))


def _score(found: DataFrame, vocabulary: Vocabulary, weight: np.ndarray, items: int, k: int, most_cells: int = 1 << 21) -> DataFrame:
    """item, class, first and score of each task's k best classes of each item."""
    shared = found.sparkSession.sparkContext.broadcast((vocabulary.of_term, vocabulary.items, vocabulary.times, weight, vocabulary.longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_term, item_of, item_times, weight, longest = shared.value
        best = [np.zeros(0, np.int64)] * 4  # item, score, first id (without one: the largest number), class

        def ranked(parts: list[np.ndarray]) -> list[np.ndarray]:
            order = np.lexsort((parts[3], parts[2], -parts[1], parts[0]))
            item = parts[0][order]
            return [x[order][np.arange(len(item)) - np.searchsorted(item, item) < k] for x in parts]

        step = max(1, most_cells // max(items, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                lists, m = column(piece, "terms"), np.asarray(column(piece, "m"))
                row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                term, times = np.asarray(lists.flatten()), np.asarray(column(piece, "times").flatten())
                worth = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * m[row]))
                # Every entry goes to all items of its term.
                n = np.diff(of_term)[term]
                entry = np.repeat(np.arange(len(term)), n)
                place = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + of_term[term][entry]
                cell, value = row[entry] * items + item_of[place], worth[entry] * item_times[place]
                if longest * int(worth.max(initial=0)) < 2**53:  # sums in doubles are exact
                    score = np.bincount(cell, weights=value, minlength=len(lists) * items).astype(np.int64)
                else:
                    score = np.zeros(len(lists) * items, np.int64)
                    np.add.at(score, cell, value)
                score = score.reshape(len(lists), items)
                if len(lists) > k:  # an item's k-th best score so far, and in this piece
                    floor = np.partition(score, len(lists) - k, axis=0)[len(lists) - k]
                    r, i = np.nonzero((score >= floor) & (score > 0))
                else:
                    r, i = np.nonzero(score > 0)
                ids = np.asarray(column(piece, "doc_id").fill_null(np.iinfo(np.int64).max))
                best = ranked([np.concatenate(x) for x in zip(best, (i, score[r, i], ids[r], np.asarray(column(piece, "class"))[r]), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["item", "score", "first", "class"])

    return found.filter("nth = 1").select("class", "m", "doc_id", "terms", "times").mapInArrow(run, "item long, score long, first long, class long")


def _blocks(items: DataFrame, block_items: int, block_bytes: int, item_bytes: int) -> list[list]:
    """Which item_ids are searched together."""
    sizes = items.groupBy("item_id").agg(F.sum(F.octet_length("text")).alias("size")).orderBy("item_id").toLocalIterator()
    out, held = [[]], 0
    for r in sizes:
        if (r["size"] or 0) > item_bytes:
            raise ValueError(f"item {r['item_id']} has {r['size']} bytes, more than item_bytes = {item_bytes}")
        if out[-1] and (len(out[-1]) == block_items or held + (r["size"] or 0) > block_bytes):
            out.append([])
            held = 0
        out[-1].append(r["item_id"])
        held += r["size"] or 0
    return out if out[0] else []


def search(docs: DataFrame, benchmark: DataFrame, *, k: int = 10, block_items: int = 2048, block_bytes: int = 8 << 20, item_bytes: int = 64 << 20) -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score."""
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for ids in _blocks(items, block_items, block_bytes, item_bytes):
        low, high = min((i for i in ids if i is not None), default=None), max((i for i in ids if i is not None), default=None)
        here = F.col("item_id").between(low, high) if low is not None else F.lit(False)
        texts: dict = {i: [] for i in ids}
        for r in items.filter(F.coalesce(here, F.lit(False)) | (F.col("item_id").isNull() if None in ids else F.lit(False))).collect():
            texts[r["item_id"]].append(r["text"])
        made = _search_block(docs, list(texts), list(texts.values()), k, kind)
        out = made if made is None or out is None else out.unionByName(made)
    return docs.sparkSession.createDataFrame([], _OUT.format(kind)) if out is None else out


def _search_block(docs: DataFrame, ids: list, texts: list[list[str]], k: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary(texts)
    held = bags(docs, vocabulary)
    total = held.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    if not total["documents"]:
        return spark.createDataFrame([], _OUT.format(kind))
    members = classes(held, total["documents"], total["terms"], k=k)
    weight = weights(held, vocabulary, total["documents"])
    by_class = Window.partitionBy("item").orderBy(F.desc("score"), "first", "class")
    scored = _score(members, vocabulary, weight, len(ids), k)
    top = scored.withColumn("nth", F.row_number().over(by_class)).filter(F.col("nth") <= k).select("item", "class", "score")
    by_doc = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    found = members.select("class", "doc_id", "row").join(F.broadcast(top), "class").withColumn("rank", F.row_number().over(by_doc)).filter(F.col("rank") <= k)  # k classes of a block's items
    names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_bag_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY term),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * docs) // terms AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM t JOIN q USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10"""
