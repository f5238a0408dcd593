"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash of a unit vector is the signed axis nearest to it after three pseudo-rotations (random signs, then a
Hadamard transform). Every row is indexed in every table. A query probes buckets in the order of its own rotated
coordinates, in two passes: the first few buckets of each table give it a k-th best score; from that score, the chance
that a neighbour at least as near hides in a table's later buckets is known (it depends on the angle and the dimension
alone, and is simulated once), and the second pass probes what brings the expected recall to ``recall`` at the least
work: a few buckets of many tables for near neighbours, most of one table for far ones. A query without a score to go
by searches one table whole, so none costs more than a comparison with every row besides the first pass. Candidates are
reranked by the inner product of the original vectors in double precision.

Buckets are split into blocks of about ``block_rows`` rows (so copies of one vector are spread) and their queries into
blocks of about ``block_queries``; a pair of blocks answers each query with its best ``k`` rows that beat what the query
already has.

Rows of unequal length as vectors: inner product is turned into angle by one more coordinate that brings every row to
the largest norm; where norms agree it is left out.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of another
dimension than most, nor rows without an id; rows that repeat an id are candidates once each, at their best score, and the least of their vectors is the query; with
fewer than k candidates all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.arrowio import column
from netloom.llm.session import checkpointed


class Rotations:
    """Pseudo-rotations of vectors padded to a power of two, a set of three for each table."""

    def __init__(self, dim: int, tables: int, norm: float, augment: bool, seed: int = 3):
        self.dim, self.norm, self.augment = dim, norm, augment
        self.size = 1 << max(int(np.ceil(np.log2(max(dim + augment, 2)))), 1)
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def padded(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        out[:, : self.dim] = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.norm)
        if self.augment and not query:
            out[:, self.dim] = np.sqrt(np.maximum(1 - (out**2).sum(axis=1), 0))
        return out

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        """Coordinates along the signed axes: 2 * size columns."""
        for signs in self.signs[table]:
            x = x * signs
            h = 1
            while h < self.size:
                x = x.reshape(len(x), -1, 2, h)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), -1)
                h *= 2
            x = x / np.sqrt(self.size)
        return np.concatenate([x, -x], axis=1)

    def probes(self, tables: int, recall: float, samples: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By cosine, how many tables to look into and how many buckets of each, so that a neighbour of that cosine is
        found with chance ``recall`` at the least work: few of many tables for near ones, most of one for far ones."""
        rng = np.random.default_rng(1)
        x = rng.normal(size=(samples, self.size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=(samples, self.size))
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        seen = np.argsort(np.argsort(-self.turned(x, 0), axis=1), axis=1)
        cosines = np.arange(0, 1, 0.02)
        used, needed = [], []
        for c in cosines:
            rank = np.sort(seen[np.arange(samples), self.turned(c * x + np.sqrt(1 - c * c) * y, 0).argmax(axis=1)])
            share = np.searchsorted(rank, np.arange(1, 2 * self.size + 1)) / samples
            options = [(t * n, t, n) for t in range(1, tables + 1) for n in np.flatnonzero(1 - (1 - share) ** t >= recall)[:1] + 1]
            _, t, n = min(options, default=(0, 1, 2 * self.size))
            used.append(t)
            needed.append(n)
        return cosines, np.array(used), np.array(needed)


def _matrix(vectors) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.asarray(vectors.flatten()).astype(np.float64).reshape(len(vectors), -1)  # products are taken in double precision


def nearest(rows: DataFrame, *, is_query, k: int = 20, tables: int = 6, first: int = 4, recall: float = 0.95, block_rows: int = 512, block_queries: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found among all other rows."""
    values = F.col(vector_col)
    sound = values.isNotNull() & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    rows = rows.filter(F.col(id_col).isNotNull()).filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), values.alias("v"), is_query.alias("q"))
    kind = rows.schema["v"].dataType.simpleString()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    by_dim = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"), F.min(norm).alias("least")).orderBy(F.desc("n"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if by_dim is None:
        return rows.sparkSession.createDataFrame([], empty)
    rows = rows.filter(F.size("v") == by_dim.dim)
    turn = Rotations(by_dim.dim, tables, by_dim.most, by_dim.least < 0.999 * by_dim.most)
    cosines, used, needed = turn.probes(tables, recall)
    every = 2 * turn.size

    def index(batches):
        for batch in batches:
            x = turn.padded(_matrix(column(batch, "v")), query=False)
            found = np.stack([turn.turned(x, t).argmax(axis=1) for t in range(tables)], axis=1) + np.arange(tables) * every
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(found.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "v"), lists], names=["id", "v", "cells"])

    indexed = checkpointed(rows.select("id", "v").mapInArrow(index, f"id long, v {kind}, cells array<int>"))
    entries = indexed.select("id", "v", F.explode("cells").alias("cell"))
    blocks = checkpointed(entries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")))

    def probe(low: np.ndarray | None):
        """Which cells queries look into: the first, or (given a 20th-best score) those from there to what is needed."""

        def run(batches):
            for batch in batches:
                v = _matrix(column(batch, "v"))
                x = turn.padded(v, query=True)
                if low is None:
                    lo, hi, of = np.zeros(len(x), int), np.full(len(x), first), np.full(len(x), tables)
                    floor = np.full(len(x), -np.inf)
                else:
                    floor = np.asarray(column(batch, "floor"))
                    cosine = np.where(np.isfinite(floor), floor / (np.linalg.norm(v, axis=1) * turn.norm), 0)
                    at = np.clip(np.floor(np.maximum(cosine, 0) / 0.02).astype(int), 0, len(cosines) - 1)
                    # Without a score to go by, one table is searched whole.
                    known = np.isfinite(floor) & (floor > 0)
                    hi, of = np.where(known, needed[at], every), np.where(known, used[at], 1)
                    lo = np.full(len(x), first)
                cells, counts = [], np.zeros(len(x), np.int64)
                orders = [np.argsort(-turn.turned(x, t), axis=1) + t * every for t in range(tables)]
                for i in range(len(x)):
                    own = np.concatenate([o[i, lo[i] : hi[i]] for o in orders[: of[i]]])
                    cells.append(own)
                    counts[i] = len(own)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, int), *cells]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "v"), pa.array(floor), lists], names=["qid", "v", "floor", "cells"])

        return run

    def rank_in_block(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and rows.num_rows:
            q, m = _matrix(queries.column("v")), _matrix(rows.column("v"))
            qid, ids, floor = (np.asarray(c.combine_chunks()) for c in (queries.column("qid"), rows.column("id"), queries.column("floor")))
            rough = q @ m.T
            rough[qid[:, None] == ids[None, :]] = -np.inf
            for i in range(len(q)):
                take = np.flatnonzero(rough[i] >= floor[i] - 1e-9 * (1 + abs(floor[i]))) if np.isfinite(floor[i]) else np.flatnonzero(rough[i] > -np.inf)
                if len(take) > k:
                    edge = np.partition(rough[i, take], len(take) - k)[len(take) - k]
                    take = take[rough[i, take] >= edge - 1e-9 * (1 + abs(edge))]
                exact = (m[take] * q[i]).sum(axis=1)
                best = np.lexsort((ids[take], -exact))[:k]
                out.append((np.full(len(best), qid[i]), ids[take[best]], exact[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    def search(probing: DataFrame) -> DataFrame:
        """Rows of a cell and queries that look into it meet in blocks of both, so that neither side of a group grows."""
        probing = checkpointed(probing)
        asked = probing.select("qid", "v", "floor", F.explode("cells").alias("cell"))
        asking = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("turns"))
        grid = checkpointed(blocks.join(asking, "cell"))
        part = lambda key, by: F.pmod(F.xxhash64(key), F.col(by).cast("long")).cast("int")
        all_of = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
        queries = asked.join(grid, "cell").withColumn("turn", part("qid", "turns")).select("cell", all_of("blocks").alias("block"), "turn", "qid", "v", "floor")
        members = entries.join(grid, "cell").withColumn("block", part("id", "blocks")).select("cell", "block", all_of("turns").alias("turn"), "id", "v")
        key = ["cell", "block", "turn"]
        return queries.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(rank_in_block, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return unique.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    queries = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    schema = f"qid long, v {kind}, floor double, cells array<int>"
    near = checkpointed(best(search(queries.mapInArrow(probe(None), schema))))
    reached = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    again = queries.join(reached, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    more = search(again.mapInArrow(probe(needed), schema))
    whole = best(near.select("query_id", "vec_id", "score").union(more))
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), is_query=F.col("vec_id") % 20 == 0)
