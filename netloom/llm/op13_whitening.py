"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are quantised to integers and packed into blocks of rows, written once into the shared folder. A step of the
bidiagonalisation then is one pass over the blocks: each task forms its centred rows' share of u = Xp and, from it, of
Xᵀu; the shares are summed by Spark, one number for each dimension. Left vectors are never gathered: every u is X times
a known vector of as many entries as there are dimensions, so Uᵀu and the full reorthogonalisation of both sides need
only what the passes returned. Where directions are used up, or the wanted components have converged, the next start is
a fresh one orthogonal to all before, so that repeated singular values are found as often as they occur; it ends when
such a start gains nothing in 16 steps, and at most as many steps as dimensions are taken. The small matrix between both
bases is upper bidiagonal but for fresh starts; its SVD gives components and deviations.

What the driver holds are a few vectors per step (dimensions x steps). Sums, deviations and the trace are exact
integers. Blocks are sized by bytes.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped; zero vectors stay, and
so do rows without an id or with a repeated one; vectors of each length are a fit of their own; a component without
variance (one row, repeated rows, fewer rows than dimensions) can't be whitened and is not returned; an empty table
gives an empty result; further columns are ignored. An entry beyond 2**62 / 64 in size is an error, as is a sum beyond
38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.arrowio import column
from netloom.llm.session import stored

SCALE = 64
OFFSET = 1_000_000
_LARGEST = float(2**62)
_DTYPES = (np.int8, np.int16, np.int32, np.int64)


def _smallest(y: np.ndarray) -> np.ndarray:
    low, high = int(y.min()), int(y.max())
    return y.astype(next(t for t in _DTYPES if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _exact(y: np.ndarray, other: int = 1) -> np.ndarray:
    """y in whole numbers whose products and sums over a block can't overflow."""
    most = max(int(np.abs(y).max(initial=0)), 1)
    return y.astype(np.int64) if most * most * max(other, 1) * max(len(y), 1) < 2**62 else y.astype(object)


def _unpack(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Blocks as (integers by row and dimension, ids)."""
    ids = column(batch, "ids")
    for i, (raw, width) in enumerate(zip(column(batch, "y"), column(batch, "width").to_pylist(), strict=True)):
        yield np.frombuffer(raw.as_buffer(), _DTYPES[width]).reshape(-1, dim), ids[i].values


def packed(rows: DataFrame, dim: int, *, block_bytes: int = 1 << 20) -> DataFrame:
    """rows (id, v) as blocks: ids, quantised entries less OFFSET in the smallest integer type, and that type."""
    size = max(1, block_bytes // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = column(batch, "id"), column(batch, "v")
            for at in range(0, batch.num_rows, size):
                part = v.slice(at, size)
                y = np.floor(np.asarray(part.flatten()).astype(np.float64).reshape(-1, dim) * SCALE)
                if np.abs(y).max() > _LARGEST:
                    raise ValueError("an entry is too large to be quantised to 64 bits")
                y = _smallest(y.astype(np.int64))
                held = ids.slice(at, size)
                lists = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
                yield pa.RecordBatch.from_arrays([lists, pa.array([y.tobytes()], pa.binary()), pa.array([_DTYPES.index(y.dtype.type)], pa.int32())], names=["ids", "y", "width"])

    return stored(rows.select("id", "v").mapInArrow(run, "ids array<bigint>, y binary, width int"))


def _summed(blocks: DataFrame, dim: int, share: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The sum over all blocks of a share of n numbers: added up within each task, then by Spark, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            for y, _ in _unpack(batch, dim):
                total += share(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    out = np.zeros(n)
    for r in blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _moments(blocks: DataFrame, dim: int) -> tuple[int, list[int], list[int]]:
    """Number of rows, exact sums of entries and of their squares by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, squares = 0, [0] * dim, [0] * dim
        for batch in batches:
            for y, _ in _unpack(batch, dim):
                y = _exact(y)
                rows += len(y)
                sums = [a + int(b) for a, b in zip(sums, y.sum(axis=0), strict=True)]
                squares = [a + int(b) for a, b in zip(squares, (y * y).sum(axis=0), strict=True)]
        whole = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, rows)), pa.array(sums, whole), pa.array(squares, whole)], names=["at", "rows", "total", "squares"])

    found = blocks.mapInArrow(run, "at int, rows long, total decimal(38,0), squares decimal(38,0)")
    by_dim = {r["at"]: r for r in found.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("rows", "total", "squares"))).collect()}
    return int(by_dim[0]["rows"]), [int(by_dim[i]["total"]) for i in range(dim)], [int(by_dim[i]["squares"]) for i in range(dim)]


@dataclass
class Components:
    """n rows with sums of quantised entries; unit columns of ``vectors`` by falling variance ``values``; their trace."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    steps: int


def _away_from(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def bidiagonalise(gram: Callable[[np.ndarray], np.ndarray], dim: int, most: int, trace: float, *, negligible: float = 1e-20, sure_steps: int = 16, seed: int = 13) -> tuple[np.ndarray, np.ndarray, int]:
    """Singular values (squared) and right vectors of X, the ``most`` leading ones converged, and the steps taken.

    ``gram`` gives Xᵀ(Xp). A left vector u is kept as w with u = Xw and as z = Xᵀu, so that uᵀXv = zᵀv and uᵀu' = wᵀz'.
    """
    rng = np.random.default_rng(seed)
    v, w, z = (np.zeros((dim, 0)) for _ in range(3))
    start, fresh, since, checked = rng.normal(size=dim), True, 0, None
    while v.shape[1] < dim:
        step = _away_from(start, v)
        step /= np.linalg.norm(step)
        # u = Xv less its parts along the left vectors so far; what rounding left of them goes after the pass.
        p = step - w @ (z.T @ step)
        q = gram(p)
        along = w.T @ q
        p, q = p - w @ along, q - z @ along
        square = float(p @ q)
        if square <= negligible * trace:
            if fresh:  # a direction at random without variance: there is none outside the basis
                break
            # Left vectors so far reach v, but none of its own goes with it.
            v, w, z = np.column_stack([v, step]), np.column_stack([w, np.zeros(dim)]), np.column_stack([z, np.zeros(dim)])
            start, fresh, since = rng.normal(size=dim), True, 0
            continue
        v, w, z = np.column_stack([v, step]), np.column_stack([w, p / np.sqrt(square)]), np.column_stack([z, q / np.sqrt(square)])
        since += 1
        start, fresh = _away_from(z[:, -1], v), False
        left, s, right = np.linalg.svd(z.T @ v)
        off = np.linalg.norm(z @ left[:, :most] - (v @ right.T[:, :most]) * s[:most], axis=0)
        converged = len(s) >= most and bool((off <= 1e-14 * s[0]).all())
        if converged and checked is not None and since >= sure_steps and np.allclose(s[:most], checked, rtol=1e-10, atol=0):
            break
        if float(start @ start) <= negligible * trace or converged and (checked is None or since >= sure_steps):
            start, fresh, since, checked = rng.normal(size=dim), True, 0, s[:most].copy() if converged else None
    left, s, right = np.linalg.svd(z.T @ v)
    return s**2, v @ right.T, v.shape[1]


def fit(blocks: DataFrame, dim: int, *, components: int = 32) -> Components:
    """Leading components of the blocks' centred rows."""
    n, totals, squares = _moments(blocks, dim)
    centre = np.array([t / n for t in totals])
    spread = sum(n * q - t * t for t, q in zip(totals, squares, strict=True))  # n**2 times the trace
    trace = spread / n  # of XᵀX

    def gram(p: np.ndarray) -> np.ndarray:
        def share(y: np.ndarray) -> np.ndarray:
            x = y - centre
            return x.T @ (x @ p)

        return _summed(blocks, dim, share, dim)

    sums = [t + n * OFFSET for t in totals]
    if not spread:
        return Components(n, sums, 0.0, np.zeros(0), np.zeros((dim, 0)), 0)
    values, vectors, steps = bidiagonalise(gram, dim, components, trace)
    take = np.flatnonzero(values > 1e-12 * trace)[:components]
    return Components(n, sums, trace / n, values[take] / n, vectors[:, take], steps)


def _whitener(found: Components) -> Callable[[np.ndarray], np.ndarray]:
    centre = np.array([(s - found.n * OFFSET) / found.n for s in found.sums])
    turn = found.vectors / np.sqrt(found.values)
    return lambda y: (y - centre) @ turn


def identity_error(blocks: DataFrame, dim: int, found: Components) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k, white = len(found.values), _whitener(found)
    upper = np.triu_indices(k)

    def share(y: np.ndarray) -> np.ndarray:
        x = white(y)
        return np.concatenate([x.sum(axis=0), (x.T @ x)[upper]])

    total = _summed(blocks, dim, share, k + len(upper[0])) / found.n
    return float(np.abs(total[k:] - (total[:k][upper[0]] * total[:k][upper[1]]) - (upper[0] == upper[1])).max())


def whiten(rows: DataFrame, *, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, dim."""
    values: Column = F.col(vector_col)
    sound = values.isNotNull() & (F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), values.alias("v"))
    out = None
    for dim in sorted(r.dim for r in rows.select(F.size("v").alias("dim")).distinct().collect()):
        blocks = packed(rows.filter(F.size("v") == dim), dim)
        found = fit(blocks, dim, components=components)
        if len(found.values):
            made = _project(blocks, dim, found)
            out = made if out is None else out.unionByName(made)
    if out is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, dim int")
    return out


def _project(blocks: DataFrame, dim: int, found: Components) -> DataFrame:
    k, white, n = len(found.values), _whitener(found), found.n
    totals = np.array([s - n * OFFSET for s in found.sums], object)
    wide = max((abs(int(t)) for t in totals), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, ids in _unpack(batch, dim):
                # n * y - totals is at most n * max|y| + max|totals|; squares of dim of them are added.
                most = n * int(np.abs(y.astype(np.int64)).max()) + wide
                kind = np.int64 if most * most * dim < 2**62 else object
                off = n * y.astype(kind) - totals.astype(kind)
                deviation = pa.array((off * off).sum(axis=1).tolist(), pa.decimal128(38, 0))
                again = pa.array(np.repeat(np.arange(len(y)), k))
                part = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y)))
                yield pa.RecordBatch.from_arrays([ids.take(again), part, deviation.take(again), pa.array(white(y).reshape(-1))], names=["vec_id", "component", "deviation", "whitened"])

    share = F.array(*(F.lit(float(e / found.trace)) for e in found.values))
    made = blocks.mapInArrow(run, "vec_id long, component int, deviation decimal(38,0), whitened double")
    added = {"n": F.lit(n).cast("long"), "explained": F.element_at(share, F.col("component")), "identity_error": F.lit(identity_error(blocks, dim, found)), "dim": F.lit(dim)}
    return made.withColumns(added).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "dim")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))
