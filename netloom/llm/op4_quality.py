"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its own mean and a covariance shrunk towards its diagonal; the raw score is the difference of the two
Gaussian log-densities, with each Mahalanobis distance taken through the cached inverse of the class's Cholesky factor.
Means and covariances come from sums of powers that Spark adds up over a bounded sample of labelled rows (``per_class``
rows of each label); three quarters of the sample fit, the rest sets where the logistic curve crosses 0.7. Scoring is one
pass over the documents without a shuffle.

Defined cases: null counts as the empty text and is scored like it; without labels of both classes every score is
0.5; repeated ids are scored row by row; rows without an id are scored and never held out; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import textvec as tv
from netloom.llm.arrowio import add_columns, column
from netloom.llm.labelled import Scale, remainder, sample_labels

_KINDS = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "stop": b".,;:?'\"()-",
    "symbol": b"!#$%&*+/<=>@[\\]^_`{|}~",
    "line": b"\n",
    "wide": range(0x80, 0x100),
}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}
STATISTICS = ("words", "word_size", "upper", "digit", "stop", "symbol", "lines", "wide", "short", "long", "distinct_words", "distinct_triples", "top_word")


def statistics(texts) -> np.ndarray:
    """One row of transformed statistics for each text: logs of sizes and of smoothed shares."""
    data, offsets = tv.as_bytes(texts)
    starts, ends, at = tv.words(data, offsets)
    docs = len(offsets) - 1
    kinds = {}
    for k, mask in _MASKS.items():
        sums = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        kinds[k] = np.diff(sums[offsets]).astype(float)
    n, size = np.diff(at).astype(float), np.diff(offsets).astype(float)
    doc = np.repeat(np.arange(docs), np.diff(at))
    long = ends - starts
    count = lambda x: np.bincount(doc, weights=x, minlength=docs)
    hashes = tv.word_hashes(data, starts, ends)
    own = tv.mix(hashes ^ tv.mix(doc.astype(np.uint64)))

    def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ordered = np.sort(x)
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(x) else np.zeros(0, int)
        return ordered[head], np.diff(np.append(head, len(x)))

    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(own)))
    of = doc[order[head]] if len(head) else head
    distinct = np.bincount(of, minlength=docs).astype(float)
    top = np.zeros(docs)
    np.maximum.at(top, of, times)
    first, triple_doc = tv.windows(at, 3)
    triples = tv.mix(tv.WindowHasher(hashes).of(first, 3) ^ tv.mix(triple_doc.astype(np.uint64)))
    order = np.argsort(triples, kind="stable")
    new = np.concatenate([[True], triples[order][1:] != triples[order][:-1]]) if len(order) else np.zeros(0, bool)
    distinct_triples = np.bincount(triple_doc[order[np.flatnonzero(new)]] if len(order) else [], minlength=docs).astype(float)
    share = lambda x, of: np.log((x + 0.5) / (of + 1.0))
    letters = kinds["upper"] + kinds["lower"] + kinds["wide"]
    return np.stack([np.log1p(n), np.log((count(long) + 1) / (n + 1)), share(kinds["upper"], letters), share(kinds["digit"], size), share(kinds["stop"], n), share(kinds["symbol"], n), share(kinds["line"], n), share(kinds["wide"], size), share(count(long <= 3), n), share(count(long > 14), n), share(distinct, n), share(distinct_triples, np.maximum(n - 2, 0)), share(top, n)], axis=1)


class Discriminant:
    """Two Gaussians with shrunk covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float):
        self.classes = []
        for k in (0, 1):
            n, sums, squares = moments[k]
            mean = sums / n
            cov = squares / n - np.outer(mean, mean)
            cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            self.classes.append((mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        logs = [-0.5 * ((((x - mean) @ inverse.T) ** 2).sum(axis=1) + det) for mean, inverse, det in self.classes]
        return np.arcsinh((logs[1] - logs[0]) / 2)


class Model:
    def __init__(self, discriminant: Discriminant | None, scale: Scale | None):
        self.discriminant, self.scale = discriminant, scale

    def __call__(self, texts) -> np.ndarray:
        if self.discriminant is None:
            return np.full(len(texts), 0.5)
        return self.scale(self.discriminant(statistics(texts)))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", trainable=None, per_class: int = 10_000, shrinkage: float = 0.1, at: float = 0.7) -> Model:
    sample = sample_labels(labels, label, trainable=F.lit(True) if trainable is None else trainable, per_class=per_class)
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", "fold", "weight")
    d = len(STATISTICS)

    def gather(batches):
        """Sums of powers of the fitting rows, by class; for the calibration rows their statistics."""
        for batch in batches:
            x = statistics(column(batch, "text"))
            y, fold, weight = (np.asarray(column(batch, c)) for c in ("label", "fold", "weight"))
            kinds, sums = [], []
            for k in (0, 1):
                own = x[(y == k) & (fold < 3)]
                kinds.append(k)
                sums.append(np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()]))
            for i in np.flatnonzero(fold == 3):
                kinds.append(2 + int(y[i]))
                sums.append(np.append(x[i], weight[i]))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=["kind", "sums"])

    got = rows.mapInArrow(gather, "kind int, sums array<double>")
    parts = got.collect()  # bounded by the sample
    moments = {k: (s := np.sum([r.sums for r in parts if r.kind == k] or [np.zeros(1 + d + d * d)], axis=0), None)[0] for k in (0, 1)}
    if any(m[0] < 2 for m in moments.values()):
        return Model(None, None)
    model = Discriminant({k: (m[0], m[1 : 1 + d], m[1 + d :].reshape(d, d)) for k, m in moments.items()}, shrinkage)
    held = [(r.sums, r.kind - 2) for r in parts if r.kind >= 2]
    x, y = np.array([h[0] for h in held]).reshape(-1, d + 1), np.array([h[1] for h in held])
    return Model(model, Scale(model(x[:, :d]), y, at=at, weight=x[:, d]))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, "score double", lambda piece: [pa.array(shared.value(column(piece, "text")), pa.float64())])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), trainable=~held_out)
    return score_quality(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
