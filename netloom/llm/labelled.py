"""What the two classifiers share: a bounded sample of labelled rows, and turning raw scores into 0 to 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by: which rows are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def sample_labels(labels: DataFrame, label: str, *, trainable: Column, per_class: int, even: bool = True) -> DataFrame:
    """doc_id, label, weight and fold (0 to 2: fit, 3: calibrate) of about per_class rows of each class.

    Rows are chosen by a hash of the id. The weight is how many labelled rows stand behind a sampled one.

    Both classes get the same expected number of rows, or up to per_class rows each where not ``even``. Rows without an id or a 0/1 label take no part; of contradicting
    labels of one id the larger counts. What comes back is bounded by 2 x per_class rows, and so may be broadcast.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & trainable).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    most = min([per_class, *counts.values()]) if len(counts) == 2 else 0
    share, weight = F.lit(0), F.lit(0.0)
    for value, n in counts.items():
        take = most if even or not most else min(per_class, n)
        share = F.when(F.col("label") == value, F.lit(int(_STEPS * take / n))).otherwise(share)
        weight = F.when(F.col("label") == value, F.lit(n / max(take, 1))).otherwise(weight)
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(_STEPS)) < share).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).cast("int")).withColumn("weight", weight)


class Scale:
    """A logistic curve that crosses ``at`` where a threshold on raw scores classes the calibration rows best."""

    def __init__(self, raw: np.ndarray, label: np.ndarray, *, at: float, weight: np.ndarray):
        self.shift, self.slope, self.centre = float(np.log(at / (1 - at))), 1.0, 0.0
        if len(raw) and len(set(label.tolist())) == 2:
            order = np.argsort(raw, kind="stable")
            s, y = raw[order], label[order].astype(float)
            w = weight[order]
            right = np.concatenate([[0.0], np.cumsum(w * (1 - y))]) + np.concatenate([np.cumsum((w * y)[::-1])[::-1], [0.0]])
            edges = np.concatenate([[s[0] - 1.0], (s[1:] + s[:-1]) / 2, [s[-1] + 1.0]])
            best = np.flatnonzero(right >= right.max() - 1e-9)
            self.centre = float(edges[best[len(best) // 2]])
            self.slope = float(2.0 / max(s.std(), 1e-6))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (raw - self.centre) + self.shift, -500, 500)))
