"""Sparse softmax regression over hashed words, trained on the driver from a bounded sample.

Features are 64-bit hashes kept exactly (a sorted array, no buckets), so that words the training sample never showed
weigh nothing instead of sharing another word's weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import segment_sums

_GATE_BITS = 22


@dataclass
class Model:
    """Logits of a row: bias + the sum of ``weights`` of its distinct features."""

    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    classes: list[str]
    temperature: float = 1.0

    def __post_init__(self) -> None:
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[self.keys >> np.uint64(64 - _GATE_BITS)] = True

    def rows_of(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known features in ``features``, and their rows in ``weights``."""
        at = np.nonzero(self.gate[features >> np.uint64(64 - _GATE_BITS)])[0]
        row = np.searchsorted(self.keys, features[at])
        row = np.minimum(row, max(0, len(self.keys) - 1))
        ok = self.keys[row] == features[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[ok], row[ok]

    def posteriors(self, features: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
        """Class probabilities of ``n`` rows; ``segment`` (ascending) has the row of each feature."""
        at, row = self.rows_of(features)
        pair = np.unique(segment[at].astype(np.int64) * max(1, len(self.keys)) + row)
        who, row = pair // max(1, len(self.keys)), pair % max(1, len(self.keys))
        logits = self.bias + segment_sums(self.weights[row].astype(np.float64), np.bincount(who, minlength=n))
        return softmax(logits / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def strong_features(sample: DataFrame, classes: int, min_rows: int, least_z: float) -> np.ndarray:
    """Sorted features that :func:`fit` would keep, counted by Spark.

    ``sample`` has ``target`` (a class number) and ``features`` (distinct 64-bit hashes of a row), in a table that can be
    read again. Its size is bounded by the caller; only the features found are sent to the driver.
    """
    size = np.zeros(classes, np.int64)
    for r in sample.groupBy("target").count().collect():
        size[r.target] = r["count"]
    n = int(size.sum())
    by = [F.count_if(F.col("target") == c).cast("double").alias(f"c{c}") for c in range(classes)]
    counted = sample.select("target", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").cast("double").alias("total"), *by).where(F.col("total") >= min_rows)
    if least_z > 0:
        rate = (F.col("total") + 1) / (n + 2)
        z = [
            (F.col(f"c{c}") / int(size[c]) - (F.col("total") - F.col(f"c{c}")) / int(n - size[c])) / F.sqrt(rate * (1 - rate) * float(1 / size[c] + 1 / (n - size[c])))
            for c in range(classes)
            if c != int(np.argmax(size)) and 0 < size[c] < n
        ]
        counted = counted.where(F.greatest(F.lit(0.0), F.lit(0.0), *z) >= least_z)
    return np.sort(counted.select("feature").toArrow().column(0).to_numpy().view(np.uint64))


def fit(rows: list[np.ndarray], target: np.ndarray, classes: list[str], min_rows: int = 2, least_z: float = 0.0, l2: float = 1e-3, steps: int = 200, held_out: float = 0.2, seed: int = 7) -> Model:
    """Train on ``rows`` (feature hashes of each, repeats ignored) with classes ``target``.

    A feature counts if ``min_rows`` rows or more have it and, for some class but the largest, its rate there is above its
    rate elsewhere by ``least_z`` standard errors: a row that shows nothing particular is of the largest class. The temperature is the one that makes a held-out part likeliest. A class
    without rows gets probability zero.
    """
    n, k = len(rows), len(classes)
    lens = np.array([len(r) for r in rows], np.int64)
    feats = np.concatenate([np.zeros(0, np.uint64), *rows]).astype(np.uint64)
    who = np.repeat(np.arange(n), lens)
    keys, code = np.unique(feats, return_inverse=True)
    pair = np.unique(who.astype(np.int64) * max(1, len(keys)) + code)
    who, code = pair // max(1, len(keys)), pair % max(1, len(keys))
    counts = np.bincount(target, minlength=k).astype(np.float64)
    by_class = np.zeros((len(keys), k))
    np.add.at(by_class, (code, target[who]), 1)
    total = by_class.sum(axis=1)
    good = total >= min_rows
    if least_z > 0:
        z = np.zeros(len(keys))
        for c in set(range(k)) - {int(np.argmax(counts))}:
            inside, outside = by_class[:, c], total - by_class[:, c]
            n_in, n_out = counts[c], n - counts[c]
            if n_in and n_out:
                rate = (total + 1) / (n + 2)
                z = np.maximum(z, (inside / n_in - outside / n_out) / np.sqrt(rate * (1 - rate) * (1 / n_in + 1 / n_out)))
        good &= z >= least_z
    new = np.cumsum(good) - 1
    ok = good[code]
    who, code = who[ok], new[code[ok]]
    keys = keys[good]
    there = counts > 0
    bias = np.where(there, np.log(np.maximum(counts, 1) / max(n, 1)), -1e9)
    if n == 0 or there.sum() < 2:
        return Model(np.zeros(0, np.uint64), np.zeros((0, k), np.float32), bias if there.any() else np.zeros(k), classes)
    rng = np.random.default_rng(seed)
    test = rng.random(n) < held_out if n >= 50 else np.zeros(n, bool)
    y = np.zeros((n, k))
    y[np.arange(n), target] = 1
    row_weight = np.where(test, 0.0, 1.0) / max(1, int((~test).sum()))
    lens = np.bincount(who, minlength=n)
    order = np.argsort(code, kind="stable")
    by_feature, per_feature = who[order], np.bincount(code, minlength=len(keys))
    w = np.zeros((len(keys), k))
    m, v, mb, vb, b = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k), bias.copy()

    def logits() -> np.ndarray:
        return b + segment_sums(w[code], lens)

    for step in range(1, steps + 1):  # Adam on the whole sample
        g = (softmax(logits()) - y) * row_weight[:, None]
        gw = segment_sums(g[by_feature], per_feature) + l2 * w / n
        gb = np.where(there, g.sum(axis=0), 0)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.1
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if test.any():
        z = logits()[test]
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), target[test]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(keys, w.astype(np.float32), b, classes, temperature)
