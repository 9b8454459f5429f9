"""Logistic regression on hashed n-grams, fitted on a bounded labelled sample.

A text's value for an n-gram is its share of the family's n-grams in the text
times ``SCALE``, so a score is the mean weight over a text's n-grams and needs
no table of counts. Fitting reads at most ``max_rows`` labelled rows, whose
sparse values are made on the executors; scoring runs over all rows in Arrow
batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitylens.llm.ngrams import Family, parts

SCALE = 10.0
#: Texts with fewer n-grams count as having so many: a few words prove little.
MIN_GRAMS = 20
#: Bound on the labelled rows that a fit reads, those with the least hash of their id.
MAX_ROWS = 3000


class Sparse:
    """Rows of sparse values."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.size = np.array([len(i) for i, _ in rows], np.int64)
        self.idx = np.concatenate([i for i, _ in rows] or [np.zeros(0, np.int32)])
        self.val = np.concatenate([v for _, v in rows] or [np.zeros(0, np.float32)])
        self.ends, self.width = np.concatenate([[0], np.cumsum(self.size)]), width

    def take(self, rows: np.ndarray) -> Sparse:
        return Sparse([(self.idx[self.ends[r] : self.ends[r + 1]], self.val[self.ends[r] : self.ends[r + 1]]) for r in rows], self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(w[self.idx] * self.val, dtype=np.float64)])
        return upto[self.ends[1:]] - upto[self.ends[:-1]]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.idx, weights=self.val * np.repeat(r, self.size), minlength=self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Sparse, dense: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 40) -> np.ndarray:
    """Weights of the sparse columns, the dense columns and the constant, by
    limited-memory quasi-Newton steps."""
    n, d, k = max(1, len(y)), x.width, dense.shape[1]

    def loss(w):
        z = x.dot(w[:d]) + dense @ w[d : d + k] + w[-1]
        p = sigmoid(z)
        r = (p - y) / n
        value = float(np.mean(np.logaddexp(0, z) - y * z) + l2 * (w[:-1] @ w[:-1]) / 2)
        return value, np.concatenate([x.back(r), dense.T @ r, [r.sum()]]) + l2 * np.append(w[:-1], 0)

    w = np.zeros(d + k + 1)
    f, g = loss(w)
    past: deque = deque(maxlen=8)
    for _ in range(steps):
        q, kept = g.copy(), []
        for s, t, rho in reversed(past):
            a = rho * (s @ q)
            q -= a * t
            kept.append(a)
        if past:
            s, t, _ = past[-1]
            q *= (s @ t) / (t @ t)
        for (s, t, rho), a in zip(past, reversed(kept), strict=True):
            q += s * (a - rho * (t @ q))
        step, slope = (1.0 if past else 1.0 / max(1e-12, np.linalg.norm(g))), -(q @ g)
        if slope > -1e-12:
            break
        for _ in range(25):
            w2 = w - step * q
            f2, g2 = loss(w2)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = w2 - w, g2 - g
        if s @ t > 1e-12:
            past.append((s, t, 1 / (s @ t)))
        w, f, g = w2, f2, g2
    return w


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant that turn margins into calibrated probabilities:
    damped Newton steps, held near slope one by a weak prior."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    prior = np.array([1.0, 0.0])

    def loss(u):
        m = u[0] * z + u[1]
        return float(np.sum(np.logaddexp(0, m) - target * m)) + 0.05 * float((u - prior) @ (u - prior))

    u = prior.copy()
    for _ in range(50):
        p = sigmoid(u[0] * z + u[1])
        v = p * (1 - p)
        h = np.array([[v @ (z * z) + 0.1, v @ z], [v @ z, v.sum() + 0.1]])
        g = np.array([(p - target) @ z, (p - target).sum()]) + 0.1 * (u - prior)
        step = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-6 and loss(u - t * step) > loss(u) - 1e-4 * t * (g @ step):
            t /= 2
        u = u - t * step
        if np.abs(t * step).sum() < 1e-8:
            break
    return max(float(u[0]), 1e-3), float(u[1])


def folds(ids: np.ndarray, n: int) -> np.ndarray:
    """A fold per row, by the row's place in a seeded shuffle."""
    return np.random.default_rng(11).permutation(len(ids)) % n


Families = Callable[[list], list[Family]]


def sparse_rows(families: list[Family], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the columns and values of all its n-grams."""
    out = []
    for d in range(len(families[0][1])):
        idx, val = [], []
        for k, (buckets, low, high) in enumerate(families):
            i, n = np.unique(buckets[low[d] : high[d]], return_counts=True)
            idx.append((i.astype(np.int64) + (k << bits)).astype(np.int32))
            val.append((n * (SCALE / max(MIN_GRAMS, high[d] - low[d]))).astype(np.float32))
        out.append((np.concatenate(idx), np.concatenate(val)))
    return out


def scores(families: list[Family], weights: np.ndarray, bits: int) -> np.ndarray:
    """Per text the sum over the families of the mean weight, times ``SCALE``.
    ``weights``: a row per model."""
    total = np.zeros((len(weights), len(families[0][1])))
    for k, (buckets, low, high) in enumerate(families):
        own = weights[:, k << bits : (k + 1) << bits]
        for m, w in enumerate(own):
            upto = np.concatenate([[0.0], np.cumsum(w[buckets], dtype=np.float64)])
            total[m] += (upto[high] - upto[low]) * (SCALE / np.maximum(MIN_GRAMS, high - low))
    return total


def labelled_sample(docs: DataFrame, labels: DataFrame, cols: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text and label columns of at most ``max_rows`` labelled documents.

    Rows without an id or a label are left out; of repeated labels of an id the
    least counts, of documents that repeat an id the one whose text has the
    least hash."""
    ok = F.col("doc_id").isNotNull()
    for c in cols:
        ok &= F.col(c).isNotNull()
    chosen = labels.where(ok).groupBy("doc_id").agg(*[F.min(c).cast("int").alias(c) for c in cols])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows ids and labels: a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", *cols).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def collect_sparse(sample: DataFrame, cols: list[str], families: Families, bits: int, n_families: int) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """Sparse values, ids and labels of the sample, in order of id."""

    def run(batches):
        for b in batches:
            texts = b["text"].tolist()
            rows = [r for a, e in parts(texts) for r in sparse_rows(families(texts[a:e]), bits)]
            out = b[["doc_id", *cols]].copy()
            out["idx"], out["val"] = [i.tobytes() for i, _ in rows], [v.tobytes() for _, v in rows]
            yield out

    schema = "doc_id long, " + "".join(f"{c} int, " for c in cols) + "idx binary, val binary"
    got: pd.DataFrame = sample.select("doc_id", *cols, "text").mapInPandas(run, schema).toPandas().sort_values("doc_id", ignore_index=True)
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["idx"], got["val"], strict=True)]
    return Sparse(rows, n_families << bits), got["doc_id"].to_numpy(), got[cols].to_numpy(dtype=np.float64).reshape(len(rows), len(cols))


