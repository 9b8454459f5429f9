"""Quality scores from pairwise preferences (Bradley-Terry).

A labelled pair says that a text of label 1 is better than one of label 0. The
probability of that is the logistic function of the difference of the texts'
scores, a score being linear in hashed n-grams and a few shares; the weights
minimise the logistic loss on feature differences. A text counts as good from
the quantile of scores on that matches the share of label 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylens.llm import linear
from qualitylens.llm.common import arrow_batches
from qualitylens.llm.ngrams import TextBatch, parts
from qualitylens.operators.selection import order_statistics
from qualitylens.session import Scratch

BITS = 17
N_FAMILIES = 3
N_SHARES = 5
#: Pairs that each row of the larger side enters; those of the other enter more.
PAIRS = 4
#: The score that the threshold gets.
GOOD = 0.7
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Whether a document is for tests only: by the checksum of its id, modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def features(texts: list) -> tuple[list, np.ndarray]:
    """n-gram families (words, word pairs, character triples) and, per text, shares
    of symbols, capitals and repeated words, mean word length and logarithm of length."""
    b = TextBatch(texts)
    words = b.words()
    families = [b.word_family(1, BITS, words), b.word_family(2, BITS, words), b.char_family(3, BITS)]
    n, chars = b.word_high - b.word_low, b.per_text(~b.space)
    p = b.points
    capital = b.per_text((p >= 65) & (p <= 90))
    symbol = b.per_text((p > 32) & (p < 127) & ~((p >= 65) & (p <= 90)) & ~((p >= 97) & (p <= 122)))
    some, all_ = np.maximum(n, linear.MIN_GRAMS), np.maximum(chars, linear.MIN_GRAMS)
    return families, np.stack([symbol / all_, capital / all_, b.repeated_words() / some, chars / some / 10, np.log1p(n) / 10], axis=1)


class Pairs:
    """Feature differences of pairs of rows, as the fit asks for them; they are
    never made, as products with a difference are differences of products."""

    def __init__(self, x: linear.Sparse, better: np.ndarray, worse: np.ndarray):
        self.x, self.better, self.worse, self.width = x, better, worse, x.width

    def dot(self, w: np.ndarray) -> np.ndarray:
        s = self.x.dot(w)
        return s[self.better] - s[self.worse]

    def back(self, r: np.ndarray) -> np.ndarray:
        n = len(self.x.size)
        return self.x.back(np.bincount(self.better, r, n) - np.bincount(self.worse, r, n))


def pairs_of(y: np.ndarray, n_pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """(better, worse): a bounded number of seeded pairs, ``n_pairs`` for each row
    of the larger side; rows of the other side take turns."""
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    r, n = np.random.default_rng(23), n_pairs * max(len(good), len(bad))
    deal = lambda side: np.concatenate([r.permutation(side) for _ in range(-(-n // len(side)))])[:n]
    return deal(good), deal(bad)


def fit(x: linear.Sparse, y: np.ndarray, n_pairs: int = PAIRS, l2: float = 1e-4) -> np.ndarray | None:
    """Weights from all pairs, each seen from both sides, so that the constant
    stays zero; None if there is no pair."""
    better, worse = pairs_of(y, n_pairs)
    if not len(better):
        return None
    both = Pairs(x, np.concatenate([better, worse]), np.concatenate([worse, better]))
    n = len(better)
    return linear.fit_logistic(both, np.zeros((2 * n, 0)), np.repeat([1.0, 0.0], n), l2)[:-1]


def _sample(rows: DataFrame) -> tuple[linear.Sparse, np.ndarray]:
    """Sparse values and labels of a bounded sample, in order of id."""

    def run(batches):
        for b in batches:
            texts, found = b["text"].tolist(), []
            for a, e in parts(texts):
                families, shares = features(texts[a:e])
                own = np.arange(N_SHARES, dtype=np.int32) + (N_FAMILIES << BITS)
                found += [(np.concatenate([i, own]), np.concatenate([v, s.astype(np.float32)])) for (i, v), s in zip(linear.sparse_rows(families, BITS), shares, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "idx": [i.tobytes() for i, _ in found], "val": [v.tobytes() for _, v in found]})

    got = rows.select("doc_id", "quality", "text").mapInPandas(run, "doc_id long, quality int, idx binary, val binary").toPandas().sort_values("doc_id", ignore_index=True)
    values = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["idx"], got["val"], strict=True)]
    return linear.Sparse(values, (N_FAMILIES << BITS) + N_SHARES), got["quality"].to_numpy(np.float64)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = linear.MAX_ROWS) -> np.ndarray | None:
    """Weights from at most ``max_rows`` labelled documents (labels: doc_id,
    quality), none of them held out."""
    learn = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    return fit(*_sample(linear.labelled_sample(docs, learn, ["quality"], max_rows)))


def margins(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """doc_id, margin: the linear score of every row's whole text."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((w[: N_FAMILIES << BITS].astype(np.float32), w[N_FAMILIES << BITS :]))  # a fixed number of weights

    def run(batches):
        grams, own = shared.value
        for b in batches:
            texts = b["text"].tolist()
            for a, e in parts(texts):
                families, shares = features(texts[a:e])
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[a:e].to_numpy(), "margin": linear.scores(families, grams[None, :], BITS)[0] + shares @ own})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, margin double")


def threshold(scored: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """The margin from which a text is good, and the margins' scale.

    Over all learnable labelled rows: with n of label 0, the middle between the
    n-th and the next least margin, which is the quantile that leaves as many
    rows below as have label 0. The scale is the margins' standard deviation."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = Scratch(scored.sparkSession).save(scored.join(known, "doc_id").select("margin", "quality"))
    s = known.agg(F.count("*").alias("n"), F.count_if(F.col("quality") <= 0).alias("bad"), F.stddev_pop("margin").alias("scale")).first()
    if not s.n:
        return 0.0, 1.0
    low, high = order_statistics(known, "margin", [min(max(s.bad - 1, 0), s.n - 1), min(s.bad, s.n - 1)])
    return (low + high) / 2, max(s.scale, 1e-9)


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = linear.MAX_ROWS) -> DataFrame:
    """Score and verdict of every row of ``docs`` (doc_id, text; other columns
    are ignored), learnt from ``labels`` (doc_id, quality).

    Returns doc_id, held_out, score, predicted. The score rises with the margin
    and is ``GOOD`` at the threshold. Null and empty texts are scored as texts
    without words; whole texts count, however long; a null doc_id stays null and
    is not held out; rows that repeat are each scored; an empty table gives no
    rows. Without labels of both kinds nothing is known, and all get ``GOOD``.
    """
    w = train(docs, labels, max_rows)
    if w is None:
        scored, score = docs.select(F.col("doc_id").cast("long")), F.lit(GOOD)
    else:
        scored = Scratch(docs.sparkSession).save(margins(docs, w))
        at, scale = threshold(scored, labels)
        score = 1 / (1 + F.exp(-((F.col("margin") - at) * (2 / scale) + math.log(GOOD / (1 - GOOD)))))
    rows = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
