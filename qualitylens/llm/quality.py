"""Quality rules: fixed counts per text, then a calibrated n-gram classifier.

A text fails the base rules if it is short or mostly repeats its own three-word
windows. Of the others a logistic regression on hashed word and character
n-grams, trained on the labelled rows and calibrated on out-of-fold margins,
gives the probability of good quality, which a fixed threshold decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitylens.llm import linear
from qualitylens.llm.common import arrow_batches
from qualitylens.llm.ngrams import TextBatch, parts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
BITS = 17
N_FAMILIES = 3
SYMBOLS = "#*$%&|<>"


def families(texts: list) -> list:
    """Words, word pairs and character triples."""
    return _families(TextBatch(texts))


def _families(b: TextBatch) -> list:
    words = b.words()
    return [b.word_family(1, BITS, words), b.word_family(2, BITS, words), b.char_family(3, BITS)]


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


class Model:
    """Weights, calibration, and the verdict where no label has taught any."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return linear.sigmoid(self.slope * (margins + self.bias) + self.shift)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = linear.MAX_ROWS, n_folds: int = 3) -> Model:
    """Fit on at most ``max_rows`` labelled documents (labels: doc_id, quality).

    Without two labels of either kind there is no model and all texts that
    pass the base rules are kept.
    """
    sample = linear.labelled_sample(docs, labels, ["quality"], max_rows)
    x, ids, y = linear.collect_sparse(sample, ["quality"], families, BITS, N_FAMILIES)
    y = (y[:, 0] > 0).astype(float)
    if min(y.sum(), (1 - y).sum()) < 2:
        return Model(None)
    none = np.zeros((len(y), 0))
    fold, margins = linear.folds(ids, n_folds), np.zeros(len(y))
    for k in range(n_folds):
        a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w = linear.fit_logistic(x.take(a), none[a], y[a])
        margins[b] = x.take(b).dot(w[:-1]) + w[-1]
    slope, shift = linear.fit_platt(margins, y)
    w = linear.fit_logistic(x, none, y)
    return Model(w[:-1].astype(np.float32), float(w[-1]), slope, shift)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, probability and verdict of every row of ``docs`` (doc_id, text;
    other columns are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, p_good. Null and empty texts have no
    words, so they fail; whole texts count, however long; a null doc_id stays
    null; rows that repeat are each judged; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    symbols = np.zeros(128, bool)
    symbols[[ord(c) for c in SYMBOLS]] = True

    def run(batches):
        m = shared.value
        for frame in batches:
            texts = frame["text"].tolist()
            for a, e in parts(texts):
                b = TextBatch(texts[a:e])
                n_words, repeat = b.word_high - b.word_low, b.repeated_words()
                failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
                p = m.probability(linear.scores(_families(b), m.weights[None, :], BITS)[0]) if m.weights is not None else np.ones(e - a)
                yield pd.DataFrame(
                    {
                        "doc_id": frame["doc_id"].iloc[a:e].to_numpy(),
                        "n_words": n_words,
                        "word_chars": b.per_text(~b.space),
                        "n_symbols": b.per_text(symbols[np.minimum(b.points, 127)] & (b.points < 127)),
                        "n_dup_lines": [duplicate_lines(t) for t in texts[a:e]],
                        "n_repeat_words": repeat,
                        "base_failed": failed,
                        "kept": ~failed & (p >= threshold),
                        "p_good": p,
                    }
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns: the
    verdict is made in the same pass, per row, without a join."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(series: pd.Series) -> pd.Series:
        m, texts, out = shared.value, series.tolist(), []
        for a, e in parts(texts):
            b = TextBatch(texts[a:e])
            n_words = b.word_high - b.word_low
            good = (n_words >= MIN_WORDS) & (100 * b.repeated_words() <= MAX_REPEAT_PERCENT * n_words)
            if m.weights is not None:
                good &= m.probability(linear.scores(_families(b), m.weights[None, :], BITS)[0]) >= threshold
            out.append(good)
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(kept(F.col("text")))
