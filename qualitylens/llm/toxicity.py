"""Toxicity by a chain of linear classifiers.

The categories are ordered. Each has a logistic regression on hashed words and
word beginnings; from the second on, the earlier categories' probabilities are
inputs too. In training these are out-of-fold predictions, so a later model
sees earlier ones as unsure as they will be on new texts. The last category's
margins are calibrated out of fold, and a fixed threshold gives the verdict.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitylens.llm import linear
from qualitylens.llm.common import arrow_batches
from qualitylens.llm.ngrams import TextBatch, parts

#: The chain, earlier first: toxic prose, toxic junk, toxic at all.
CATEGORIES = ("toxic_prose", "toxic_junk", "toxic")
THRESHOLD = 0.5
BITS = 17
N_FAMILIES = 4
#: A toxic word is a small share of a text, so its weight must be free to grow.
L2, STEPS = 1e-6, 40


def families(texts: list) -> list:
    """Lower-cased words, and the first 4 to 6 letters of words."""
    b = TextBatch(texts, lower=True)
    return [b.word_family(1, BITS), *[b.prefix_family(k, BITS) for k in (4, 5, 6)]]


def category_labels(labels: DataFrame) -> DataFrame:
    """The chain's labels from doc_id, toxic and quality; a null in either gives none."""
    toxic, good = F.col("toxic") > 0, F.col("quality") > 0
    return labels.select(
        "doc_id",
        (toxic & good).cast("int").alias("toxic_prose"),
        (toxic & ~good).cast("int").alias("toxic_junk"),
        (toxic & (good | ~good)).cast("int").alias("toxic"),
    )


class Chain:
    """Weights per category, inputs from earlier ones, constants, calibration."""

    def __init__(self, names: tuple, weights: np.ndarray, earlier: list, bias: list, platt: list):
        self.names, self.weights, self.earlier, self.bias, self.platt = names, weights, earlier, bias, platt

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """A column per category, from a row of margins per category."""
        p = np.zeros((margins.shape[1], len(self.names)))
        for k in range(len(self.names)):
            z = margins[k] + p[:, :k] @ self.earlier[k] + self.bias[k]
            a, b = self.platt[k]
            p[:, k] = linear.sigmoid(a * z + b)
        return p


def train(docs: DataFrame, labels: DataFrame, names: tuple = CATEGORIES, max_rows: int = linear.MAX_ROWS, n_folds: int = 3) -> Chain | None:
    """Fit the chain on at most ``max_rows`` labelled documents (``labels``:
    doc_id and a column per category). A category without two labels of either
    kind always has probability zero; None if no category can be learnt."""
    names = tuple(names)
    sample = linear.labelled_sample(docs, labels, list(names), max_rows)
    x, ids, y = linear.collect_sparse(sample, list(names), families, BITS, N_FAMILIES)
    fold = linear.folds(ids, n_folds)
    out, weights, earlier, bias, platt = np.zeros((len(ids), 0)), [], [], [], []
    learnt = False
    splits = [(np.flatnonzero(fold != f), np.flatnonzero(fold == f)) for f in range(n_folds)]
    splits = [(a, b, x.take(a), x.take(b)) for a, b in splits]
    for k in range(len(names)):
        t = (y[:, k] > 0).astype(float) if len(y) else np.zeros(0)
        if len(t) < 4 or min(t.sum(), (1 - t).sum()) < 2:
            weights.append(np.zeros(x.width)), earlier.append(np.zeros(k)), bias.append(-40.0), platt.append((1.0, 0.0))
            out = np.column_stack([out, np.zeros(len(ids))])
            continue
        learnt = True
        margins = np.zeros(len(t))
        for a, b, xa, xb in splits:
            w = linear.fit_logistic(xa, out[a], t[a], L2, STEPS)
            margins[b] = xb.dot(w[: x.width]) + out[b] @ w[x.width : -1] + w[-1]
        platt.append(linear.fit_platt(margins, t))
        w = linear.fit_logistic(x, out, t, L2, STEPS)
        weights.append(w[: x.width]), earlier.append(w[x.width : -1]), bias.append(float(w[-1]))
        out = np.column_stack([out, linear.sigmoid(platt[-1][0] * margins + platt[-1][1])])
    return Chain(names, np.array(weights, np.float32), earlier, bias, platt) if learnt else None


def judge(docs: DataFrame, chain: Chain | None, names: tuple = CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """Probabilities of every category and the verdict for every row of
    ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, ``p_<name>`` per category, and toxic, the last category's
    verdict. Null and wordless texts are not toxic; whole texts count, however
    long; a null doc_id stays null; rows that repeat are each judged; without
    a chain all probabilities are zero; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    names = chain.names if chain else tuple(names)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a fixed number of weights

    def run(batches):
        model = shared.value
        for frame in batches:
            texts = frame["text"].tolist()
            for a, e in parts(texts):
                p = np.zeros((e - a, len(names)))
                if model:
                    found = families(texts[a:e])
                    p = model.probabilities(linear.scores(found, model.weights, BITS))
                    p[found[0][1] == found[0][2]] = 0
                out = {"doc_id": frame["doc_id"].iloc[a:e].to_numpy()} | {f"p_{n}": p[:, k] for k, n in enumerate(names)}
                yield pd.DataFrame(out | {"toxic": p[:, -1] >= threshold})

    schema = "doc_id long, " + "".join(f"p_{n} double, " for n in names) + "toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)
