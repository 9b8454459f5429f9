import math

import numpy as np

from qualitylens.llm import linear
from qualitylens.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = T.train(docs, T.category_labels(labels.where("doc_id % 4 <> 1")))
    got = T.judge(docs, chain)
    assert got.count() == docs.count()
    rows = got.join(labels.where("doc_id % 4 = 1").withColumnRenamed("toxic", "label"), "doc_id").collect()
    clean = [r.toxic for r in rows if not r.label]
    bad = [r.toxic for r in rows if r.label]
    assert sum(clean) <= 0.03 * len(clean) and sum(bad) >= 0.4 * len(bad)
    # batches do not matter: the same rows one by one
    few = docs.where("doc_id < 5")
    one = {r.doc_id: r.p_toxic for r in T.judge(few.repartition(5), chain).collect()}
    assert all(abs(one[r.doc_id] - r.p_toxic) < 1e-9 for r in got.where("doc_id < 5").collect())


def test_held_out_accuracy_with_more_labels(spark):
    """Some 3,000 labels, of which a tenth are toxic, catch more than 300 do."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = T.train(docs, T.category_labels(labels.where("doc_id % 4 <> 1")))
    held = labels.where("doc_id % 4 = 1").withColumnRenamed("toxic", "label")
    rows = T.judge(docs.join(held, "doc_id", "left_semi"), chain).join(held, "doc_id").collect()
    clean, bad = [r.toxic for r in rows if not r.label], [r.toxic for r in rows if r.label]
    assert sum(clean) <= 0.01 * len(clean) and sum(bad) >= 0.85 * len(bad)


def test_chain_feeds_on_earlier_categories(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    docs = spark.createDataFrame([(i, f"{words[i % 4]} other{(i // 4) % 4} filler{i % 7} text") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 == 0)) for i in range(400)], "doc_id long, a int, b int")
    chain = T.train(docs, labels, ("a", "b"))
    assert len(chain.earlier[0]) == 0 and len(chain.earlier[1]) == 1 and chain.earlier[1][0] != 0
    rows = T.judge(docs, chain).collect()
    assert sum(r.toxic == (r.doc_id % 4 == 0) for r in rows) > 380


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, 1), (None, 1, None)], "doc_id long, toxic int, quality int")
    assert T.train(none, T.category_labels(labels)) is None
    assert T.judge(none, None).count() == 0
    rows = T.judge(spark.createDataFrame([(1, None, 3.0), (None, "", 2.0), (1, "x " * 9000, 1.0)], "doc_id long, text string, p_toxic double"), None).collect()
    assert len(rows) == 3 and not any(r.toxic for r in rows)


def slow_features(text):
    """Column -> value of one text, by plain loops over its families."""
    out = {}
    for k, (buckets, low, high) in enumerate(T.families([text])):
        grams = buckets[low[0] : high[0]].tolist()
        for g in grams:
            at = (k << T.BITS) + g
            out[at] = out.get(at, 0.0) + linear.SCALE / max(linear.MIN_GRAMS, len(grams))
    return out


def slow_probabilities(chain, text):
    """The chain of one text, category after category."""
    x, p = slow_features(text), []
    for k in range(len(chain.names)):
        z = sum(float(chain.weights[k][i]) * v for i, v in x.items()) + chain.bias[k]
        z += sum(w * q for w, q in zip(chain.earlier[k], p, strict=True))
        p.append(1 / (1 + math.exp(-(chain.platt[k][0] * z + chain.platt[k][1]))))
    return p


def sample(n):
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    r = np.random.default_rng(5)
    rows = []
    for i in range(n):
        picked = r.integers(0, 5, 12)
        a, b = int((picked == 0).sum() > 2), int((picked == 1).sum() > 2)
        rows.append((i, " ".join(words[k] for k in picked), a, b, int(a or b)))
    return rows


def test_chain_equals_a_slow_reference(spark):
    """Training by plain loops over folds and categories, scoring by plain sums."""
    rows, names = sample(90), ("a", "b", "c")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, a int, b int, c int")
    chain = T.train(docs, labels, names)
    x = [slow_features(r[1]) for r in rows]
    fold = linear.folds(np.arange(len(rows)), 3)
    sparse = lambda at: linear.Sparse([(np.array(sorted(x[i])), np.array([x[i][c] for c in sorted(x[i])], np.float32)) for i in at], T.N_FAMILIES << T.BITS)
    earlier = [[] for _ in rows]  # out-of-fold probabilities of the categories before
    for k in range(3):
        y = np.array([r[2 + k] for r in rows], float)
        dense = lambda at: np.array([earlier[i] for i in at]).reshape(len(at), k)  # noqa: B023, E731
        margins = np.zeros(len(rows))
        for f in range(3):
            learn, ask = [i for i in range(len(rows)) if fold[i] != f], [i for i in range(len(rows)) if fold[i] == f]
            w = linear.fit_logistic(sparse(learn), dense(learn), y[learn], T.L2, T.STEPS)
            for i in ask:
                margins[i] = sum(w[c] * v for c, v in x[i].items()) + sum(a * b for a, b in zip(w[-1 - k : -1], earlier[i], strict=True)) + w[-1]
        a, b = linear.fit_platt(margins, y)
        every = list(range(len(rows)))
        w = linear.fit_logistic(sparse(every), dense(every), y, T.L2, T.STEPS)
        assert np.allclose(chain.earlier[k], w[-1 - k : -1], atol=1e-2, rtol=1e-2) and abs(chain.platt[k][0] - a) < 1e-2
        for i in every:
            earlier[i] = earlier[i] + [1 / (1 + math.exp(-(a * margins[i] + b)))]
    texts = [r[1] for r in rows] + ["other words only", "Alpha ALPHA alpha beta"]
    got = T.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()
    for r in got:
        want = slow_probabilities(chain, texts[r.doc_id])
        assert np.allclose([r.p_a, r.p_b, r.p_c], want, atol=1e-6) and r.toxic == (want[-1] >= T.THRESHOLD)


def test_fit_reaches_the_optimum():
    """Against full Newton steps on a small dense problem."""
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 6)).astype(np.float32)
    y = (x @ r.normal(size=6) + r.normal(size=200) > 0).astype(float)
    w = linear.fit_logistic(linear.Sparse([(np.arange(6), row) for row in x], 6), np.zeros((200, 0)), y, 1e-2, 60)
    ones, u = np.column_stack([x, np.ones(200)]), np.zeros(7)
    keep = 1e-2 * np.diag([1.0] * 6 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-ones @ u))
        u -= np.linalg.solve(ones.T @ (ones * (p * (1 - p))[:, None]) / 200 + keep, ones.T @ (p - y) / 200 + keep @ u)
    assert np.allclose(w, u, atol=1e-3)
