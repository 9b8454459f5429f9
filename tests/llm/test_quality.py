import random
import re

import numpy as np
import pytest

from qualitylens.llm import linear, quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    words = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), failed


def texts():
    r = random.Random(5)
    out = [None, "", " \n\t", "a b c a b c", "x\n\nx\n x\nx", "é| &  <tag>\x0b#", "\x1c \x85 y", "😀 " * 60, "line one\nline two\nline one\r\nline one"]
    for n in (40, 55, 200):
        for _ in range(6):
            out.append(" ".join(r.choice(["a", "bb", "c#", "|", "dé", "f\nf", "\n"]) for _ in range(n)))
    return out


def test_counts_are_those_of_brute_force(spark):
    docs = [(i, t, "k") for i, t in enumerate(texts())]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    rows = quality.judge(df, quality.Model(None)).collect()
    for r in rows:
        want = brute(docs[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1])


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(none, labels)
    assert model.weights is None and quality.judge(none, model).count() == 0
    df = spark.createDataFrame([(None, "a " * 80), (1, None), (1, None)], "doc_id long, text string")
    assert quality.judge(df, model).count() == 3 and quality.keep_good(df, model).count() == 0


def test_gradient_and_calibration():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 400).astype(float)
    rows = [(np.array([int(v) * 3, 1], np.int32), np.array([1.0, r.normal()], np.float32)) for v in y]
    w = linear.fit_logistic(linear.Sparse(rows, 8), np.zeros((400, 0)), y)
    z = linear.Sparse(rows, 8).dot(w[:-1]) + w[-1]
    assert ((z > 0) == (y > 0)).mean() > 0.99
    a, b = linear.fit_platt(r.normal(size=4000) + 0, (r.random(4000) < 0.3).astype(float))
    assert abs(linear.sigmoid(np.array([b]))[0] - 0.3) < 0.05 and abs(a) < 0.2


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    got = quality.judge(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    good = got[got.quality == 1]
    assert good[~good.base_failed].kept.mean() > 0.97
    assert got[got.quality == 0].kept.mean() < 0.25
    frame = quality.keep_good(docs, model)
    assert frame.columns == docs.columns
    assert frame.count() == quality.judge(docs, model).where("kept").count()
