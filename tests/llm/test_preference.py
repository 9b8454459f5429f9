from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from qualitylens.llm import linear
from qualitylens.llm import preference as P
from qualitylens.session import table

SF = "/root/testdata/sf0.01"


def test_held_out_quality_and_no_leak(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in P.judge(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    tests = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(x.predicted == y for x, y in tests) >= 0.95 * len(tests)
    pairs = [x.score > z.score for x, y in tests if y for z, q in tests if not q]
    assert sum(pairs) >= 0.97 * len(pairs)
    # labels of held-out rows, and columns beside the text, change nothing
    turned = labels.withColumn("quality", F.when(P.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("quality", F.lit(0))
    assert {r.doc_id: round(r.score, 9) for r in P.judge(other, turned).collect()} == {k: round(r.score, 9) for k, r in got.items()}


def test_the_fit_orders_pairs_as_all_pairs_would():
    r = np.random.default_rng(5)
    true = r.normal(size=12)
    rows = [(np.arange(12, dtype=np.int32), r.normal(size=12).astype(np.float32)) for _ in range(300)]
    y = np.array([float(v @ true + r.logistic() > 1) for _, v in rows])
    w = P.fit(linear.Sparse(rows, 12), y, l2=1e-3)
    s = np.array([v @ w[:12] for _, v in rows])
    right = lambda s: (s[y > 0][:, None] > s[y <= 0][None]).mean()
    assert right(s) >= right(np.array([v @ true for _, v in rows])) - 0.02
    assert P.fit(linear.Sparse(rows, 12), np.ones(300)) is None
    better, worse = P.pairs_of(y)
    assert len(better) == len(worse) == 4 * max(y.sum(), (1 - y).sum()) and y[better].all() and not y[worse].any()


def test_odd_rows(spark):
    good = "plain words in a quiet line that says something new every time"
    rows = [(k, f"{good} {k}" if k % 3 else f"$$$ {k} ### &&& !!! %%%") for k in range(90)]
    odd = [(None, None), (None, good), (500, ""), (500, None), (501, "x " * 400_000), (502, good), (502, good)]
    d = spark.createDataFrame([(t, k, "s", 0.0) for k, t in rows + odd], "text string, doc_id long, score string, margin double")
    lab = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows] + [(None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, quality int")
    got = P.judge(d, lab).collect()
    assert len(got) == len(rows) + len(odd) and all(r.score is not None for r in got)
    known = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id < 90 and r.doc_id != 5}
    assert sum(p == (k % 3 > 0) for k, p in known.items()) >= 0.95 * len(known)
    assert {r.score for r in P.judge(d, lab.where("quality = 1")).collect()} == {0.7}
    assert P.judge(d.where("false"), lab).count() == 0
    assert P.judge(d, lab.where("false")).where("predicted = 1").count() == len(got)
