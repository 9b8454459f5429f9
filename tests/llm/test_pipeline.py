from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from qualitylens.llm import mixing, packing, quality

from test_line_dedup import brute as brute_lines
from test_quality import brute as brute_quality
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, 0
    frames = [docs.toPandas()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        frames.append(docs.toPandas())
        at += 1
    start, good, lines, single, mixed, packed = frames

    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    p = dict(quality.judge(spark.createDataFrame(start[["doc_id", "text"]]), model).select("doc_id", "p_good").collect())
    want = {i for i, t in zip(start.doc_id, start.text) if not brute_quality(t)[-1] and p[i] >= 0.5}
    assert set(good.doc_id) == want and len(good) == len(want)

    want = {i: t for i, t, _, n in brute_lines(list(zip(good.doc_id, good.text))) if not (n and not t.strip(" \t\n\x0b\x0c\r"))}
    assert dict(zip(lines.doc_id, lines.text)) == want
    assert (lines.text.str.len() == lines.n_chars).all()

    fps = {i: brute_fp(t) for i, t in want.items()}
    words = {i: t.lower().split() for i, t in want.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    alike = lambda a, b: sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or alike(a, b))
    assert sorted(single.doc_id) == sorted(set(root.values()))

    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(single[["doc_id", "source", "text"]])).collect()}
    assert Counter(mixed.doc_id) == Counter({i: n for i, n in copies.items() if n})
    assert set(zip(mixed.doc_id, mixed.text)) <= set(zip(single.doc_id, single.text))

    ids = packed.groupby("doc_id").length.sum()
    n = packed.groupby("doc_id").doc_tokens.first()
    assert {i: ids[i] // n[i] for i in ids.index} == dict(Counter(mixed.doc_id))
    assert packed.groupby("sequence_id").length.sum().max() <= packing.SEQ_LEN
    assert P.run(spark, SF).count() > 0


def test_odd_rows_and_clashing_columns(spark):
    text = " ".join(f"word{k} goes on in its own way" for k in range(40))
    rows = [(k, f"{text} {k}\nshared line of more than eight words in all documents here\nown {k}", "en", "s", 1, 7, 7, "c") for k in range(6)]
    rows += [(None, None, None, None, None, 7, 7, None), (2, None, "en", None, 0, 7, 7, None), (9, "", "en", "s", 0, 7, 7, "c"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped int, copies string")
    docs = docs.withColumn("fp", F.col("doc_id")).withColumn("size", F.lit(5))
    for table in (docs, docs.where("false")):
        for name, stage in P.STAGES[1:]:
            out = stage(spark, table, SF)
            if name == "packing":
                assert out.select("length").count() >= table.count()
            else:
                assert out.columns == docs.columns
                assert {(r.n_lines, r.n_dropped, r["size"]) for r in out.collect()} <= {(7, 7, 5)}
                table = out
