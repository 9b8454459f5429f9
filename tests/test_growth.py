"""Queries whose tasks must not grow with the tables."""

import duckdb

import __spark_entry__
from qualitylens.plans import graphs
from qualitylens.session import Scratch


def same_as_sql(spark, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    got = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect())
    assert got == want
    return got


def words(n, at=0):
    return " ".join("w" + "".join(chr(97 + int(c)) for c in f"{k:03}") for k in range(at, at + n))


def test_pairs_of_texts_and_queries_are_weighed_in_bounded_parts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, words(20, k)) for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, words(15, 3 * k)) for k in range(12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(graphs, "_MEETINGS", 200, raising=False)
    files, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, *a: (out := save(self, df, *a), files.append((set(df.columns), len(out.inputFiles()))))[0])
    assert same_as_sql(spark, "q141_tfidf_cosine", tmp_path, "documents", "benchmark")
    assert max(n for columns, n in files if {"doc_id", "item_id"} <= columns) > 5


def test_cosines_that_round_up_to_the_cut_are_kept(spark, tmp_path):
    spark.createDataFrame([(k, words(54)) for k in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(5) + " unknown word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = same_as_sql(spark, "q141_tfidf_cosine", tmp_path, "documents", "benchmark")
    assert got == [(1, k, 0.15) for k in range(5)]  # 0.14996 before it is rounded


def test_coverage_reports_are_parsed_once_and_no_file_is_lost(spark, tmp_path):
    rows = [(o, (o * k) % 9, k, "NRAO"[(o + k) % 4], 5 * o + k) for o in range(60) for k in range(1, 6)] + [(1, 99, 1, "O", 3), (1, 98, 2, "R", 9), (1, 98, 2, "R", 9)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = same_as_sql(spark, "q005_coverage_json", tmp_path, "lineitem")
    assert ("part/99", 0, 0, 0, 0, 0) in got
    df = __spark_entry__.queries()["q005_coverage_json"](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan json") == 1
