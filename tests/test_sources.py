import json

from pyspark.sql import functions as F

from qualitylens.sources import files as S


def test_source_tree(spark, tmp_path):
    for name in ("b.py", "a/c.py", "a/site-packages/d.py", "e.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    got = [r.path.rsplit("/", 1)[1] for r in S.source_tree(spark, str(tmp_path)).collect()]
    assert got == ["c.py", "b.py"]
    assert S.source_tree(spark, str(tmp_path), limit=1).count() == 1


def test_telemetry_round_trip(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([("run", "p", None, 3), ("run", "q", "fast", 0)], "event string, project string, tier string, blocking_count long")
    S.append_telemetry(rows, root)
    S.append_telemetry(rows.limit(1), root)
    day = next((tmp_path / "t").glob("dt=*"))
    (day / "bad.json").write_text("{broken\n")
    got = S.telemetry(spark, root)
    assert got.count() == 3 and {r.tier for r in got.collect()} == {"unknown", "fast"}
    assert S.telemetry(spark, root, since="2999-01-01").count() == 0
    plan = S.telemetry(spark, root, since="2020-01-01", project="q")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan.replace("\n", " ")
    assert S.telemetry(spark, root, project="q").count() == 1


def test_documents_coverage_and_log(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "d" / "2.json").write_text("{no")
    assert [r.a for r in S.json_documents(spark, str(tmp_path / "d"), "a int").collect()] == [1]
    (tmp_path / "c.json").write_text(json.dumps({"files": {"x.py": {"executed_lines": [1, 2], "missing_lines": [3], "excluded_lines": [], "missing_branches": [[1, 2], [2, -1], [3], [4, 0]]}}}))
    got = sorted((r.file, r.line, r.state) for r in S.coverage_json(spark, str(tmp_path / "c.json")).collect())
    assert got == [("x.py", 1, "executed"), ("x.py", 2, "executed"), ("x.py", 3, "missing")]
    assert sorted(map(tuple, S.coverage_branches(spark, str(tmp_path / "c.json")).collect())) == [("x.py", 1, 2), ("x.py", 4, 0)]
    (tmp_path / "log").write_text("COMMIT 1\nb.py\na.py\n\nCOMMIT 2\na.py\n")
    got = {r.commit: r.files for r in S.commit_log(spark, str(tmp_path / "log")).collect()}
    assert got == {"1": ["a.py", "b.py"], "2": ["a.py"]}


def test_numbits_retention_generation(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\x05"),), (bytearray(b"\x81\x05"),), (bytearray(),)], "b binary")
    assert [r.n for r in df.select(S.decode_numbits(F.col("b")).alias("n")).collect()] == [[0, 1, 2, 3, 4, 5, 6, 7, 8, 10], [0, 7, 8, 10], []]
    runs = spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 1, 9)], "type string, ts int, run_id int")
    assert sorted(r.run_id for r in S.retained(runs, 2).collect()) == [3, 4, 9]
    state = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "x")], "key string, generation int, v string")
    assert {r.key: r.v for r in S.newest_generation(state, "key").collect()} == {"k": "new", "j": "x"}


def test_coverage_reports_a_line(spark, tmp_path):
    files = [{"é/x.py": {"executed_lines": [1, None], "missing_branches": [[1, 2], [2, -1], [3], [4, None], None]}, "y.py": {}}, {"é/x.py": {"excluded_lines": [7], "missing_branches": None}}]
    (tmp_path / "c.json").write_bytes(b"\r\n".join(json.dumps({"files": f}, ensure_ascii=False).encode() for f in files) + b"\n{broken\n\n")
    got = sorted(tuple(r) for r in S.coverage_files(spark, str(tmp_path / "c.json"), False).collect())
    assert got == [("y.py", [], [], [], []), ("é/x.py", [], [], [7], []), ("é/x.py", [1, None], [], [], [(1, 2)])]
    assert sorted(tuple(r)[1:] for r in S.coverage_json(spark, str(tmp_path / "c.json"), False).collect() if r.line) == [(1, "executed"), (7, "excluded")]
    assert [tuple(r) for r in S.coverage_branches(spark, str(tmp_path / "c.json"), False).collect()] == [("é/x.py", 1, 2)]
