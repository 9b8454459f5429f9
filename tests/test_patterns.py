import random
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from qualitylens.operators import patterns as P


def test_first_rule(spark):
    r = random.Random(3)
    part = lambda: r.choice(["a", "ab", "b.c", "x+", "[q", "", "é", "(z)"])
    names = list({part() + "/" + part() + r.choice(["::", "/", ""]) + part() for _ in range(150)}) + ["", "a\nb"]
    rules = [(part() + r.choice(["*", "?*", "*/", "[ab]*", "[!a]*", ""]) + part(), k) for k in range(60)] + [("*", 900), ("a/*", -1), (None, 5), (names[0], 3), (names[0], 4)]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [(None, -1)], "name string, rule int")
    got = P.first_rule(rows, spark.createDataFrame(rules, "p string, o int"), "name", "p", "o", "won")
    assert got.columns == ["name", "rule", "won"]
    known = [x for x in rules if x[0] is not None]

    def want(n):
        whole = [x for x in known if "*" not in x[0] and x[0] == n]
        some = [x for x in known if "*" in x[0] and fnmatchcase(n, x[0])]
        return max(whole, key=lambda x: x[1]) if whole else min(some, key=lambda x: x[1], default=None)

    for x in got.where("name is not null").collect():
        assert (x.won and tuple(x.won)) == want(x.name)
    assert got.where("name is null and won is not null").count() == 0
    none = spark.createDataFrame([], "p string, o int")
    assert P.first_rule(rows, none, "name", "p", "o").where("rule is not null").count() == 0


def test_globs_are_those_of_file_names(spark):
    r = random.Random(1)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(r.randint(0, n)))
    cases = [(some("ab*?[]!-^\\&~.", 9), some("ab[]!-^\\&.\n", 7)) for _ in range(4000)] + [("[]-?!a~]*", "&"), ("a[!]b]*é", "axé")]
    rows = [(*c, P._glob(c[0])[-1]) for c in cases]
    for x in spark.createDataFrame(rows, "p string, n string, regex string").select("p", "n", F.expr("n rlike regex").alias("fits")).collect():
        assert x.fits == fnmatchcase(x.n, x.p), (x.p, x.n)


def test_first_rule_meets_few_patterns(spark):
    """Patterns that share their ends and differ between: names meet by all literals, not by one end."""
    n = 3000
    rules = spark.range(n).selectExpr("concat('O/?-H*::', id, '*') as p", "id as o").union(spark.range(n, 2 * n).selectExpr("concat('*::', id, '?')", "id")).union(spark.range(2 * n, 3 * n).selectExpr("concat('O/*', id)", "id"))
    rows = spark.range(20_000).selectExpr("concat('O/', if(id % 2 = 0, '1-HIGH', '2-LOW'), '::', id) as name")
    got = {x.name: x.rule and x.rule.o for x in P.first_rule(rows, rules, "name", "p", "o").collect()}
    for k in range(0, 20_000, 7):
        heads = [int(str(k)[:d]) for d in range(1, 6) if d <= len(str(k)) and str(int(str(k)[:d])) == str(k)[:d] and int(str(k)[:d]) < n] if k % 2 == 0 else []
        less = [k // 10] if n <= k // 10 < 2 * n else []
        tails = [int(str(k)[-d:]) for d in range(1, len(str(k)) + 1) if str(k)[-d] != "0" and 2 * n <= int(str(k)[-d:]) < 3 * n]
        assert got[f"O/{'2-LOW' if k % 2 else '1-HIGH'}::{k}"] == min([*heads, *less, *tails], default=None)
    plan = P.first_rule(rows, rules, "name", "p", "o")._jdf.queryExecution().executedPlan().toString()
    assert "head#" in plan and "middle#" in plan and "tail#" in plan and "ArrowEvalPython" not in plan


def test_pattern_hits(spark, monkeypatch):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé ") for _ in range(r.randint(1, n)))
    patterns, texts = list({word(4) for _ in range(300)}), [word(80) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(t, 0) for t in texts], "t string, hits int").withColumn("i", F.monotonically_increasing_id())
    table = spark.createDataFrame([(p,) for p in patterns] + [(None,), ("",)], "p string")
    for x in P.pattern_hits(df, "t", table, "p").collect():
        at = {p: [k for k in range(len(x.t or "")) if x.t.startswith(p, k)] for p in patterns}
        assert [tuple(h) for h in x.hits] == sorted((p, len(ks), ks[0]) for p, ks in at.items() if ks)
    assert P.pattern_hits(df, "t", table.where("false"), "p").where("size(hits) > 0").count() == 0
    monkeypatch.setattr(P, "MAX_CHARS", 3)
    with pytest.raises(ValueError):
        P.pattern_hits(df, "t", table, "p")


def test_pattern_hits_take_small_batches(spark):
    """Memory of Python: texts come by the thousand at most, and hits are never rows of Python objects."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        df = spark.range(3000).selectExpr("concat('abc', id) as t")
        got = P.pattern_hits(df, "t", spark.createDataFrame([("abc",), ("9",)], "p string"), "p")
        assert int(spark.conf.get(name)) <= 1000
        assert "ArrowEvalPython" in (plan := got._jdf.queryExecution().toString()) and "hits" in plan
        counts = {x.p: x.n for x in got.selectExpr("explode(hits) as h").groupBy("h.pattern").agg(F.sum("h.n").alias("n")).toDF("p", "n").collect()}
        assert counts == {"abc": 3000, "9": sum(str(k).count("9") for k in range(3000))}
    finally:
        spark.conf.set(name, before)


def test_exemptions(spark):
    rules = [
        ("complexity", "a.py", None), ("radon", "src/a.py", ["K1"]), ("K9", "b.py", []), ("ruff", "b.py", ["K2"]), ("ruff", "b.py", ["K3"]),
        ("ruff", "c.py", ["K2"]), ("ruff", "src/c.py", None), (None, "d.py", None), ("ruff", None, None),
    ]
    rules = spark.createDataFrame(rules, "section string, file string, codes array<string>")
    cases = {
        ("radon", "K1", "x/a.py"): True, ("radon", "K2", "src/a.py"): False, ("radon", "K1", "src/a.py"): True, ("other", "K2", "a.py"): False,
        ("ruff", "K9", "b.py"): False, ("mypy", "K9", "b.py"): True, ("ruff", "K3", "b.py"): True, ("ruff", None, "b.py"): False,
        ("ruff", "K1", "src/c.py"): False, ("ruff", "K2", "src/c.py"): True, (None, "K1", "d.py"): False, (None, "K9", "b.py"): True,
        ("ruff", "K2", None): False, ("ruff", "K2", ""): False, (None, None, "a.py"): False,
    }
    rows = spark.createDataFrame([(*k, 0) for k in cases for _ in range(2)], "l string, k string, f string, rule int")
    got = P.exempted(rows, rules, "l", "k", "f", {"radon": ("complexity",)}).collect()
    assert sorted((str(r.l), str(r.k), str(r.f), r.exempt) for r in got) == sorted((*map(str, k), v) for k, v in cases.items() for _ in range(2))
    assert P.exempted(rows.limit(0), rules, "l", "k", "f", {}).count() == 0 and not any(r.exempt for r in P.exempted(rows, rules.limit(0), "l", "k", "f", {}).collect())
