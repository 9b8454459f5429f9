"""Scans over hot keys, as-of joins, first supersets: against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qualitylens.operators import relational as R
from qualitylens.operators import sequence as S


def rows(n=400, seed=1):
    """One key has a third of the rows, some keys are null, values are null now and then."""
    r = random.Random(seed)
    key = lambda: 1 if r.random() < 0.34 else r.choice([None, 2, 3, 4, 5])
    return [(key(), float(r.randrange(n // 3)), i, r.choice([None, "a", "b", "b"])) for i in range(n)]


def by_key(data):
    out = {}
    for x in sorted(data, key=lambda x: (x[1], x[2])):
        out.setdefault(x[0], []).append(x)
    return out


@pytest.fixture(scope="module")
def events(spark):
    # names that the operators use themselves, to clash
    return spark.createDataFrame(rows(), "k int, at double, s long, v string")


def test_scans_equal_windows_over_whole_keys(spark, events):
    d = S.Dealt(events, ["k"], ["at", "s"], rows=16)
    assert d.df.select("s").distinct().count() >= 20
    sizes = [x["count"] for x in d.df.groupBy("s").count().collect()]
    assert max(sizes) <= 4 * 16
    d = d.previous(was=lambda r: r["v"]).total(n=lambda r: F.when(r["v"] == "b", 1)).latest(seen=lambda r: r["v"]).soonest(due=lambda r: r["v"])
    got = {x.s: (x.k, x.at, x.v, x.was, x.n, x.seen, x.due) for x in d.rows().collect()}
    want = {}
    for k, xs in by_key(rows()).items():
        for i, (_, t, s, v) in enumerate(xs):
            before, after = [x[3] for x in xs[: i + 1] if x[3]], [x[3] for x in xs[i:] if x[3]]
            want[s] = (k, t, v, xs[i - 1][3] if i else None, before.count("b"), before[-1] if before else None, after[0] if after else None)
    assert got == want
    assert S.Dealt(events.where("false"), ["k"], ["at"]).total(n=lambda r: F.lit(1)).rows().count() == 0


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, events, forward, strict, monkeypatch):
    monkeypatch.setattr(S, "_deals", lambda df, n: 9)
    left = [(k, None if i % 50 == 0 else t, i) for k, t, i, _ in rows(300, 2)]
    right = [(k, None if i % 40 == 0 else t, i) for k, t, i, _ in rows(120, 3)] + [(2, 5.0, 900), (2, 5.0, 901)]
    a, b = spark.createDataFrame(left, "k int, r double, l int"), spark.createDataFrame(right, "k int, at double, l int")
    for tolerance in (None, 3.0):
        got = S.asof_join(a, b, ["k"], "r", "at", forward=forward, strict=strict, tolerance=tolerance, tie="l")
        assert got.columns == ["k", "r", "l", "match"]
        got = {x.l: x.match and (x.match.k, x.match.at, x.match.l) for x in got.collect()}
        want = {}
        for k, t, i in left:
            near = [y for y in right if None not in (k, t, y[0], y[1]) and y[0] == k and (y[1] > t or y[1] == t and not strict if forward else y[1] < t or y[1] == t and not strict)]
            best = (min if forward else max)(near, key=lambda y: (y[1], y[2]), default=None)
            want[i] = best if best and (tolerance is None or abs(best[1] - t) <= tolerance) else None
        assert got == want


def test_ranges_runs_and_repeats_of_a_hot_key(spark, events):
    data = rows()
    got = {x.s: x.in_range for x in S.count_in_range(events.withColumn("ts", F.timestamp_seconds("at")), ["k"], "ts", 20).collect()}
    assert {x[2] for x in data} == set(got)
    for k, t, s, _ in data:
        assert got[s] == sum(y[0] == k and t - 20 <= y[1] <= t for y in data)
    longest = {}
    for k, xs in by_key(data).items():
        run = 0
        for i, x in enumerate(xs):
            run = run + 1 if i and xs[i - 1][3] == x[3] else 1
            longest[k, x[3]] = max(longest.get((k, x[3]), 0), run)
    assert {(x.k, x.v): x.longest for x in S.longest_run(events, "k", ["at", "s"], "v").collect()} == longest
    kept = set()
    for xs in by_key(data).values():
        last = None
        for x in xs:
            if last is None or x[1] - last >= 15:
                last = x[1]
                kept.add(x[2])
    assert {x.s for x in S.once_within(events, ["k"], "at", "s", 15).collect()} == kept


def test_first_superset(spark, monkeypatch):
    monkeypatch.setattr(R, "FIRST_SETS", 4)
    monkeypatch.setattr(R, "MORE_SETS", 2)
    r = random.Random(6)
    sets = [(i, [r.choice("abcdefgh") for _ in range(r.randint(0, 6))], r.randint(1, 9)) for i in range(200)] + [(900, None, 3), (None, ["a"], 1), (901, ["zz"], 1), (901, ["zz"], 2)]
    df = spark.createDataFrame(sets, "first long, items array<string>, w int")
    want = Counter()
    for i, xs, n in sets:
        above = [j for j, ys, m in sets if xs and ys and i is not None and j is not None and m > n and set(xs) <= set(ys)]
        if above:
            want[i, min(above)] += 1
    assert Counter((x["first"], x.superset) for x in R.first_superset(df, "first", "items", "w").collect()) == want
    assert R.first_superset(df.where("false"), "first", "items", "w").count() == 0


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 2, "y")], "key int, rank int, row string")
    assert [tuple(x) for x in R.keep_best(df, ["key"], [F.col("rank")]).collect()] == [(1, 2, "y")]
    hits = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "hit int, at int")
    assert {x.hit: x.streak for x in S.trailing_streak(hits, "hit", ["at"], F.col("at") > 1).collect()} == {1: 1, 2: 1}
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "island string, at int").withColumn("key", F.lit(1))
    assert {x.island: x.longest for x in S.longest_run(runs, "key", ["at"], "island").collect()} == {"a": 2, "b": 1}
    paths = spark.createDataFrame([("a/b", 7)], "path string, v int")
    rules = spark.createDataFrame([("a", 1), ("a", 2)], "prefix string, v int")
    assert [tuple(x) for x in R.longest_prefix(paths, rules, "path", "prefix", "v").collect()] == [("a/b", 2)]


def test_interval_join_over_bins(spark):
    r = random.Random(9)
    points = [(r.choice([1, 1, 1, 2, None]), None if i % 60 == 0 else r.uniform(-50, 50), i) for i in range(400)]
    spans = [(r.choice([1, 1, 2, None]), float(a := r.randrange(-50, 50)), a + r.choice([0.0, 1.0, 3.0, -1.0, 40.0]), i) for i in range(90)]
    p, s = spark.createDataFrame(points, "k int, x double, i int"), spark.createDataFrame(spans, "k int, bin double, b double, j int")
    got = Counter((x.i, x.j) for x in R.interval_join(p, s, "k", "x", "bin", "b").collect())
    assert got == Counter((i, j) for k, x, i in points for m, a, b, j in spans if k is not None and k == m and x is not None and a <= x <= b)
    assert R.interval_join(p, s.where("false"), "k", "x", "bin", "b").count() == 0
