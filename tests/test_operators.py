from pyspark.sql import functions as F

from qualitylens.functions import scalar as X
from qualitylens.operators import graph as G
from qualitylens.operators import relational as R
from qualitylens.operators import sequence as S


def test_keep_best_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 1, None)], "k string, v int, t string")
    got = {r.k: r.t for r in R.keep_best(df, ["k"], [-F.col("v")]).collect()}
    assert got == {None: "b", "x": None}
    assert R.keep_best(df.where("false"), ["k"], [F.col("v")]).count() == 0


def test_bag_delta(spark):
    s = "k string, n int, rank int"
    a = spark.createDataFrame([("x", 3, 1), ("gone", 2, 1), ("up", 2, 0)], s)
    b = spark.createDataFrame([("x", 5, 1), ("new", 1, 2), ("up", 1, 2)], s)
    got = {r.k: tuple(r)[1:] for r in R.bag_delta(a, b, ["k"]).collect()}
    assert got == {"x": (2, 0, 0, 3), "gone": (0, 2, 0, 0), "new": (1, 0, 0, 0), "up": (0, 1, 1, 0)}


def test_longest_prefix_and_pairs(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/bc",), ("z",), (None,)], "path string")
    rules = spark.createDataFrame([("a", 1), ("a/b", 2)], "prefix string, v int")
    assert {r.path: r.v for r in R.longest_prefix(paths, rules, "path", "prefix", "v").collect()} == {"a/b/c": 2, "a/bc": 1, "z": None, None: None}
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, None)], "g int, i string")
    assert {(r.a, r.b): r.n for r in R.pair_counts(sets, "g", "i").collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (2, 1, "b"), (3, 1, "a"), (3, 2, None)], "k int, t int, v string")
    assert {r.k: r.streak for r in S.trailing_streak(df, "k", ["t"], F.col("v") == "b").collect()} == {1: 2, 2: 1, 3: 0}
    assert {(r.k, r.v): r.longest for r in S.longest_run(df, "k", ["t"], "v").collect()} == {(1, "a"): 1, (1, "b"): 2, (2, "b"): 1, (3, "a"): 1, (3, None): 1}
    x = spark.createDataFrame([(1, t, float(t)) for t in range(5)] + [(2, 0, 1.0), (3, 0, None)], "k int, t int, v double")
    assert {r.k: round(r.ewma, 6) for r in S.ewma(x, "k", ["t"], "v").collect()} == {1: 3.5749, 2: 1.0}


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 1), (9, 9)], "src int, dst int")
    assert {r.node: r.hops for r in G.reachable(e, spark.createDataFrame([(3,)], "node int")).collect()} == {3: 0, 1: 1, 4: 1, 2: 2, 5: 2}
    assert sorted(r.path for r in G.cycles(e).collect()) == [[1, 2], [1, 2, 3]]
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 7)], "src int, dst int")
    assert {r.node: r.tier for r in G.layers(dag).collect()} == {1: 0, 2: 1, 3: 2, 7: None, 8: None}


def test_layers_move_each_edge_few_times(spark, monkeypatch):
    """A chain with a wide last layer: the wide part is not written anew each round; cycles, loops and shortcuts besides."""
    wide, save = [], G.Scratch.save

    def counted(self, df, by=None):
        out = save(self, df, by)
        wide.append(out.count() if {"src", "dst"} <= set(out.columns) else 0)
        return out

    monkeypatch.setattr(G.Scratch, "save", counted)
    e = [(k, k + 1) for k in range(5)] + [(5, 100 + k) for k in range(400)] + [(0, 3), (2, 5), (9, 9), (0, 0)]
    e += [(50, 51), (51, 52), (52, 51), (52, 53), (53, 54), (49, 50), (0, 54), (49, 1), (60, None)]
    want = {k: k for k in range(6)} | {100 + k: 6 for k in range(400)} | {9: 0, 49: 0, 50: 1, 51: None, 52: None, 53: None, 54: None, 60: 0}
    want |= {k: k for k in range(1, 6)}
    got = G.layers(spark.createDataFrame(e, "src long, dst long")).collect()
    assert {r.node: r.tier for r in got} == want and len(got) == len(want)
    assert sum(wide) < 5 * len(e)


def test_closure_extends_the_newest_paths_only(spark, monkeypatch):
    """Chains, shortcuts and a cycle; of a deep hierarchy the wide last layer is joined once a path, not again."""
    e = [(k, k + 1) for k in range(11)] + [(0, 2), (20, 21), (21, 22), (22, 20), (22, 0), (30, 30), (None, 1)]
    ahead = {}
    for a, b in e:
        ahead.setdefault(a, set()).add(b)
    want = {(a, b) for a, bs in ahead.items() if a is not None for b in bs}
    while more := {(a, c) for a, b in want for c in ahead.get(b, ())} - want:
        want |= more
    got = [tuple(r) for r in G.closure(spark.createDataFrame(e, "src long, dst long")).collect()]
    assert sorted(got) == sorted(want)
    tree, saved, save = [(0, 1), (1, 2), (2, 3)] + [(3, 10 + k) for k in range(300)], [], G.Scratch.save
    monkeypatch.setattr(G.Scratch, "save", lambda self, df, by=None: (out := save(self, df, by), saved.append(out.count()))[0])
    assert G.closure(spark.createDataFrame(tree, "src long, dst long")).count() == 1206
    assert sum(saved) < 1300


def test_cycles_take_a_fixed_number_of_rounds(spark, monkeypatch):
    """Two triangles, a long chain between them and a long ring: no rounds along them."""
    saved, save = [], G.Scratch.save
    monkeypatch.setattr(G.Scratch, "save", lambda self, df, by=None: (saved.append(1), save(self, df, by))[1])
    e = [(0, 1), (1, 2), (2, 0), (100, 101), (101, 102), (102, 100)] + [(2, 3), (12, 100)] + [(k, k + 1) for k in range(3, 12)] + [(200 + k, 200 + (k + 1) % 14) for k in range(14)]
    assert sorted(r.path for r in G.cycles(spark.createDataFrame(e, "src long, dst long"), 3).collect()) == [[0, 1, 2], [100, 101, 102]]
    assert len(saved) <= 6


def test_scalars(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([],), ([1.0, 0.2],)], "c array<double>")
    assert [round(r.x, 6) for r in df.select(X.noisy_or(F.col("c")).alias("x")).collect()] == [0.75, 0.0, 1.0]
    g = spark.createDataFrame([([0.25, 1.0, None],), ([0.0, 1.0],), ([None],)], "c array<double>")
    assert [r.x and round(r.x, 6) for r in g.select(X.geometric_mean(F.col("c")).alias("x")).collect()] == [0.5, 0.0, None]


def test_set_cover_is_greedy(spark):
    import random

    for seed in range(2):
        r = random.Random(seed)
        kills = {t: {r.randrange(60) for _ in range(r.randint(1, 9))} for t in range(25)}
        left, want = set().union(*kills.values()), []
        while left:
            t = min(kills, key=lambda t: (-len(kills[t] & left), t))  # noqa: B023
            want.append((len(want) + 1, t, len(kills[t] & left)))
            left -= kills[t]
        df = spark.createDataFrame([(m, t) for t, ms in kills.items() for m in ms] + [(None, 3)], "mutant long, test long")
        assert sorted(map(tuple, G.set_cover(df).collect())) == want
    assert G.set_cover(df.where("false")).count() == 0


def test_set_cover_takes_few_rounds_and_bounded_batches(spark, monkeypatch):
    """Tests that all share mutants: not one step a round, and with small batches the same steps."""
    import random

    r, saved, save = random.Random(4), [], G.Scratch.save
    monkeypatch.setattr(G.Scratch, "save", lambda self, df, by=None: (saved.append(1), save(self, df, by))[1])
    kills = {f"{c}{t:02}": {(c, r.randrange(90)) for _ in range(r.randint(5, 20))} for c in "ab" for t in range(40)}
    df = spark.createDataFrame([(f"{c}{m}", t) for t, ms in kills.items() for c, m in ms], "mutant string, test string")
    left, want = set().union(*kills.values()), []
    while left:
        t = min(kills, key=lambda t: (-len(kills[t] & left), t))  # noqa: B023
        want.append((len(want) + 1, t, len(kills[t] & left)))
        left -= kills[t]
    got = sorted(map(tuple, G.set_cover(df).collect()))
    assert got == want and len(saved) < len(want)
    for most in (12, 150):
        assert sorted(map(tuple, G.set_cover(df, most).collect())) == want


def test_set_cover_links_little_and_orders_once(spark, monkeypatch):
    """Copies of a component whose tests all share a mutant, and a chain: links only
    where least tests differ, and tests of whole components are not put in order."""
    linked, ordered, components, running = [], [], G.components, G.running
    monkeypatch.setattr(G, "components", lambda links, scratch=None: (linked.append(links.count()), components(links, scratch))[1])
    monkeypatch.setattr(G, "running", lambda *a, **k: (ordered.append(1), running(*a, **k))[1])
    kills = {100 * c + t: {f"{c}-{m * t % 11}" for m in range(t % 7 + 1)} for c in range(3) for t in range(20)}
    kills |= {1000 + k: {f"chain {k}", f"chain {k + 1}"} for k in range(30)}
    left, want = set().union(*kills.values()), []
    while left:
        t = min(kills, key=lambda t: (-len(kills[t] & left), t))  # noqa: B023
        want.append((len(want) + 1, t, len(kills[t] & left)))
        left -= kills[t]
    df = spark.createDataFrame([(m, t) for t, ms in kills.items() for m in ms], "mutant string, test long")
    assert sorted(map(tuple, G.set_cover(df).collect())) == want
    assert linked[0] < 30 and len(ordered) == 1


def test_folds_in_stretches_and_large_groups(spark):
    r = [((k * 37) % 50, k, float((k * 7919) % 13)) for k in range(300)]
    one = spark.createDataFrame([(1, t, i, v) for t, i, v in r], "k int, t int, i int, v double")
    want = None
    for *_, v in sorted(r):
        want = v if want is None else 0.7 * v + 0.3 * want
    assert round(S.ewma(one, "k", ["t", "i"], "v").collect()[0].ewma, 9) == round(want, 9)
    big = spark.createDataFrame([(g, f"{i:03}") for g in (1, 2) for i in range(600)] + [(3, "000"), (3, "001")], "g int, i string")
    got = R.pair_counts(big, "g", "i").groupBy("n").count().collect()
    assert {x.n: x["count"] for x in got} == {2: 600 * 599 // 2 - 1, 3: 1}
    late = spark.createDataFrame([("a", 0.0, 1), ("a", 50.0, 2), ("a", 90.0, 3), ("a", 120.0, 4), ("a", 191.0, 5), ("b", 60.0, 6), (None, 1.0, 7)], "k string, at double, id int")
    assert sorted(x.id for x in S.once_within(late, ["k"], "at", "id", 100).collect()) == [1, 4, 6, 7]


def test_components_and_cycles_to_five(spark):
    import itertools
    import random

    r = random.Random(8)
    # a ring of five, one of six, a hub that much leads to and from, random edges, chains
    e = [(k, (k + 1) % 5) for k in range(5)] + [(10 + k, 10 + (k + 1) % 6) for k in range(6)] + [(20 + k, 50) for k in range(25)] + [(50, 60 + k) for k in range(25)] + [(60, 20), (61, 21), (4, 10), (85, 86), (86, 87), (87, 88)]
    e += [(r.randrange(100, 125), r.randrange(100, 125)) for _ in range(45)] + [(7, 7)]
    df = spark.createDataFrame(e, "src long, dst long")
    ahead = {}
    for a, b in e:
        ahead.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in ahead.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    nodes = {x for pair in e for x in pair}
    to = {n: reach(n) for n in nodes}
    assert {x.node: x.root for x in G.strong_components(df).collect()} == {n: min(m for m in to[n] if n in to[m]) for n in nodes}

    def walks(path):
        for b in ahead.get(path[-1], ()):
            if b == path[0] and len(path) > 1:
                yield path
            elif b > path[0] and b not in path and len(path) < 5:
                yield from walks([*path, b])

    want = sorted(itertools.chain.from_iterable(walks([n]) for n in nodes))
    assert [0, 1, 2, 3, 4] in want and not any(n in p for p in want for n in range(10, 16))
    assert sorted(x.path for x in G.cycles(df, 5).collect()) == want
    assert G.cycles(df.where("false"), 3).count() == 0
