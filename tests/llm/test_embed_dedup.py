import numpy as np

from qualitylens.llm import embed_dedup as E


def brute(rows):
    ok = lambda v: v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
    at = [k for k, (_, v) in enumerate(rows) if ok(v)]
    wide = np.array([len(rows[k][1]) for k in at])
    x = np.array([list(rows[k][1]) + [0.0] * (16 - len(rows[k][1])) for k in at], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & (wide[:, None] == wide[None, :])
    name = lambda k: 1 << 62 if rows[k][0] is None else rows[k][0]
    best = {k: name(k) for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for i, k in enumerate(at):
            m = min(best[at[j]] for j in np.flatnonzero(near[i]))
            if m < best[k]:
                best[k], changed = m, True
    links = {k: int(near[i].sum()) - 1 for i, k in enumerate(at)}
    return sorted(((i, links.get(k, 0), best[k] if best[k] < 1 << 62 else None) for k, (i, _) in enumerate(rows)), key=str)


def make(seed=0, groups=12, size=40):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = r.normal(size=16)
        for _ in range(size if g % 3 == 0 else 3):
            rows.append((c + r.normal(size=16) * 0.08).tolist())
    rows += [r.normal(size=16).tolist() for _ in range(300)]
    rows += [rows[0]] * 30 + [[2 * v for v in rows[0]]]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.01], [2.0, 4.0], [1.0, -2.0], [1.0, 2.0] + [0.0] * 14, [3.0], [1e-200] * 16, [1e200] * 16]
    ids = r.permutation(len(rows)).tolist()
    out = [(i, v) for i, v in zip(ids, rows)]
    return out + [(None, rows[5]), (None, None), (out[3][0], rows[3])]


def test_against_brute_force(spark, monkeypatch):
    rows = make()
    scaled = [(i, v if v is None or not v or v[0] is None or not np.isfinite(v).all() or not any(v) else (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<double>, label int, e string")
    want = brute(scaled)
    for target, most in ((1000, 4096), (100, 64)):  # one shard; several, in blocks
        monkeypatch.setattr(E, "TARGET", target)
        monkeypatch.setattr(E, "MAX_SHARD", most)
        got = E.near_duplicates(df).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_graph_search_recall():
    r = np.random.default_rng(1)
    c = r.normal(size=(20, 32))
    x = np.concatenate([c[k] + r.normal(size=(60, 32)) * 0.05 for k in range(20)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = E.Graph(x, E.build_graph(x))
    got, true = g.search(x, 0.95), x @ x.T >= 0.95
    assert not (got & ~true).any()
    assert (got & true).sum() >= 0.95 * true.sum()
    assert g.greedy >= len(x)  # every query walks from the medoid


def test_tasks_search_greedily_from_the_medoid(monkeypatch):
    """The path that the query takes, a task of one shard, does not start at the query itself."""
    made = []
    plain = E.Graph.__init__
    monkeypatch.setattr(E.Graph, "__init__", lambda self, *a: (plain(self, *a), made.append(self))[0])
    r = np.random.default_rng(2)
    x = np.concatenate([v + r.normal(size=(4, 24)) * 0.01 for v in r.normal(size=(100, 24))])
    lists = E.build_graph(E.units(list(x)))
    f = E.pd.DataFrame({"cid": np.arange(400), "vec": list(x), "m": 1, "shards": [np.array([7, 9])] * 400, "nbrs": lists, "block": 0})
    out = E.search_task(7, f, 0.95, E.BEAM, True)
    assert made[0].greedy >= 400 and made[0].ranged >= 400
    assert (out.hits == 3).mean() > 0.9 and len(out) > 380
    assert not len(E.search_task(9, f, 0.95, E.BEAM, True))  # counted in shard 7


def test_audited_recall(spark):
    for n in (500, 5000):
        r = np.random.default_rng(n)
        c = r.normal(size=(n // 10, 24))
        x = c[r.integers(0, len(c), n)] + r.normal(size=(n, 24)) * 0.1
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = np.array([v.n_links for v in sorted(E.near_duplicates(df).collect(), key=lambda v: v.vec_id)])
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = (u @ u.T >= 0.95).sum(axis=1) - 1
        assert (got <= want).all() and (got[want > 0] / want[want > 0]).mean() >= 0.95


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_all_pairs_are_the_last_resort(spark, monkeypatch):
    """A recall that no graph reaches ends in all pairs of blocks, each class
    in one shard, and those are whole."""
    monkeypatch.setattr(E, "TARGET", 100)
    monkeypatch.setattr(E, "MAX_SHARD", 64)
    monkeypatch.setattr(E, "RETRIES", 0)
    seen, plain = [], E._search
    monkeypatch.setattr(E, "_search", lambda *a: (seen.append(a[5]), plain(*a))[1])
    monkeypatch.setattr(E, "audit", lambda *a: 0.0)
    rows = [(i, v) for i, v in make(3) if v and v[0] is not None and np.isfinite(v).all() and any(v) and 1e-100 < np.abs(v).max() < 1e100]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert seen == [True, False]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)


def test_measured_recall(spark, monkeypatch):
    monkeypatch.setattr(E, "ASKED", 16)
    monkeypatch.setattr(E, "AGAINST", 100)
    rows = [(i, v) for i, v in make(4) if v is None or not v or v[0] is None or not np.isfinite(v).all() or not any(v) or 1e-100 < np.abs(v).max() < 1e100]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    true = {}
    for i, n, _ in brute(rows):
        if i is not None and i % 5 == 0:
            true[i] = true.get(i, 0) + n
    true = {i: n for i, n in true.items() if n}
    halved = spark.createDataFrame([(i, n // 2) for i, n in true.items()], "vec_id long, n_links long")
    out = {r.band: r for r in E.measured_recall(df, halved, every=5).collect()}
    assert (out["all"].queries, out["all"].links, out["all"].met) == (len(true), sum(true.values()), sum(n // 2 for n in true.values()))
    assert out["all"].least_recall == min(n // 2 / n for n in true.values())
    assert sum(out[b].queries for b in out if b != "all") == len(true)
    whole = {r.band: r.recall for r in E.measured_recall(df, E.near_duplicates(df), every=5).collect()}
    assert whole["all"] >= 0.95
    assert not E.measured_recall(df.limit(0), halved).count()
