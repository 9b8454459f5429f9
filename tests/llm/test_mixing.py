from collections import Counter, defaultdict

import pytest

from qualitylens.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, __id int, s string, row int, copies int"


def rows_of():
    out = []
    for k in range(60):
        out.append((k, "big", "w " * (5 + k % 7)))
    for k in range(60, 90):
        out.append((k, "mid", "w " * (1 + k % 4)))
    out += [(90, "tiny", "a b"), (91, None, "n n n"), (None, "mid", "x y z"), (None, "mid", "p q"), (None, None, None), (92, "empty", None), (93, "empty", "  \n")]
    # one id in several sources and with several texts, and whole rows that repeat
    out += [(7, "tiny", "one two three"), (7, "big", "one two three"), (7, "big", "one two four")] + [(8, "mid", "same same")] * 5
    return [(*r, k, "c", k, -1) for k, r in enumerate(out)]


def targets(rows):
    size = defaultdict(int)
    for _, s, t, *_ in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    left, open_, goal = sum(size.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            return goal | share, size
        for s in over:
            goal[s] = 3.0 * size[s]
            left -= 3 * size[s]
            open_.discard(s)
    return goal, size


def test_targets_and_words_taken(spark):
    rows = rows_of()
    goal, size = targets(rows)
    got = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len((t or "").split())) for i, s, t, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) < 1 for s in size)
    again = M.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_rows_repeat_as_the_mix_says(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    plan = defaultdict(int)
    for r in M.mix(df).collect():
        plan[r.doc_id, r.source, r.th] += r.copies
    out = M.repeat_rows(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.source, r.th) for r in out.selectExpr("doc_id", "source", "xxhash64(text) as th").collect())
    assert got == Counter({k: n for k, n in plan.items() if n})
    assert set(map(tuple, out.collect())) <= set(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.mix(none).count() == 0 and M.repeat_rows(none).count() == 0
    blank = spark.createDataFrame([(1, "a", None, 1, "", 1, 1), (2, "a", " ", 1, "", 1, 1)], SCHEMA)
    assert {r.taken for r in M.mix(blank).collect()} == {0} and M.repeat_rows(blank).count() == 0
