import itertools

import numpy as np
import pytest

from qualitylens.llm import chat as C

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return C.train(spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id % 4 <> 0"))


def some_model(seed=0):
    r = np.random.default_rng(seed)
    return C.Model(r.integers(0, 9, 3), r.integers(0, 9, (3, 3)), [r.integers(0, 9, (3, n)) for n in C.ROW], [r.integers(0, 9, (C.STATES, n)) for n in C.LINE])


def test_viterbi_is_the_best_of_all_paths():
    """Lines of several rows: the first line of a row begins a turn, the others may."""
    r, m = np.random.default_rng(0), some_model()
    for first in ([1], [1, 0], [1, 0, 1], [1, 0, 0, 1, 0]):
        first = np.array(first, bool)
        line, row = r.integers(0, np.prod(C.LINE), len(first)), r.integers(0, np.prod(C.ROW), first.sum())
        s = m.scores(row, line, first)
        best, back = C.viterbi(m.start, m.move, s)
        score = lambda p: m.start[p[0]] + sum(m.move[a, b] for a, b in zip(p, p[1:])) + sum(s[t, x] for t, x in enumerate(p))
        want = max(itertools.product(range(C.STATES), repeat=len(first)), key=score)
        assert C.trace(back, int(best.argmax())) == list(want)
        assert C.decode_many(m, s, np.array([0]), np.array([-1]), np.array([-1])).tolist() == list(want)
        assert all(p < len(C.ROLES) for p, f in zip(want, first) if f)


def test_pieces_give_what_whole_transcripts_give(spark, model):
    words = lambda c, t: "\n".join("word " * ((t * 7 + (c or 0) + k) % 40) + ("?" if t % 3 == 0 else "") for k in range(1 + t % 3))
    rows = [(c, t, words(c, t)) for c in (1, 2, None) for t in range(20)] + [(1, 5, "Bot: " + words(k, k)) for k in range(9)] + [(2, None, words(3, k)) for k in range(7)]
    rows += [(1, 5, "the same")] * 8
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3)
    run = lambda n: sorted(map(tuple, C.decode(turns, model, n).collect()), key=str)
    assert run(1000) == run(3) == run(1)


def test_held_out_roles(spark, model):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id % 4 = 0")
    rows = C.decode(turns, model).join(turns, ["conv_id", "turn"]).collect()
    assert len(rows) == turns.count()  # no row of the sample holds two turns
    assert sum(r.recovered == r.role for r in rows) > 0.93 * len(rows)


def test_rows_with_several_speakers_are_split(spark, model):
    pasted = "Human: what is it?\nand why\nAssistant: it is this\nbecause of that\n\nUser: thanks\nBot: welcome"
    rows = [(1, 0, pasted), (2, 0, "hello there"), (2, 1, "Answer: a text that quotes\nno one: at all"), (3, 0, "Note: plain text\nwith lines\nof its own")]
    got = sorted(map(tuple, C.decode(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).collect()))
    want = [("user", "what is it?\nand why"), ("assistant", "it is this\nbecause of that"), ("user", "thanks"), ("assistant", "welcome")]
    assert [(p, r, t) for c, _, p, r, t in got if c == 1] == [(k, r, f"<|{r}|>\n{t}\n<|end|>") for k, (r, t) in enumerate(want)]
    assert [g[2:] for g in got if g[:2] == (2, 1)] == [(0, "assistant", "<|assistant|>\na text that quotes\nno one: at all\n<|end|>")]
    assert [g[4] for g in got if g[0] == 3] == ["<|%s|>\nNote: plain text\nwith lines\nof its own\n<|end|>" % g[3] for g in got if g[0] == 3]


def test_a_marker_against_the_role_stays(spark):
    """Where labels teach that a role writes another's marker, its text is kept."""
    rows = [(c, t, "Answer: " + "why is it so?" if t % 2 == 0 else "so it is " * 30, ("user", "assistant")[t % 2]) for c in range(200) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    got = {r.turn: r for r in C.decode(df.where("conv_id = 3"), C.train(df)).collect()}
    assert [got[t].recovered for t in range(4)] == ["user", "assistant"] * 2
    assert got[0].rendered == "<|user|>\nAnswer: why is it so?\n<|end|>"


def test_odd_tables(spark, model):
    schema = "conv_id long, turn long, role string, text string, piece string, h int, c int, states int"
    assert C.decode(spark.createDataFrame([], schema), model).count() == 0
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "odd", ""), (None, 5, "user", "a " * 9000), (None, None, None, "x\n" * 300), (-(1 << 63), 5, None, "y")]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema)
    got = C.decode(df, model).collect()
    assert len(got) == 6 and sorted((r.conv_id is None) for r in got) == [False] * 4 + [True] * 2
    assert C.decode(df, C.train(df.where("false"))).count() == 6
