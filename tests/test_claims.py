"""Claims, freshness and lenses on small cases."""

import re

import pytest
from pyspark.sql import functions as F

from qualitylens.functions import claims as CL
from qualitylens.operators import lenses as L
from qualitylens.operators.freshness import staleness

TEXTS = {
    1: "The key idea is late binding. It works because we define it once.\nThen more.\n\n| because | a table |\n\n- [ ] therefore\n\n  Why not that?  Batch work!",
    2: "",
    3: None,
    4: "no capital. after this? one sentence",
    5: "\nA.\tB!\n \n\nC",
    6: "|x\n\n\n- [x] y",
}


def by_hand(text):
    out = []
    for p in re.split(r"\n\s*\n", re.sub(r"(?<!\n)\n(?!\n)", " ", text)):
        p = p.strip()
        if p and not p.startswith(("|", "- [")):
            out += re.split(r"(?<=[.!?])\s+(?=[A-Z])", p)
    return out


def test_sentences(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id int, text string")
    got = {r.id: r.s for r in df.select("id", CL.sentences(F.col("text")).alias("s")).collect()}
    assert got == {k: None if t is None else by_hand(t) for k, t in TEXTS.items()}
    assert len(got[1]) == 5


def test_claim_scores(spark):
    want = {
        "We define the core axiom because it enables reuse": dict(core_theory=6, problem_solving=3, alignment=3, architecture=3, anti_patterns=3, abstractions=5),
        "This provides a channel": dict(core_theory=1, problem_solving=1, alignment=1, architecture=1, anti_patterns=-2, abstractions=1),
        "It will break": dict(core_theory=0, problem_solving=0, alignment=2, architecture=0, anti_patterns=2, abstractions=0),
        "**Lesson learnt**: guided search is better than a scan": dict(core_theory=0, problem_solving=5, alignment=0, architecture=0, anti_patterns=0, abstractions=1),
        "**rationale** why that and not this": dict(core_theory=0, problem_solving=0, alignment=0, architecture=2, anti_patterns=0, abstractions=1),
        "": dict.fromkeys(CL.FACETS, 0),
        None: dict.fromkeys(CL.FACETS, 0),
    }
    df = spark.createDataFrame([(s,) for s in want], "s string")
    got = {r.s: {c.facet: c.score for c in r.c} for r in df.select("s", CL.claim_scores(F.col("s")).alias("c")).collect()}
    assert got == want


def test_staleness(spark):
    kind = "page string, sections map<string,string>, manifest string, version int, stale string"
    now = [("same", {"a": "1", "b": None}, None, 1), ("other", {"a": "1", "b": "2", "d": None}, "m", 2), ("none", {"a": "1"}, "m", 1), ("empty", None, "m", None), (None, {}, "m", 1)]
    old = [("same", {"b": None, "a": "1"}, None, 1), ("other", {"a": "0", "c": "3", "d": "x"}, "n", 1), ("empty", None, "m", None), ("gone", {}, "m", 1), (None, {}, "m", 1)]
    rows = lambda v: spark.createDataFrame([(*r, "x") for r in v], kind)
    got = {r.page: (r.stale, r.unknown, r.version_changed, r.manifest_changed, r.new, r.removed, r.changed) for r in staleness(rows(now), rows(old), "page").collect()}
    assert got == {
        "same": (False, False, False, False, [], [], []),
        "other": (True, False, True, True, ["b"], ["c"], ["a", "d"]),
        "none": (True, True, False, False, [], [], []),
        "empty": (False, False, False, False, [], [], []),
        None: (True, True, False, False, [], [], []),
    }
    assert not staleness(rows([]), rows(old), "page").count()


@pytest.mark.parametrize(
    ("lens", "want"),
    [
        (lambda: L.mutation(F.lit(0.29)), None),
        (lambda: L.mutation(F.lit(1.5)), ("mutation", 1.0, "support")),
        (lambda: L.specification(F.lit(0.2), F.lit("B")), ("specification", 0.8, "support")),
        (lambda: L.specification(F.lit(0.2), F.lit("A")), None),
        (lambda: L.specification(F.lit(0.7), F.lit("B")), ("specification", 0.7, "oppose")),
        (lambda: L.composition_gap(F.lit(0.0)), None),
        (lambda: L.composition_gap(F.lit(2.5)), ("composition_gap", 0.5, "support")),
        (lambda: L.cohesion(F.lit(0.95), F.lit(2)), ("cohesion", 0.1, "support")),
        (lambda: L.cohesion(F.lit(0.5), F.lit(1)), None),
        (lambda: L.fan_in(F.lit(5)), ("fan_in", 0.5, "oppose")),
        (lambda: L.fan_in(F.lit(1)), None),
        (lambda: L.fan_in(F.lit(1), few=1), ("fan_in", 0.4, "support")),
        (lambda: L.cochange(F.lit(0.4)), ("cochange", 0.4, "oppose")),
        (lambda: L.cochange(F.lit(0.25)), ("cochange", 0.75, "support")),
        (lambda: L.assertion_quality(F.lit(0.9), F.lit(0)), None),
        (lambda: L.assertion_quality(F.lit(0.95), F.lit(1)), ("assertion_quality", 0.1, "support")),
        (lambda: L.algebraic(F.lit("safe"), F.lit(0)), None),
        (lambda: L.algebraic(F.lit("unsafe"), F.lit(3)), ("algebraic", 0.5, "oppose")),
        (lambda: L.import_tracing(F.lit(True), F.lit(0), F.lit(0)), ("import_tracing", 0.6, "oppose")),
        (lambda: L.import_tracing(F.lit(False), F.lit(2), F.lit(3)), ("import_tracing", 0.4, "support")),
        (lambda: L.import_tracing(F.lit(False), F.lit(3), F.lit(0)), None),
        (lambda: L.call_graph(F.lit(12)), ("call_graph", 0.75, "support")),
        (lambda: L.contract_coverage(F.lit(True), F.lit(None).cast("boolean")), ("contract_coverage", 0.5, "support")),
        (lambda: L.cross_channel(F.lit(None).cast("boolean")), None),
        (lambda: L.purity(F.lit(True)), ("purity", 0.8, "support")),
        (lambda: L.dep_clustering(F.lit(True), F.lit(0.7)), ("dep_clustering", 0.7, "support")),
    ],
)
def test_a_lens(spark, lens, want):
    got = L.evidence(spark.range(1), F.lit("t"), [lens()]).collect()
    assert [(r.lens, round(r.confidence, 12), r.signal) for r in got] == ([want] if want else [])


def test_fusion(spark):
    e = [("a", "purity", 0.8, "support"), ("a", "mutation", 0.5, "support"), ("a", "fan_in", 0.5, "oppose"), ("b", "fan_in", 0.9, "oppose"), (None, "cohesion", 0.7, "support")]
    e += [("c", "purity", 0.5, "support")] * 3
    df = spark.createDataFrame(e, "target string, lens string, confidence double, signal string")
    got = {r.target: (round(r.support, 9), round(r.oppose, 9), round(r.net, 9), r.lenses) for r in L.fuse(df).collect()}
    assert got == {"a": (0.9, 0.5, 0.4, 2), "b": (0.0, 0.9, 0.0, 0), None: (0.7, 0.0, 0.7, 1), "c": (0.875, 0.0, 0.875, 1)}
    got = {r.target: round(r.net, 9) for r in L.fuse(df, L.FILE_WEIGHTS).collect()}
    assert got == {"a": 0.15, "b": 0.0, None: 1.0, "c": 0.875}
    assert not L.fuse(df.limit(0)).count()


def test_file_verdicts(spark):
    rows = [(0.5, 2, 0.2, 3), (0.5, 1, 0.2, 3), (0.75, 3, 0.9, 1), (0.75, 2, None, None), (0.8, 3, None, None)]
    df = spark.createDataFrame(rows, "net double, lenses int, score double, parts int")
    got = [r.v for r in df.select(L.file_verdict(*[F.col(c) for c in df.columns]).alias("v")).collect()]
    assert got == ["SPLIT", "INVESTIGATE", "SPLIT", "INVESTIGATE", "SPLIT"]


def test_sentences_that_pass_no_gate_score_nothing(spark):
    """Every rule matches one of these; the gates must let each of them through."""
    some = "Thus|SINCE x|rather than|not by|key|Emerges|we define|is defined as|the definition|axiom|we hypothesize|a hypothesis|research question|xthis work tests|This project explores|easier x than|transform it into|Classified|deduplicates|workflow|finally|**Lesson|the fix was|xthe Workaround was"
    some += "|it will break|bypass|right way|point is|non goal|nongoal|non-goal|not a goal|out of scope|secondary objective|why x instead|trade-off|tradeoff|**Rationale**|decomposed|drop-in|dropin|separation of concerns|O(n|vectorize|vectoris|can  fail|black box|blackbox|hard-coded|hardcode|adhoc|ad-hoc|ad hoc"
    some += "|trying harder|scope creep|we call|we term|is called|known as|refers to|x**a b c**|tier|it returns|plain words|thennot|"
    df = spark.createDataFrame([(s,) for s in some.split("|")] + [(f"é {s.upper()}, é",) for s in some.split("|")] + [(None,)], "s string")
    plain = F.array(*[F.coalesce(F.col("s").rlike(p), F.lit(False)).cast("int") * w for _, w, p in CL.RULES])
    rows = df.select("s", plain.alias("h"), CL.claim_scores(F.col("s")).alias("c"), CL.may_claim(F.col("s")).alias("may")).collect()
    for r in rows:
        want = {f: sum(h for h, (of, _, _) in zip(r.h, CL.RULES) if of in (None, f)) for f in CL.FACETS}
        assert {c.facet: c.score for c in r.c} == want, r.s
        assert r.may or max(want.values()) < 1, r.s
    assert all(any(r.h[k] for r in rows) for k in range(len(CL.RULES)))
    assert [r.may for r in rows if r.s in ("plain words", "it returns", "tier", None)] == [False, False, False, None]
    assert len(CL.NEEDS) == len(CL.RULES)
