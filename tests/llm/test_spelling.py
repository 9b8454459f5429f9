import random
import re
from collections import Counter
from zlib import crc32

import pytest

from qualitylens.llm import spelling as S


def slow_words(docs):
    total = Counter()
    for k, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def slow(docs):
    words = slow_words(docs)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def corpus(seed, alphabet="abé", lengths=(5, 11), n=250):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(*lengths))) for _ in range(60)]
    word = lambda: r.choice(base[:6] * 8 + base) if r.random() < 0.7 else "".join(r.choice(alphabet) for _ in range(r.randint(*lengths)))
    case = lambda w: r.choice([w, w, w.upper().replace("É", "é"), w.capitalize()])
    return [(k, r.choice([" ", ", ", "1", "\n"]).join(case(word()) for _ in range(r.randint(0, 40)))) for k in range(n)]


@pytest.mark.parametrize(("alphabet", "lengths"), [("abé", (5, 11)), ("a", (6, 40)), ("aÉ×", (7, 9)), ("theinro", (7, 8))])
def test_against_brute_force(spark, alphabet, lengths):
    docs = corpus(1, alphabet, lengths) + [(None, "nulltexts nulltexts"), (None, None), (3, None), (4, ""), (5, "repeated repeated"), (5, "repeated repeated")]
    d = spark.createDataFrame([(t, k, 1) for k, t in docs], "text string, doc_id long, n int")
    want = slow(docs)
    assert any(x[4] for x in want)
    for most in (2048, 3):  # blocks whole, and halved down to one character
        got = S.variants(d, most).select("word", "form", "root", "n", "n_near", "form_n")
        assert sorted(map(tuple, got.collect())) == want


def test_chains_lead_to_the_last_form(spark):
    words = {"abcdefg": 2000, "abcdefgh": 200, "abcdefghi": 20, "abcdefghij": 2, "zzzzzzzz": 2}
    rows = [(str(k), " ".join([w] * n)) for k, (w, n) in enumerate(words.items())]
    docs = [(int(k), t) for k, t in rows if not any(crc32(f"{k}:{w}".encode()) % 31 == 0 for w in t.split()[:1])]
    assert len(docs) == len(rows)
    got = {r.word: (r.form, r.root) for r in S.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got["abcdefghij"] == ("abcdefghi", "abcdefg") and got["abcdefg"] == (None, "abcdefg") and got["zzzzzzzz"] == (None, "zzzzzzzz")


def test_long_words_and_an_empty_table(spark):
    long = "ab" * 20_000
    docs = [(0, f"{long} {long} {long[:-1]} {long[:-1]} {long}x {long}x")]
    assert slow_words(docs) == {long: 2, long[:-1]: 2, long + "x": 2}
    got = {len(r.word): r.n_near for r in S.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {40_000: 2, 39_999: 1, 40_001: 1}
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
