import hashlib
import math
import random
import re
from zlib import crc32

from qualitylens.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text, n):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(ws[i : i + k]) for i in range(len(ws)) for k in range(1, n + 1) if i + k <= len(ws)], len(ws)


def slow(docs, target, n=1, size=10_000, percent=10, least=20, seed=2024):
    h = lambda s: crc32(s.encode()) % size
    s, t = [0] * size, [0] * size
    for _, x in docs:
        for f in slow_features(x, n)[0]:
            s[h(f)] += 1
    for x in target:
        for f in slow_features(x, n)[0]:
            t[h(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + size) / ((a + 1) * (sum(t) + size)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for k, x in docs:
        f, words = slow_features(x, n)
        weight = sum(gain[h(y)] for y in f) // len(f) if f else 0
        u = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[1:]))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r.append(place)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in rows), key=str)


def texts(n, seed=3):
    r = random.Random(seed)
    sep = [" ", "  ", "\n", ", ", "-", "é", "  ", "!", "\x7f"]
    word = lambda: "".join(r.choice("abcXYZ09é中😀") for _ in range(r.randint(1, 3)))
    return ["".join(word() + r.choice(sep) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_against_brute_force(spark):
    docs = list(enumerate(texts(400))) + [(7, "again and again " * 30), (7, "again and again " * 30), (None, "no id " * 40), (None, None), (900, None), (901, ""), (902, "w " * 300_000)]
    target = texts(30, 9) + [None, ""]
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, rank string, n_words int")
    b = spark.createDataFrame([(t, t) for t in target], "text string, doc_id string")
    for n, size in ((1, 10_000), (3, 97)):
        got = I.resample(d, b, n, size).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, got.collect()), key=str) == slow(docs, target, n, size)


def test_a_scan_in_stretches_is_the_same(monkeypatch):
    text = " ".join(texts(40, 5)).encode()
    whole = I.scan(text, 3)
    monkeypatch.setattr(I, "STRETCH", 16)
    assert I.scan(text, 3) == whole
    assert I.scan(None) == ([], 0) and I.scan(b"a" * 100)[1] == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(k, "one two three " * 8) for k in range(30)], "doc_id long, text string")
    assert I.resample(none, some).count() == 0
    got = I.resample(some, none).collect()
    assert len(got) == 30 and sorted(r.rank for r in got if r.rank) == [1, 2, 3]
