import random
import re

import xxhash

from qualitylens.llm import simhash
from qualitylens.operators.graph import components


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if root[a] != root[b] and linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_fingerprints_and_groups(spark):
    r = random.Random(1)
    texts = [None, "", " \t", "one", "one two", "One TWO three", "a b c d", "É é x", "x" * 9000]
    base = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(300)) for _ in range(4)]
    for b in base:
        for _ in range(5):
            w = b.split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    docs = [(i, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp int")
    rows = {x.doc_id: x for x in simhash.near_duplicates(df).collect()}
    fps = {i: brute_fp(t) for i, t, _ in docs}
    assert {i: x.fp % 2**64 for i, x in rows.items()} == fps
    want = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: x.component_id for i, x in rows.items()} == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))


def test_links_are_those_of_brute_force(spark):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(20)}
    hot = r.getrandbits(32)
    fps |= {hot << 32 | r.getrandbits(8) for _ in range(60)} | {r.getrandbits(6) << 32 | hot for _ in range(60)}
    for x in list(fps)[:15]:
        for _ in range(4):
            x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius, most in ((1, 64), (2, 64), (2, 3)):
        found = {x.node: x.root for x in components(simhash.links(df, radius, most)).collect()}
        want = brute_components(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= radius)
        assert {x: found.get(x, x) for x in signed} == want


def test_components_of_chains_and_nothing(spark):
    r = random.Random(3)
    names = r.sample(range(1000), 200)
    chain = list(zip(names, names[1:])) + [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {x.node: x.root for x in components(df).collect()}
    assert {got[n] for n in names} == {min(names)} and got[5001] == 5000
    assert components(df.where("false")).count() == 0


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.component_id or -1) for x in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert simhash.keep_one(df).count() == 2


def test_similar_sets_against_brute_force(spark):
    """With a similarity, groups are the closure of both kinds of links."""
    import random

    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(60, 200))) for _ in range(60)]
    for k in range(60):
        words = texts[k].split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[0]] * 5 + ["few words", "few words", "", "", None]
    rows = list(enumerate(texts)) + [(None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.fp, x.component_id) for x in simhash.near_duplicates(docs, similarity=0.8).collect()}

    def grams(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = {i: grams(t) for i, t in rows if i is not None}
    group = {i: i for i in sets}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or ((got[a][0] ^ got[b][0]) & (2**64 - 1)).bit_count() <= 2)
    ]
    for _ in range(10):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert len({group[i] for i in sets}) < len(set(texts))
    assert {i: got[i][1] for i in sets} == group
    assert got[None][1] == group[1]


def test_similar_sets_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty, similarity=0.8).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f", 1), (1, "g h i j k l", 2), (2, "a b c d e f", 3), (None, None, 4)], "doc_id long, text string, key int")
    assert simhash.near_duplicates(odd, similarity=0.8).count() == 4
    assert simhash.keep_one(odd, similarity=0.8).columns == ["doc_id", "text", "key"]


def test_similar_sets_that_share_a_frequent_passage(spark):
    """Near copies meet though most of each text stands in all the others."""
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**9)}"
    passage = [word() for _ in range(400)]
    texts = []
    for k in range(80):
        own = [word() for _ in range(100)]
        texts.append(passage + own)
        texts.append(passage + own[: 50 + k % 3] + [word() for _ in range(50 - k % 3)])
        if k % 4 == 0:  # too long to be alike, though it holds all
            texts.append(passage + own + [word() for _ in range(140)])
        if k % 4 == 1:  # a change in the middle of the passage
            texts.append(passage[:200] + [word() for _ in range(15)] + passage[200:] + own)
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(i, " ".join(texts[k])) for i, k in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.fp, x.component_id) for x in simhash.near_duplicates(docs, similarity=0.8).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    alike = lambda a, b: ((got[a][0] ^ got[b][0]) & (2**64 - 1)).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = {(a, b) for a in sets for b in sets if a < b and alike(a, b)}
    root = brute_components(list(sets), lambda a, b: (min(a, b), max(a, b)) in near)
    assert 80 <= len(set(root.values())) < len(sets) - 80
    assert {i: c for i, (_, c) in got.items()} == root


def test_one_row_of_each_group_whatever_the_ids(spark):
    """Unlike texts without an id, or with one id, are each kept."""
    rows = [(None, "c c c one", "p"), (None, "d d d two words", "q"), (None, "c c c one", "r"), (3, "a text", "s"), (5, "a text", "t"), (5, "b other", "u"), (5, "b other", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    for kw in ({}, {"similarity": 0.8}):
        kept = simhash.keep_one(df, **kw)
        assert kept.columns == df.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        assert got == sorted([(None, "c c c one"), (None, "d d d two words"), (3, "a text"), (5, "b other")], key=str)
    wide = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4)], "doc_id long, text string, fp int, h int, row int, root int")
    assert simhash.keep_one(wide).collect()[0].row == 3
