from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from qualitylens.llm import packing

TEXTS = [
    None, "", "   \n", "Hello, World! It's 3 o'clock.", "a" * 5000, "<|endoftext|> x<|endoftext|>y", "É é Σας ΣΑΣ ́x y\x85z",
    "word " * 3000, "One two. " * 900, "no stops " * 1500, "x", "The end!",
]


def test_words_are_encoded_as_in_whole_texts():
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()[:400]
    texts += [t or "" for t in TEXTS] + ["don't I'LL they're 's x's ÀÉÎÕÜ straße STRASSE ÷× ÿŸ ½ª º µ ß", "e\u0301a a\u0308,b. \u212a\u2126 ﬁx İstanbul ſ", "a.b,c!!d 12abc34 x_y ... *** .a"]
    t = Tokenizer.from_file(packing.default_tokenizer())
    ids, sizes, _ = packing.WordIds.of(packing.default_tokenizer()).texts(pa.array(texts))
    at = 0
    for x, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == t.encode(x, add_special_tokens=False).ids, x
        at += n


def check(rows, docs, seq_len):
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted(tuple(t.encode(x or "", add_special_tokens=False).ids) + (1,) for _, x in docs)
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
    pad = total = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= seq_len
        pad += packing.padding(at, seq_len)
        total += at
    got, open_ = [], defaultdict(list)
    for r in rows:
        open_[r.doc_id, r.doc_tokens].append(r)
    for (_, n), pieces in open_.items():
        pieces.sort(key=lambda r: (r.start))
        copies = sum(p.length for p in pieces) // n
        assert copies * n == sum(p.length for p in pieces)
        if copies == 1:
            at = 0
            for p in pieces:
                assert p.start == at
                at += p.length
            got.append(tuple(i for p in pieces for i in memoryview(bytes(p.ids)).cast("I")))
    return sorted(got), want, pad, total


@pytest.mark.parametrize("seq_len", [256, 2048])
def test_round_trip(spark, seq_len):
    docs = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, ids string, start int")
    rows = packing.pack(df.repartition(2), seq_len=seq_len).collect()
    got, want, pad, total = check(rows, docs, seq_len)
    assert got == want
    assert pad <= 0.1 * total
    crc = packing.with_crc(packing.pack(df.coalesce(1), seq_len=seq_len)).collect()
    plain = packing.pack(df.coalesce(1), seq_len=seq_len).collect()
    assert [r.ids_crc32 for r in crc] == [packing.crc_of(memoryview(bytes(r.ids)).cast("I")) for r in plain]


def test_empty_and_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (None, None)], "doc_id long, text string").coalesce(1)).collect()
    assert sum(r.length for r in rows) == 3 * 3 + 1


def brute(pos, penalty, seq_len):
    cost = [0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= seq_len:
                free = n & (n - 1) == 0 and n >= 32
                cost[j] = min(cost[j], cost[i] + (0 if free else seq_len - n) + penalty[j])
    return cost[-1]


def test_windows_are_cheapest():
    import random

    for seed in range(30):
        r = random.Random(seed)
        pos = sorted({0, 3000, *(r.randrange(1, 3000) for _ in range(90))} | set(range(0, 3000, 100)))
        penalty = [r.choice([0, 8, 64]) for _ in pos]
        ends = packing.cut_windows(pos, penalty, 256)
        by = dict(zip(pos, penalty))
        cost, a = 0, 0
        for e in ends:
            n = e - a
            cost += (0 if n & (n - 1) == 0 and n >= 32 else 256 - n) + by[e]
            a = e
        assert cost == brute(pos, penalty, 256)


def test_no_crumbs_at_the_end_of_a_stream(spark):
    # one document whose ids are no sum of few powers: only windows of LEAST ids or more are unpadded
    for n in (700, 2500, 5003):
        docs = spark.createDataFrame([(1, "word " * n)], "doc_id long, text string").coalesce(1)
        rows = packing.pack(docs, seq_len=256).collect()
        got, want, pad, total = check(rows, [(1, "word " * n)], 256)
        assert got == want and total == n + 1
        lengths = [sum(r.length for r in rows if r.sequence_id == s) for s in sorted({r.sequence_id for r in rows})]
        assert all(k >= packing.LEAST for k in lengths[:-1]) and pad <= 256


def test_other_tokenizers_are_refused():
    import pytest

    from qualitylens.llm.packing import WordIds, default_tokenizer

    path = default_tokenizer()
    assert WordIds.of(path) is WordIds.of(path)
    with pytest.raises(ValueError):
        WordIds.of(path.replace("word_bpe_49k", "byte_bpe_50k"))
