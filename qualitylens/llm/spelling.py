"""Groups of spelling variants: words one edit apart, and the form to write.

Words within one inserted, deleted or replaced character are found by a
positional q-gram index. Of a pair the longer word's length is its class. An
edit leaves one half of the longer word intact, so words meet in the blocks of
a class that share that half: a long q-gram at an end. A block of more than
``BLOCK`` words halves the other half again, and so on down to one character,
where a block cannot have more words than the alphabet has letters.

Within a block words are probed against posting lists of their short q-grams by
position: the shortest lists, which no neighbour can all avoid, are merged by a
heap; those that share as many grams as one edit must leave are compared. A pair
counts in the one block whose open stretch holds its edit, so it counts once.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitylens.llm.common import arrow_batches
from qualitylens.llm.importance import CRC
from qualitylens.session import Scratch

LEAST = 7
MIN_COUNT = 2
EVERY = 31
RATIO = 10
#: Characters of a gram within a block.
Q = 2
#: Words of a block that is not halved again.
BLOCK = 2048
#: Words that a task counts before it passes them on.
HELD = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)
_LOWER = {k: k + 32 for k in range(65, 91)}


def _own_words(doc_id, text: str) -> Iterator[tuple[str, int]]:
    """Words of a text and how often it has them, after the seeded deletions."""
    low: Counter = Counter()
    for w, n in Counter(_RUN.findall(text)).items():
        low[w if w.islower() else w.translate(_LOWER)] += n
    head = b"" if doc_id is None else str(doc_id).encode()
    for w, n in low.items():
        h = crc32(b":" + w.encode(), crc32(head))
        if h % EVERY == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
        if len(w) >= LEAST:
            yield w, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: all words that occur often enough. A task adds up its own
    counts first, ``HELD`` words at a time."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for d, t in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                for w, n in _own_words(d or None, t) if t else ():
                    held[w] += n
            if len(held) >= HELD:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    # as text, so that a null id does not turn the others into fractions
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").mapInPandas(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _halved(rows: DataFrame) -> DataFrame:
    """Every row's two blocks, with half of its open stretch.

    ``head`` and ``tail`` characters of the word are fixed; in a class of words
    of up to ``m`` characters the open stretch is [head, m - tail)."""
    middle = F.expr("(head + m - tail) div 2")
    ends = F.explode(F.array(F.struct(F.col("head"), (F.col("m") - middle).alias("tail")), F.struct(middle.alias("head"), F.col("tail")))).alias("at")
    rows = rows.select("word", "n", "m", ends).select("word", "n", "m", F.col("at.head").cast("int").alias("head"), F.col("at.tail").cast("int").alias("tail"))
    return rows.withColumn("block", F.concat_ws("|", "m", F.expr("left(word, head)"), F.expr("right(word, tail)")))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n, m, head, tail, block: every word in the blocks where it can meet
    a neighbour. Blocks above ``most`` are halved until there are none, but
    those with one open character. One flag a round reaches the driver."""
    scratch = Scratch(words.sparkSession)
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    out, rows = None, _halved(rows)
    while True:
        rows = scratch.save(rows)
        large = scratch.save(rows.where("m - tail - head > 1").groupBy("block").agg(F.count("*").alias("k")).where(F.col("k") > most).select("block"))
        if not large.limit(1).count():
            return rows if out is None else out.unionByName(rows)
        done = rows.join(large, "block", "left_anti")
        out = done if out is None else out.unionByName(done)
        rows = _halved(rows.join(large, "block", "left_semi"))


def _edit(x: str, y: str, i: int, j: int) -> bool:
    """Whether one edit within [i, j) of ``x`` gives ``y``, which is as long or
    one shorter, both equal outside; the edit is at the first difference."""
    p = i
    while p < len(y) and x[p] == y[p]:
        p += 1
    return p < j and x[p + 1 :] == y[p + (len(x) == len(y)) :]


def neighbours(words: list[str], counts: list[int], m: int, head: int, tail: int) -> list[tuple[str, int, int, str]]:
    """(word, its neighbours, the greatest count of one, that one) of a block's words."""
    i, j = head, m - tail
    grams = lambda w, end: range(max(0, i - Q + 1), min(len(w) - Q + 1, end))
    near: dict[str, list] = {}

    def met(a: int, b: int) -> None:
        for x, y in ((a, b), (b, a)):
            best = near.setdefault(words[x], [0, 0, ""])
            best[0] += 1
            if (-counts[y], words[y]) < (-best[1], best[2]):
                best[1:] = counts[y], words[y]

    index: dict[tuple[str, int], list[int]] = {}
    of: list[set] = []
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    for n, k in enumerate(order):
        w = words[k]
        if len(w) == m:
            own = [(w[p : p + Q], p) for p in grams(w, j)]
            least = len(own) - Q  # grams that one edit leaves at the least
            if least < 1:
                found = range(n)
            else:
                lists = sorted((index[g] for g in own if g in index), key=len)
                # a neighbour misses Q grams at most: it is in one of any Q + 1 lists
                spare = Q + 1 - (len(own) - len(lists))
                found = (c for c, _ in groupby(heapq.merge(*lists[: max(spare, 0)])))
            mine = set(own)
            for c in found:
                if (least < 1 or len(mine & of[c]) >= least) and _edit(w, words[order[c]], i, j):
                    met(k, order[c])
        else:  # a shorter word's gram is at its place in the longer one or one further
            own = [(w[p : p + Q], p + s) for p in grams(w, j - 1) for s in (0, 1)]
            mine = set(own)
        of.append(mine)
        for g in mine:
            index.setdefault(g, []).append(n)
    return [(w, *best) for w, best in near.items()]


def links(placed: DataFrame) -> DataFrame:
    """word, n_near, near_n, near: of every word with a neighbour, from its
    blocks; a task holds one block at a time."""
    arrow_batches(placed.sparkSession, 10_000)
    schema = "word string, n_near long, near_n long, near string"

    def run(batches):
        last, words, counts = None, [], []
        found: list = []

        def close():
            if len(words) > 1:
                found.extend(neighbours(words, counts, *last[1:]))

        for b in batches:
            for w, n, *key in zip(*[b[c].tolist() for c in ("word", "n", "block", "m", "head", "tail")], strict=True):
                if last is None or key[0] != last[0]:
                    close()
                    last, words, counts = key, [], []
                words.append(w)
                counts.append(n)
            if found:
                yield pd.DataFrame(found, columns=["word", "n_near", "near_n", "near"])
                found.clear()
        close()
        yield pd.DataFrame(found, columns=["word", "n_near", "near_n", "near"]).astype({"n_near": "int64", "near_n": "int64"})

    rows = placed.repartition("block").sortWithinPartitions("block").mapInPandas(run, schema)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from a word (forms: word,
    form). Counts rise tenfold from form to form, so chains are short, and each
    round doubles how far a word sees."""
    scratch = Scratch(forms.sparkSession)
    now = scratch.save(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.save(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """Words of all documents with their neighbours, form and root.

    ``docs`` (doc_id, text); other columns are ignored. Returns word, form,
    root, n, n_near, form_n. Null and empty texts have no words, whole texts
    count, a null doc_id is the empty text in the deletions' hash, rows that
    repeat count again, an empty table gives no rows; of neighbours with equal
    counts the first in code-point order is the form.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.save(vocabulary(docs))
    near = links(blocks(words, most))
    enough = F.col("near_n") >= RATIO * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"))
    rows = scratch.save(rows)
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_ACCENTED = "[A-Za-z\\x{00C0}-\\x{00FF}]"

ORACLE = f"""with recursive o as (select doc_id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r from (select doc_id, unnest(regexp_extract_all(text, '{_ACCENTED}{{{LEAST},}}')) as u from documents)),
d as (select doc_id, r, count(*) as n from o group by all), c as (select *, coalesce(doc_id::varchar, '') || ':' || r as s from d), h as (select r, n, {CRC.format(w="s")} as h from c),
x as (select case when h % {EVERY} = 0 then left(r, (h % length(r))::bigint) || substr(r, (h % length(r))::bigint + 2) else r end as word, n from h),
w as (select word, cast(sum(n) as bigint) as n from x where length(word) >= {LEAST} group by word having sum(n) >= {MIN_COUNT}),
cut as (select distinct word, n, left(word, i - 1) || substr(word, i + 1) as rest, i from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
e as (select a.word as a, b.word as b from cut a join cut b on a.rest = b.rest and a.i = b.i where a.word <> b.word union select cut.word, w.word from cut join w on cut.rest = w.word union select w.word, cut.word from cut join w on cut.rest = w.word),
m as (select a as word, count(*) as n_near, arg_min(b, struct_pack(k := -w.n, b := b)) as near, max(w.n) as near_n from e join w on w.word = b group by a),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= {RATIO} * w.n then near end as form, case when near_n >= {RATIO} * w.n then near_n end as form_n from w left join m using (word)),
p as (select word, form as ahead from f where form is not null union all select p.word, f.form from p join f on f.word = p.ahead where f.form is not null),
t as (select p.word, ahead as root from p join f on f.word = p.ahead where f.form is null)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from f left join t using (word)"""
