"""Importance resampling towards a target distribution, on hashed word n-grams.

Features are runs of one to ``n`` words, joined by one space; a feature's
bucket is the CRC-32 of its bytes modulo the number of buckets. One scan of a
text keeps a ring of running checksums, one for each of the last n starts: a
further word extends each by a space and itself, and every state is a bucket.
A text is kept as the counts of its buckets, which are at most as many as there
are buckets, however long it is.

A bucket's gain is the log ratio of its smoothed shares in the target and in
the corpus; a text's weight is the mean gain of its features. Gumbel noise from
a hash of the id makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qualitylens.llm.common import arrow_batches
from qualitylens.operators.relational import running
from qualitylens.session import Scratch

BUCKETS = 10_000
#: Words of a feature at most.
GRAMS = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Bytes of a text that are looked at together.
STRETCH = 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def words(text: bytes) -> Iterator[bytes]:
    """Words of a lower-case text in order, found stretch by stretch: a stretch
    ends at a character between words."""
    a = 0
    while a < len(text):
        gap = _GAP.search(text, a + STRETCH) if a + STRETCH < len(text) else None
        b = gap.start() if gap else len(text)
        yield from _WORD.findall(text, a, b)
        a = b


def scan(text: bytes | None, n: int = GRAMS, size: int = BUCKETS) -> tuple[list[int], int]:
    """The buckets of a text's features as they end, and its number of words."""
    out: list[int] = []
    ring: deque[int] = deque(maxlen=n)
    total = 0
    for w in words((text or b"").lower()):  # of bytes, so only A-Z
        total += 1
        if n > 1:
            step = b" " + w
            ring = deque((crc32(step, c) for c in ring), maxlen=n)
        # the state with n words falls off as the new start enters
        ring.append(crc32(w))
        out.extend([c % size for c in ring])
    return out, total


def bucket_counts(df: DataFrame, key: str, n: int = GRAMS, size: int = BUCKETS) -> DataFrame:
    """``key``, n_words, n_features and the buckets of every row's ``text`` with
    their counts. A null text is empty; rows that repeat stay."""
    arrow_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            found, n_words, n_features, owner = [], [], [], []
            for k, t in enumerate(b.column(1)):
                own, w = scan(t.as_py(), n, size)
                bins, counts = np.unique(np.array(own, np.int64), return_counts=True)
                found.append((bins.astype(np.int32), counts))
                n_words.append(w)
                n_features.append(len(own))
                owner.append(len(bins))
            ends = pa.array(np.concatenate([[0], np.cumsum(owner)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in found] or [np.zeros(0)]).astype(t))) for i, t in ((0, np.int32), (1, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists], [key, "n_words", "n_features", "bins", "counts"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"{key} {kind}, n_words long, n_features long, bins array<int>, counts array<long>")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("bins").flatten().to_numpy(zero_copy_only=False), b.column("counts").flatten().to_numpy(zero_copy_only=False)


def totals(counted: DataFrame, size: int = BUCKETS) -> DataFrame:
    """bucket, n: all features of a bucket; a task adds up its own rows first."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            bins, counts = _flat(b)
            np.add.at(total, bins, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return counted.select("bins", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket from both tables of ``totals``: ``size`` numbers,
    the only thing that comes to the driver."""
    spark = corpus.sparkSession
    j = spark.range(size).select(F.col("id").cast("int").alias("bucket"))
    j = j.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = j.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c, k: (F.col(c) + k).cast("double")
    ratio = d("t", 1) * d("all_s", size) / (d("s", 1) * d("all_t", size))
    rows = j.crossJoin(F.broadcast(both)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.bucket] = r.gain
    return out


def weights(counted: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_features, weight: the floored mean gain; 0 of none."""
    shared = counted.sparkSession.sparkContext.broadcast(gain)  # a fixed number of buckets

    def run(batches):
        for b in batches:
            bins, counts = _flat(b)
            upto = np.concatenate([[0], np.cumsum(shared.value[bins] * counts)])
            ends = np.concatenate([[0], np.cumsum(b.column("bins").value_lengths().to_numpy(zero_copy_only=False))])
            n = b.column("n_features").to_numpy(zero_copy_only=False)
            total = upto[ends[1:]] - upto[ends[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("n_words"), b.column("n_features"), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], [key, "n_words", "n_features", "weight"])

    kind = counted.schema[key].dataType.simpleString()
    return counted.mapInArrow(run, f"{key} {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the key; a null key is empty."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def highest(rows: DataFrame, score: str, key: str, percent: int, name: str = "rank", among: str = "true") -> DataFrame:
    """``rows`` with ``name``: the place (1, 2, 3...) of those among the highest
    floor(percent * N / 100) of the N rows that satisfy ``among``, else null; ties to the
    smaller ``key``, then by the other columns.

    Scores are whole numbers. Their counts, summed from the highest down over
    two levels, give every score's first place; only rows of the scores that
    are drawn are ordered, each score by itself."""
    scratch = Scratch(rows.sparkSession)
    saved = scratch.save(rows.withColumn("__in", F.coalesce(F.expr(among), F.lit(False))))
    less = (-F.col(score)).alias("less")
    levels = saved.where("__in").groupBy(less).agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("less") / 256))
    levels = running(levels, ["part"], ["less"], before=F.col("n")).select((-F.col("less")).alias(score), "before")
    wanted = saved.agg(F.count_if("__in").alias("n")).select(F.expr(f"n * {int(percent)} div 100").alias("wanted"))
    levels = scratch.save(levels.crossJoin(F.broadcast(wanted)).where("before < wanted"))
    near = saved.where("__in").join(levels, score)
    order = W.partitionBy(score).orderBy(F.col(key).asc_nulls_first(), *[c for c in rows.columns if c not in (key, score)])
    near = near.withColumn("place", F.col("before") + F.row_number().over(order))
    place = F.when(F.col("place") <= F.col("wanted"), F.col("place"))
    rest = saved.where("__in").join(levels, score, "left_anti").unionByName(saved.where("not __in"))
    return near.select(*rows.columns, place.alias(name)).union(rest.select(*rows.columns, F.lit(None).cast("long").alias(name)))


def resample(docs: DataFrame, target: DataFrame, n: int = GRAMS, size: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``min_words`` words, by
    their likeness to the texts of ``target``.

    ``docs`` (doc_id, text) and ``target`` (text); other columns are ignored.
    Returns doc_id, n_words, n_features, weight, score, rank of every row; rank
    is null where a row is not drawn. Null and empty texts have no features and
    weight 0; whole texts count; rows that repeat an id are drawn each by
    itself; a null id is a key like any other and comes first among ties; an
    empty table gives no rows, an empty target makes rare words weigh more.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.save(bucket_counts(docs, "doc_id", n, size))
    wanted = bucket_counts(target.select("text", F.lit(0).alias("one")), "one", n, size)
    scored = weights(counted, gains(totals(counted, size), totals(wanted, size), size))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return highest(scored, "score", "doc_id", percent, "rank", f"n_words >= {int(min_words)}")


#: The CRC-32 of a text's UTF-8 bytes, from the polynomial 0xEDB88320.
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(hex(encode({w}))), 2), lambda i: ('0x' || substr(hex(encode({w})), i, 2))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"

ORACLE = f"""with c as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from documents),
q as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from benchmark),
v as (select w, {CRC.format(w="w")} % {BUCKETS} as b from (select w from c union select w from q)),
s as (select b, count(*) as s from c join v using (w) group by b), t as (select b, count(*) as t from q join v using (w) group by b), z as (select (select sum(s) from s) as zs, (select sum(t) from t) as zt),
g as (select b, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (zs + {BUCKETS})::double / ((coalesce(s, 0) + 1)::double * (zt + {BUCKETS})::double))) as bigint) as gain from (select distinct b from v) left join s using (b) left join t using (b), z),
f as (select doc_id, count(*) as n_features, cast(floor(sum(gain)::double / count(*)) as bigint) as weight from c join v using (w) join g using (b) group by doc_id),
d as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint as h from documents left join f using (doc_id)),
e as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score from d),
r as (select doc_id, row_number() over (order by score desc, doc_id) as place from e where n_features >= {MIN_WORDS})
select e.doc_id, n_features, weight, score, case when place <= (select count(*) from r) * {PERCENT} // 100 then place end as rank from e left join r using (doc_id)"""
