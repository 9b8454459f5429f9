"""Mixing sources to target weights by capped water-filling.

Sources share the corpus's words by weight. A source whose share exceeds
``max_epochs`` times its own size is clamped there and the excess goes to the
others by weight, until none is above: the level at which that settles is
found in one pass over the sources in order of cap per weight. Each document
of a source is then taken a whole number of times, plus once more for the
documents that come first in a seeded order, until the source's target is
met; the document at the edge is taken in part.

The seeded order is by a hash of the document's id, so reruns agree. Its
running totals are taken over two levels of hash prefixes and then within a
prefix, so no task ever orders a whole source, however hot it is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.llm.common import word_count
from qualitylens.session import Scratch

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source its size, exact target and target in whole words.

    ``sizes``: source, size. One row per source enters the window, nothing
    else. Sources go by code point, null last, and ``weights`` repeat along them.
    """
    big = "decimal(38,0)"
    w = F.array(*[F.lit(int(x)) for x in weights])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(w, (F.col("rank") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    # cap per weight as an exact integer
    s = s.withColumn("ratio", F.col("cap").cast(big) * (F.lit(math.lcm(*weights)) / F.col("weight")).cast("int"))
    order = W.orderBy("ratio", "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    fits = F.col("left").cast(big) * F.col("weight") <= F.col("cap").cast(big) * F.col("weights_left")
    s = s.withColumn("first", F.min(F.when(fits, F.struct("ratio", "rank", "left", "weights_left"))).over(everything))
    s = s.withColumn("capped", F.col("first").isNull() | (F.struct("ratio", "rank", "left", "weights_left") < F.col("first")))
    share = F.col("weight").cast(big) * F.col("first.left")
    return s.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double") / F.col("first.weights_left")).alias("target"),
        F.when(F.col("capped"), F.col("cap")).otherwise(F.expr("cast(cast(weight as decimal(38,0)) * first.left as decimal(38,0)) div first.weights_left")).cast("long").alias("target_words"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Words that the mix takes of each document.

    ``docs``: doc_id, source, text; other columns are ignored. Returns doc_id,
    source, size, source_size, target, taken, copies, th: ``taken`` counts
    words with repeats, ``copies`` rounds the document at the edge of a source's
    sample to a whole one, ``th`` is the text's hash.

    Null and empty texts have size 0 and are taken 0 times. A null source is a
    source of its own, a null doc_id orders like an empty one. Rows that
    repeat an id count each; ties in the seeded order go by id, size and text.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h"), F.xxhash64("text").alias("th")))
    # a key that is never null, for joins
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = sized.select("*", key.alias("key"), F.substring("h", 1, 2).alias("b1"), F.substring("h", 3, 2).alias("b2"))
    targets = source_targets(sized.select("source", "size"), weights, max_epochs)
    targets = targets.select(key.alias("key"), "source_size", "target", "target_words")

    fine = sized.groupBy("key", "b1", "b2").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("key", "b1").agg(F.sum("n").alias("n"))
    before = lambda by, order: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.select("key", "b1", F.coalesce(F.sum("n").over(before(["key"], ["b1"])), F.lit(0)).alias("c1"))
    fine = fine.select("key", "b1", "b2", F.coalesce(F.sum("n").over(before(["key", "b1"], ["b2"])), F.lit(0)).alias("c2"))
    starts = fine.join(coarse, ["key", "b1"]).join(targets, "key")

    inner = before(["key", "b1", "b2"], ["h", "doc_id", "size", "th"])
    rows = sized.withColumn("c3", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(starts, ["key", "b1", "b2"])
    whole = F.when(F.col("source_size") > 0, F.expr("target_words div source_size")).otherwise(F.lit(0))
    rest = F.col("target_words") - F.col("whole") * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("c1") - F.col("c2") - F.col("c3")))
    rows = rows.withColumn("whole", whole).withColumn("rest", rest).withColumn("extra", extra)
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("extra") * 2 >= F.col("size")).cast("int")).otherwise(F.lit(0))
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
        "th",
    )


def repeat_rows(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the
    columns of ``docs``. Rows are matched by source, id and text. Of rows that
    repeat all three some may be taken once more than others; which of them is
    settled by their other columns, and that some rows of the mix are equal in
    those too changes nothing."""
    others = [F.col(f"`{n}`") for n in docs.columns if n not in ("doc_id", "text", "source")]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    key = lambda i, s, h: [F.coalesce(F.concat(F.lit("s"), s), F.lit("n")).alias("s"), i.isNull().alias("none"), F.coalesce(i.cast("string"), F.lit("")).alias("id"), h.alias("h")]
    plan = mix(docs, **kw).select(*key(F.col("doc_id"), F.col("source"), F.col("th")), "copies")
    by = ["s", "none", "id", "h"]
    # what rows that repeat a key take together is dealt evenly among them
    plan = plan.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("copies").alias("all"))
    # the row travels as one column, so no name of its own can clash
    rows = docs.select(*key(F.col("doc_id"), F.col("source"), F.xxhash64("text")), order.alias("order"), F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"))
    rows = rows.join(plan.where("all > 0"), by)
    one = W.partitionBy(*by).orderBy("order")
    nth = F.when(F.col("rows") > 1, F.row_number().over(one)).otherwise(1)
    rows = rows.withColumn("copies", (F.expr("all div rows") + (nth <= F.col("all") % F.col("rows")).cast("int")).cast("int"))
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: DuckDB SQL of the mixing query, over a relation d(doc_id, source, size).
MIX_SQL = """
s as (select source, sum(size) as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) as rk from s),
w as (select *, 1 + (rk - 1) % 3 as weight, 3 * source_size as cap from r),
o as (select *, row_number() over (order by cap * (6 // weight), rk) as pos from w),
p as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by pos rows between unbounded preceding and 1 preceding), 0) as lft,
        sum(weight) over () - coalesce(sum(weight) over (order by pos rows between unbounded preceding and 1 preceding), 0) as wl from o),
k as (select min(pos) as pos from p where lft * weight <= cap * wl),
l as (select p.lft, p.wl, p.pos from p join k on p.pos = k.pos),
t as (select p.source, p.source_size,
        case when l.pos is null or p.pos < l.pos then cast(p.cap as double) else cast(p.weight * l.lft as double) / cast(l.wl as double) end as target,
        case when l.pos is null or p.pos < l.pos then p.cap else (p.weight * l.lft) // l.wl end as tw
      from p left join l on true),
c as (select d.*, md5('mix-1:' || coalesce(cast(d.doc_id as varchar), '')) as h from d),
q as (select c.doc_id, c.size, cast(t.source_size as bigint) as source_size, t.target,
        case when t.source_size > 0 then t.tw // t.source_size else 0 end as whole, t.tw,
        coalesce(sum(c.size) over (partition by c.source order by c.h, c.doc_id, c.size rows between unbounded preceding and 1 preceding), 0) as before
      from c join t on c.source is not distinct from t.source)
"""

MIXING_ORACLE = (
    r"with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),"
    + MIX_SQL
    + """
select doc_id, size, source_size, target,
  cast(whole * size + greatest(0, least(size, tw - whole * source_size - before)) as bigint) as taken from q
"""
)
