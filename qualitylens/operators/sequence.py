"""Operators on ordered rows: streaks, islands, trends, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.session import Scratch


#: Rows of a stretch: what a window sorts in one task.
STRETCH = 1 << 18


def _deals(df: DataFrame, rows: int) -> int:
    """As many ranges as keep each near ``rows`` rows, and every core busy."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


Row = Callable[[Column], Column]


class Dealt:
    """Rows in order of ``keys`` and then ``order``, dealt into stretches of
    bounded size, for scans that a window per key would do in one task.

    A key with very many rows is spread over stretches. Each scan works within
    the stretches; one summary a stretch, carried from stretch to stretch of its
    key, is joined back. So a task sorts a stretch or a key's summaries, never a
    whole key. The dealt rows are a written table: stretches stay as they are
    when an executor is lost.

    The caller's columns travel as one struct, so their names clash with
    nothing; a scan adds columns under the names given, from functions of that
    struct. Null keys are equal to one another. The order should tell all rows
    of a key apart, or equals come in any order.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], rows: int = STRETCH):
        some = lambda names: F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("_"))
        named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), some(keys).alias("key"), some(order).alias("at"))
        dealt = named.repartitionByRange(_deals(df, rows), "key", "at").withColumn("s", F.spark_partition_id())
        self.df = Scratch(df.sparkSession).save(dealt)
        self._in = W.partitionBy("key", "s").orderBy("at")
        self._over = W.partitionBy("key").orderBy("s")

    def _scan(self, what: dict[str, Row], end, carry, local) -> DataFrame:
        v = F.struct(*[f(F.col("row")).alias(n) for n, f in what.items()])
        ends = self.df.withColumn("v", v).groupBy("key", "s").agg(F.struct(*[end(F.col(f"v.{n}")).alias(n) for n in what]).alias("end"))
        carried = ends.select("key", "s", F.struct(*[carry(F.col(f"end.{n}")).alias(n) for n in what]).alias("carried"))
        return self.df.withColumn("v", v).withColumn("here", F.struct(*[local(F.col(f"v.{n}")).alias(n) for n in what])).join(carried, ["key", "s"])

    def _put(self, rows: DataFrame, what, value) -> Dealt:
        row = F.col("row")
        for n in what:
            row = row.withField(n, value(n))
        self.df = rows.select(row.alias("row"), "key", "at", "s")
        return self

    def previous(self, **what: Row) -> Dealt:
        """Each value as it is in the row before of the same key; null in the first."""
        boxed = {n: (lambda r, f=f: F.struct(f(r).alias("x"))) for n, f in what.items()}
        rows = self._scan(boxed, lambda v: F.max_by(v, "at"), lambda v: F.lag(v).over(self._over), lambda v: F.lag(v).over(self._in))
        return self._put(rows, what, lambda n: F.coalesce(f"here.{n}", f"carried.{n}")["x"])

    def total(self, **what: Row) -> Dealt:
        """Sums over the rows of the key up to each, itself included; nulls count 0."""
        before = self._over.rowsBetween(W.unboundedPreceding, -1)
        upto = self._in.rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = self._scan(what, F.sum, lambda v: F.sum(v).over(before), lambda v: F.sum(v).over(upto))
        return self._put(rows, what, lambda n: F.coalesce(F.col(f"here.{n}"), F.lit(0)) + F.coalesce(F.col(f"carried.{n}"), F.lit(0)))

    def latest(self, **what: Row) -> Dealt:
        """The last value that is not null among the rows up to each, itself included."""
        before = self._over.rowsBetween(W.unboundedPreceding, -1)
        upto = self._in.rowsBetween(W.unboundedPreceding, W.currentRow)
        last = lambda v, w: F.last(v, ignorenulls=True).over(w)
        rows = self._scan(what, lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("at"))), lambda v: last(v, before), lambda v: last(v, upto))
        return self._put(rows, what, lambda n: F.coalesce(f"here.{n}", f"carried.{n}"))

    def soonest(self, **what: Row) -> Dealt:
        """The first value that is not null among the rows from each on, itself included."""
        after = self._over.rowsBetween(1, W.unboundedFollowing)
        on = self._in.rowsBetween(W.currentRow, W.unboundedFollowing)
        first = lambda v, w: F.first(v, ignorenulls=True).over(w)
        rows = self._scan(what, lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("at"))), lambda v: first(v, after), lambda v: first(v, on))
        return self._put(rows, what, lambda n: F.coalesce(f"here.{n}", f"carried.{n}"))

    def rows(self) -> DataFrame:
        """The caller's columns and those that the scans added."""
        return self.df.select("row.*")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, *, name: str = "match", forward: bool = False, strict: bool = False, tolerance: float | None = None, tie: str | None = None) -> DataFrame:
    """``left`` with ``name``: the nearest row of ``right``, as a struct, with the
    same ``keys`` and a time at or before the left row's (``forward``: at or
    after; ``strict``: not at the same time), no further than ``tolerance``.

    Times are numbers. Of right rows at one time the last by ``tie`` counts
    (``forward``: the first). One pass in order over both tables together, dealt
    into stretches that carry the last known right row in from those before.
    Null keys and null times match nothing; no left row is lost or repeated."""
    side = int(forward == strict)
    pack = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    key = F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k")
    known = F.lit(True)
    for c in (*keys, right_at):
        known &= F.col(f"`{c}`").isNotNull()
    ties = F.col(f"`{tie}`") if tie else F.lit(0)
    r = right.where(known).select(key, F.col(f"`{right_at}`").alias("t"), F.lit(1 - side).alias("side"), ties.alias("tie"), F.lit(None).cast(left.schema).alias("l"), pack(right).alias("r"))
    no_tie = F.lit(None).cast(r.schema["tie"].dataType)
    rows = left.select(key, F.col(f"`{left_at}`").alias("t"), F.lit(side).alias("side"), no_tie.alias("tie"), pack(left).alias("l"), F.lit(None).cast(right.schema).alias("r")).union(r)
    dealt = Dealt(rows, ["k"], ["t", "side", "tie"])
    found = (dealt.soonest if forward else dealt.latest)(m=lambda x: x["r"]).rows().where("l is not null")
    gap = F.abs(F.col("t") - F.col("m")[right_at])
    near = F.col("t").isNotNull() if tolerance is None else gap <= tolerance
    return found.select("l.*", F.when(near, F.col("m")).alias(name))


def trailing_streak(df: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """Per key the length of the last run of rows that satisfy ``hit``: the
    rows after the last that does not, by aggregates alone."""
    rows = df.select(F.struct(F.col(f"`{key}`").alias("k"), F.struct(*order).alias("at"), F.coalesce(hit, F.lit(False)).alias("hit")).alias("r"))
    last = rows.where("not r.hit").groupBy(F.struct("r.k").alias("g")).agg(F.max("r.at").alias("last_miss"))
    joined = rows.withColumn("g", F.struct("r.k")).join(last, "g", "left")
    streak = F.count(F.when(F.col("last_miss").isNull() | (F.col("r.at") > F.col("last_miss")), 1))
    return joined.groupBy("g").agg(streak.alias("streak")).select(F.col("g.k").alias(key), "streak")


def longest_run(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Per key and value the longest run of rows with that value: a run begins
    where the value differs from the row before, and runs are numbered by a sum."""
    dealt = Dealt(df.select(*{key, value, *order}), [key], order).previous(__was=lambda r: F.struct(r[value].alias("x")))
    begins = lambda r: F.when(r["__was"].isNull() | ~r["__was"]["x"].eqNullSafe(r[value]), 1).otherwise(0)
    runs = dealt.total(__run=begins).rows().groupBy(key, value, "__run").agg(F.count("*").alias("n"))
    return runs.groupBy(key, value).agg(F.max("n").alias("longest"))


def half_trend(df: DataFrame, key: list[str], order: str, value: str, ratio: float = 0.2) -> DataFrame:
    """Compare the means of the first and second half (the odd row is in the
    second): more than ``ratio`` below is improving, above degrading; fewer than
    4 rows give no_data."""
    w = W.partitionBy(*key).orderBy(order)
    rows = df.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(W.partitionBy(*key)))
    half = F.floor(F.col("n") / 2)
    out = rows.groupBy(*key).agg(
        F.first("n").alias("n"),
        F.avg(F.when(F.col("i") < half, F.col(value))).alias("first_half"),
        F.avg(F.when(F.col("i") >= half, F.col(value))).alias("second_half"),
    )
    a, b = F.col("first_half"), F.col("second_half")
    trend = F.when(F.col("n") < 4, "no_data").when(b < a * (1 - ratio), "improving").when(b > a * (1 + ratio), "degrading").otherwise("stable")
    return out.withColumn("trend", trend)


def pieces(df: DataFrame, key: str, order: list[str], value: Column, make, n: int | None = None) -> DataFrame:
    """key, pieces: per key its rows' values in order, folded stretch by stretch.

    Rows are dealt by ranges of key and order, so a key with very many rows is
    spread over several tasks. ``make`` turns a stretch's ordered array of
    values into its effect, a column of bounded size; ``pieces`` is a key's
    array of effects in order, at most one per range (``n``, by default enough
    for some ``STRETCH`` rows each)."""
    n = n or _deals(df, STRETCH)
    rows = df.select(key, *order, value.alias("v")).repartitionByRange(n, key, *order).withColumn("piece", F.spark_partition_id())
    values = F.transform(F.array_sort(F.collect_list(F.struct(*order, "v"))), lambda x: x["v"])
    some = rows.groupBy(key, "piece").agg(values.alias("s")).select(key, "piece", make(F.col("s")).alias("effect"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("piece", "effect"))), lambda x: x["effect"])
    return some.groupBy(key).agg(whole.alias("pieces"))


def ewma(df: DataFrame, key: str, order: list[str], value: str, new: float = 0.7) -> DataFrame:
    """Fold per key: f = new * value + (1 - new) * f, from the first value. A
    stretch's effect is f -> weight * f + sum."""

    def effect(s: Column) -> Column:
        step = lambda a, v: F.struct((a["w"] * (1 - new)).alias("w"), (new * v + (1 - new) * a["t"]).alias("t"))
        f = F.aggregate(s, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t")), step)
        return F.struct(s[0].alias("first"), f["w"].alias("w"), f["t"].alias("t"))

    rows = pieces(df.where(F.col(value).isNotNull()), key, order, F.col(value).cast("double"), effect)
    return rows.select(key, F.aggregate("pieces", F.col("pieces")[0]["first"], lambda a, x: x["w"] * a + x["t"]).alias("ewma"))


def once_within(df: DataFrame, keys: list[str], at: str, name: str, seconds: int) -> DataFrame:
    """The rows (``keys``, ``at`` in seconds, ``name``) that come first or at
    least ``seconds`` after the last one of their keys that was kept. A row
    that is left out does not prolong the time; rows at one time go by ``name``,
    which tells rows apart; rows without a time are left out.

    Each row points to the first one that could follow it if it were kept, found
    by an as-of join. The kept rows are those that a key's first row leads to:
    each round doubles the steps that a pointer makes, so a key with n kept rows
    takes log n rounds, and no task holds a key."""
    scratch = Scratch(df.sparkSession)
    key = F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_"))
    rows = scratch.save(df.select(key.alias("k"), F.col(f"`{at}`").cast("double").alias("t"), F.col(f"`{name}`").alias("i")).where("t is not null"))
    later = rows.select("k", "i", (F.col("t") + seconds).alias("due"))
    jump = scratch.save(asof_join(later, rows, ["k"], "due", "t", forward=True, tie="i").where("match is not null").select("k", "i", F.col("match.i").alias("to")))
    kept = [scratch.save(rows.groupBy("k").agg(F.min(F.struct("t", "i"))["i"].alias("i")))]
    while jump.limit(1).count():
        reached = kept[0]
        for part in kept[1:]:
            reached = reached.union(part)
        kept.append(scratch.save(reached.join(jump, ["k", "i"]).select("k", F.col("to").alias("i"))))
        jump = scratch.save(jump.join(jump.select("k", F.col("i").alias("to"), F.col("to").alias("further")), ["k", "to"]).select("k", "i", F.col("further").alias("to")))
    reached = kept[0]
    for part in kept[1:]:
        reached = reached.union(part)
    out = rows.join(reached, ["k", "i"], "left_semi")
    return out.select("k.*", F.col("t").alias(at), F.col("i").alias(name)).drop("_")


def count_in_range(df: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Per row the rows of its key within the seconds before it, itself and those
    at the same time included, as ``in_range``: the rows up to its time less
    those before the range, both running counts over one order."""
    scratch = Scratch(df.sparkSession)
    t = F.col(f"`{ts}`").cast("timestamp").cast("double")
    rows = scratch.save(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.struct(*[F.col(f"`{k}`") for k in key]).alias("k"), t.alias("t")).withColumn("i", F.monotonically_increasing_id()))
    # a row asks before the rows at the range's start, counts, and asks after all at its time
    asks = F.array(F.struct((F.col("t") - seconds).alias("t"), F.lit(0).alias("o"), F.lit(-1).alias("sign")), F.struct("t", F.lit(1).alias("o"), F.lit(0).alias("sign")), F.struct("t", F.lit(2).alias("o"), F.lit(1).alias("sign")))
    marks = rows.select("k", "i", F.explode(asks).alias("a")).select("k", "i", "a.*")
    seen = Dealt(marks, ["k"], ["t", "o", "i"]).total(n=lambda r: F.when(r["o"] == 1, 1).otherwise(0)).rows()
    counts = seen.where("sign <> 0").groupBy("i").agg(F.sum(F.col("sign") * F.col("n")).alias("in_range"))
    return rows.join(counts, "i").select("row.*", "in_range")
