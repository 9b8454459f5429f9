"""Exact order statistics and quantiles without a buffer of all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.session import Scratch

#: Bins of a pass, and the values that are fetched once a bin has no more.
BINS = 1024
FEW = 4096


def _inner(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values that stand at ``ranks`` (from 0) in ascending order; nulls and
    NaN are left out. A rank that is not below the number of values is an error.

    Each pass counts the values in ``BINS`` stretches of every interval that
    still holds a rank, and the stretch that holds it, shrunk to its own least
    and greatest value, is the next interval. A pass brings that many counts to
    the driver, however many values there are; the last one at most ``FEW``
    values a rank. ``df`` is read once a pass, and there are a few passes.
    """
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(v.alias("v")).where(_inner(F.col("v")))
    whole = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    if any(not 0 <= k < whole.n for k in ranks):
        raise ValueError(f"ranks {ranks} of {whole.n} values")
    # rank: (least, greatest, values in between, values before)
    at = {k: (whole.lo, whole.hi, whole.n, 0) for k in ranks}
    found: dict[int, float] = {}
    while True:
        found |= {k: lo for k, (lo, hi, _, _) in at.items() if lo == hi}
        at = {k: x for k, x in at.items() if k not in found}
        if not at:
            return [found[k] for k in ranks]
        small = {x for x in at.values() if x[2] <= FEW}
        if small:
            inside = F.lit(False)
            for lo, hi, _, _ in small:
                inside |= F.col("v").between(lo, hi)
            values = sorted(r.v for r in rows.where(inside).collect())
            for k, x in list(at.items()):
                if x in small:
                    first = next(i for i, y in enumerate(values) if y >= x[0])
                    found[k] = values[first + k - x[3]]
            continue
        spans = sorted(set(at.values()))
        which = None
        for i, (lo, hi, _, _) in enumerate(spans):
            # halves, so that the width of an interval is never infinite
            step = (hi / 2 - lo / 2) / BINS
            b = F.least(F.floor((F.col("v") / 2 - lo / 2) / step), F.lit(BINS - 1)) if step > 0 else F.when(F.col("v") == lo, 0).otherwise(1)
            here = F.when(F.col("v").between(lo, hi), F.struct(F.lit(i).alias("span"), b.cast("long").alias("bin")))
            which = here if which is None else F.coalesce(which, here)
        bins = rows.select("v", which.alias("at")).where("at is not null").groupBy("at.span", "at.bin")
        counted = sorted(bins.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect(), key=lambda r: (r.span, r.bin))
        for k, x in list(at.items()):
            before = x[3]
            for r in (r for r in counted if spans[r.span] == x):
                if k < before + r.n:
                    at[k] = (r.lo, r.hi, r.n, before)
                    break
                before += r.n


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """The values at ``shares`` (0 to 1) of all values, between two neighbours in
    proportion; null if there is no value."""
    n = df.where(_inner(F.col(f"`{value}`").cast("double"))).count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    ranks = sorted({k for p in places for k in (int(p), min(int(p) + 1, n - 1))})
    known = dict(zip(ranks, order_statistics(df, value, ranks), strict=True))
    return [known[int(p)] + (p - int(p)) * (known[min(int(p) + 1, n - 1)] - known[int(p)]) for p in places]


def quantiles_by(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """``key``, q: per key the values at ``shares`` (0 to 1), as an array, between
    two neighbours in proportion. Nulls and NaN are left out, keys without other
    values give no row, null is a key.

    Each round counts a key's values in ``BINS`` stretches of the interval that
    holds a rank and goes on with the one stretch; at ``FEW`` values they are
    sorted. A key never meets in one task but as counts. One flag a round
    reaches the driver."""
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.struct(F.col(f"`{key}`").alias("key")).alias("k"), F.col(f"`{value}`").cast("double").alias("v")).where(_inner(F.col("v")))
    whole = rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = lambda s: s * (F.col("n") - 1)
    wanted = [F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), F.least(F.floor(place(s)) + up, F.col("n") - 1).alias("rank"), (place(s) - F.floor(place(s))).alias("part")) for i, s in enumerate(shares) for up in (0, 1)]
    now = whole.select("k", "lo", "hi", "n", F.lit(0).cast("long").alias("before"), F.explode(F.array(*wanted)).alias("w")).select("k", "w.*", "lo", "hi", "n", "before")
    found = []
    while True:
        now = scratch.save(now)
        found.append(now.where(f"lo = hi or n <= {FEW}"))
        large = now.where(f"lo < hi and n > {FEW}")
        if not large.limit(1).count():
            break
        step = (F.col("hi") / 2 - F.col("lo") / 2) / BINS
        b = F.when(step > 0, F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / step), F.lit(BINS - 1))).otherwise(F.when(F.col("v") == F.col("lo"), 0).otherwise(1))
        inside = rows.join(large, "k").where("v between lo and hi").withColumn("bin", b)
        bins = inside.groupBy("k", "i", "up", "rank", "part", "before", "bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        earlier = W.partitionBy("k", "i", "up").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        now = bins.where("rank >= before and rank < before + n").select("k", "i", "up", "rank", "part", "lo", "hi", "n", "before")
    last = found[0]
    for part in found[1:]:
        last = last.unionByName(part)
    same = last.where("lo = hi").select("k", "i", "up", "part", F.col("lo").alias("x"))
    few = rows.join(last.where("lo < hi"), "k").where("v between lo and hi").groupBy("k", "i", "up", "part", "rank", "before")
    few = few.agg(F.array_sort(F.collect_list("v")).alias("vs")).select("k", "i", "up", "part", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("x"))
    each = same.union(few).groupBy("k", "i").agg(F.max("part").alias("part"), F.max(F.when(F.col("up") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("up") == 1, F.col("x"))).alias("b"))
    q = F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("q")))), lambda x: x["q"])
    return each.groupBy("k").agg(q.alias("q")).select(F.col("k.key").alias(key), "q")
