"""Relational operators: dedup, deltas, fusion, coverage, joins by range and prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.session import Scratch


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; null keys are equal. Only one
    candidate per key and task is shuffled: the best is an aggregate."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"), F.struct(*order).alias("rank"), row.alias("row"))
    return rows.groupBy("key").agg(F.min_by("row", "rank").alias("row")).select("row.*")


def bag_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference of two tables of (keys, n, rank): per key the
    counts that are new, resolved, escalated and still active.

    The smaller of both counts is common; it is escalated if the rank rose and
    still active otherwise. What is over is new or resolved."""
    b = before.select(*keys, F.col("n").alias("n0"), F.col("rank").alias("r0"))
    a = after.select(*keys, F.col("n").alias("n1"), F.col("rank").alias("r1"))
    j = b.join(a, keys, "full")
    n0, n1 = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    common, rose = F.least(n0, n1), F.coalesce(F.col("r1") > F.col("r0"), F.lit(False))
    return j.select(
        *keys,
        (n1 - common).alias("new"),
        (n0 - common).alias("resolved"),
        F.when(rose, common).otherwise(0).alias("escalated"),
        F.when(rose, F.lit(0)).otherwise(common).alias("still_active"),
    )


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points inside the spans of their key, both ends included: the columns of
    both, the key once. Null keys, points and ends meet nothing.

    Points and spans are dealt to bins of the spans' mean width (one number on
    the driver), so a key with very many points or spans is spread over its
    bins; a span stands in every bin it touches, three on average at most, a
    point in one, so a pair is found once and then verified."""
    place = lambda df, c: F.col(f"`{c}`").cast("timestamp").cast("double") if df.schema[c].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else F.col(f"`{c}`").cast("double")
    pack = lambda df, names: F.struct(*[F.col(f"`{c}`") for c in names])
    a, b = place(spans, start), place(spans, end)
    width = spans.where(b >= a).agg(F.avg(b - a)).first()[0] or 1.0
    bin_of = lambda x: F.floor(x / width)
    p = points.select(F.col(f"`{key}`").alias("k"), bin_of(place(points, at)).alias("bin"), place(points, at).alias("x"), pack(points, points.columns).alias("p"))
    s = spans.where(b >= a).select(F.col(f"`{key}`").alias("k"), F.explode(F.sequence(bin_of(a), bin_of(b))).alias("bin"), a.alias("a"), b.alias("b"), pack(spans, [c for c in spans.columns if c != key]).alias("s"))
    return p.join(s, ["k", "bin"]).where("x between a and b").select("p.*", "s.*")


def longest_prefix(rows: DataFrame, prefixes: DataFrame, path: str, prefix: str, value: str, sep: str = "/") -> DataFrame:
    """``rows`` with ``value`` of the longest ``prefix`` that is a leading stretch
    of each row's ``path``, null if there is none: an equality join on all
    stretches, not a nested loop. A column ``value`` of the rows is replaced; of
    equal prefixes the greatest value counts."""
    from qualitylens.functions.scalar import path_prefixes

    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{path}`").alias("path"))
    tries = packed.select("path").distinct().select("path", F.explode(path_prefixes(F.col("path"), sep)).alias("p"))
    hits = tries.join(prefixes.select(F.col(f"`{prefix}`").alias("p"), F.col(f"`{value}`").alias("v")), "p")
    best = hits.groupBy("path").agg(F.max(F.struct(F.length("p").alias("n"), "v"))["v"].alias("v"))
    return packed.join(best, "path", "left").select(F.col("row").withField(value, F.col("v")).alias("row")).select("row.*")


#: Sets that are asked first, and how many times more each further time.
FIRST_SETS, MORE_SETS = 1024, 32


def first_superset(sets: DataFrame, name: str, items: str, weight: str) -> DataFrame:
    """``name`` (a number), superset: for every set of items (an array) that
    another set of more ``weight`` holds, the least name of such a set. Sets that
    none holds, and empty ones, give no row.

    Sets that are equal in items and weight are one class. Every class is listed
    under all its items and asks at the item that fewest classes have, bounded
    by size and weight and by a mask of 63 hashed items, before items are
    compared. Answers are sought in order of names, a stretch of classes after
    the other, each ``MORE_SETS`` times as long, and a class that has its answer
    asks no more; nothing leaves the joins but a minimum a class."""
    scratch = Scratch(sets.sparkSession)
    col = lambda c: F.col(f"`{c}`")
    rows = sets.select(col(name).alias("name"), F.array_sort(F.array_distinct(col(items))).alias("items"), col(weight).alias("w"))
    rows = rows.where("name is not null and w is not null and size(items) > 0")
    each = rows.groupBy("items", "w").agg(F.min("name").alias("first")).withColumn("item", F.explode("items"))
    rare = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    each = each.join(rare, "item").withColumn("bit", F.expr("shiftleft(1L, cast(pmod(xxhash64(item), 63) as int))"))
    classes = each.groupBy("items", "w", "first").agg(F.min_by("item", F.struct("n", "item")).alias("item"), F.bit_or("bit").alias("mask"))
    classes = scratch.save(classes)
    lists = classes.withColumn("item", F.explode("items"))
    total, upto, shares = classes.count(), FIRST_SETS, []
    while upto < total:
        shares.append(upto / total)
        upto *= MORE_SETS
    # where the stretches end need not be exact; it is a handful of names
    cuts = classes.agg(F.percentile_approx("first", shares, 10_000)).first()[0] if shares else []
    left = classes.select(F.col("w").alias("mine"), F.col("items").alias("own"), F.col("mask").alias("bits"), "item")
    found, low = None, None
    for high in [*cuts, None]:
        part = lists if low is None else lists.where(F.col("first") > F.lit(low))
        part = part if high is None else part.where(F.col("first") <= F.lit(high))
        near = left.join(part, "item").where("w > mine and size(items) >= size(own) and (bits & ~mask) = 0")
        hits = scratch.save(near.where(F.size(F.array_except("own", "items")) == 0).groupBy("own", "mine").agg(F.min("first").alias("superset")))
        left = left.join(hits, ["own", "mine"], "left_anti")
        found, low = hits if found is None else found.union(hits), high
    answers = found.select(F.col("own").alias("items"), F.col("mine").alias("w"), "superset")
    return rows.join(answers, ["items", "w"]).select(F.col("name").alias(name), "superset")


#: Items of a group that are paired within a row.
BLOCK = 256


def pair_counts(df: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """How many groups have both items, for items a < b. A group's distinct
    items are dealt into blocks of some ``BLOCK``, and each pair of blocks is a
    row of its own, so a large group costs more rows, not a larger one."""
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("x")).distinct()
    blocks = rows.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g", F.ceil(F.col("k") / BLOCK).alias("blocks"))
    rows = rows.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    rows = rows.select("g", "x", "block", F.explode(met).alias("at"))
    side = lambda k: F.collect_list(F.when(F.col("block") == F.col(f"at.{k}"), F.col("x")))
    sides = rows.groupBy("g", "at").agg(side("i").alias("xs"), side("j").alias("ys"))
    pairs = sides.select("at", F.explode("xs").alias("x"), "ys").select("at", "x", F.explode("ys").alias("y")).where("at.i < at.j or x < y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def running(rows: DataFrame, coarse: list[str], fine: list[str], **values: Column) -> DataFrame:
    """``rows`` with, for each of ``values``, its sum over all rows that come
    earlier in ascending order of ``coarse`` and then ``fine``.

    Totals go level by level through ``coarse``, from general to particular, so
    only the distinct values of its first column are ever ordered in one task,
    and the rows themselves within equal ``coarse`` columns."""
    names = list(values)
    rows = rows.withColumns({f"__{n}": v for n, v in values.items()})
    starts = None
    for k in range(len(coarse)):
        totals = rows.groupBy(*coarse[: k + 1]).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in names])
        before = W.partitionBy(*coarse[:k]).orderBy(coarse[k]).rowsBetween(W.unboundedPreceding, -1)
        level = totals.select(*coarse[: k + 1], *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{k}{n}") for n in names])
        starts = level if starts is None else level.join(starts, coarse[:k])
    within = W.partitionBy(*coarse).orderBy(*fine).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"__in{n}": F.coalesce(F.sum(f"__{n}").over(within), F.lit(0)) for n in names}).join(starts, coarse)
    total = {n: sum((F.col(f"__{k}{n}") for k in range(len(coarse))), F.col(f"__in{n}")) for n in names}
    return rows.withColumns(total).drop(*[f"__{x}{n}" for n in names for x in ("", "in", *range(len(coarse)))])


def greedy_order(kills: DataFrame) -> DataFrame:
    """Tests by number of mutants, then id (a number); new = mutants that no
    earlier test kills; with running coverage. One pass in a fixed order: each
    mutant belongs to the first test that kills it."""
    n = kills.groupBy("test").agg(F.count("*").alias("kills"))
    first = kills.join(n, "test").groupBy("mutant").agg(F.min_by("test", F.struct(-F.col("kills"), "test")).alias("test"))
    new = first.groupBy("test").agg(F.count("*").alias("new"))
    rows = n.join(new, "test", "left").select("test", "kills", F.coalesce("new", F.lit(0)).alias("new"), (-F.col("kills")).alias("less"), F.floor(F.col("test") / 4096).alias("part"))
    total = kills.agg(F.countDistinct("mutant").alias("total"))
    rows = running(rows, ["less", "part"], ["test"], rank=F.lit(1), covered=F.col("new"))
    rows = rows.withColumn("rank", F.col("rank") + 1).withColumn("covered", F.col("covered") + F.col("new")).drop("less", "part")
    return rows.crossJoin(F.broadcast(total))
