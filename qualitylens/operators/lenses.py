"""Lenses: metrics of a target as evidence for or against taking it apart.

A lens turns columns of a wide row into at most one piece of evidence, a struct
of lens, confidence and signal (``support`` or ``oppose``), or null where it
has nothing to say. ``evidence`` unpivots a wide table by its lenses and
``fuse`` unites all evidence of a target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights of lenses when files are judged; others weigh 1.
FILE_WEIGHTS = {"cohesion": 2.0, "fan_in": 1.5, "cochange": 1.0, "import_tracing": 1.0}


def _says(lens: str, signal: str, confidence) -> Column:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.lit(lens).alias("lens"), c.cast("double").alias("confidence"), F.lit(signal).alias("signal"))


def _at_most_one(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def _rest(c: Column) -> Column:
    """What is missing to 1, and 0.1 at least."""
    return F.greatest(1 - c, F.lit(0.1))


def purity(pure: Column, confidence=0.8) -> Column:
    return F.when(pure, _says("purity", "support", confidence))


def mutation(survival: Column) -> Column:
    return F.when(survival >= 0.3, _says("mutation", "support", _at_most_one(survival)))


def specification(level: Column, regime: Column) -> Column:
    loose = F.when((regime == "B") & (level < 0.5), _says("specification", "support", _at_most_one(1 - level)))
    return loose.when(level >= 0.7, _says("specification", "oppose", _at_most_one(level)))


def composition_gap(gamma: Column) -> Column:
    return F.when(gamma > 0, _says("composition_gap", "support", _at_most_one(gamma / 5.0)))


def cohesion(score: Column, parts: Column) -> Column:
    return F.when((score < 0.5) | (parts > 1), _says("cohesion", "support", _rest(score)))


def fan_in(count: Column, threshold: int = 5, few: int = 0) -> Column:
    """Many dependents oppose, up to ``few`` (0 for a function, 1 for a file) support."""
    many = F.when(count >= threshold, _says("fan_in", "oppose", _at_most_one(count / (2.0 * threshold))))
    return many.when(count <= few, _says("fan_in", "support", 0.4))


def cochange(strength: Column, threshold: float = 0.4) -> Column:
    tight = F.when(strength >= threshold, _says("cochange", "oppose", _at_most_one(strength)))
    return tight.when(strength < threshold, _says("cochange", "support", _rest(strength)))


def dep_clustering(extractable: Column, confidence=0.5) -> Column:
    return F.when(extractable, _says("dep_clustering", "support", confidence))


def assertion_quality(score: Column, weaknesses: Column) -> Column:
    return F.when((score < 0.8) | (weaknesses > 0), _says("assertion_quality", "support", _rest(score)))


def algebraic(safety: Column, properties: Column) -> Column:
    safe = F.when((safety == "safe") & (properties > 0), _says("algebraic", "support", 0.6))
    return safe.when(safety == "unsafe", _says("algebraic", "oppose", 0.5))


def import_tracing(has_io: Column, depth: Column, foreign: Column) -> Column:
    io = F.when(has_io, _says("import_tracing", "oppose", 0.6))
    return io.when((depth <= 2) & (foreign <= 3), _says("import_tracing", "support", 0.4))


def call_graph(fan_out: Column, threshold: int = 8) -> Column:
    return F.when(fan_out >= threshold, _says("call_graph", "support", _at_most_one(fan_out / (2.0 * threshold))))


def contract_coverage(published: Column, consumed: Column) -> Column:
    return F.when(published & ~F.coalesce(consumed, F.lit(False)), _says("contract_coverage", "support", 0.5))


def cross_channel(found: Column) -> Column:
    return F.when(found, _says("cross_channel", "support", 0.5))


def evidence(wide: DataFrame, target: Column, lenses: list[Column]) -> DataFrame:
    """target, lens, confidence, signal: a row for every lens that has something
    to say about a row; null metrics say nothing. No shuffle."""
    e = wide.select(target.alias("target"), F.explode(F.array_compact(F.array(*lenses))).alias("e"))
    return e.select("target", "e.lens", "e.confidence", "e.signal")


def fuse(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """target, support, oppose, net (support without oppose, 0 at least),
    lenses (distinct supporting ones) of every target.

    A side's probability is 1 - prod(1 - c) over its evidence, each confidence
    first multiplied by its lens's weight and held at 1. Evidence is united in
    the order of lens and confidence, so reruns agree to the last bit. Evidence
    is counted by (lens, signal, confidence) before it is gathered, and equal
    pieces become one power, so a target gathers its different pieces only.
    """
    weight = F.lit(1.0)
    for lens, w in (weights or {}).items():
        weight = F.when(F.col("lens") == lens, w).otherwise(weight)
    c = _at_most_one(F.col("confidence") * weight)
    counted = rows.select("target", "lens", "signal", c.alias("c")).groupBy("target", "lens", "signal", "c").agg(F.count("*").alias("n"))
    piece = F.struct("lens", "c", "n")
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("signal") == s, piece)))
    g = counted.groupBy("target").agg(side("support").alias("s"), side("oppose").alias("o"), F.countDistinct(F.when(F.col("signal") == "support", F.col("lens"))).alias("lenses"))
    union = lambda a: 1 - F.aggregate(a, F.lit(1.0), lambda acc, p: acc * F.pow(1 - p["c"], p["n"]))
    g = g.select("target", union(F.col("s")).alias("support"), union(F.col("o")).alias("oppose"), "lenses")
    return g.select("target", "support", "oppose", F.greatest(F.col("support") - F.col("oppose"), F.lit(0.0)).alias("net"), "lenses")


def file_verdict(net: Column, lenses: Column, score: Column, parts: Column) -> Column:
    """SPLIT for files that fall apart by themselves, or on strong evidence of three lenses."""
    apart = (score < 0.3) & (parts >= 3) & (net >= 0.5) & (lenses >= 2)
    return F.when(F.coalesce(apart, F.lit(False)) | ((net >= 0.75) & (lenses >= 3)), "SPLIT").otherwise("INVESTIGATE")
