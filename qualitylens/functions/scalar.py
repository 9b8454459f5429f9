"""Scalar expressions of the data model (Column to Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("informational", "warning", "blocking")


def severity_rank(severity: Column) -> Column:
    """0 informational, 1 warning, 2 blocking."""
    return F.when(severity == "blocking", 2).when(severity == "warning", 1).otherwise(0)


def fingerprint(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts joined by ``|``; null is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def band(x: Column, *steps: tuple[float, str], default: str) -> Column:
    """The label of the first step, from high to low, that x reaches."""
    out = None
    for least, label in steps:
        out = F.when(x >= least, label) if out is None else out.when(x >= least, label)
    return out.otherwise(default)


def noisy_or(confidences: Column) -> Column:
    """1 - prod(1 - c) over an array; 0 for an empty one."""
    return 1 - F.aggregate(confidences, F.lit(1.0), lambda acc, c: acc * (1 - c))


def geometric_mean(values: Column) -> Column:
    """Of the non-null values of an array; 0 if any is not positive, null if there is none."""
    known = F.filter(values, lambda v: v.isNotNull())
    logs = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + F.log(F.greatest(v, F.lit(1e-300))))
    mean = F.when(F.exists(known, lambda v: v <= 0), F.lit(0.0)).otherwise(F.exp(logs / F.size(known)))
    return F.when(F.size(known) > 0, mean)


def path_prefixes(path: Column, sep: str = "/") -> Column:
    """All leading stretches of a path, shortest first."""
    steps = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), sep))


def linear_decay(n: Column, start: float = 0.6, over: int = 50) -> Column:
    """start * max(0, 1 - n / over)."""
    return start * F.greatest(F.lit(0.0), 1 - n / over)


def backoff(base: Column, failures: Column, cap: int = 6) -> Column:
    """base * 2 ** min(failures, cap)."""
    return base * F.pow(F.lit(2.0), F.least(failures, F.lit(cap)))
