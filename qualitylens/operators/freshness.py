"""Freshness: what was made from sections, a manifest entry and a version
against the state that was stored when it was made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staleness(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Which pages are stale, and why: one row for each row of ``current``.

    Both: key (one row each), sections (map of section to hash), manifest,
    version; other columns are ignored. Returns key, stale, unknown (no stored
    state; nothing else is said then), version_changed, manifest_changed, and
    new, removed and changed, the sorted names of sections. Null hashes,
    manifests and versions equal each other; null sections are no sections. A
    null key has no stored state. One join on the key; maps stay in their row.
    """
    none = F.create_map().cast("map<string,string>")
    side = lambda df, n: df.select(F.col(key), F.struct(F.coalesce("sections", none).alias("sections"), "manifest", "version").alias(n))
    both = side(current, "now").join(side(stored, "old"), key, "left")
    now, old = F.map_keys("now.sections"), F.map_keys("old.sections")
    known = F.col("old").isNotNull()
    list_of = lambda c: F.when(known, F.sort_array(c)).otherwise(F.array().cast("array<string>"))
    differs = lambda k: ~F.col("now.sections")[k].eqNullSafe(F.col("old.sections")[k])
    out = both.select(
        key,
        (~known).alias("unknown"),
        (known & ~F.col("now.version").eqNullSafe(F.col("old.version"))).alias("version_changed"),
        (known & ~F.col("now.manifest").eqNullSafe(F.col("old.manifest"))).alias("manifest_changed"),
        list_of(F.array_except(now, old)).alias("new"),
        list_of(F.array_except(old, now)).alias("removed"),
        list_of(F.filter(F.array_intersect(now, old), differs)).alias("changed"),
    )
    why = F.col("unknown") | F.col("version_changed") | F.col("manifest_changed") | (F.size("new") + F.size("removed") + F.size("changed") > 0)
    return out.withColumn("stale", why)
