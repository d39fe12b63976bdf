"""Newest-wins key/value views with tombstones, versioned maps, size tiers and sample ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.limits import checked_limit


def newest(versions: DataFrame, tombstones: bool = False) -> DataFrame:
    """The newest value of each key; a null value deletes it, and is given only with ``tombstones``."""
    found = versions.groupBy("key").agg(F.max_by("value", "generation").alias("value"), F.max("generation").alias("generation"))
    return found if tombstones else found.where("value is not null")


def lookup_many(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """(position, key, value) for every asked key, in which keys may repeat and be absent.

    Versions are reduced to the asked keys before they are grouped.
    """
    asked = versions.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.join(newest(asked), "key", "left").select("position", "key", "value")


def scan_prefix(versions: DataFrame, prefix: str) -> DataFrame:
    return newest(versions.where(F.col("key").startswith(prefix)))


def as_of(versions: DataFrame, version: int) -> DataFrame:
    """The map as it was at a version."""
    return newest(versions.where(F.col("generation") <= version))


def first_with_prefix(versions: DataFrame, prefix: str, limit: int) -> DataFrame:
    return scan_prefix(versions, prefix).orderBy("key").limit(checked_limit(limit))


def removed(versions: DataFrame, keys: DataFrame, version: int) -> DataFrame:
    """versions and a tombstone for each key that is there; an absent key changes nothing."""
    there = newest(versions.join(keys, "key", "left_semi")).select("key", F.lit(None).cast("string").alias("value"), F.lit(version).cast("long").alias("generation"))
    return versions.unionByName(there)


def size_tiers(sizes: DataFrame, column: str) -> DataFrame:
    """(tier, n): sizes by power of two."""
    return sizes.where(F.col(column) > 0).groupBy(F.floor(F.log2(column)).cast("long").alias("tier")).agg(F.count("*").alias("n"))


def sample_ranges(files: DataFrame, size: str, width: int = 16 << 10, whole: int = 1 << 20, samples: int = 8) -> DataFrame:
    """(key, ordinal, offset, length): a file of at most ``whole`` bytes in one range, else evenly spaced ones."""
    count = F.when(F.col(size) <= whole, 1).otherwise(samples)
    at = F.explode(F.sequence(F.lit(0), count - 1)).alias("ordinal")
    rows = files.select("*", at)
    offset = F.when(F.col(size) <= whole, 0).otherwise(F.expr(f"div({size} - {width}, {samples - 1})") * F.col("ordinal"))
    return rows.select("key", F.col("ordinal").cast("long").alias("ordinal"), offset.cast("long").alias("offset"), F.when(F.col(size) <= whole, F.col(size)).otherwise(width).cast("long").alias("length"))
