"""Levels, tiers and leftovers of stored runs: what a merge tree holds, what to compact, what may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Packs that a tier may hold; how many of the oldest are merged beyond that.
PACKS, MERGED = 4, 5


def level(generation: Column, last: int) -> Column:
    """The level that a generation (from 1) is in after ``last`` insertions.

    Each insertion merges all full levels below the first empty one, as adding one to a binary number carries. So
    the levels in use are the bits of ``last``, and a generation's level is the highest bit in which it, less one,
    differs from ``last``.
    """
    return (F.length(F.bin((generation - 1).bitwiseXOR(F.lit(last)))) - 1).cast("int")


def levels(versions: DataFrame, last: int) -> DataFrame:
    """(level, key, value, generation): the newest record of each key within each level; deletions are kept."""
    put = versions.withColumn("level", level(F.col("generation"), last))
    newest = put.groupBy("level", "key").agg(F.max(F.struct("generation", "value")).alias("top"))
    return newest.select("level", "key", "top.value", "top.generation")


def level_statistics(versions: DataFrame, last: int) -> DataFrame:
    """(level, entries, deletions, low, high) of each level in use."""
    return levels(versions, last).groupBy("level").agg(F.count("*").alias("entries"), F.count_if(F.col("value").isNull()).alias("deletions"), F.min("key").alias("low"), F.max("key").alias("high"))


def compacted(versions: DataFrame) -> DataFrame:
    """One record a key, the newest, with deletions: what a merge of all levels leaves."""
    return versions.groupBy("key").agg(F.max(F.struct("generation", "value")).alias("top")).select("key", "top.value", "top.generation")


def compaction_plan(packs: DataFrame) -> DataFrame:
    """(tier, pack_id) to be merged, for packs (pack_id, size, age): the oldest MERGED of a tier with more than PACKS."""
    tiered = packs.where("size > 0").withColumn("tier", F.floor(F.log2("size")).cast("long"))
    full = tiered.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") > PACKS).select("tier")
    order = Window.partitionBy("tier").orderBy(F.col("age").desc(), "pack_id")
    return tiered.join(full, "tier").withColumn("place", F.row_number().over(order)).where(F.col("place") <= MERGED).select("tier", "pack_id")


def reclaimable(listed: DataFrame, live: DataFrame, pattern: str) -> DataFrame:
    """(name): files that no head names and whose names are of the known form; others are left alone."""
    return listed.where(F.col("name").rlike(pattern)).join(live.select("name").distinct(), "name", "left_anti").select("name")


def census(runs: DataFrame) -> DataFrame:
    """(class, n): retained runs by class."""
    return runs.groupBy("class").agg(F.count("*").alias("n"))


def unreachable(runs: DataFrame, roots: DataFrame) -> DataFrame:
    """(run_id): runs that no root reaches and no lease holds."""
    return runs.where("not leased").select("run_id").join(roots.select("run_id").distinct(), "run_id", "left_anti")
