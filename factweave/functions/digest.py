"""Digests of rows and tables that do not depend on partitioning or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(columns: list[str]) -> Column:
    """Each value with its length before it (null: a dash), so that different rows never read the same."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("|", *parts)


def row_digest(columns: list[str]) -> Column:
    return F.sha2(row_key(columns).cast("binary"), 256)


def table_digest(df: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One row (rows, digest): the digest of 256 bucket digests, each of its sorted row digests.

    Rows meet by the first byte of their digest, so no task sorts more than a 256th of them.
    """
    hashed = df.select(row_digest(columns).alias("h")).withColumn("bucket", F.substring("h", 1, 2))
    each = hashed.groupBy("bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "").cast("binary"), 256).alias("d"), F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda x: F.concat(x["bucket"], x["d"])), "").cast("binary"), 256).alias("digest"))


def is_digest(column: str) -> Column:
    return F.col(column).rlike("^[0-9a-f]{64}$")
