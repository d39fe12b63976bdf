"""Changes of a snapshot: pages replaced and deleted in two phases, children flattened, metadata checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replaced(base: DataFrame, touched: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base without rows of touched pages, and the new rows: first all go, then all come, so rows may move between pages."""
    return base.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


def remaining_refs(refs: DataFrame, replaced_pages: DataFrame, deleted_pages: DataFrame, gone_blocks: DataFrame) -> DataFrame:
    """References (source_page, target_page, target_block) after a change.

    Those from touched pages go; those to a page go only if it is deleted, not if it is replaced; those to a block
    go if it is gone and no replacement keeps it.
    """
    touched = replaced_pages.select("page_id").union(deleted_pages.select("page_id")).distinct()
    kept = refs.join(touched, refs["source_page"] == touched["page_id"], "left_anti")
    kept = kept.join(deleted_pages.select(F.col("page_id").alias("target_page")), "target_page", "left_anti")
    return kept.join(gone_blocks.select(F.col("block_id").alias("target_block")), "target_block", "left_anti").select(*refs.columns)


def flattened(pages: DataFrame, keys: Sequence[str], array: str, value: str) -> DataFrame:
    """Child rows of a nested array; ordinal is the place in it."""
    return pages.select(*keys, F.posexplode(array).alias("ordinal", value)).withColumn("ordinal", F.col("ordinal").cast("long"))


def preservation(prior: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, outcome): Incomplete without a prior row, Contradiction where a column differs, else Preserved."""
    old = prior.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(old, key, "left").select(key, F.when(F.col("_there").isNull(), "Incomplete").when(~same, "Contradiction").otherwise("Preserved").alias("outcome"))


def conflicts(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys with more than one payload."""
    return df.groupBy(key).agg(F.min(payload).alias("low"), F.max(payload).alias("high"), F.count("*").alias("copies")).where("low <> high").select(key, "copies")
