"""Bounded, totally ordered reads of graph facts: points, lists, distinct candidates, joins and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.limits import Corrupt, after, checked_text, cursor_page, page
from factweave.sources.staging import staged


def point(df: DataFrame, column: str, value, columns: Sequence[str] | None = None) -> DataFrame:
    """The row with this key; with ``columns``, only these are read."""
    if isinstance(value, str):
        checked_text(value, blank=True)
    found = df.where(F.col(column) == F.lit(value))
    return found.select(*columns) if columns else found


def equal_to(df: DataFrame, wanted: dict, order: Sequence[str], limit: int, kind: str = "page") -> DataFrame:
    """Rows whose columns equal the wanted values exactly (no case folding); None values do not restrict."""
    for name, value in wanted.items():
        if isinstance(value, str):
            checked_text(value, blank=True)
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return page(df, order, limit, kind)


def tasks(df: DataFrame, marker: str | None, limit: int) -> DataFrame:
    """By deadline, then schedule, each with nulls last, then page and block."""
    found = df if marker is None else df.where(F.col("marker") == checked_text(marker))
    return page(found, [F.col("deadline").asc_nulls_last(), F.col("scheduled").asc_nulls_last(), "page_id", "block_id"], limit, "task")


def candidates(df: DataFrame, keys: Sequence[str], cursor: Sequence | None, limit: int, kind: str = "referrer") -> DataFrame:
    """Distinct keys past the cursor; the cursor restricts before rows are made distinct."""
    return page(df.where(after(keys, cursor)).select(*keys).distinct(), list(keys), limit, kind)


def task_candidate_blocks(tasks: DataFrame, blocks: DataFrame, pages: DataFrame, marker: str, cursor: Sequence | None, limit: int) -> DataFrame:
    """Tasks of a marker with their block and page, by (page_id, block_id)."""
    past = after(["page_id", "block_id"], cursor)
    found = tasks.where(F.col("marker") == checked_text(marker)).where(past)
    if cursor is not None:  # the scans of blocks and pages begin there too
        blocks, pages = blocks.where(past), pages.where(F.col("page_id") >= F.lit(cursor[0]))
    joined = found.join(blocks, ["block_id", "page_id"]).join(pages.select("page_id", "name", "path", "text_kind"), "page_id")
    out = joined.select("page_id", "block_id", "path", "name", "text_kind", "order_key", "content", "marker", "priority")
    return page(out, ["page_id", "block_id"], limit, "candidate")


def named_pages(pages: DataFrame, facts: DataFrame, columns: Sequence[str], cursor: Sequence | None, limit: int, kind: str) -> DataFrame:
    """Distinct (path, columns..., page_id) of facts joined with their source pages, past the cursor."""
    keys = ["path", *columns, "page_id"]
    joined = facts.join(pages.select("page_id", "path"), facts["source_page"] == pages["page_id"]).select(*keys).distinct()
    return cursor_page(joined, keys, cursor, limit, kind)


def reference_counts(postings: DataFrame, claim: str, entity: str, source_page: int | None, cursor: Sequence | None, limit: int) -> DataFrame:
    """Distinct source entities of each claim, by claim; the cursor restricts claims before they are grouped."""
    found = postings if source_page is None else postings.where(F.col("source_page") == source_page)
    counted = found.where(after([claim], cursor)).select(claim, entity).distinct().groupBy(claim).agg(F.count("*").alias("sources"))
    return page(counted, [claim], limit, "name")


def alias_bindings(aliases: DataFrame) -> DataFrame:
    """(normalized_alias, candidate_ordinal from 0, page_id) over distinct declarations."""
    order = Window.partitionBy("normalized_alias").orderBy("source_page")
    return aliases.select("normalized_alias", "source_page").distinct().select("normalized_alias", (F.row_number().over(order) - 1).cast("long").alias("candidate_ordinal"), F.col("source_page").alias("resolved_page"))


def rebound(bindings: DataFrame, aliases: DataFrame, touched: DataFrame) -> DataFrame:
    """Bindings after a change: those of touched aliases are numbered anew, the rest stay."""
    again = alias_bindings(aliases.join(touched, "normalized_alias", "left_semi"))
    return bindings.join(touched, "normalized_alias", "left_anti").unionByName(again)


def coverage(sources: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """One row: sources, how many are covered, how many are not."""
    marked = sources.select(key).join(covered.select(key).distinct().withColumn("has", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("total"), F.count("has").alias("covered"), (F.count("*") - F.count("has")).alias("missing"))


def mismatches(owners: DataFrame, index: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: owners without an index row, or whose index row differs in a column."""
    right = index.select(*key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = owners.join(right, list(key), "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return joined.agg(F.count_if(F.col("_there").isNull()).alias("absent"), F.count_if(F.col("_there").isNotNull() & differs).alias("different"))


def ancestors(blocks: DataFrame) -> DataFrame:
    """(page_id, block_id, ancestor_id, distance) for chains of any length.

    Doubling: each round joins the longest paths with all others, so a chain of n blocks takes log2(n) joins. The
    last round is that which finds no longer path. Parents must not form a ring.
    """
    step = blocks.where("parent_id is not null").select("page_id", "block_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).cast("long").alias("distance"))
    paths, reach = step, 1
    while True:
        longest = paths.where(F.col("distance") == reach).select("page_id", "block_id", F.col("ancestor_id").alias("_via"))
        onward = paths.select("page_id", F.col("block_id").alias("_via"), "ancestor_id", (F.col("distance") + reach).alias("distance"))
        further = staged(longest.join(onward, ["page_id", "_via"]).select("page_id", "block_id", "ancestor_id", "distance"), "ancestors")
        if further.isEmpty():
            return paths
        paths, reach = paths.unionByName(further), reach * 2
        if reach > 1 << 40:
            raise Corrupt("parents form a ring")
