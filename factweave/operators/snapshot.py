"""A snapshot of graph facts, changed as a whole: nested pages come, pages go, and readers see one state or the other."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factweave.functions.limits import Incomplete, Stale
from factweave.operators.reads import alias_bindings, rebound
from factweave.sources.files import Files

#: Columns of a snapshot's tables. Entity types: 0 page, 1 block.
TABLES = {
    "pages": "page_id long, name string, name_key string, path string, text_kind int, preamble string",
    "blocks": "block_id long, page_id long, parent_block_id long, order_key string, content string, uuid string, origin int",
    "refs": "source_type int, source_id long, source_page_id long, target_type int, target_id long, kind int, ordinal long",
    "properties": "owner_type int, owner_id long, page_id long, name string, normalized_name string, ordinal long, value string",
    "tags": "owner_type int, owner_id long, page_id long, ordinal long, tag string",
    "tasks": "block_id long, page_id long, marker string, priority string, scheduled string, deadline string",
    "search": "entity_type int, entity_id long, page_id long, text string, normalized string",
    "search_owners": "entity_type int, entity_id long, page_id long",
}
#: What a nested page holds; a block within it has the same three arrays and at most one task.
OWNED = "references array<struct<target_type:int,target_id:long,kind:int>>, properties array<struct<name:string,value:string>>, tags array<string>"
_BLOCK = "block_id:long,parent_block_id:long,order_key:string,content:string,uuid:string,origin:int," + OWNED.replace(" array", ":array").replace(", ", ",") + ",task:struct<marker:string,priority:string,scheduled:string,deadline:string>"
NESTED = f"page_id long, name string, path string, text_kind int, preamble string, text string, {OWNED}, blocks array<struct<{_BLOCK}>>"

Snapshot = Mapping[str, DataFrame]


def _page_column(table: str) -> str:
    return "source_page_id" if table == "refs" else "page_id"


def _typed(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[table])])


def reset(spark: SparkSession) -> dict[str, DataFrame]:
    """The empty snapshot."""
    return {t: spark.createDataFrame([], ddl) for t, ddl in TABLES.items()}


def is_empty(snapshot: Snapshot) -> bool:
    return all(df.isEmpty() for df in snapshot.values())


def flattened(pages: DataFrame) -> dict[str, DataFrame]:
    """The rows of all tables for nested pages (NESTED). An ordinal is a place in its array, from 0.

    A block has an outside uuid and its origin, or neither; else the read of blocks fails.
    """
    blocks = pages.select("page_id", F.inline("blocks"))
    paired = F.col("uuid").isNull() == F.col("origin").isNull()
    owners = [
        pages.select(F.lit(0).alias("owner_type"), F.col("page_id").alias("owner_id"), "page_id", "references", "properties", "tags", F.col("text").alias("owner_text")),
        blocks.select(F.lit(1).alias("owner_type"), F.col("block_id").alias("owner_id"), "page_id", "references", "properties", "tags", F.col("content").alias("owner_text")),
    ]
    both = reduce(DataFrame.unionByName, owners)

    def children(array: str) -> DataFrame:
        return both.select("owner_type", "owner_id", "page_id", F.posexplode(array).alias("ordinal", "x"))

    entities = both.select(F.col("owner_type").alias("entity_type"), F.col("owner_id").alias("entity_id"), "page_id", F.col("owner_text").alias("text"), F.lower("owner_text").alias("normalized"))
    out = {
        "pages": pages.withColumn("name_key", F.lower("name")),
        "blocks": blocks.withColumn("uuid", F.when(paired, F.col("uuid")).otherwise(F.raise_error(F.lit("Corrupt: uuid without origin or origin without uuid")))),
        "refs": children("references").select(F.col("owner_type").alias("source_type"), F.col("owner_id").alias("source_id"), F.col("page_id").alias("source_page_id"), "x.target_type", "x.target_id", "x.kind", "ordinal"),
        "properties": children("properties").select("owner_type", "owner_id", "page_id", "x.name", F.lower("x.name").alias("normalized_name"), "ordinal", "x.value"),
        "tags": children("tags").withColumnRenamed("x", "tag"),
        "tasks": blocks.where("task is not null").select("block_id", "page_id", "task.*"),
        "search": entities.where("text is not null"),
        "search_owners": entities.where("text is not null"),
    }
    return {t: _typed(df, t) for t, df in out.items()}


def applied(base: Snapshot, replacements: DataFrame, deletions: DataFrame) -> dict[str, DataFrame]:
    """The snapshot after nested pages have replaced theirs and pages (page_id) have been deleted.

    First everything that touched pages own goes, then the new rows come, so blocks may move between pages. References
    from elsewhere to a page go only if it is deleted; those to a block go if it is gone and no replacement has it.
    """
    new = flattened(replacements)
    touched = replacements.select("page_id").union(deletions.select("page_id")).distinct()
    gone = base["blocks"].join(touched, "page_id", "left_semi").select("block_id").join(new["blocks"].select("block_id"), "block_id", "left_anti")
    out = {}
    for table, df in base.items():
        page = _page_column(table)
        kept = df.join(touched.withColumnRenamed("page_id", page), page, "left_anti")
        if table == "refs":
            ends = deletions.select(F.lit(0).alias("target_type"), F.col("page_id").alias("target_id")).union(gone.select(F.lit(1), "block_id")).distinct()
            kept = kept.join(ends, ["target_type", "target_id"], "left_anti")
        out[table] = kept.select(*df.columns).unionByName(new[table])
    return out


def removed_counts(base: Snapshot, touched: DataFrame) -> DataFrame:
    """(table, removed): how many rows of touched pages each table owns."""
    each = [df.join(touched.select(F.col("page_id").alias(_page_column(t))).distinct(), _page_column(t), "left_semi").agg(F.count("*").alias("removed")).select(F.lit(t).alias("table"), "removed") for t, df in base.items()]
    return reduce(DataFrame.unionByName, each)


class SnapshotStore:
    """Snapshots in a folder, and a pointer to the one that counts, with its stamp (sequence, digest).

    A change writes a new folder and swaps the pointer; a reader that asks for an exact stamp gets it or Stale.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, self.folder)

    def stamp(self) -> dict:
        return json.loads(self.files.read("current")) if self.files.exists("current") else {"sequence": 0, "digest": "", "folder": None}

    def checked(self, sequence: int, digest: str) -> dict:
        """The stamp, if it is exactly that."""
        now = self.stamp()
        if (now["sequence"], now["digest"]) != (sequence, digest):
            raise Stale(f"the snapshot is at {now['sequence']}, not {sequence}")
        return now

    def read(self, sequence: int | None = None, digest: str = "") -> dict[str, DataFrame]:
        now = self.stamp() if sequence is None else self.checked(sequence, digest)
        if now["folder"] is None:
            return reset(self.spark)
        return {t: self.spark.read.schema(ddl).parquet(f"{self.folder}/{now['folder']}/{t}") for t, ddl in TABLES.items()}

    def commit(self, snapshot: Snapshot, after: tuple[int, str], sequence: int, digest: str) -> None:
        """Publishes a snapshot in place of the one with the stamp ``after``."""
        now = self.checked(*after)
        name = f"snapshot-{sequence}-{uuid.uuid4().hex}"
        for table, df in snapshot.items():
            _typed(df, table).write.parquet(f"{self.folder}/{name}/{table}")
        old = self.files.read("current") if now["folder"] is not None else None
        self.files.replace("current", old, json.dumps({"sequence": sequence, "digest": digest, "folder": name}).encode())

    def apply(self, replacements: DataFrame, deletions: DataFrame, after: tuple[int, str], sequence: int, digest: str) -> None:
        self.commit(applied(self.read(*after), replacements, deletions), after, sequence, digest)


def by_source(base: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """base without the rows of touched sources, and the new rows; key: source_page."""
    return base.join(touched, "source_page", "left_anti").select(*base.columns).unionByName(new)


def touched_sources(new_coverage: DataFrame, removed: DataFrame) -> DataFrame:
    return new_coverage.select("source_page").union(removed.select("source_page")).distinct()


def catalog_changed(base: Mapping[str, DataFrame], new: Mapping[str, DataFrame], removed: DataFrame, prior_count: int | None = None, post_count: int | None = None) -> dict[str, DataFrame]:
    """The reference catalog (coverage, postings, aliases, bindings) after its sources have been read anew or removed.

    Rows are replaced by source. Bindings of aliases that old or new rows of touched sources declare are numbered
    anew. With ``post_count`` the number of covered sources must come to it: counted in full, or, with
    ``prior_count``, reckoned as prior - replaced + inserted after the prior number has been checked.
    """
    touched = touched_sources(new["coverage"], removed)
    out = {t: by_source(base[t], new[t], touched) for t in ("coverage", "postings", "aliases")}
    old_names = base["aliases"].join(touched, "source_page", "left_semi").select("normalized_alias")
    out["bindings"] = rebound(base["bindings"], out["aliases"], old_names.union(new["aliases"].select("normalized_alias")).distinct())
    if post_count is not None:
        if prior_count is None:
            found = out["coverage"].count()
        else:
            if (there := base["coverage"].count()) != prior_count:
                raise Incomplete(f"{there} sources are covered, not {prior_count}")
            found = inductive_count(base["coverage"], new["coverage"], touched).first()["post"]
        if found != post_count:
            raise Incomplete(f"{found} sources are covered, not {post_count}")
    return out


def inductive_count(coverage: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """One row (prior, replaced, inserted, post), post being prior - replaced + inserted."""
    marked = coverage.select("source_page").join(touched.select("source_page", F.lit(1).alias("hit")), "source_page", "left")
    told = marked.agg(F.count("*").alias("prior"), F.count("hit").alias("replaced"))
    return told.join(new.agg(F.count("*").alias("inserted"))).withColumn("post", F.col("prior") - F.col("replaced") + F.col("inserted"))  # one row each


def bindings_of(aliases: DataFrame) -> DataFrame:
    return alias_bindings(aliases)


def first_failure(checks: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(otherwise)
    for condition, name in reversed(checks):
        out = F.when(condition, name).otherwise(out)
    return out
