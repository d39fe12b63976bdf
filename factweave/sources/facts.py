"""Graph facts as views of the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.tables import table


@dataclass
class Facts:
    """Lazy DataFrames; nothing is read before an action."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def pages(self) -> DataFrame:
        return self._table("customer").select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("name"), F.lower("c_name").alias("name_key"), F.concat(F.lit("seg/"), "c_mktsegment", F.lit("/"), "c_name").alias("path"), (F.col("c_nationkey") % 2).alias("text_kind"))

    @property
    def blocks(self) -> DataFrame:
        return self._table("orders").select(F.col("o_orderkey").alias("block_id"), F.col("o_custkey").alias("page_id"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("order_key"), F.col("o_orderpriority").alias("content"))

    @property
    def tasks(self) -> DataFrame:
        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        return self._table("orders").select(
            F.col("o_orderkey").alias("block_id"), F.col("o_custkey").alias("page_id"), F.col("o_orderstatus").alias("marker"), F.col("o_orderpriority").alias("priority"),
            F.when(F.col("o_orderkey") % 3 != 0, day).alias("scheduled"), F.when(F.col("o_orderstatus") != "F", day).alias("deadline"),
        )

    @property
    def tree(self) -> DataFrame:
        return self._table("conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("block_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"), "role", "text")

    @property
    def claims(self) -> DataFrame:
        """Postings to external uuids, kinds 6 and 7."""
        return self._table("lineitem").select(F.col("l_suppkey").alias("source_page"), F.col("l_orderkey").alias("source_entity"), F.col("l_partkey").alias("claim"), (F.lit(6) + F.col("l_linenumber") % 2).alias("kind"), F.col("l_linenumber").alias("ordinal"))

    @property
    def names(self) -> DataFrame:
        """Postings to page names, kinds 0 to 5."""
        owners = self._table("customer").select("c_custkey", "c_mktsegment")
        return self._table("orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("source_page"), F.col("o_orderkey").alias("source_entity"), F.col("c_mktsegment").alias("raw_name"), F.lower("c_mktsegment").alias("normalized_name"), (F.col("o_orderkey") % 6).alias("kind"))

    @property
    def aliases(self) -> DataFrame:
        nations = self._table("nation").select("n_nationkey", "n_name")
        return self._table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("source_page"), F.col("n_name").alias("raw_alias"), F.lower("n_name").alias("normalized_alias"))

    @property
    def properties(self) -> DataFrame:
        entries = F.expr("stack(3, 'Brand', 0L, p_brand, 'Type', 1L, p_type, 'Size', 2L, cast(p_size AS string)) AS (name, ordinal, value)")
        return self._table("part").select(F.col("p_partkey").alias("owner_id"), (F.col("p_partkey") % 2).cast("int").alias("owner_type"), F.col("p_size").alias("page_id"), entries).withColumn("normalized_name", F.lower("name"))

    @property
    def tags(self) -> DataFrame:
        return self._table("part").select(F.col("p_partkey").alias("owner_id"), F.col("p_size").alias("page_id"), F.posexplode(F.split("p_name", " ")).alias("ordinal", "tag")).withColumn("ordinal", F.col("ordinal").cast("long"))

    def tags_named(self, tag: str) -> DataFrame:
        """The tags of one name; names that do not hold it are dropped in the scan, before any is split."""
        found = self._table("part").where(F.col("p_name").contains(tag))
        return found.select(F.col("p_partkey").alias("owner_id"), F.col("p_size").alias("page_id"), F.posexplode(F.split("p_name", " ")).alias("ordinal", "tag")).where(F.col("tag") == tag).withColumn("ordinal", F.col("ordinal").cast("long"))

    @property
    def texts(self) -> DataFrame:
        return self._table("conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("entity_id"), "text")

    @property
    def frames(self) -> DataFrame:
        """Journal frames: each user is a device with its own sequence from 0."""
        from pyspark.sql import Window

        order = Window.partitionBy("user_id").orderBy("event_id")
        return self._table("events").select(F.col("user_id").alias("device"), (F.row_number().over(order) - 1).cast("long").alias("sequence"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), F.sha2(F.col("props").cast("binary"), 256).alias("payload_digest"), F.col("event_id").alias("frame_id"))

    @property
    def versions(self) -> DataFrame:
        """Key/value versions by generation; a null value is a tombstone."""
        return self._table("events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key"), F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("value"), F.col("event_id").alias("generation"))

    @property
    def batches(self) -> DataFrame:
        """Accepted batches: eight peers take turns, each with its own counter; the head is the batch before."""
        me = F.col("event_id")
        return self._table("events").select(me.alias("batch_id"), (me % 8).alias("peer"), (F.floor(me / 8) + 1).alias("counter"), F.when(me > 0, me - 1).alias("head"), F.sha2(F.col("props").cast("binary"), 256).alias("digest"))
