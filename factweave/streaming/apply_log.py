"""The accepted-event log as a stream: exactly-once application of batches in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factweave.functions.limits import BatchCollision
from factweave.sources.staging import stage_folder, staged


def shared_folder(spark: SparkSession) -> str:
    """A new folder for a stream's log and checkpoint, which all executors share."""
    return stage_folder(spark)


#: Parts of the applied log by key; a micro-batch is met only by those that its keys fall in.
PARTS = 64


class AppliedLog:
    """Applied batches as Parquet, one folder for each micro-batch, so that a repeated micro-batch replaces itself."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str = "batch_id", digest: str = "digest"):
        self.spark, self.folder, self.schema, self.key, self.digest = spark, folder, schema, key, digest

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """What has been applied, without micro-batches from ``before`` on; with ``parts``, no other is listed or read."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(StructType([*self.schema, StructField("epoch", LongType()), StructField("part", LongType())])).parquet(f"{self.folder}/applied")
        found = found if before is None else found.where(F.col("epoch") < before)
        return (found if parts is None else found.where(F.col("part").isin(parts))).drop("epoch", "part")

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/applied")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Appends new batches; the same batch again is a no-op, the same id with another digest refuses all."""
        batch = staged(batch.withColumn("part", F.pmod(F.xxhash64(self.key), F.lit(PARTS))), "micro-batch")
        parts = [r[0] for r in batch.select("part").distinct().collect()]  # at most PARTS numbers
        within = batch.groupBy(self.key).agg(F.min(self.digest).alias("low"), F.max(self.digest).alias("high"))
        prior = self.read(before=epoch, parts=parts).select(self.key, F.col(self.digest).alias("_digest"))
        clash = within.join(prior, self.key, "left").where((F.col("low") != F.col("high")) | (F.col("_digest") != F.col("low")))
        if not clash.isEmpty():
            raise BatchCollision("a batch id came with two digests")
        fresh = batch.dropDuplicates([self.key]).join(prior, self.key, "left_anti").select(*self.schema.names, "part")
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/applied/epoch={epoch}")


def run_available(source: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Applies everything that the streaming source has now, then stops; a later call goes on from the checkpoint."""
    query = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def replay_as_stream(spark: SparkSession, batches: DataFrame) -> DataFrame:
    """The log after batches, each delivered twice, have gone through the stream."""
    folder = shared_folder(spark)
    batches.write.parquet(f"{folder}/in")
    batches.write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(batches.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    applied = AppliedLog(spark, folder, batches.schema)
    run_available(source, f"{folder}/checkpoint", applied.apply)
    return applied.read()
