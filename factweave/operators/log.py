"""Accepted-event log: classification of requests, vector clocks, latest documents, manifests, journal frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classified(requests: DataFrame, accepted: DataFrame, current: int) -> DataFrame:
    """(request, outcome) for requests (batch_id, digest, head, sequence) against accepted batches (batch_id, digest).

    An accepted batch with the same digest is a Duplicate, with another a BatchCollision; then an unknown head
    is MissingDependency, a sequence other than current + 1 AcceptanceOrder; else New.
    """
    prior = accepted.select("batch_id", F.col("digest").alias("_digest"))
    heads = accepted.select(F.col("batch_id").alias("head"), F.lit(True).alias("_known"))
    joined = requests.join(prior, "batch_id", "left").join(heads, "head", "left")
    outcome = (
        F.when(F.col("_digest") == F.col("digest"), "Duplicate").when(F.col("_digest").isNotNull(), "BatchCollision")
        .when(F.col("head").isNotNull() & F.col("_known").isNull(), "MissingDependency").when(F.col("sequence") != current + 1, "AcceptanceOrder").otherwise("New")
    )
    return joined.select("batch_id", outcome.alias("outcome"))


def clock(batches: DataFrame) -> DataFrame:
    """The vector clock of a set of batches: the largest counter of each peer."""
    return batches.groupBy("peer").agg(F.max("counter").alias("counter"))


def clocks(batches: DataFrame, peers: list[int]) -> DataFrame:
    """Each batch of a chain with its clock, as running maxima within spans of the chain and the spans before.

    Spans are of fixed width, so that no task holds the whole chain.
    """
    width = 4096
    span = batches.withColumn("_span", F.floor(F.col("batch_id") / width))
    names = [f"p{p}" for p in peers]
    tops = span.groupBy("_span").agg(*[F.max(F.when(F.col("peer") == p, F.col("counter"))).alias(n) for p, n in zip(peers, names, strict=True)])
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one row for each span
    base = tops.select("_span", *[F.coalesce(F.max(n).over(before), F.lit(0)).alias(f"b{n}") for n in names])
    inside = Window.partitionBy("_span").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = span.join(base, "_span")
    return joined.select("batch_id", "peer", "counter", *[F.greatest(F.coalesce(F.max(F.when(F.col("peer") == p, F.col("counter"))).over(inside), F.lit(0)), F.col(f"b{n}")).alias(n) for p, n in zip(peers, names, strict=True)])


def descends(clocked: DataFrame, pairs: DataFrame, peers: list[int]) -> DataFrame:
    """(descendant, ancestor, descends): the descendant's clock has reached the ancestor's counter; an absent ancestor is none."""
    old = clocked.select(F.col("batch_id").alias("ancestor"), F.col("peer").alias("_peer"), F.col("counter").alias("_counter"))
    new = clocked.select(F.col("batch_id").alias("descendant"), *[f"p{p}" for p in peers])
    reached = F.lit(None).cast("long")
    for p in peers:
        reached = F.when(F.col("_peer") == p, F.col(f"p{p}")).otherwise(reached)
    return pairs.join(new, "descendant").join(old, "ancestor", "left").select("descendant", "ancestor", F.coalesce(reached >= F.col("_counter"), F.lit(False)).alias("descends"))


def latest(versions: DataFrame, key: str, value: str, sequence: str) -> DataFrame:
    """The value with the largest sequence of each key."""
    return versions.groupBy(key).agg(F.max_by(value, sequence).alias(value), F.max(sequence).alias(sequence))


def gaps(frames: DataFrame) -> DataFrame:
    """(device, sequence, gap): how far each frame is from the one that should come before it; 1 is no gap."""
    order = Window.partitionBy("device").orderBy("sequence")
    return frames.select("device", "sequence", (F.col("sequence") - F.coalesce(F.lag("sequence").over(order), F.lit(-1))).alias("gap"))


def replayed(frames: DataFrame, extents: DataFrame) -> DataFrame:
    """Frames of each device below its committed extent; what lies beyond never happened."""
    return frames.join(extents, "device").where(F.col("sequence") < F.col("extent")).drop("extent")


def frame_validity(frames: DataFrame) -> DataFrame:
    """(frame_id, outcome): the first check that fails."""
    outcome = F.when(F.col("payload").isNull(), "Missing").when(F.octet_length("payload") == 0, "Empty").when(~F.col("payload_digest").rlike("^[0-9a-f]{64}$"), "Malformed").when(F.sha2(F.col("payload").cast("binary"), 256) != F.col("payload_digest"), "Corrupt").otherwise("Valid")
    return frames.select("frame_id", outcome.alias("outcome"))


def manifest_outcome(manifests: DataFrame) -> DataFrame:
    """(batch_id, outcome) for manifests with counter, heads (array) and objects (array of digests)."""
    heads, objects = F.col("heads"), F.col("objects")
    outcome = (
        F.when(F.col("counter") <= 0, "CounterNotPositive").when((F.array_sort(heads) != heads) | (F.size(F.array_distinct(heads)) != F.size(heads)), "HeadsNotSortedUnique")
        .when(F.array_contains(heads, F.col("batch_id")), "SelfDependency").when(F.size(F.array_distinct(objects)) != F.size(objects), "DuplicateObject").otherwise("Valid")
    )
    return manifests.select("batch_id", outcome.alias("outcome"))
