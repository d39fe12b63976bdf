"""Causality of accepted batches: clocks over any graph of heads, descent, and the checks before a batch is accepted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.limits import REFUSALS, MissingDependency
from factweave.operators.snapshot import first_failure
from factweave.sources.staging import staged


def clocks(batches: DataFrame) -> DataFrame:
    """(batch_id, peer, counter): each batch's clock, the largest counter of each peer among it and its ancestors.

    ``batches`` has batch_id, peer, counter and heads (array of batch ids, each accepted). A batch of a peer has the
    peer's batch before among its ancestors. In each round a batch takes in, pointwise, the clocks of its heads, of
    the batches that its own clock names, and of its peer's batch 1, 2, 4, ... places back, so the reach about
    doubles. Rounds go on until nothing grows, which is when every batch has all of its heads' clocks. A round has
    at most batches times (peers + heads) rows to take in, and no task holds a chain.
    """
    dots = staged(batches.select("batch_id", "peer", "counter"), "dots")
    known = dots.select(F.col("batch_id").alias("via"), F.col("peer").alias("p"), F.col("counter").alias("c"))
    links = staged(batches.select(F.col("batch_id").alias("of"), F.explode("heads").alias("via")).distinct(), "heads")
    if not links.join(known, "via", "left_anti").isEmpty():
        raise MissingDependency("a head is not accepted")
    at = dots.withColumnRenamed("batch_id", "via")
    state, total, back = dots, None, 1
    while True:
        named = state.select(F.col("batch_id").alias("of"), "peer", "counter").join(at, ["peer", "counter"]).select("of", "via")
        jump = dots.select(F.col("batch_id").alias("of"), "peer", (F.col("counter") - back).alias("counter")).join(at, ["peer", "counter"]).select("of", "via")
        via = links.union(named).union(jump).distinct()
        further = via.join(state.withColumnRenamed("batch_id", "via"), "via").select(F.col("of").alias("batch_id"), "peer", "counter")
        state = staged(further.groupBy("batch_id", "peer").agg(F.max("counter").alias("counter")), "clocks")
        if (now := _total(state)) == total:
            return state
        total, back = now, back * 2


def _total(state: DataFrame) -> tuple[int, int]:
    row = state.agg(F.count("*").alias("n"), F.sum("counter").alias("s")).first()
    return row["n"], row["s"] or 0


def union(clocked: DataFrame, group: str) -> DataFrame:
    """The pointwise largest of the clocks of each group."""
    return clocked.groupBy(group, "peer").agg(F.max("counter").alias("counter"))


def continuity(batches: DataFrame, clocked: DataFrame) -> DataFrame:
    """(batch_id, outcome): whether the counter is one more than what the heads know of the batch's own peer."""
    seen = batches.select("batch_id", "peer", F.explode("heads").alias("head")).join(clocked.withColumnsRenamed({"batch_id": "head", "counter": "c"}), ["head", "peer"]).groupBy("batch_id").agg(F.max("c").alias("before"))
    joined = batches.select("batch_id", "counter").join(seen, "batch_id", "left")
    return joined.select("batch_id", F.when(F.col("counter") == F.coalesce("before", F.lit(0)) + 1, "Continuous").otherwise("Gap").alias("outcome"))


def descends(batches: DataFrame, clocked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(descendant, ancestor, descends): the descendant's clock has reached the ancestor's counter.

    An ancestor that is not accepted is no ancestor; a descendant that is not accepted is an error.
    """
    there = batches.select(F.col("batch_id").alias("descendant"), F.lit(True).alias("_there"))
    dots = batches.select(F.col("batch_id").alias("ancestor"), "peer", F.col("counter").alias("_counter"))
    asked = pairs.join(there, "descendant", "left").join(dots, "ancestor", "left")
    reach = clocked.select(F.col("batch_id").alias("descendant"), "peer", F.col("counter").alias("_reach"))
    told = F.coalesce(F.col("_reach") >= F.col("_counter"), F.lit(False))
    return asked.join(reach, ["descendant", "peer"], "left").select("descendant", "ancestor", F.when(F.col("_there"), told).otherwise(F.raise_error(F.lit("MissingDependency: the descendant is not accepted"))).alias("descends"))


def preflight(requests: DataFrame, accepted: DataFrame, compared: Sequence[str], current: int, root: str, stamp: tuple[int, str], given_root: str | None = None) -> DataFrame:
    """(batch_id, outcome) for requests against the accepted batches and the current state, by the first check that tells.

    Malformed (no id, no peer or a counter under 1), Corrupt (the given root is not the stored one), for an accepted id
    BatchCollision (one of the ``compared`` columns differs, nulls being equal), FrontierRegression (the same, but
    the state has not gone past it), MaterializationCollision (another ``materialization``) or Duplicate; else
    MissingDependency (a head is not accepted), AcceptanceOrder (the sequence is not current + 1),
    FrontierRegression (another prior root), Stale (a materialization, and the stamp is not the current state), New.
    """
    old = accepted.select("batch_id", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in compared], F.col("materialization").alias("_materialization"))
    ids = accepted.select(F.col("batch_id").alias("head"))
    unknown = requests.select("batch_id", F.explode("heads").alias("head")).join(ids, "head", "left_anti").select("batch_id").distinct().withColumn("_lacks", F.lit(True))
    joined = requests.join(old, "batch_id", "left").join(unknown, "batch_id", "left")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    has = F.coalesce("_known", F.lit(False))
    checks = [
        (F.col("batch_id").isNull() | F.col("peer").isNull() | (F.coalesce("counter", F.lit(0)) < 1), "Malformed"),
        (F.lit((given_root or root) != root), "Corrupt"),
        (has & ~same, "BatchCollision"),
        (has & ((F.col("sequence") > current) | (F.col("prior_root") == root)), "FrontierRegression"),
        (has & ~F.col("materialization").eqNullSafe(F.col("_materialization")), "MaterializationCollision"),
        (has, "Duplicate"),
        (F.coalesce("_lacks", F.lit(False)), "MissingDependency"),
        (F.col("sequence") != current + 1, "AcceptanceOrder"),
        (F.col("prior_root") != root, "FrontierRegression"),
        (F.col("materialization").isNotNull() & F.lit(tuple(stamp) != (current, root)), "Stale"),
    ]
    return joined.select("batch_id", first_failure(checks, "New").alias("outcome"))


def admitted(outcomes: DataFrame) -> DataFrame:
    """The batches to be applied; raises the error of the first outcome, by batch, that refuses. Duplicates are left out."""
    bad = outcomes.where(~F.col("outcome").isin("New", "Duplicate")).orderBy("batch_id").first()
    if bad:
        raise REFUSALS.get(bad["outcome"], MissingDependency)(f"batch {bad['batch_id']}: {bad['outcome']}")
    return outcomes.where("outcome = 'New'").select("batch_id")


def root_shape(roots: DataFrame) -> DataFrame:
    """(root_id, outcome): a root without batches has no keys, one with batches has both."""
    empty = F.col("batches") == 0
    good = F.when(empty, F.col("map_key").isNull() & F.col("clock_key").isNull()).otherwise(F.col("map_key").isNotNull() & F.col("clock_key").isNotNull())
    return roots.select("root_id", F.when((F.col("batches") >= 0) & good, "Valid").otherwise("Malformed").alias("outcome"))


def manifest_outcome(manifests: DataFrame, version: int = 1, most_bytes: int = 64 << 20) -> DataFrame:
    """(batch_id, outcome) for manifests: version, counter, heads (array), objects (array of struct<document, kind, digest, length>).

    Objects are in strict order of (document, kind, digest, length); the policy is that no digest stands twice.
    """
    heads, objects = F.col("heads"), F.col("objects")
    places = F.sequence(F.lit(1), F.size(objects) - 1)
    fits = F.size(objects) > 1
    repeats = F.when(fits, F.exists(places, lambda i: F.element_at(objects, i) == F.element_at(objects, i + 1))).otherwise(False)
    falls = F.when(fits, F.exists(places, lambda i: F.element_at(objects, i) >= F.element_at(objects, i + 1))).otherwise(False)
    digests = F.transform(objects, lambda o: o["digest"])
    checks = [
        (F.col("version") != version, "UnknownVersion"),
        (F.col("counter") <= 0, "InvalidCausalDot"),
        ((F.array_sort(heads) != heads) | (F.size(F.array_distinct(heads)) != F.size(heads)), "NonCanonicalCausalDependencies"),
        (F.array_contains(heads, F.col("batch_id")), "CausalSelfDependency"),
        (falls & repeats, "DuplicateDescriptor"),
        (falls, "NonCanonicalDescriptors"),
        (F.exists(objects, lambda o: (o["length"] <= 0) | (o["length"] > most_bytes)), "InvalidObjectLength"),
        (F.size(F.array_distinct(digests)) != F.size(digests), "DuplicateObjectDigest"),
    ]
    return manifests.select("batch_id", first_failure(checks, "Valid").alias("outcome"))


def required_objects(manifests: DataFrame, document: str, kind: int) -> DataFrame:
    """(batch_id, digest, length): the objects that each manifest requires for a document and kind."""
    wanted = F.filter("objects", lambda o: (o["document"] == document) & (o["kind"] == kind))
    return manifests.select("batch_id", F.inline(wanted)).select("batch_id", "digest", "length")


def manifest_text(version: str = "version") -> Column:
    """The canonical JSON of a manifest's version, batch_id, counter and heads, in that order, without spaces."""
    return F.to_json(F.struct(F.col(version).alias("version"), "batch_id", "counter", "heads"))


def canonical_outcome(texts: DataFrame, text: str) -> DataFrame:
    """(batch_id, outcome): Canonical if what the text decodes to is written exactly so, NonCanonical, or Malformed."""
    told = F.from_json(F.col(text), "version int, batch_id long, counter long, heads array<long>", {"mode": "PERMISSIVE"})
    again = F.to_json(told)
    bad = told.isNull() | told["version"].isNull() | told["batch_id"].isNull() | told["counter"].isNull() | told["heads"].isNull()
    return texts.select("batch_id", F.when(bad, "Malformed").when(again != F.col(text), "NonCanonical").otherwise("Canonical").alias("outcome"))
