"""Authenticated maps: a root digest over key/value records that depends on the records alone, and the rules of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.encoding import sha256, sized_hex
from factweave.functions.limits import Corrupt

#: Bytes of keys and values.
MAX_KEY, MAX_VALUE = 96, 4096
#: Tags of digests: a record, a bucket of records, the root.
RECORD, BUCKET, ROOT = "00", "01", "02"


def record_digests(records: DataFrame) -> DataFrame:
    """(key, place, leaf): the digest of the key, which gives the record its place, and that of the record."""
    leaf = sha256(F.concat(F.lit(RECORD), sized_hex(F.col("key")), sized_hex(F.col("value"))))
    return records.select("key", F.sha2(F.col("key").cast("binary"), 256).alias("place"), leaf.alias("leaf"))


def buckets(records: DataFrame) -> DataFrame:
    """(bucket, node): the digest of the records with the same first two bytes of place, in order of place."""
    told = record_digests(records)
    inside = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"]), "")
    return told.groupBy(F.substring("place", 1, 4).alias("bucket")).agg(sha256(F.concat(F.lit(BUCKET), inside)).alias("node"))


def root(records: DataFrame) -> DataFrame:
    """One row (root). The records' order, partitions and history do not count, only what they are.

    A record's bucket is told by its key's digest, so buckets are even whatever the keys, and at most 65,536 digests
    meet in the last step.
    """
    fold = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "node"))), lambda x: F.concat(x["bucket"], x["node"])), "")
    return buckets(records).agg(sha256(F.concat(F.lit(ROOT), fold)).alias("root"))


def authenticated(asked: DataFrame, records: DataFrame, expected: str) -> DataFrame:
    """(key, outcome) for asked (key, value): Present, Different or Absent; refused if the records have another root."""
    if (found := root(records).first()["root"]) != expected:
        raise Corrupt(f"the records have the root {found}")
    known = record_digests(records).select("key", F.col("leaf").alias("_leaf"))
    told = record_digests(asked).join(known, "key", "left")
    return told.select("key", F.when(F.col("_leaf").isNull(), "Absent").when(F.col("_leaf") == F.col("leaf"), "Present").otherwise("Different").alias("outcome"))


def proof(records: DataFrame, key: str) -> dict:
    """What proves a record against the root: the digests of its bucket's records and those of all buckets."""
    place = records.sparkSession.range(1).select(F.sha2(F.lit(key).cast("binary"), 256)).first()[0]
    inside = record_digests(records).where(F.startswith(F.col("place"), F.lit(place[:4]))).orderBy("place").collect()
    return {"key": key, "inside": [(r["place"], r["leaf"]) for r in inside], "buckets": [(r["bucket"], r["node"]) for r in buckets(records).orderBy("bucket").collect()]}


def proves(told: dict, value: str, expected: str) -> bool:
    """Whether the proof shows that the key has the value in the map with the root."""
    from hashlib import sha256 as hashed

    key, content = told["key"].encode(), value.encode()
    place = hashed(key).hexdigest()
    leaf = hashed(bytes.fromhex(RECORD) + len(key).to_bytes(8, "big") + key + len(content).to_bytes(8, "big") + content).hexdigest()
    node = hashed(bytes.fromhex(BUCKET + "".join(x for _, x in sorted(told["inside"])))).hexdigest()
    whole = hashed(bytes.fromhex(ROOT + "".join(b + n for b, n in sorted(told["buckets"])))).hexdigest()
    return (place, leaf) in told["inside"] and (place[:4], node) in told["buckets"] and whole == expected


def key_outcome(records: DataFrame) -> DataFrame:
    """(key, outcome): KeyLength, ValueLength, PrefixOfAnother or Valid.

    A key may not begin another. Keys are cut to each length that keys have, at most MAX_KEY of them, and met by
    equality, so no task needs all keys in order.
    """
    size = F.octet_length("key")
    lengths = sorted(r[0] for r in records.select(size.alias("n")).where(f"n between 1 and {MAX_KEY}").distinct().collect())
    data = F.col("key").cast("binary")
    cut = F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n < size)).alias("n")
    starts = records.select(data.alias("_key"), cut).select(F.col("_key").substr(F.lit(1), F.col("n")).alias("_start")).distinct().withColumn("_begins", F.lit(True))
    told = records.withColumn("_start", data).join(starts, "_start", "left")
    length = F.octet_length("value")
    return told.select("key", F.when((size < 1) | (size > MAX_KEY), "KeyLength").when((length < 1) | (length > MAX_VALUE), "ValueLength").when(F.col("_begins"), "PrefixOfAnother").otherwise("Valid").alias("outcome"))


def sorted_unique(keys: list) -> bool:
    """Whether keys are in strict order, as a lookup of many demands."""
    return all(a < b for a, b in zip(keys, keys[1:], strict=False))
