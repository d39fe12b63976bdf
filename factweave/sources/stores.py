"""Immutable Parquet files behind a head: packs of records named by their digests, and the levels of a merge tree.

A head is one small file swapped by compare-and-swap. It names a catalog by its digest, and the catalog names every
folder that counts; folders are never found by listing. A writer that loses the swap leaves folders that no head
names, which ``reclaim`` retires.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.limits import Corrupt, ResourceLimit, Stale
from factweave.operators.compaction import MERGED, PACKS
from factweave.sources.files import Files

#: Packs that a catalog may hold, and its bytes.
MAX_PACKS, MAX_CATALOG_BYTES = 256, 64 << 20


class Head:
    """A catalog (a dict) behind a head file; each names the one before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files, self.catalogs = Files(spark, f"{self.folder}/head"), Files(spark, f"{self.folder}/catalogs")

    def digest(self) -> str | None:
        return self.files.read("current", exactly=64).decode() if self.files.exists("current") else None

    def catalog(self) -> dict:
        """The catalog that the head names; Corrupt if it has another digest."""
        if (named := self.digest()) is None:
            return {"generation": 0, "previous": None, "entries": []}
        data = self.catalogs.read(named, most=MAX_CATALOG_BYTES)
        if hashlib.sha256(data).hexdigest() != named:
            raise Corrupt(f"the catalog {named} has another digest")
        return json.loads(data)

    def advance(self, before: dict, entries: list[dict]) -> dict:
        """Publishes the catalog that follows ``before``, then swaps the head; Stale if ``before`` is not the newest."""
        named = self.digest()
        if self.catalog() != before:
            raise Stale("the head has moved")
        after = {"generation": before["generation"] + 1, "previous": named, "entries": entries}
        data = json.dumps(after, sort_keys=True).encode()
        if len(data) > MAX_CATALOG_BYTES:
            raise ResourceLimit(f"the catalog has {len(data)} bytes")
        told = hashlib.sha256(data).hexdigest()
        self.catalogs.publish(told, data)
        self.files.replace("current", named.encode() if named else None, told.encode())
        return after

    def path(self, entry: dict) -> str:
        return f"{self.folder}/data/{entry['name']}"

    def reclaim(self) -> list[str]:
        """Renames folders of known names that the catalog does not name; others are left alone. No writer may be at work."""
        live = {e["name"] for e in self.catalog()["entries"]}
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        there = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        gone = [p for p in there if p.getName().startswith(("pack-", "run-")) and p.getName() not in live]
        for p in gone:
            fs.rename(p, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/retired-{p.getName()}"))
        return sorted(p.getName() for p in gone)


def _verified(digest: str, content: str) -> Column:
    return F.when(F.sha2(F.col(content), 256) == F.col(digest), F.col(content)).otherwise(F.raise_error(F.concat(F.lit("Corrupt: the record of "), F.col(digest))))


class Packs(Head):
    """Records (digest, content) in packs, sorted by digest, so that a lookup of a few reads only the row groups they may be in."""

    def _put(self, records: DataFrame, name: str) -> dict:
        once = records.groupBy("digest").agg(F.first("content").alias("content"))  # equal digests, equal bytes
        once.repartitionByRange("digest").sortWithinPartitions("digest").write.parquet(self.path({"name": name}))
        told = self.spark.read.parquet(self.path({"name": name})).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("size"), F.min("digest").alias("low"), F.max("digest").alias("high")).first()
        return {"name": name} | told.asDict()

    def add(self, contents: DataFrame, column: str = "content") -> dict:
        """Puts a pack of these binary contents (nulls are left out) in place; the new catalog."""
        before = self.catalog()
        if len(before["entries"]) >= MAX_PACKS:
            raise ResourceLimit(f"the catalog holds {MAX_PACKS} packs: compact first")
        data = F.col(column).cast("binary")
        entry = self._put(contents.where(F.col(column).isNotNull()).select(F.sha2(data, 256).alias("digest"), data.alias("content")), f"pack-{uuid.uuid4().hex}")
        return self.advance(before, [*before["entries"], entry])

    def _read(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], "digest string, content binary")
        return self.spark.read.schema("digest string, content binary").parquet(*[self.path(e) for e in entries])

    def read(self) -> DataFrame:
        """(digest, content) of all records, each once; the read fails if one has another digest."""
        return self._read(self.catalog()["entries"]).groupBy("digest").agg(F.first("content").alias("content")).select("digest", _verified("digest", "content").alias("content"))

    def get(self, digests: list[str]) -> dict[str, bytes]:
        """The contents of a few digests, from the packs whose range may hold them; those that no pack has are left out."""
        near = [e for e in self.catalog()["entries"] if any(e["low"] is not None and e["low"] <= d <= e["high"] for d in digests)]
        found = self._read(near).where(F.col("digest").isin(digests)).select("digest", _verified("digest", "content").alias("content"))
        return {r["digest"]: bytes(r["content"]) for r in found.collect()}

    def lookup(self, asked: DataFrame) -> DataFrame:
        """(digest, content) for each row of asked (digest); null where no pack has it."""
        return asked.select("digest").join(self.read(), "digest", "left")

    def plan(self) -> list[dict]:
        """The oldest packs of the first tier (by power of two of their bytes) that holds too many; none if no tier does."""
        tiers: dict[int, list[dict]] = {}
        for e in self.catalog()["entries"]:  # in order of age
            tiers.setdefault(e["size"].bit_length(), []).append(e)
        return next((packs[:MERGED] for _, packs in sorted(tiers.items()) if len(packs) > PACKS), [])

    def compact(self) -> bool:
        """Merges the planned packs into one, verified; whether there were any. Readers of the old catalog keep their packs."""
        before, old = self.catalog(), self.plan()
        if not old:
            return False
        records = self._read(old).select("digest", _verified("digest", "content").alias("content"))
        entry, gone = self._put(records, f"pack-{uuid.uuid4().hex}"), {e["name"] for e in old}
        self.advance(before, [entry, *[e for e in before["entries"] if e["name"] not in gone]])
        return True


class Levels(Head):
    """Newest-wins records (key, value) in runs, one a level at most; a null value deletes, and deletions are kept."""

    def insert_many(self, records: DataFrame) -> dict:
        """Adds records with distinct keys as the newest: all full levels below the first empty one are merged with them, as a binary number carries.

        Of n insertions a record is so rewritten log2(n) times at most, and there are as many runs to read.
        """
        before = self.catalog()
        held = {e["level"]: e for e in before["entries"]}
        free = next(n for n in range(len(held) + 1) if n not in held)
        generation = before["generation"] + 1
        merged = records.select("key", "value", F.lit(generation).cast("long").alias("generation"))
        if free:
            merged = merged.unionByName(self._read([held[n] for n in range(free)]))
        name = f"run-{uuid.uuid4().hex}"
        newest = merged.groupBy("key").agg(F.count_if(F.col("generation") == generation).alias("n"), F.max_by(F.struct("value", "generation"), "generation").alias("top"))
        checked = newest.where(F.when(F.col("n") <= 1, True).otherwise(F.raise_error(F.concat(F.lit("Contradiction: the key occurs twice: "), F.col("key").cast("string")))))
        checked.select("key", "top.value", "top.generation").sortWithinPartitions("key").write.parquet(self.path({"name": name}))
        return self.advance(before, [*[e for n, e in sorted(held.items()) if n > free], {"name": name, "level": free}])

    def _read(self, entries: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[self.path(e) for e in entries]).select("key", "value", "generation")

    def read(self, deletions: bool = False) -> DataFrame:
        """(key, value, generation) of the newest record of each key."""
        entries = self.catalog()["entries"]
        if not entries:
            return self.spark.createDataFrame([], "key string, value string, generation long")
        newest = self._read(entries).groupBy("key").agg(F.max_by(F.struct("value", "generation"), "generation").alias("top")).select("key", "top.value", "top.generation")
        return newest if deletions else newest.where("value is not null")

    def lookup(self, key) -> object:
        """The newest value of a key, or None; the key reaches the scans of all levels."""
        found = self.read().where(F.col("key") == F.lit(key)).first()
        return found["value"] if found else None
