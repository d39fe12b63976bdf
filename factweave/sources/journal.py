"""Journals of frames: segments read and recovered, and a journal whose frontier alone says what is committed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.encoding import CHECKSUM_BYTES, FRAME_VERSION, HEADER_BYTES, MAGIC, MAX_FRAME_BYTES, MAX_HEADER_BYTES, MIN_FRAME_BYTES, PREFIX_BYTES, frame, frame_fields, frame_outcome
from factweave.functions.limits import AcceptanceOrder, Corrupt
from factweave.sources.files import Files


@dataclass
class Scan:
    """What a segment holds: frames (sequence, kind, payload), committed bytes, bytes of a torn tail, the first error."""

    frames: list[tuple[int, int, bytes]] = field(default_factory=list)
    committed: int = 0
    torn: int = 0
    error: str | None = None


def scanned(data: bytes, device: int, base: int = 0) -> Scan:
    """Reads frames one after the other. Only a tail too short for any frame is an interrupted append; all else that does not read is damage, and is told with its place."""
    out, expected = Scan(), base
    while (left := len(data) - out.committed) > 0:
        at = out.committed
        if left < MIN_FRAME_BYTES:
            out.torn = left
            return out
        header, payload = int.from_bytes(data[at + 8 : at + 12], "big"), int.from_bytes(data[at + 12 : at + 20], "big")
        total = PREFIX_BYTES + CHECKSUM_BYTES + header + payload
        problem = (
            "InvalidFrameMagic" if data[at : at + 8] != MAGIC else "FrameHeaderTooLarge" if header > MAX_HEADER_BYTES else "FrameTooLarge" if total > MAX_FRAME_BYTES
            else "LengthExceedsSegment" if total > left else None
        )
        if problem is None:
            one = data[at : at + total]
            head = one[PREFIX_BYTES : PREFIX_BYTES + HEADER_BYTES]
            content = one[PREFIX_BYTES + header : -CHECKSUM_BYTES]
            found, sequence = int.from_bytes(head[2:10], "big", signed=True), int.from_bytes(head[10:18], "big")
            problem = (
                "ChecksumMismatch" if hashlib.sha256(one[:-CHECKSUM_BYTES]).digest() != one[-CHECKSUM_BYTES:] else "NonCanonicalFrameHeader" if header != HEADER_BYTES
                else "UnknownFrameSchemaVersion" if int.from_bytes(head[:2], "big") != FRAME_VERSION else "PayloadDigestMismatch" if hashlib.sha256(content).digest() != head[19:51]
                else "SegmentDeviceMismatch" if found != device else "SegmentSequenceGap" if sequence != expected else None
            )
        if problem:
            out.error = f"{problem} at {at}"
            return out
        out.frames.append((sequence, head[18], content))
        out.committed += total
        expected = sequence + 1
    return out


def read_segments(segments: DataFrame, extents: bool = False) -> DataFrame:
    """(device, sequence, kind, payload, committed, torn, error) of segments (device, base, content binary).

    Segments are read in parallel, each in order. With ``extents`` there is a column extent: only so many bytes count,
    what lies beyond never happened. A segment without frames, or with an error, has one row with a null sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen = scanned(row["content"][: row["extent"]] if extents else row["content"], row["device"], row["base"])
                rows = [(row["device"], *f, seen.committed, seen.torn, None) for f in seen.frames]
                if seen.error or not rows:
                    rows.append((row["device"], None, None, None, seen.committed, seen.torn, seen.error))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["device", "sequence", "kind", "payload", "committed", "torn", "error"])

    wanted = ["device", "base", "content", *(["extent"] if extents else [])]
    return segments.select(*wanted).mapInArrow(run, "device long, sequence long, kind int, payload binary, committed long, torn long, error string")


class Journal:
    """Frames of many devices in a folder. The frontier file is the only authority on what is committed.

    ``append`` writes the frames of a batch as one epoch and then swaps the frontier, which has the epochs and names
    the table of each device's next sequence; so it stays small, however many devices there are. An epoch whose swap
    did not happen was not appended: no read sees it, and ``recover`` retires it. A batch that does not go on where
    the frontier ends is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, f"{self.folder}/frontier")

    def frontier(self) -> dict:
        return json.loads(self.files.read("current", most=64 << 20)) if self.files.exists("current") else {"epochs": [], "next": None}

    def next(self) -> DataFrame:
        """(device, next) of each device that has committed frames."""
        return self._next(self.frontier()["next"])

    def _next(self, name: str | None) -> DataFrame:
        schema = "device long, next long"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/next/{name}") if name else self.spark.createDataFrame([], schema)

    def _go_on(self, frames: DataFrame, before: str | None) -> str:
        """Writes the table of next sequences after these frames; its name. The devices are compared by Spark, and the driver gets the first that is refused."""
        name = uuid.uuid4().hex
        path = f"{self.folder}/next/{name}"
        sequence, expected = F.col("sequence").cast("long"), F.coalesce("next", F.lit(0))
        told = frames.groupBy(F.col("device").cast("long").alias("device")).agg(F.min(sequence).alias("low"), F.max(sequence).alias("high"), F.count_distinct(sequence).alias("n"), F.count("*").alias("rows"))
        good = (F.col("low") == expected) & (F.col("n") == F.col("rows")) & (F.col("high") - F.col("low") + 1 == F.col("n")) & F.col("device").isNotNull()
        problem = F.format_string("device %s expects %s, got %s to %s in %s frames", "device", expected, "low", "high", "rows")
        both = told.join(self._next(before).hint("merge"), "device", "full_outer")
        both.select("device", F.coalesce(F.col("high") + 1, "next").alias("next"), F.when(F.col("rows").isNotNull() & ~F.coalesce(good, F.lit(False)), problem).alias("problem")).write.parquet(path)
        refused = self.spark.read.schema("device long, problem string").parquet(path).where("problem is not null").agg(F.min_by("problem", "device").alias("first"), F.min("problem").alias("any")).first()
        if refused["any"]:
            self._delete(name)
            raise AcceptanceOrder(refused["first"] or refused["any"])
        return name

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/next/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def append(self, frames: DataFrame) -> int:
        """Appends frames (device, sequence, kind, payload); the epoch they are in."""
        before = self.frontier()
        after = self._go_on(frames, before["next"])
        epoch = max(before["epochs"], default=-1) + 1
        path = f"{self.folder}/epochs/{epoch}"
        frames.select("device", "sequence", frame(F.col("device"), F.col("sequence"), F.col("kind"), F.col("payload")).alias("frame")).write.mode("overwrite").parquet(path)
        expected = json.dumps(before, sort_keys=True).encode() if before["epochs"] else None
        self.files.replace("current", expected, json.dumps({"epochs": [*before["epochs"], epoch], "next": after}, sort_keys=True).encode())
        if before["next"]:
            self._delete(before["next"])
        return epoch

    def read(self) -> DataFrame:
        """(device, sequence, kind, payload) of all committed frames; the read fails if one of them is damaged."""
        known = self.frontier()["epochs"]
        if not known:
            return self.spark.createDataFrame([], "device long, sequence long, kind int, payload binary")
        raw = self.spark.read.parquet(*[f"{self.folder}/epochs/{e}" for e in known])
        outcome = frame_outcome(F.col("frame"))
        checked = raw.select(F.when(outcome == "Valid", frame_fields(F.col("frame"))).otherwise(F.raise_error(F.concat(F.lit("Corrupt: "), outcome))).alias("f"))
        return checked.select("f.*")

    def replay(self) -> DataFrame:
        """Committed frames by device and sequence."""
        return self.read().orderBy("device", "sequence")

    def recover(self) -> list[str]:
        """Retires epochs that the frontier does not name; refuses a journal that lacks one it names."""
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/epochs")
        fs = jvm_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        there = [s.getPath() for s in fs.listStatus(jvm_path)] if fs.exists(jvm_path) else []
        known = {str(e) for e in self.frontier()["epochs"]}
        if missing := known - {p.getName() for p in there}:
            raise Corrupt(f"epochs {sorted(missing)} are gone")
        retired = [p for p in there if p.getName() not in known and not p.getName().startswith("retired-")]
        for p in retired:
            fs.rename(p, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/epochs/retired-{p.getName()}"))
        return sorted(p.getName() for p in retired)
