"""Files of exact bytes in any storage that Hadoop reaches: published once, read with a bound, replaced by compare-and-swap."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.limits import ByteCollision, ResourceLimit, Stale


class Files:
    """Exact files in one folder. Names are single path elements."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(self.folder))

    def _at(self, name: str):
        if not name or "/" in name or name in (".", ".."):
            raise ValueError(f"not a file name: {name!r}")
        return self._path(f"{self.folder}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isFile())

    def read(self, name: str, most: int = 1 << 20, exactly: int | None = None) -> bytes:
        """The file's bytes; refused if there are more than ``most``, or not ``exactly`` so many."""
        size = self._fs.getFileStatus(self._at(name)).getLen()
        if size > most or exactly not in (None, size):
            raise ResourceLimit(f"{name} has {size} bytes")
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    def _write(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self._at(name), False)
        try:
            stream.write(data)
        finally:
            stream.close()

    def _holds(self, name: str, data: bytes) -> bool:
        return self._fs.getFileStatus(self._at(name)).getLen() == len(data) and self.read(name, most=len(data)) == data

    def publish(self, name: str, data: bytes) -> bool:
        """Writes the file aside and renames it. The same bytes again are a no-op (False); other bytes are refused."""
        if self.exists(name):
            if self.read(name, most=max(len(data), self._fs.getFileStatus(self._at(name)).getLen())) != data:
                raise ByteCollision(f"{name} is there with other bytes")
            return False
        aside = f".{name}.{uuid.uuid4().hex}"
        self._write(aside, data)
        if not self._fs.rename(self._at(aside), self._at(name)):
            self._fs.delete(self._at(aside), False)
            return self.publish(name, data)
        return True

    def publish_all(self, files: Mapping[str, bytes]) -> int:
        """Publishes many files; how many were new."""
        return sum([self.publish(name, data) for name, data in sorted(files.items())])

    def replace(self, name: str, expected: bytes | None, data: bytes) -> None:
        """Compare-and-swap: the file must hold the expected bytes (None: must not be there)."""
        there = self.exists(name)
        if there != (expected is not None) or (there and not self._holds(name, expected)):
            raise Stale(f"{name} has changed")
        aside = f".{name}.{uuid.uuid4().hex}"
        self._write(aside, data)
        if expected is not None:
            self._fs.delete(self._at(name), False)
        if not self._fs.rename(self._at(aside), self._at(name)):
            raise Stale(f"{name} has changed")

    def retire(self, name: str) -> str:
        """Renames the file out of the way; nothing is deleted."""
        retired = f"retired-{uuid.uuid4().hex}-{name}"
        self._fs.rename(self._at(name), self._at(retired))
        return retired


def fingerprints(files: DataFrame, key: str, content: str, width: int = 64 << 10, samples: int = 8) -> DataFrame:
    """(key, length, first, last, interior): digests of a file's first and last bytes and of evenly spaced samples.

    ``content`` is binary, as the binaryFile source gives it.
    """
    data, size = F.col(content), F.octet_length(content).cast("long")
    step = F.greatest(F.lit(0), F.expr(f"(octet_length(`{content}`) - {width}) div {samples + 1}"))
    inside = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.hex(data.substr((i * step + 1).cast("int"), F.lit(width))))
    return files.select(
        key, size.alias("length"), F.sha2(F.substring(data, 1, width), 256).alias("first"), F.sha2(data.substr(F.greatest(F.lit(1), size.cast("int") - width + 1), F.lit(width)), 256).alias("last"),
        F.sha2(F.unhex(F.array_join(inside, "")), 256).alias("interior"),
    )
