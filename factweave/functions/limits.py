"""Errors and bounds of reads, and cursor pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ROWS, MAX_QUERY_BYTES, MAX_READ_BYTES = 10_000, 64 << 10, 64 << 20
#: Bytes charged for a row of each read besides its strings, which cost their bytes and 16 each.
CHARGES = {"page": 64, "inventory": 32, "navigation": 32, "alias": 16, "name": 0, "block": 96, "structure": 48, "candidate": 72, "referrer": 64, "property": 64, "tag": 64, "task": 64, "search": 72}


class FactError(Exception):
    """Anything that a read or a change refuses."""


class InvalidQuery(FactError): ...


class ResourceLimit(FactError): ...


class Stale(FactError): ...


class Corrupt(FactError): ...


class Incomplete(FactError): ...


class Contradiction(FactError): ...


class BatchCollision(FactError): ...


class AcceptanceOrder(FactError): ...


class MissingDependency(FactError): ...


class FrontierRegression(FactError): ...


class MaterializationCollision(FactError): ...


class ByteCollision(FactError): ...


#: The error of each outcome that refuses a request.
REFUSALS = {c.__name__: c for c in (Corrupt, Stale, BatchCollision, MaterializationCollision, AcceptanceOrder, MissingDependency, FrontierRegression, Incomplete, Contradiction)}


def checked_entities(df: DataFrame, kind: str = "entity_type", ident: str | None = None, width: int = 16) -> DataFrame:
    """df, whose read fails as Corrupt at an entity type other than 0 and 1, or a binary id of another width."""
    good = F.col(kind).isin(0, 1)
    if ident is not None:
        good = good & (F.octet_length(ident) == width)
    return df.where(F.when(good, True).otherwise(F.raise_error(F.lit("Corrupt: entity type or id"))))


def checked_headers(df: DataFrame, refused: Column, reason: str) -> DataFrame:
    """df, whose read fails at the first row that ``refused`` holds for; a validator of (path, kind) is such a condition."""
    return df.where(F.when(~F.coalesce(refused, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"InvalidQuery: {reason}"))))


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_ROWS:
        raise InvalidQuery(f"limit {limit} is not in 1..{MAX_ROWS}")
    return limit


def checked_text(text: str, blank: bool = False) -> str:
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise ResourceLimit(f"query text has over {MAX_QUERY_BYTES} bytes")
    if not blank and not text.strip():
        raise InvalidQuery("blank query text")
    return text


def after(columns: Sequence[str], cursor: Sequence | None) -> Column:
    """Rows past the cursor in the order of the columns. Written out in ANDs and ORs, which reach the Parquet scan."""
    if cursor is None:
        return F.lit(True)
    if len(cursor) != len(columns) or any(c is None for c in cursor):
        raise InvalidQuery("a cursor has all its columns or none")
    out = None
    for i in range(len(columns)):
        part = F.col(columns[i]) > F.lit(cursor[i])
        for name, value in zip(columns[:i], cursor[:i], strict=True):
            part = (F.col(name) == F.lit(value)) & part
        out = part if out is None else out | part
    return out


def page(df: DataFrame, order: Sequence[str | Column], limit: int, kind: str = "page") -> DataFrame:
    """The first rows in order. The read fails, and is never cut short, if they hold more than MAX_READ_BYTES."""
    first = df.orderBy(*order).limit(checked_limit(limit))
    texts = [f.name for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    cost = F.lit(CHARGES[kind])
    for name in texts:
        cost = cost + F.coalesce(F.octet_length(name) + 16, F.lit(0))
    total = F.sum(cost).over(Window.partitionBy())  # at most MAX_ROWS rows, which one task holds already
    return first.withColumn("_bytes", total).where(F.when(F.col("_bytes") <= MAX_READ_BYTES, True).otherwise(F.raise_error(F.lit("ResourceLimit: the read exceeds its byte budget")))).drop("_bytes")


def cursor_page(df: DataFrame, keys: Sequence[str], cursor: Sequence | None, limit: int, kind: str = "page") -> DataFrame:
    return page(df.where(after(keys, cursor)), list(keys), limit, kind)
