"""Canonical bytes of typed values, rows and journal frames, made of DataFrame functions.

Bytes are put together as hexadecimal text and turned into binary once, so all of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, FloatType, IntegralType, StringType

#: Tags of canonical values.
NULL, INTEGER, REAL, TEXT, BLOB = "00", "01", "02", "03", "04"
#: The layout of a frame: magic, header length (4 bytes), payload length (8), header, payload, SHA-256 of all before.
MAGIC, FRAME_VERSION = b"FWJRNL01", 1
PREFIX_BYTES, HEADER_BYTES, CHECKSUM_BYTES = 20, 51, 32
SEAL_MAGIC = b"FWSEAL01"
MIN_FRAME_BYTES, MAX_HEADER_BYTES, MAX_FRAME_BYTES = PREFIX_BYTES + CHECKSUM_BYTES, 1 << 10, 64 << 20


def number_hex(value: Column, size: int = 8) -> Column:
    """A whole number in so many bytes, the largest first; negative ones in two's complement."""
    return F.lower(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def sized_hex(value: Column) -> Column:
    """The bytes of a text or binary value behind their number."""
    return F.concat(number_hex(F.octet_length(value)), F.lower(F.hex(value.cast("binary"))))


def value_hex(value: Column, kind: DataType) -> Column:
    """A value behind its type, so that 1, 1.0, "1" and null are four different values; 0.0 and -0.0 are two."""
    if isinstance(kind, (IntegralType, BooleanType)):
        told = F.concat(F.lit(INTEGER), number_hex(value))
    elif isinstance(kind, (DoubleType, FloatType)):
        bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value.cast("double"))
        told = F.concat(F.lit(REAL), number_hex(bits.cast("long")))
    elif isinstance(kind, (StringType, BinaryType)):
        told = F.concat(F.lit(TEXT if isinstance(kind, StringType) else BLOB), sized_hex(value))
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.when(value.isNull(), F.lit(NULL)).otherwise(told)


def row_hex(df: DataFrame, columns: Sequence[str]) -> Column:
    """The number of columns, then each value behind the number of its bytes."""
    values = [value_hex(F.col(c), df.schema[c].dataType) for c in columns]
    return F.concat(number_hex(F.lit(len(columns))), *[F.concat(number_hex(F.length(v) / 2), v) for v in values])


def sha256(hexadecimal: Column) -> Column:
    return F.sha2(F.unhex(hexadecimal), 256)


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (rows, digest) that depends on the table's typed rows alone, not on their order or partitions.

    Rows meet by the first two bytes of their digest, so a task sorts a 65,536th of them; the digests of these
    buckets are folded in order.
    """
    rows = df.select(sha256(row_hex(df, columns)).alias("h")).withColumn("bucket", F.substring("h", 1, 4))
    each = rows.groupBy("bucket").agg(sha256(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("d"), F.count("*").alias("n"))
    fold = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda x: F.concat(x["bucket"], x["d"])), "")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), sha256(fold).alias("digest"))


def table_digests(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(name, rows, digest) of each table."""
    out = None
    for name, (df, columns) in sorted(tables.items()):
        one = table_digest(df, columns).select(F.lit(name).alias("name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def database_digest(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row (digest) over all tables' names, columns, numbers of rows and digests, by name."""
    named = {n: F.lit(n.encode().hex() + "".join(f"2c{c.encode().hex()}" for c in columns)) for n, (_, columns) in tables.items()}
    told = table_digests(tables)
    label = F.lit("")
    for name, text in named.items():
        label = F.when(F.col("name") == name, text).otherwise(label)
    each = told.select(F.struct("name", F.concat(label, number_hex(F.col("rows")), "digest").alias("x")).alias("s"))
    return each.agg(sha256(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]), "")).alias("digest"))


def sealed(schema: Column, payload: Column) -> Column:
    """An envelope that binds a payload to its schema number and its digest: magic, schema (4 bytes), payload length (8), payload, SHA-256 of the payload."""
    data = payload.cast("binary")
    return F.unhex(F.concat(F.lit(SEAL_MAGIC.hex()), number_hex(schema, 4), sized_hex(data), F.sha2(data, 256)))


def sealed_fields(data: Column) -> Column:
    """struct(schema, payload, digest) of an envelope, whose digest need not hold; null if the layout does not, or bytes follow."""
    size, head = F.octet_length(data), len(SEAL_MAGIC) + 12
    length = _number(data, len(SEAL_MAGIC) + 4, 8)
    whole = (size >= head + CHECKSUM_BYTES) & (F.substring(data, 1, len(SEAL_MAGIC)) == F.lit(SEAL_MAGIC)) & (length == size - head - CHECKSUM_BYTES)
    fields = F.struct(
        _number(data, len(SEAL_MAGIC), 4).cast("long").alias("schema"), data.substr(F.lit(head + 1), size - (head + CHECKSUM_BYTES)).alias("payload"),
        F.lower(F.hex(data.substr(size - CHECKSUM_BYTES + 1, F.lit(CHECKSUM_BYTES)))).alias("digest"),
    )
    return F.when(whole, fields)


def sealed_outcome(data: Column, schema: int) -> Column:
    """Malformed, UnknownSchema, DigestMismatch or Valid, in this order: a foreign schema is told before a forged digest."""
    found = sealed_fields(data)
    return F.when(found.isNull(), "Malformed").when(found["schema"] != schema, "UnknownSchema").when(F.sha2(found["payload"], 256) != found["digest"], "DigestMismatch").otherwise("Valid")


def frame(device: Column, sequence: Column, kind: Column, payload: Column) -> Column:
    """A journal frame: whole numbers device and sequence, a kind of one byte, and the payload, as binary."""
    data = payload.cast("binary")
    header = F.concat(number_hex(F.lit(FRAME_VERSION), 2), number_hex(device), number_hex(sequence), number_hex(kind, 1), F.sha2(data, 256))
    body = F.concat(F.lit(MAGIC.hex()), number_hex(F.lit(HEADER_BYTES), 4), number_hex(F.octet_length(data)), header, F.lower(F.hex(data)))
    return F.unhex(F.concat(body, sha256(body)))


def _number(data: Column, begin: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, begin + 1, size)), 16, 10).cast("decimal(20,0)")


def frame_outcome(data: Column) -> Column:
    """Valid, or the first check that fails, in the order size, magic, lengths, checksum, version, header, payload."""
    size = F.octet_length(data)
    header, payload = _number(data, len(MAGIC), 4), _number(data, len(MAGIC) + 4, 8)
    total = F.lit(PREFIX_BYTES + CHECKSUM_BYTES) + header + payload
    body = data.substr(F.lit(1), size - CHECKSUM_BYTES)
    checksum = F.lower(F.hex(data.substr(size - CHECKSUM_BYTES + 1, F.lit(CHECKSUM_BYTES))))
    content = data.substr(F.lit(PREFIX_BYTES + HEADER_BYTES + 1), size - (PREFIX_BYTES + HEADER_BYTES + CHECKSUM_BYTES))
    return (
        F.when(data.isNull(), "Missing").when(size > MAX_FRAME_BYTES, "FrameTooLarge").when(size < MIN_FRAME_BYTES, "TruncatedFrame")
        .when(F.substring(data, 1, len(MAGIC)) != F.lit(MAGIC), "InvalidFrameMagic").when(header > MAX_HEADER_BYTES, "FrameHeaderTooLarge").when(total > MAX_FRAME_BYTES, "FrameTooLarge")
        .when(total != size, "FrameLengthMismatch").when(F.sha2(body, 256) != checksum, "ChecksumMismatch").when(_number(data, PREFIX_BYTES, 2) != FRAME_VERSION, "UnknownFrameSchemaVersion")
        .when(header != HEADER_BYTES, "NonCanonicalFrameHeader").when(F.sha2(content, 256) != F.lower(F.hex(F.substring(data, PREFIX_BYTES + 20, 32))), "PayloadDigestMismatch").otherwise("Valid")
    )


def frame_fields(data: Column) -> Column:
    """struct(device, sequence, kind, payload) of a valid frame."""
    size = F.octet_length(data)
    return F.struct(
        _number(data, PREFIX_BYTES + 2, 8).cast("long").alias("device"), _number(data, PREFIX_BYTES + 10, 8).cast("long").alias("sequence"), _number(data, PREFIX_BYTES + 18, 1).cast("int").alias("kind"),
        data.substr(F.lit(PREFIX_BYTES + HEADER_BYTES + 1), size - (PREFIX_BYTES + HEADER_BYTES + CHECKSUM_BYTES)).alias("payload"),
    )
