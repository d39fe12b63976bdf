"""Expected schemas of a database of facts: made empty, validated, and checked for integrity."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factweave.functions.limits import Contradiction, Corrupt
from factweave.operators.snapshot import TABLES as GRAPH
from factweave.sources.files import Files

#: Tables of the reference catalog, of stamps and of the frontier, beside those of the graph.
CATALOG = {
    "coverage": "source_page long, source_digest string, stamp_digest string",
    "postings": "source_page long, source_type int, source_entity long, locator string, ordinal long, kind int, target_type int, raw_name string, normalized_name string, raw_uuid string, resolved_page long, resolved_block long",
    "aliases": "source_page long, raw_alias string, normalized_alias string",
    "bindings": "normalized_alias string, candidate_ordinal long, resolved_page long",
}
FRONTIER = {
    "stamp": "sequence long, digest string, catalog_root string",
    "materialized": "sequence long, batch_id long, input_digest string",
    "frontier": "canonical binary, digest string, applied long",
    "documents": "document_id string, canonical binary, sequence long",
    "clocks": "batch_id long, peer long, counter long",
    "applied": "batch_id long, peer long, counter long, sequence long, heads array<long>, digest string, effect string, prior_root string, post_root string, materialization string",
}
DATABASE = GRAPH | CATALOG | FRONTIER
VERSION = 1


def initialise(spark: SparkSession, folder: str, claim: dict, tables: dict[str, str] = DATABASE) -> None:
    """Empty typed tables, and the claim (workspace, lineage) that later opens must make again."""
    files = Files(spark, folder)
    files.publish("claim", json.dumps(claim | {"version": VERSION}, sort_keys=True).encode())
    for name, ddl in tables.items():
        spark.createDataFrame([], ddl).write.mode("errorifexists").parquet(f"{folder}/{name}")


def opened(spark: SparkSession, folder: str, claim: dict, tables: dict[str, str] = DATABASE) -> dict[str, DataFrame]:
    """The tables, if the claim and every schema are as expected; nothing is changed."""
    files = Files(spark, folder)
    if not files.exists("claim") or json.loads(files.read("claim")) != claim | {"version": VERSION}:
        raise Contradiction("the folder has another claim")
    out = {}
    for name, ddl in tables.items():
        out[name] = spark.read.parquet(f"{folder}/{name}")
        if problem := schema_problem(out[name], ddl):
            raise Corrupt(f"{name}: {problem}")
    return out


def schema_problem(df: DataFrame, ddl: str) -> str | None:
    """What sets a table's columns apart from the expected ones, in order; nullability does not count."""
    expected, found = ([(f.name, f.dataType.simpleString()) for f in s] for s in (StructType.fromDDL(ddl), df.schema))
    return None if expected == found else f"expected {expected}, found {found}"


def integrity(df: DataFrame, key: list[str], parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(check, violations): repeated keys, and for each foreign key (column: parent, its key) the rows without a parent."""
    out = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit("unique").alias("check"), "violations")
    for column, (parent, name) in (parents or {}).items():
        lost = df.where(F.col(column).isNotNull()).join(parent.select(F.col(name).alias(column)).distinct(), column, "left_anti")
        out = out.unionByName(lost.agg(F.count("*").alias("violations")).select(F.lit(f"parent of {column}").alias("check"), "violations"))
    return out
