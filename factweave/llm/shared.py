"""What several operators share: stored intermediates, Python workers, connected components."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Long texts make 10,000 rows, Spark's default, too much for a worker.
ARROW_ROWS = 512
#: Rows of a table that joins send to all executors; larger ones meet in sort-merge joins.
FEW_ROWS = 16_384


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="factweave-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own only on a local master without one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file://" + _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


#: Folders that stored() wrote within each scratch() that is open, innermost last.
_written: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that stores an operator's result; all else that stored() wrote inside goes on leaving."""
    kept: list[str] = []

    def result(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        kept.append(_written[-1].pop())
        return out

    _written.append([])
    try:
        yield result
    finally:
        for path in _written.pop():
            _delete(spark, path)
        if _written:
            _written[-1] += kept


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing needs it."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def for_python(spark: SparkSession) -> None:
    """Bounds Arrow batches, and lets the workers of this session import the package from where the driver has it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def row_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def told_apart(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with the hint of how to join it, by its number of rows: Spark's own estimate is that of its compressed file, and of one element for an array."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FEW_ROWS else df.hint("merge")


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the component's smallest node.

    Alternating large-star and small-star rounds on distinct edges: each node's neighbours are re-hung under
    the smallest of them, which needs logarithmically many rounds and at most one row for each edge. A hub's
    rows meet only in a sort-merge join, whose hot side Spark splits, and in pre-aggregated minima. Where few edges
    are left, the minima are broadcast.
    Null ends and loops are ignored; no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = stored(edges, name)
    mark = _mark(state)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = state.union(state.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(told_apart(low, mark[0]), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(told_apart(low, mark[0]), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.union(low.select("a", "m")).distinct(), name)
        now = _mark(after)
        dropped(state)
        state = after
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = state.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum, which stay the same once the edges do."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("x")).first()
    return int(row["n"]), int(row["x"] or 0)
