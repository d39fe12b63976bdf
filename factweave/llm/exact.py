"""Exact deduplication by a tree of merges over sorted digest runs, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.shared import scratch, stored

#: Characters that do not count when texts are compared.
BLANK = r"[\x20\x09-\x0D]+"
KEY = ("text_sha256", "check", "size")


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, "")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, points, text_sha256, check, size): the digest of each normalised text, and what verifies it."""
    plain = normalised(text_column)
    return docs.select(
        F.col(id_column),
        F.length(F.coalesce(F.col(text_column), F.lit(""))).cast("long").alias("points"),
        F.sha2(plain.cast("binary"), 256).alias("text_sha256"),
        F.xxhash64(plain).alias("check"),
        F.length(plain).cast("long").alias("size"),
    )


def merged_runs(units: DataFrame, id_column: str, fan_in: int = 8) -> DataFrame:
    """One row per class: the key, the row that stays (``best``) and the number of rows.

    Every input partition first makes a sorted run of its own digests, so a class of any size sends one row from
    each run. The runs are dealt by digest in one exchange, and each task holds its share of every run in order;
    there ``fan_in`` neighbouring runs at a time are merged, round by round, until one is left. Rows count as
    equal only if the digest, an independent 64-bit hash and the length agree, and the smallest identifier is
    kept on every level.
    """
    best = F.struct((-F.col("points")).alias("shorter"), F.col(id_column).isNull().alias("nameless"), F.col(id_column).alias("id"))
    runs = 1 + (units.select(F.spark_partition_id().alias("run")).agg(F.max("run")).first()[0] or 0)
    state = units.withColumn("run", F.spark_partition_id()).groupBy(*KEY, "run").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    state = state.repartition(*KEY).sortWithinPartitions(*KEY, "run")
    while True:
        runs = -(-runs // fan_in)
        state = state.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy(*KEY, "run").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        if runs == 1:
            return state.drop("run")


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fan_in: int = 8) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when the same but for white space (BLANK). Of equal texts the row with the most code points
    in its original text stays, then the one with the smallest id. Null text counts as empty; a null id comes
    after all others. Rows that repeat an id and its text are one document: all of them say kept, and each
    counts in group_size. Other columns are ignored; no rows give no rows.
    """
    with scratch(docs.sparkSession) as result:
        units = stored(digests(docs, id_column, text_column), "exact-units")
        several = stored(merged_runs(units, id_column, fan_in).where("group_size > 1").select(*KEY, F.col("best.id").alias("keep_id"), "group_size", F.lit(True).alias("several")), "exact-several")
        joined = units.join(several, list(KEY), "left")
        keep = F.when(F.col("several"), F.col("keep_id")).otherwise(F.col(id_column))
        return result(joined.select(id_column, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(id_column).eqNullSafe(keep).alias("kept"), "text_sha256"), "exact-classes")


def kept_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id and its text, one.

    Where no id repeats, which one count over the ids tells, the texts are dealt by id once and met there by the ids
    that go. Where ids repeat, the digest of the text is part of the key, and of equal rows one is taken. Columns of
    docs may have any names.
    """
    row, ident = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column)
    with scratch(docs.sparkSession) as result:
        found = classes(docs, id_column, text_column)
        if found.groupBy(id_column).count().where("count > 1").isEmpty():
            gone = result(found.where("not kept").select(ident.alias("gone_id")), "exact-gone")
            rows = docs.select(row, ident.alias("own_id"))
            return rows.join(gone.hint("merge"), F.col("own_id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")
        stay = result(found.where("kept").select(ident.alias("stay_id"), F.col("text_sha256").alias("stay_digest")).distinct(), "exact-stay")
    rows = docs.select(row, ident.alias("own_id"), F.sha2(normalised(text_column).cast("binary"), 256).alias("own_digest"))
    same = F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_digest") == F.col("stay_digest"))
    return rows.join(stay.hint("merge"), same, "left_semi").groupBy("own_id", "own_digest").agg(F.first("row").alias("row")).select("row.*")
