"""From raw documents to packed training sequences: five stages, each an operator of factweave.llm.

A stage reads and returns the columns of documents and drops others, whatever their names; an empty table gives an
empty one. Texts may be of any length, ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import exact, langid, neardup, pii
from factweave.llm.queries import SURROGATE_KEY, packed
from factweave.llm.shared import row_remainder, stored
from factweave.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; a null lang becomes the language found, others stay.

    Texts that are null or have no letter go, and so do texts that tell no language: their best score is hardly
    over an equal share for each language (a text in a script that no learned language has can score a little more). Where no row has a label there is nothing to learn from, and all texts
    with a letter stay. Documents of which the sample learns are judged like all others. Rows may repeat.
    """
    model = langid.learned(docs, F.coalesce(row_remainder("doc_id", 5) != 0, F.lit(True)))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    told = langid.labelled(docs, model, COLUMNS).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > langid.least_score(model)))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts; null and empty texts are one class; rows that repeat an id and text are one."""
    return exact.kept_rows(docs).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; texts without words are all kept."""
    return neardup.kept_rows(docs).select(COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text. Null and empty texts stay as they are."""
    made = pii.replaced(docs, SURROGATE_KEY)
    return made.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens; a null or empty text is its end id."""
    return packed(docs)


STAGES = [
    ("language", identify_language),
    ("exact copies", drop_copies),
    ("near copies", drop_near_copies),
    ("personal data", replace_personal_data),
    ("packing", pack),
]

#: No SQL: language, near copies and tokens are beyond it. tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
