import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factweave.llm import langid, neardup

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_a_plain_version(spark):
    """Each stage against plain Python over the rows it got."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], FOLDER).cache())
    raw, named, single, apart, safe, packed = ([r.asDict() for r in df.collect()] for df in seen)
    assert {r["doc_id"] for r in named} == {r["doc_id"] for r in raw if langid.has_letter(r["text"])}  # all of them tell a language
    best = {}
    for r in named:
        key = re.sub("[\x20\x09-\x0d]+", "", r["text"])
        best[key] = min(best.get(key, (0, 0)), (-len(r["text"]), r["doc_id"])) if key in best else (-len(r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in single} == {i for _, i in best.values()}
    sets, root = {r["doc_id"]: neardup.shingles(r["text"]) for r in single}, {r["doc_id"]: r["doc_id"] for r in single}
    for a in sets:
        for b in sets:
            if a < b and neardup.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r["doc_id"] for r in apart} == set(root.values())
    assert {r["doc_id"] for r in safe} == {r["doc_id"] for r in apart} and all(list(df.columns) == corpus_pipeline.COLUMNS for df in seen[1:-1])
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {r["doc_id"]: len(known.encode(r["text"], add_special_tokens=False).ids) + 1 for r in safe}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == lengths


def test_run(spark):
    """What run() gives are the stages one after the other, and its sequences have no gaps."""
    out = corpus_pipeline.run(spark, FOLDER).collect()
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    assert max(ends.values()) <= 1024 and {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.select("doc_id").collect()}


DDL = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, _id int, row string, score string"


def test_odd_tables_go_through_every_stage(spark):
    """Nulls, empty texts, repeated rows, ties, clashing columns, and a table without rows."""
    english, german = "the man and the dog were in the house of the old king", "der Mann und der Hund waren in dem Haus des alten Herrn"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, english, "en", "s", 1), (4, german, "de", "s", 2), (4, german, "de", "s", 2), (5, english + " ", None, None, 3), (6, "123 !?", "en", "s", 4), (None, english + " again", "en", "s", 5)]
    docs = spark.createDataFrame([(*r, "x", 7, "y", "z") for r in rows], DDL)
    for start in (docs, spark.createDataFrame([], DDL), docs.withColumn("lang", F.lit(None).cast("string"))):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, FOLDER)
            assert now.columns == corpus_pipeline.COLUMNS, name
        told = sorted((r["doc_id"] or 0, r["text"].strip()) for r in now.collect())
        assert told == ([] if start.isEmpty() else [(0, english + " again"), (4, german), (5, english)])
        assert {r["doc_id"] for r in corpus_pipeline.pack(spark, now, FOLDER).collect()} == {i or None for i, _ in told}


def test_language_is_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 10 != 3, F.col("lang")))
    out = corpus_pipeline.identify_language(spark, hidden, FOLDER)
    assert out.where("lang is null").isEmpty() and out.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    right = out.where("doc_id % 10 = 3").select("doc_id", "lang").join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    assert right.agg(F.avg((F.col("lang") == F.col("true")).cast("int"))).first()[0] > 0.97
