import pytest
from pyspark.sql import functions as F

from factweave.functions.digest import table_digest
from factweave.functions.limits import BatchCollision, InvalidQuery, ResourceLimit, after, checked_limit, checked_text, cursor_page
from factweave.operators import changes, log, reads, search, versions
from factweave.streaming.apply_log import AppliedLog, shared_folder


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_limits_are_refused_not_cut():
    for bad in (0, 10_001):
        with pytest.raises(InvalidQuery):
            checked_limit(bad)
    with pytest.raises(ResourceLimit):
        checked_text("x" * (64 * 1024 + 1))
    with pytest.raises(InvalidQuery):
        checked_text("  ")
    with pytest.raises(InvalidQuery):
        after(["a", "b"], (1, None))


def test_byte_budget_fails_the_read(spark):
    big = spark.range(17).select("id", F.repeat(F.lit("x"), 4 << 20).alias("text"))
    with pytest.raises(Exception, match="ResourceLimit"):
        cursor_page(big, ["id"], None, 100).agg(F.sum(F.length("text"))).collect()


def test_pages_of_a_cursor_make_the_whole(spark):
    df = spark.createDataFrame([(a, b) for a in range(4) for b in range(5)], "a int, b int")
    got, cursor = [], None
    while part := [tuple(r) for r in cursor_page(df, ["a", "b"], cursor, 3).collect()]:
        got += part
        cursor = part[-1]
    assert got == rows(df)


def test_cursor_reaches_the_scan(spark, tmp_path):
    spark.range(10).withColumn("b", F.col("id")).write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(after(["id", "b"], (3, 4)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def test_distinct_counts_and_candidates(spark):
    postings = spark.createDataFrame([("A", 1), ("A", 1), ("A", 2), ("B", 2)], "claim string, entity int")
    assert rows(reads.reference_counts(postings, "claim", "entity", None, None, 10)) == [("A", 2), ("B", 1)]
    assert rows(reads.candidates(postings, ["entity"], (1,), 10)) == [(2,)]


def test_marker_case_is_exact_and_nulls_come_last(spark):
    tasks = spark.createDataFrame([(1, 1, "TODO", None, None), (2, 1, "TODO", "2", None), (3, 1, "todo", "1", None)], "block_id int, page_id int, marker string, deadline string, scheduled string")
    assert [r["block_id"] for r in reads.tasks(tasks, "TODO", 10).collect()] == [2, 1]


def test_search(spark):
    texts = spark.createDataFrame([(1, 0, "foo-bar common"), (2, 0, "foo common bar"), (3, 0, "")], "page_id int, entity_id int, text string")
    assert rows(search.phrase_pages(texts, ["page_id", "entity_id"], "foo-bar", "page_id", None, 10)) == [(1,)]
    assert [r[0] for r in search.bm25(texts, ["page_id", "entity_id"], "foo common", 10).collect()] == [1, 2]
    assert rows(search.matching(texts, ["page_id"], [["fo*"]], ["nothing"], 10)) == [(1,), (2,)]
    with pytest.raises(InvalidQuery):
        search.terms_of("++")


def test_blocks_may_move_between_replaced_pages(spark):
    base = spark.createDataFrame([(1, 10), (2, 20)], "page_id int, block int")
    new = spark.createDataFrame([(1, 20), (2, 10)], "page_id int, block int")
    assert rows(changes.replaced(base, new, new, "page_id")) == [(1, 20), (2, 10)]


def test_refs_to_a_replaced_page_stay_and_to_a_deleted_page_go(spark):
    refs = spark.createDataFrame([(9, 1, 0), (9, 2, 0), (1, 9, 0)], "source_page int, target_page int, target_block int")
    one, two = spark.createDataFrame([(1,)], "page_id int"), spark.createDataFrame([(2,)], "page_id int")
    assert rows(changes.remaining_refs(refs, one, two, spark.createDataFrame([], "block_id int"))) == [(9, 1, 0)]


def test_newest_wins_with_tombstones(spark):
    data = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1), ("b", None, 3)], "key string, value string, generation long")
    assert rows(versions.newest(data)) == [("a", "2", 2)]
    asked = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "z")], "position int, key string")
    assert rows(versions.lookup_many(data, asked)) == [(0, "b", None), (1, "a", "2"), (2, "a", "2"), (3, "z", None)]
    assert rows(versions.newest(versions.removed(data, spark.createDataFrame([("a",), ("q",)], "key string"), 9))) == []
    assert rows(versions.as_of(data, 1)) == [("a", "1", 1), ("b", "1", 1)]


def test_digest_ignores_order_and_partitions(spark):
    df = spark.range(500).withColumn("t", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")))
    assert table_digest(df, ["id", "t"]).collect() == table_digest(df.orderBy(F.desc("id")).repartition(7), ["id", "t"]).collect()
    assert table_digest(df, ["id", "t"]).collect() != table_digest(df.where("id <> 5"), ["id", "t"]).collect()


def test_gaps_and_ancestors(spark):
    frames = spark.createDataFrame([(1, 0), (1, 1), (1, 4)], "device int, sequence long")
    assert rows(log.gaps(frames)) == [(1, 0, 1), (1, 1, 1), (1, 4, 3)]
    chain = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(6)], "page_id int, block_id int, parent_id int")
    assert rows(reads.ancestors(chain)) == sorted((1, b, a, b - a) for b in range(6) for a in range(b))


def test_applied_log_is_exactly_once_and_refuses_collisions(spark):
    folder = shared_folder(spark)
    one = spark.createDataFrame([(1, "x"), (2, "y")], "batch_id long, digest string")
    applied = AppliedLog(spark, folder, one.schema)
    applied.apply(one, 0)
    applied.apply(one, 1)
    applied.apply(one, 0)
    assert rows(applied.read()) == [(1, "x"), (2, "y")]
    with pytest.raises(BatchCollision):
        applied.apply(spark.createDataFrame([(2, "z")], one.schema), 2)
    assert rows(applied.read()) == [(1, "x"), (2, "y")]
