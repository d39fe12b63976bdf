"""Changes, causality, journals, files, maps and levels against plain versions."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from factweave.functions import encoding, limits
from factweave.operators import authenticated, causality, compaction, search, snapshot
from factweave.plans import catalog, records  # noqa: F401  records adds its queries to the catalog
from factweave.sources import files, journal, schemas
from factweave.sources.staging import stage_folder


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def page(ident, blocks=(), name="P", text="words here", refs=()):
    return (ident, name, f"p/{ident}", 0, None, text, list(refs), [("k", "v")], ["t"], [(b, None, str(b), f"block {b}", None, None, [], [], [], None) for b in blocks])


def nested(spark, *pages):
    return spark.createDataFrame(list(pages), snapshot.NESTED)


def test_blocks_move_and_references_follow_the_rules(spark):
    base = snapshot.flattened(nested(spark, page(1, [10, 11]), page(2, [20]), page(3, [30], refs=[(0, 1, 0), (0, 2, 0), (1, 10, 0), (1, 11, 0), (1, 20, 0)])))
    after = snapshot.applied(base, nested(spark, page(1, [20, 10])), spark.createDataFrame([(2,)], "page_id long"))
    assert rows(after["blocks"].select("block_id", "page_id")) == [(10, 1), (20, 1), (30, 3)]
    # Page 2 is deleted, block 11 is gone, block 20 has moved to page 1, which was replaced.
    assert {(r["target_type"], r["target_id"]) for r in after["refs"].where("source_page_id = 3").collect()} == {(0, 1), (1, 10), (1, 20)}
    assert after["search"].where("page_id = 2").isEmpty() and after["search"].where("page_id = 1").count() == 3
    assert not snapshot.is_empty(after) and snapshot.is_empty(snapshot.reset(spark))
    assert dict(rows(snapshot.removed_counts(base, spark.createDataFrame([(1,), (9,)], "page_id long")))) == {"pages": 1, "blocks": 2, "refs": 0, "properties": 1, "tags": 1, "tasks": 0, "search": 3, "search_owners": 3}


def test_uuid_needs_its_origin(spark):
    bad = list(page(1, [10]))
    bad[9] = [(10, None, "a", "c", "uuid", None, [], [], [], None)]
    with pytest.raises(Exception, match="Corrupt"):
        snapshot.flattened(nested(spark, tuple(bad)))["blocks"].collect()


def test_snapshots_are_read_at_their_stamp(spark):
    store = snapshot.SnapshotStore(spark, stage_folder(spark))
    assert snapshot.is_empty(store.read(0, ""))
    store.commit(snapshot.flattened(nested(spark, page(1, [10]), page(2, [20]))), (0, ""), 1, "a")
    old = store.read(1, "a")
    store.apply(nested(spark, page(1, text="other")), spark.createDataFrame([(2,)], "page_id long"), (1, "a"), 2, "b")
    assert rows(store.read()["pages"].select("page_id")) == [(1,)] and old["pages"].count() == 2
    for stale in (lambda: store.read(1, "a"), lambda: store.commit({}, (1, "a"), 3, "c"), lambda: store.read(2, "x")):
        with pytest.raises(limits.Stale):
            stale()
    index = search.indexed(store.read()["search"], ["entity_type", "entity_id", "page_id"])
    assert len(search.search(index, ["entity_type", "entity_id"], "other", 10).collect()) == 1 and not search.search(index, ["entity_type", "entity_id"], "block", 10).collect()


def test_catalog_counts_must_agree(spark):
    aliases = spark.createDataFrame([(1, "A", "a"), (2, "A", "a"), (3, "B", "b")], schemas.CATALOG["aliases"])
    base = {"coverage": aliases.select("source_page"), "postings": aliases.select("source_page"), "aliases": aliases, "bindings": snapshot.bindings_of(aliases)}
    new = {"coverage": spark.createDataFrame([(1,), (4,)], "source_page long"), "postings": spark.createDataFrame([(1,)], "source_page long"), "aliases": spark.createDataFrame([(1, "B", "b"), (4, "A", "a")], schemas.CATALOG["aliases"])}
    gone = spark.createDataFrame([(3,)], "source_page long")
    for prior in (None, 3):
        out = snapshot.catalog_changed(base, new, gone, prior, 3)
        assert rows(out["bindings"]) == [("a", 0, 2), ("a", 1, 4), ("b", 0, 1)] and rows(out["coverage"]) == [(1,), (2,), (4,)]
    for prior, post in ((None, 4), (3, 4), (2, 3)):
        with pytest.raises(limits.Incomplete):
            snapshot.catalog_changed(base, new, gone, prior, post)


def test_clocks_equal_a_walk_of_all_ancestors(spark):
    batches, heads, before = [], {}, {}
    for i in range(120):  # three peers; a long chain each, with crossings
        peer = i % 3
        near = [before[peer]] if peer in before else []
        heads[i] = sorted({*near, *([i - 2] if i % 5 == 0 and i >= 2 else []), *([i - 7] if i % 4 == 0 and i >= 7 else [])})
        batches.append((i, peer, i // 3 + 1, heads[i]))
        before[peer] = i
    df = spark.createDataFrame(batches, "batch_id long, peer long, counter long, heads array<long>")
    seen = {}
    for i in range(120):
        seen[i] = {i}.union(*(seen[h] for h in heads[i]))
    want = sorted((i, p, max(batches[a][2] for a in seen[i] if batches[a][1] == p)) for i in seen for p in {batches[a][1] for a in seen[i]})
    clocked = causality.clocks(df)
    assert rows(clocked) == sorted(want, key=repr)
    pairs = spark.createDataFrame([(i, a) for i in range(0, 120, 7) for a in range(0, 125, 3)], "descendant long, ancestor long")
    assert all(r["descends"] == (r["ancestor"] in seen[r["descendant"]]) for r in causality.descends(df, clocked, pairs).collect())
    assert {r["outcome"] for r in causality.continuity(df, clocked).collect()} == {"Continuous"}
    with pytest.raises(Exception, match="MissingDependency"):
        causality.descends(df, clocked, spark.createDataFrame([(999, 1)], "descendant long, ancestor long")).collect()
    with pytest.raises(limits.MissingDependency):
        causality.clocks(spark.createDataFrame([(1, 1, 1, [77])], df.schema))


def test_refusals_are_raised(spark):
    outcomes = lambda *x: spark.createDataFrame(list(enumerate(x)), "batch_id long, outcome string")
    assert rows(causality.admitted(outcomes("New", "Duplicate", "New"))) == [(0,), (2,)]
    for name, error in limits.REFUSALS.items():
        with pytest.raises(error):
            causality.admitted(outcomes("New", name))


@pytest.fixture(scope="module")
def segment(spark):
    made = spark.range(4).select(encoding.frame(F.lit(7), F.col("id"), F.lit(2), F.concat(F.lit("payload "), F.col("id"))).alias("x")).collect()
    return [bytes(r["x"]) for r in made]


def test_frames_are_the_layout_in_words(segment):
    header = (1).to_bytes(2, "big") + (7).to_bytes(8, "big") + bytes(8) + b"\x02" + hashlib.sha256(b"payload 0").digest()
    body = encoding.MAGIC + len(header).to_bytes(4, "big") + (9).to_bytes(8, "big") + header + b"payload 0"
    assert segment[0] == body + hashlib.sha256(body).digest()


def test_every_flipped_byte_is_refused_and_short_tails_are_torn(spark, segment):
    one = segment[1]
    flipped = [(i, one[:i] + bytes([one[i] ^ 1]) + one[i + 1 :]) for i in range(len(one))]
    told = spark.createDataFrame([(-1, one), *flipped], "at int, data binary").select("at", encoding.frame_outcome(F.col("data")).alias("o")).collect()
    assert {r["o"] for r in told if r["at"] < 0} == {"Valid"} and all(r["o"] != "Valid" for r in told if r["at"] >= 0)
    whole = b"".join(segment)
    assert [f[0] for f in journal.scanned(whole, 7).frames] == [0, 1, 2, 3]
    for cut in range(len(whole)):
        scan = journal.scanned(whole[:cut], 7)
        left = cut - scan.committed
        assert len(scan.frames) == cut // len(one) and (scan.torn == left and not scan.error if left < encoding.MIN_FRAME_BYTES else scan.error and not scan.torn)
    assert journal.scanned(whole, 8).error == "SegmentDeviceMismatch at 0" and journal.scanned(whole, 7, 1).error == "SegmentSequenceGap at 0"
    assert journal.scanned(segment[0] + segment[2], 7).error == f"SegmentSequenceGap at {len(one)}"
    both = spark.createDataFrame([(7, 0, whole, len(one) * 2)], "device long, base long, content binary, extent long")
    assert journal.read_segments(both, extents=True).count() == 2 and journal.read_segments(both).count() == 4


def test_journal_is_read_up_to_its_frontier(spark):
    held = journal.Journal(spark, stage_folder(spark))
    frames = lambda *x: spark.createDataFrame([(d, s, 1, f"{d}/{s}") for d, s in x], "device long, sequence long, kind int, payload string")
    assert held.read().isEmpty() and held.append(frames((1, 0), (1, 1), (2, 0))) == 0
    for bad in (frames((1, 3)), frames((1, 1)), frames((2, 2), (2, 3)), frames((3, 0), (3, 0))):
        with pytest.raises(limits.AcceptanceOrder):
            held.append(bad)
    frames((9, 0)).write.parquet(f"{held.folder}/epochs/1")  # an append that did not come to its end
    assert held.read().count() == 3 and held.recover() == ["1"]
    held.append(frames((2, 1), (1, 2)))
    assert [(r["device"], r["sequence"]) for r in held.replay().collect()] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]


def test_journal_of_many_devices_keeps_a_small_frontier(spark):
    """The frontier held each device's next sequence: 1 MiB at 80,000 devices, which the next append refused to read."""
    held = journal.Journal(spark, stage_folder(spark))
    frames = lambda s, n=100_000: spark.range(n).select(F.col("id").alias("device"), F.lit(s).cast("long").alias("sequence"), F.lit(1).alias("kind"), F.lit("p").alias("payload"))
    assert held.next().isEmpty() and (held.append(frames(0)), held.append(frames(1, 90_000))) == (0, 1)
    assert held.read().count() == 190_000 and {(r["next"], r["count"]) for r in held.next().groupBy("next").count().collect()} == {(1, 10_000), (2, 90_000)}
    assert len(held.files.read("current")) < 200
    with pytest.raises(limits.AcceptanceOrder, match="device 90000 expects 1, got 2 to 2 in 1 frames"):
        held.append(frames(2))
    with pytest.raises(limits.AcceptanceOrder):
        held.append(frames(0, 1).withColumn("device", F.lit(None).cast("long")))  # its frame could not be read
    assert held.frontier()["epochs"] == [0, 1] and held.append(frames(2, 5)) == 2 and held.read().count() == 190_005


def test_journal_replay_has_every_frame(spark, tmp_path):
    """The query and its SQL kept the first six frames of each device."""
    devices = [7, 8, 9, *[7] * 19, *[8] * 5, *[9] * 6]  # of 20, 6 and 7 frames
    events = spark.createDataFrame([(i, d, f"p{i}") for i, d in enumerate(devices)], "event_id long, user_id long, props string").withColumn("event_type", F.lit("view"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    expected = sorted((d, devices[:i].count(d), f"p{i}") for i, d in enumerate(devices))
    found = catalog.QUERIES["q79_journal_replay"](spark, str(tmp_path))
    assert sorted((r["device"], r["sequence"], r["payload"]) for r in found.collect()) == expected
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        assert sorted(con.sql(catalog.ORACLE_SQL["q79_journal_replay"]).fetchall()) == expected


def test_large_files_are_replaced(spark):
    held = files.Files(spark, stage_folder(spark))
    large = bytes(3 << 20)
    held.replace("head", None, large)
    for expected in (None, b"1", large[1:], large[1:] + b"1"):
        with pytest.raises(limits.Stale):
            held.replace("head", expected, b"2")
    held.replace("head", large, b"2")
    assert held.read("head") == b"2"


def test_files_are_exact(spark):
    held = files.Files(spark, stage_folder(spark))
    assert held.publish("a", b"one") and not held.publish("a", b"one") and held.publish_all({"a": b"one", "b": b"two"}) == 1
    with pytest.raises(limits.ByteCollision):
        held.publish("a", b"other")
    with pytest.raises(limits.ResourceLimit):
        held.read("a", most=2)
    with pytest.raises(limits.ResourceLimit):
        held.read("a", exactly=4)
    held.replace("head", None, b"1")
    held.replace("head", b"1", b"2")
    for expected in (None, b"1"):
        with pytest.raises(limits.Stale):
            held.replace("head", expected, b"3")
    assert held.read("head") == b"2" and held.retire("b").endswith("-b") and not held.exists("b") and held.names()[0] == "a"


def test_types_count_in_digests(spark):
    one = lambda ddl, v: encoding.table_digest(spark.createDataFrame([(v,)], f"x {ddl}"), ["x"]).first()["digest"]
    told = [one("long", 1), one("string", "1"), one("double", 1.0), one("binary", b"1"), one("string", None), one("string", ""), one("double", 0.0), one("double", -0.0)]
    assert len(set(told)) == len(told) and one("int", 1) == told[0]
    df = spark.range(300).withColumn("t", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")))
    assert encoding.table_digest(df, ["id", "t"]).collect() == encoding.table_digest(df.orderBy(F.desc("id")).repartition(5), ["id", "t"]).collect()
    assert encoding.table_digest(df, ["id", "t"]).first()["digest"] != encoding.table_digest(df, ["t", "id"]).first()["digest"]


def test_map_root_does_not_depend_on_its_history(spark):
    once = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    steps = [(f"k{i}", "old", 1) for i in range(150)] + [(f"k{i}", f"v{i}", 2) for i in range(200)] + [("x", "y", 1), ("x", None, 3)]
    history = compaction.compacted(spark.createDataFrame(steps, "key string, value string, generation long")).where("value is not null")
    root = authenticated.root(once).first()["root"]
    assert root == authenticated.root(history).first()["root"] != authenticated.root(once.where("key <> 'k7'")).first()["root"]
    told = authenticated.proof(once, "k7")
    assert authenticated.proves(told, "v7", root) and not authenticated.proves(told, "v8", root) and not authenticated.proves(told, "v7", "0" * 64)
    asked = spark.createDataFrame([("k1", "v1"), ("k2", "?"), ("k999", "v")], "key string, value string")
    assert rows(authenticated.authenticated(asked, once, root)) == [("k1", "Present"), ("k2", "Different"), ("k999", "Absent")]
    with pytest.raises(limits.Corrupt):
        authenticated.authenticated(asked, once, "0" * 64)
    keys = spark.createDataFrame([("a", "1"), ("ab", "1"), ("b", ""), ("", "1"), ("c" * 97, "1"), ("d", "1" * 4097)], "key string, value string")
    assert dict(rows(authenticated.key_outcome(keys))) == {"a": "PrefixOfAnother", "ab": "Valid", "b": "ValueLength", "": "KeyLength", "c" * 97: "KeyLength", "d": "ValueLength"}
    assert authenticated.sorted_unique([1, 2]) and not authenticated.sorted_unique([1, 1])


@pytest.mark.parametrize("last", [1, 6, 13, 32])
def test_levels_are_those_of_carrying(spark, last):
    held: dict[int, list[int]] = {}
    for generation in range(1, last + 1):
        merged, at = [generation], 0
        while at in held:
            merged += held.pop(at)
            at += 1
        held[at] = merged
    got = spark.range(1, last + 1).select("id", compaction.level(F.col("id"), last).alias("level")).collect()
    assert {r["id"]: r["level"] for r in got} == {g: at for at, gs in held.items() for g in gs}


def test_queries_are_parsed(spark):
    texts = spark.createDataFrame([("page", 1, "foo-bar common words"), ("block", 2, "foo common bar"), ("block", 3, "bars only"), ("page", 4, "foo-bar common words"), ("block", 5, "")], "entity_type string, entity_id int, text string")
    index = search.indexed(texts, ["entity_type", "entity_id"])
    found = lambda q: [r["entity_id"] for r in search.search(index, ["entity_type", "entity_id"], q, 10).collect()]
    assert found("foo-bar") == found('"foo bar"') == [1, 4] and sorted(found("bar*")) == [1, 2, 3, 4] and found("foo NOT words") == [2]
    assert sorted(found("only OR foo common")) == [1, 2, 3, 4] and found("(only OR words) AND foo") == [1, 4] and found("NEAR(foo bar, 1) NOT words") == [2] and found("NEAR(foo bar, 0)") == [1, 4]
    for bad in ("", "a OR", "(a", "a)", "AND", "NEAR(a b, x)", "++", "NOT a"):
        with pytest.raises(limits.InvalidQuery):
            search.Query(bad)


def test_databases_are_opened_as_claimed(spark):
    folder, few = stage_folder(spark), {t: schemas.DATABASE[t] for t in ("pages", "stamp")}
    schemas.initialise(spark, folder, {"workspace": "w"}, few)
    assert all(df.isEmpty() for df in schemas.opened(spark, folder, {"workspace": "w"}, few).values())
    with pytest.raises(limits.Contradiction):
        schemas.opened(spark, folder, {"workspace": "x"}, few)
    with pytest.raises(limits.Corrupt):
        schemas.opened(spark, folder, {"workspace": "w"}, few | {"stamp": "sequence long"})
    twice = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "a long, b long")
    assert rows(schemas.integrity(twice, ["a"], {"b": (spark.createDataFrame([(5,)], "id long"), "id")})) == [("parent of b", 1), ("unique", 1)]


def test_checked_reads_fail(spark):
    df = spark.createDataFrame([(0, b"1" * 16), (2, b"2" * 16)], "entity_type int, id binary")
    assert limits.checked_entities(df.where("entity_type = 0"), ident="id").count() == 1
    for bad in (limits.checked_entities(df), limits.checked_entities(df.where("entity_type = 0").withColumn("id", F.lit(b"1")), ident="id"), limits.checked_headers(df, F.col("entity_type") == 2, "kind")):
        with pytest.raises(Exception, match="Corrupt|InvalidQuery"):
            bad.select("entity_type").collect()


def test_a_chain_of_thirty_has_all_its_ancestors(spark):
    from factweave.operators.reads import ancestors

    chain = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(30)], "page_id int, block_id int, parent_id int")
    assert rows(ancestors(chain)) == sorted(((1, b, a, b - a) for b in range(30) for a in range(b)), key=repr)


def test_manifest_json_is_canonical(spark):
    df = spark.createDataFrame([(1, 1, 2, [3, 4])], "version int, batch_id long, counter long, heads array<long>").withColumn("t", causality.manifest_text())
    text = df.first()["t"]
    assert json.loads(text) == {"version": 1, "batch_id": 1, "counter": 2, "heads": [3, 4]}
    for written, outcome in ((text, "Canonical"), (text + " ", "NonCanonical"), ("{", "Malformed"), (text.replace("1", "x", 1), "Malformed")):
        assert causality.canonical_outcome(df.withColumn("t", F.lit(written)), "t").first()["outcome"] == outcome


def test_packs_are_found_by_their_head_alone(spark):
    from factweave.sources import stores

    folder = stage_folder(spark)
    held = stores.Packs(spark, folder)
    assert held.read().count() == 0 and held.get(["0"]) == {} and not held.compact()
    text = [f"record {i}".encode() for i in range(40)]
    digest = [hashlib.sha256(t).hexdigest() for t in text]
    before = held.catalog()
    for i in range(6):
        held.add(spark.createDataFrame([(t,) for t in text[i * 6 : i * 6 + 8]] + [(None,)], "content binary"))
    with pytest.raises(limits.Stale):
        held.advance(before, [])
    assert len(held.plan()) == 5 and held.compact() and not held.compact()
    assert [e["rows"] for e in held.catalog()["entries"]] == [32, 8] and held.catalog()["generation"] == 7
    assert rows(held.read()) == sorted(((d, bytearray(t)) for d, t in zip(digest[:38], text[:38], strict=True)), key=repr)
    assert held.get([digest[3], digest[39]]) == {digest[3]: text[3]}
    assert {r["digest"]: r["content"] is None for r in held.lookup(spark.createDataFrame([(digest[3],), (digest[39],)], "digest string")).collect()} == {digest[3]: False, digest[39]: True}
    assert len(held.reclaim()) == 5 and held.reclaim() == [] and held.read().count() == 38
    forged = held._read(held.catalog()["entries"]).where(F.col("digest") == digest[0]).withColumn("content", F.lit(b"x"))
    forged.write.mode("append").parquet(held.path(held.catalog()["entries"][1]))
    with pytest.raises(Exception, match="Corrupt"):
        held.get([digest[0], *digest[30:34]])


def test_levels_carry_like_a_binary_number(spark):
    from factweave.sources import stores

    held, plain = stores.Levels(spark, stage_folder(spark)), {}
    assert held.read().count() == 0 and held.lookup("a") is None
    for n in range(1, 8):
        new = {f"k{n % 3}": f"v{n}", f"k{n}": None if n % 2 else "x"}
        held.insert_many(spark.createDataFrame(list(new.items()), "key string, value string"))
        plain |= new
        assert sorted(e["level"] for e in held.catalog()["entries"]) == [b for b in range(3) if n >> b & 1]
    assert {r["key"]: r["value"] for r in held.read(deletions=True).collect()} == plain and held.lookup("k2") == plain["k2"]
    with pytest.raises(Exception, match="Contradiction"):
        held.insert_many(spark.createDataFrame([("a", "1"), ("a", "2")], "key string, value string"))
    assert held.catalog()["generation"] == 7


def test_sealed_payloads_tell_what_is_wrong(spark):
    df = spark.createDataFrame([(b"",), (b"abc",)], "p binary").select("p", encoding.sealed(F.lit(7), F.col("p")).alias("x"))
    for r in df.collect():
        x, outcome = bytes(r["x"]), lambda b, schema=7: spark.createDataFrame([(b,)], "x binary").select(encoding.sealed_outcome(F.col("x"), schema)).first()[0]
        assert outcome(x) == "Valid" and outcome(x, 8) == "UnknownSchema" and outcome(x[:-1]) == outcome(x + b"0") == outcome(b"") == outcome(None) == "Malformed"
        assert all(outcome(x[:i] + bytes([x[i] ^ 1]) + x[i + 1 :]) != "Valid" for i in (0, 10, 15, len(x) - 1))
