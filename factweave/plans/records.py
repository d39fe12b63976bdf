"""Registered queries on whole changes, clocks, frames, digests, maps and levels, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import encoding
from factweave.operators import authenticated, causality, compaction, reads, search, snapshot
from factweave.plans.catalog import VIEWS, registered
from factweave.sources import files, journal, stores
from factweave.sources.facts import Facts
from factweave.sources.schemas import integrity
from factweave.sources.staging import stage_folder, staged
from factweave.sources.tables import table

VIEWS |= {
    # Nested pages, flat: customers with two references, a property and two tags, and their orders as blocks.
    "n_pages": "SELECT c_custkey AS page_id, c_name AS name, 'seg/' || c_mktsegment || '/' || c_name AS path, c_nationkey % 2 AS text_kind, CASE WHEN c_custkey % 4 = 0 THEN 'pre ' || c_name END AS preamble, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ' ' || c_name END AS text, c_mktsegment AS seg, c_nationkey AS nation FROM customer",
    "n_blocks": "SELECT o_orderkey AS block_id, o_custkey AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - 1 END AS parent_block_id, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS order_key, o_orderpriority AS content, CASE WHEN o_orderkey % 5 = 0 THEN 'u' || o_orderkey END AS uuid, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS origin, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    # The change: pages of 10, 20, ... are replaced (names in lower case, only blocks of even id, which move to the page before), pages of 1, 11, ... are deleted.
    "t_pages": "SELECT page_id FROM n_pages WHERE page_id % 10 IN (0, 1)",
    "m_pages": "SELECT page_id, lower(name) AS name, path, text_kind, preamble, text, seg, nation FROM n_pages WHERE page_id % 10 = 0",
    "m_blocks": "SELECT * FROM n_blocks WHERE page_id % 10 = 0 AND block_id % 2 = 0",
    "x_pages": "SELECT * FROM n_pages WHERE page_id % 10 NOT IN (0, 1) UNION ALL SELECT * FROM m_pages",
    "x_blocks": "SELECT * FROM n_blocks WHERE page_id % 10 NOT IN (0, 1) UNION ALL SELECT * FROM m_blocks",
    "g_blocks": "SELECT block_id FROM n_blocks WHERE page_id % 10 IN (0, 1) AND block_id NOT IN (SELECT block_id FROM m_blocks)",
    "f_dag": "SELECT event_id AS batch_id, event_id // 64 * 8 + event_id % 8 AS peer, event_id % 64 // 8 + 1 AS counter, list_filter([CASE WHEN event_id % 64 >= 8 THEN event_id - 8 END, CASE WHEN event_id % 3 = 0 AND event_id % 64 >= 1 THEN event_id - 1 END, CASE WHEN event_id % 7 = 0 AND event_id % 64 >= 5 THEN event_id - 5 END], lambda x: x IS NOT NULL) AS heads FROM events",
    "dag_edges": "SELECT batch_id, unnest(heads) AS head FROM f_dag",
    "named": "SELECT DISTINCT CASE WHEN c_custkey % 50 = 0 THEN repeat(CAST(c_custkey AS VARCHAR), 40) WHEN c_custkey % 60 = 1 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS key, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS value FROM customer",
    "f_manifests": """SELECT event_id AS batch_id, CASE WHEN event_id % 31 = 0 THEN 2 ELSE 1 END AS version, event_id % 13 AS counter,
    CASE WHEN event_id % 5 = 0 THEN [event_id - 1, event_id - 2] WHEN event_id % 7 = 0 THEN [event_id - 1, event_id] ELSE [event_id - 2, event_id - 1] END AS heads,
    [('a' || event_id % 3, event_id % 2, 'd' || event_id % 4, event_id % 9), ('a' || event_id % 2 + 1, 1, 'd' || event_id % 3, 5)] AS objects FROM events""",
    "v_insertions": "SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS key, CASE WHEN event_id % 7 <> 0 THEN props END AS value, event_id // 100 + 1 AS insertion, event_id AS generation FROM events",
}


def nested(f: Facts) -> DataFrame:
    """The fixture's nested pages. Collecting a page's blocks is part of the fixture, not of the operators."""
    orders, customers = table(f.spark, f.folder, "orders"), table(f.spark, f.folder, "customer")
    key, five = F.col("o_orderkey"), F.col("o_orderkey") % 5 == 0
    reference = "array<struct<target_type:int,target_id:long,kind:int>>"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    block = F.struct(
        key.alias("block_id"), F.when(key % 2 == 0, key - 1).alias("parent_block_id"), F.lpad(key.cast("string"), 10, "0").alias("order_key"), F.col("o_orderpriority").alias("content"),
        F.when(five, F.concat(F.lit("u"), key)).alias("uuid"), F.when(five, 1).alias("origin"),
        F.array(F.struct(F.lit(0), key % 100 + 1, F.lit(0)), F.struct(F.lit(1), key + 3, F.lit(2))).cast(reference).alias("references"),
        F.array(F.struct(F.lit("Priority").alias("name"), F.col("o_orderpriority").alias("value"))).alias("properties"), F.array("o_orderstatus").alias("tags"),
        F.when(F.col("o_orderstatus") != "F", F.struct(F.col("o_orderstatus").alias("marker"), F.col("o_orderpriority").alias("priority"), F.when(key % 3 != 0, day).alias("scheduled"), day.alias("deadline"))).alias("task"),
    )
    blocks = orders.groupBy(F.col("o_custkey").alias("page_id")).agg(F.collect_list(block).alias("blocks"))
    me, segment, name = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")
    pages = customers.select(
        me.alias("page_id"), "c_name", F.concat(F.lit("seg/"), segment, F.lit("/"), name).alias("path"), (F.col("c_nationkey") % 2).alias("text_kind"), F.when(me % 4 == 0, F.concat(F.lit("pre "), name)).alias("preamble"),
        F.when(me % 3 > 0, F.concat(segment, F.lit(" "), name)).alias("text"), F.array(F.struct(F.lit(0), F.col("c_nationkey") + 1, F.lit(1)), F.struct(F.lit(1), me * 2, F.lit(0))).cast(reference).alias("references"),
        F.array(F.struct(F.lit("Segment").alias("name"), segment.alias("value"))).alias("properties"), F.array(segment, F.lit("customer")).alias("tags"),
    ).withColumnRenamed("c_name", "name")
    return pages.join(blocks, "page_id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(blocks.schema["blocks"].dataType)))


def change(f: Facts) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The base snapshot, the nested replacements and the deletions."""
    whole = nested(f)
    new = whole.where("page_id % 10 = 0").withColumns({"name": F.lower("name"), "blocks": F.filter("blocks", lambda b: b["block_id"] % 2 == 0)})
    return snapshot.flattened(whole), new, whole.where("page_id % 10 = 1").select("page_id")


_OWNED = {
    "pages": "SELECT page_id, name, lower(name) AS name_key, path, text_kind, preamble FROM x_pages",
    "blocks": "SELECT block_id, page_id, parent_block_id, order_key, content, uuid, origin FROM x_blocks",
    "properties": "SELECT 0 AS owner_type, page_id AS owner_id, page_id, 'Segment' AS name, 'segment' AS normalized_name, 0 AS ordinal, seg AS value FROM x_pages UNION ALL SELECT 1, block_id, page_id, 'Priority', 'priority', 0, content FROM x_blocks",
    "tags": "SELECT 0 AS owner_type, page_id AS owner_id, page_id, 0 AS ordinal, seg AS tag FROM x_pages UNION ALL SELECT 0, page_id, page_id, 1, 'customer' FROM x_pages UNION ALL SELECT 1, block_id, page_id, 0, status FROM x_blocks",
    "tasks": "SELECT block_id, page_id, status AS marker, content AS priority, CASE WHEN block_id % 3 <> 0 THEN day END AS scheduled, day AS deadline FROM x_blocks WHERE status <> 'F'",
    "search": "SELECT 0 AS entity_type, page_id AS entity_id, page_id, text, lower(text) AS normalized FROM x_pages WHERE text IS NOT NULL UNION ALL SELECT 1, block_id, page_id, content, lower(content) FROM x_blocks",
    "search_owners": "SELECT 0 AS entity_type, page_id AS entity_id, page_id FROM x_pages WHERE text IS NOT NULL UNION ALL SELECT 1, block_id, page_id FROM x_blocks",
    "refs": """SELECT * FROM (
        SELECT 0 AS source_type, page_id AS source_id, page_id AS source_page_id, 0 AS target_type, nation + 1 AS target_id, 1 AS kind, 0 AS ordinal, page_id % 10 = 0 AS new FROM x_pages
        UNION ALL SELECT 0, page_id, page_id, 1, page_id * 2, 0, 1, page_id % 10 = 0 FROM x_pages
        UNION ALL SELECT 1, block_id, page_id, 0, block_id % 100 + 1, 0, 0, page_id % 10 = 0 FROM x_blocks
        UNION ALL SELECT 1, block_id, page_id, 1, block_id + 3, 2, 1, page_id % 10 = 0 FROM x_blocks)
        WHERE new OR NOT ((target_type = 0 AND target_id IN (SELECT page_id FROM n_pages WHERE page_id % 10 = 1)) OR (target_type = 1 AND target_id IN (SELECT block_id FROM g_blocks)))""",
}
_OWNED["refs"] = f"SELECT source_type, source_id, source_page_id, target_type, target_id, kind, ordinal FROM ({_OWNED['refs']})"
_SNAPSHOT = ("n_pages", "n_blocks", "m_pages", "m_blocks", "x_pages", "x_blocks", "g_blocks")


def _apply(name: str):
    @registered(f"q60_apply_{name}", _OWNED[name], *_SNAPSHOT)
    def _(f: Facts) -> DataFrame:
        return snapshot.applied(*change(f))[name]


for _name in _OWNED:
    _apply(_name)


@registered(
    "q61_removed_counts",
    "SELECT 'pages' AS \"table\", (SELECT count(*) FROM t_pages) AS removed UNION ALL SELECT 'blocks', (SELECT count(*) FROM n_blocks WHERE page_id IN (SELECT page_id FROM t_pages)) UNION ALL SELECT 'refs', 2 * (SELECT count(*) FROM t_pages) + 2 * (SELECT count(*) FROM n_blocks WHERE page_id IN (SELECT page_id FROM t_pages))"
    " UNION ALL SELECT 'properties', (SELECT count(*) FROM t_pages) + (SELECT count(*) FROM n_blocks WHERE page_id IN (SELECT page_id FROM t_pages)) UNION ALL SELECT 'tags', 2 * (SELECT count(*) FROM t_pages) + (SELECT count(*) FROM n_blocks WHERE page_id IN (SELECT page_id FROM t_pages))"
    " UNION ALL SELECT 'tasks', (SELECT count(*) FROM n_blocks WHERE status <> 'F' AND page_id IN (SELECT page_id FROM t_pages)) UNION ALL SELECT t, (SELECT count(*) FROM n_pages WHERE text IS NOT NULL AND page_id IN (SELECT page_id FROM t_pages)) + (SELECT count(*) FROM n_blocks WHERE page_id IN (SELECT page_id FROM t_pages)) FROM (VALUES ('search'), ('search_owners')) v(t)",
    "n_pages", "n_blocks", "t_pages",
)
def _(f: Facts) -> DataFrame:
    base, new, gone = change(f)
    return snapshot.removed_counts(base, new.select("page_id").union(gone))


@registered("q62_snapshot_store", f"SELECT block_id, page_id, order_key FROM ({_OWNED['blocks']})", *_SNAPSHOT)
def _(f: Facts) -> DataFrame:
    base, new, gone = change(f)
    store = snapshot.SnapshotStore(f.spark, stage_folder(f.spark))
    store.commit(base, (0, ""), 1, "one")
    store.apply(new, gone, (1, "one"), 2, "two")
    return store.read(2, "two")["blocks"].select("block_id", "page_id", "order_key")


def _catalog(f: Facts) -> tuple[dict, dict, DataFrame]:
    aliases = f.aliases
    base = {"coverage": aliases.select("source_page").distinct(), "postings": f.names, "aliases": aliases, "bindings": snapshot.bindings_of(aliases)}
    one = F.col("source_page") % 10 == 0
    again = aliases.where(one).withColumns({"raw_alias": F.lit("Renamed"), "normalized_alias": F.lit("renamed")})
    new = {"coverage": again.select("source_page").distinct(), "postings": f.names.where(one).withColumn("kind", F.lit(5).cast("long")), "aliases": again}
    return base, new, aliases.where("source_page % 10 = 1").select("source_page").distinct()


@registered(
    "q63_catalog_bindings",
    "SELECT normalized_alias, row_number() OVER (PARTITION BY normalized_alias ORDER BY source_page) - 1 AS candidate_ordinal, source_page AS resolved_page FROM (SELECT DISTINCT CASE WHEN source_page % 10 = 0 THEN 'renamed' ELSE normalized_alias END AS normalized_alias, source_page FROM f_aliases WHERE source_page % 10 <> 1)",
    "f_aliases",
)
def _(f: Facts) -> DataFrame:
    return snapshot.catalog_changed(*_catalog(f))["bindings"]


@registered("q63b_catalog_postings", "SELECT source_page, source_entity, raw_name, normalized_name, CASE WHEN source_page % 10 = 0 THEN 5 ELSE kind END AS kind FROM f_names WHERE source_page % 10 <> 1 OR source_page NOT IN (SELECT source_page FROM f_aliases)", "f_names", "f_aliases")
def _(f: Facts) -> DataFrame:
    return snapshot.catalog_changed(*_catalog(f))["postings"]


@registered("q63c_inductive_count", "SELECT count(*) AS prior, count(*) FILTER (WHERE p % 10 IN (0, 1)) AS replaced, count(*) FILTER (WHERE p % 10 = 0) AS inserted, count(*) FILTER (WHERE p % 10 <> 1) AS post FROM (SELECT DISTINCT source_page AS p FROM f_aliases)", "f_aliases")
def _(f: Facts) -> DataFrame:
    base, new, removed = _catalog(f)
    return snapshot.inductive_count(base["coverage"], new["coverage"], snapshot.touched_sources(new["coverage"], removed))




def dag(f: Facts) -> DataFrame:
    """Lineages of 64 batches by 8 peers; a batch has up to three heads."""
    me, at = F.col("event_id"), F.col("event_id") % 64
    heads = F.array(F.when(at >= 8, me - 8), F.when((me % 3 == 0) & (at >= 1), me - 1), F.when((me % 7 == 0) & (at >= 5), me - 5))
    return table(f.spark, f.folder, "events").select(me.alias("batch_id"), (F.floor(me / 64) * 8 + me % 8).alias("peer"), (F.floor(at / 8) + 1).alias("counter"), F.filter(heads, lambda x: x.isNotNull()).alias("heads"))


@registered("q55_dag_clocks", "RECURSIVE SELECT r.b AS batch_id, d.peer, max(d.counter) AS counter FROM reach r JOIN f_dag d ON d.batch_id = r.a GROUP BY 1, 2", "f_dag", "dag_edges")
def _(f: Facts) -> DataFrame:
    return causality.clocks(dag(f))


@registered("q56_dag_descends", "RECURSIVE SELECT d.batch_id AS descendant, d.batch_id - 1 - d.batch_id % 11 AS ancestor, EXISTS (SELECT 1 FROM reach r WHERE r.b = d.batch_id AND r.a = d.batch_id - 1 - d.batch_id % 11) AS descends FROM f_dag d", "f_dag", "dag_edges")
def _(f: Facts) -> DataFrame:
    batches = dag(f)
    pairs = batches.select(F.col("batch_id").alias("descendant"), (F.col("batch_id") - 1 - F.col("batch_id") % 11).alias("ancestor"))
    return causality.descends(batches, causality.clocks(batches), pairs)


@registered(
    "q57_counter_continuity",
    "RECURSIVE SELECT d.batch_id, CASE WHEN d.counter + CASE WHEN d.batch_id % 13 = 0 THEN 1 ELSE 0 END = 1 + coalesce((SELECT max(p.counter) FROM reach r JOIN f_dag p ON p.batch_id = r.a WHERE r.b = d.batch_id AND r.a <> r.b AND p.peer = d.peer), 0) THEN 'Continuous' ELSE 'Gap' END AS outcome FROM f_dag d",
    "f_dag", "dag_edges",
)
def _(f: Facts) -> DataFrame:
    batches = dag(f)
    return causality.continuity(batches.withColumn("counter", F.col("counter") + F.when(F.col("batch_id") % 13 == 0, 1).otherwise(0)), causality.clocks(batches))


_REQUEST = """SELECT batch_id, peer, CASE WHEN batch_id % 17 = 0 THEN 0 ELSE counter END AS counter, CASE WHEN batch_id % 19 = 0 THEN [batch_id + 1000000] ELSE CASE WHEN head IS NULL THEN [] ELSE [head] END END AS heads,
    CASE WHEN batch_id % 5 = 1 THEN digest || 'x' ELSE digest END AS digest, CASE WHEN batch_id % 7 = 0 THEN NULL ELSE 'e' END AS effect, CASE WHEN batch_id < 500 THEN batch_id + CASE WHEN batch_id % 11 = 0 THEN 9000 ELSE 0 END WHEN batch_id % 3 = 0 THEN batch_id ELSE 501 END AS sequence,
    CASE WHEN batch_id % 23 = 0 THEN 'root500' WHEN batch_id < 500 OR batch_id % 29 = 0 THEN 'old' ELSE 'root500' END AS prior_root, CASE WHEN batch_id % 2 = 0 THEN 'm' || batch_id % 31 // 30 END AS materialization FROM f_batches"""
_ACCEPTED = "SELECT batch_id, digest, CASE WHEN batch_id % 7 = 0 THEN NULL ELSE 'e' END AS effect, CASE WHEN batch_id % 2 = 0 THEN 'm0' END AS materialization FROM f_batches WHERE batch_id < 500"


@registered(
    "q58_preflight",
    f"""SELECT r.batch_id, CASE WHEN r.counter < 1 THEN 'Malformed' WHEN a.batch_id IS NOT NULL AND (r.digest IS DISTINCT FROM a.digest OR r.effect IS DISTINCT FROM a.effect) THEN 'BatchCollision'
      WHEN a.batch_id IS NOT NULL AND (r.sequence > 500 OR r.prior_root = 'root500') THEN 'FrontierRegression' WHEN a.batch_id IS NOT NULL AND r.materialization IS DISTINCT FROM a.materialization THEN 'MaterializationCollision' WHEN a.batch_id IS NOT NULL THEN 'Duplicate'
      WHEN len(list_filter(r.heads, lambda h: h >= 500)) > 0 THEN 'MissingDependency' WHEN r.sequence <> 501 THEN 'AcceptanceOrder' WHEN r.prior_root <> 'root500' THEN 'FrontierRegression' WHEN r.materialization IS NOT NULL THEN 'Stale' ELSE 'New' END AS outcome
      FROM ({_REQUEST.replace("head IS NULL THEN []", "head IS NULL THEN CAST([] AS BIGINT[])").replace("ELSE [head] END", "ELSE [head // 3] END")}) r LEFT JOIN ({_ACCEPTED}) a ON a.batch_id = r.batch_id""",
    "f_batches",
)
def _(f: Facts) -> DataFrame:
    b = f.batches
    me = F.col("batch_id")
    accepted = b.where("batch_id < 500").select("batch_id", "digest", F.when(me % 7 != 0, "e").alias("effect"), F.when(me % 2 == 0, "m0").alias("materialization"))
    heads = F.when(me % 19 == 0, F.array(me + 1_000_000)).when(F.col("head").isNull(), F.array().cast("array<long>")).otherwise(F.array(F.floor(F.col("head") / 3)))
    requests = b.select(
        "batch_id", "peer", F.when(me % 17 == 0, 0).otherwise(F.col("counter")).alias("counter"), heads.alias("heads"), F.when(me % 5 == 1, F.concat("digest", F.lit("x"))).otherwise(F.col("digest")).alias("digest"), F.when(me % 7 != 0, "e").alias("effect"),
        F.when(me < 500, me + F.when(me % 11 == 0, 9000).otherwise(0)).when(me % 3 == 0, me).otherwise(501).alias("sequence"), F.when(me % 23 == 0, "root500").when((me < 500) | (me % 29 == 0), "old").otherwise("root500").alias("prior_root"),
        F.when(me % 2 == 0, F.concat(F.lit("m"), F.floor(me % 31 / 30))).alias("materialization"),
    )
    return causality.preflight(requests, accepted, ["digest", "effect"], 500, "root500", (499, "root499"))


@registered("q59_root_shape", "SELECT event_id AS root_id, CASE WHEN CASE WHEN event_id % 4 = 0 THEN event_id % 3 <> 0 AND event_id % 5 <> 0 ELSE event_id % 3 = 0 AND event_id % 5 = 0 END THEN 'Valid' ELSE 'Malformed' END AS outcome FROM events")
def _(f: Facts) -> DataFrame:
    me = F.col("event_id")
    return causality.root_shape(table(f.spark, f.folder, "events").select(me.alias("root_id"), F.when(me % 4 == 0, 0).otherwise(me).alias("batches"), F.when(me % 3 == 0, "k").alias("map_key"), F.when(me % 5 == 0, "k").alias("clock_key")))


def _texts(f: Facts) -> DataFrame:
    """Conversations as entities: even turns are blocks, odd ones pages; the id is unique within a type."""
    kind = F.when(F.col("turn") % 2 == 0, "block").otherwise("page")
    return table(f.spark, f.folder, "conversations").select(kind.alias("entity_type"), (F.col("conv_id") * 1000 + F.col("turn")).alias("entity_id"), F.col("conv_id").alias("page_id"), "text")


_TOKENS = "toks AS (SELECT CASE WHEN turn % 2 = 0 THEN 'block' ELSE 'page' END AS entity_type, conv_id * 1000 + turn AS entity_id, conv_id AS page_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM conversations)"


def _ranked(tfs: list[str], holds: str, limit: int, where: str = "len(t) > 0") -> str:
    term = lambda i: f"ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
    n = range(len(tfs))
    return (
        f"WITH {_TOKENS}, counted AS (SELECT entity_type, entity_id, len(t) AS dl, {', '.join(f'{x} AS tf{i}' for i, x in enumerate(tfs))} FROM toks WHERE {where}), "
        f"whole AS (SELECT *, count(*) OVER () AS n, avg(dl) OVER () AS avgdl, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) OVER () AS df{i}' for i in n)} FROM counted) "
        f"SELECT entity_type, entity_id, round(-({' + '.join(map(term, n))}), 9) AS rank FROM whole WHERE {holds} ORDER BY rank, entity_type, entity_id LIMIT {limit}"
    )


def _one(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


@registered("q64_search_query", _ranked([_one("the"), _one("and"), _one("of")], "((tf0 > 0 AND tf1 > 0) OR tf2 > 0)", 500))
def _(f: Facts) -> DataFrame:
    return search.search(search.indexed(_texts(f), ["entity_type", "entity_id"]), ["entity_type", "entity_id"], "the and OR of", 500)


@registered("q64b_search_not_prefix", _ranked([_one("the"), _one("of"), "len(list_filter(t, lambda x: starts_with(x, 'an')))"], "tf0 > 0 AND NOT tf1 > 0 AND tf2 > 0", 500))
def _(f: Facts) -> DataFrame:
    return search.search(search.indexed(_texts(f), ["entity_type", "entity_id"]), ["entity_type", "entity_id"], "the NOT of an*", 500)


@registered("q64c_search_phrase", _ranked(["len(list_filter(generate_series(1, len(t) - 1), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))", _one("in")], "tf0 > 0 AND tf1 > 0", 500))
def _(f: Facts) -> DataFrame:
    return search.search(search.indexed(_texts(f), ["entity_type", "entity_id"]), ["entity_type", "entity_id"], '"of the" in', 500)


@registered(
    "q64d_search_near",
    _ranked([_one("the"), _one("and")], "tf0 > 0 AND tf1 > 0 AND near", 500).replace(" FROM toks WHERE", ", len(list_filter(generate_series(1, len(t)), lambda i: t[i] = 'the' AND list_contains(t[greatest(1, i - 3):i + 3], 'and'))) > 0 AS near FROM toks WHERE"),
)
def _(f: Facts) -> DataFrame:
    return search.search(search.indexed(_texts(f), ["entity_type", "entity_id"]), ["entity_type", "entity_id"], "NEAR(the and, 2)", 500)


@registered("q65_index_delete", _ranked([_one("the")], "tf0 > 0", 500, "len(t) > 0 AND page_id % 3 <> 1"))
def _(f: Facts) -> DataFrame:
    texts = _texts(f)
    index = search.unindexed(search.indexed(texts, ["entity_type", "entity_id", "page_id"]), texts.where("page_id % 3 = 1"))
    return search.search(index, ["entity_type", "entity_id"], "the", 500)


def _hex(value: str, kind: str) -> str:
    if kind == "int":
        return f"CASE WHEN {value} IS NULL THEN '00' ELSE '01' || lpad(lower(to_hex(CAST({value} AS BIGINT))), 16, '0') END"
    return f"CASE WHEN {value} IS NULL THEN '00' ELSE '03' || lpad(lower(to_hex(CAST(octet_length(encode({value})) AS BIGINT))), 16, '0') || lower(hex(encode({value}))) END"


def _row(columns: dict[str, str]) -> str:
    size = "lpad(lower(to_hex(CAST({} AS BIGINT))), 16, '0')"
    parts = [f"{size.format(f'len({_hex(c, k)}) // 2')} || {_hex(c, k)}" for c, k in columns.items()]
    return " || ".join([size.format(len(columns)), *parts])


def _digest(view: str, columns: dict[str, str]) -> str:
    return f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, sha256(unhex(string_agg(b || d, '' ORDER BY b))) AS digest FROM (SELECT substr(h, 1, 4) AS b, sha256(unhex(string_agg(h, '' ORDER BY h))) AS d, count(*) AS n FROM (SELECT sha256(unhex({_row(columns)})) AS h FROM {view}) GROUP BY 1)"


_TASK = {"block_id": "int", "page_id": "int", "marker": "text", "scheduled": "text", "deadline": "text"}
_PAGE = {"page_id": "int", "name": "text", "path": "text", "text_kind": "int"}


@registered("q66_typed_digest", _digest("f_tasks", _TASK), "f_tasks")
def _(f: Facts) -> DataFrame:
    return encoding.table_digest(f.tasks, list(_TASK))


def _named(name: str, columns: dict[str, str]) -> str:
    return name.encode().hex() + "".join(f"2c{c.encode().hex()}" for c in columns)


@registered(
    "q67_database_digest",
    "SELECT sha256(unhex(string_agg(x, '' ORDER BY name))) AS digest FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, '{_named(n, c)}' || lpad(lower(to_hex(rows)), 16, '0') || digest AS x FROM ({_digest(v, c)})" for n, v, c in (("pages", "f_pages", _PAGE), ("tasks", "f_tasks", _TASK))) + ")",
    "f_pages", "f_tasks",
)
def _(f: Facts) -> DataFrame:
    return encoding.database_digest({"tasks": (f.tasks, list(_TASK)), "pages": (f.pages, list(_PAGE))})


_SIZED = "lpad(lower(to_hex(CAST(octet_length(encode({0})) AS BIGINT))), 16, '0') || lower(hex(encode({0})))"


@registered(
    "q68_map_root",
    f"SELECT sha256(unhex('02' || string_agg(b || node, '' ORDER BY b))) AS root FROM (SELECT substr(place, 1, 4) AS b, sha256(unhex('01' || string_agg(leaf, '' ORDER BY place))) AS node FROM (SELECT sha256(key) AS place, sha256(unhex('00' || {_SIZED.format('key')} || {_SIZED.format('value')})) AS leaf FROM f_newest WHERE value IS NOT NULL) GROUP BY 1)",
    "f_newest",
)
def _(f: Facts) -> DataFrame:
    return authenticated.root(compaction.compacted(f.versions).where("value is not null"))


@registered(
    "q69_key_rules",
    "SELECT k.key, CASE WHEN octet_length(encode(key)) NOT BETWEEN 1 AND 96 THEN 'KeyLength' WHEN octet_length(encode(value)) NOT BETWEEN 1 AND 4096 THEN 'ValueLength' WHEN EXISTS (SELECT 1 FROM named o WHERE o.key <> k.key AND starts_with(o.key, k.key)) THEN 'PrefixOfAnother' ELSE 'Valid' END AS outcome FROM (SELECT key, value FROM named) k",
    "named",
)
def _(f: Facts) -> DataFrame:
    me = F.col("c_custkey")
    key = F.when(me % 50 == 0, F.repeat(me.cast("string"), 40)).when(me % 60 == 1, "").otherwise(me.cast("string"))
    return authenticated.key_outcome(table(f.spark, f.folder, "customer").select(key.alias("key"), F.when(me % 7 == 0, "").otherwise(F.col("c_name")).alias("value")).distinct())




@registered(
    "q70_lsm_levels",
    "SELECT level, count(*) AS entries, count(*) FILTER (WHERE value IS NULL) AS deletions, min(key) AS low, max(key) AS high FROM (SELECT level, key, arg_max_null(value, generation) AS value FROM (SELECT *, CAST(floor(log2(xor(insertion - 1, (SELECT max(insertion) FROM v_insertions)))) AS INTEGER) AS level FROM v_insertions) GROUP BY 1, 2) GROUP BY 1",
    "v_insertions",
)
def _(f: Facts) -> DataFrame:
    events = f.versions.withColumn("insertion", (F.floor(F.col("generation") / 100) + 1).cast("long"))
    last = events.agg(F.max("insertion")).first()[0]
    put = events.withColumn("level", compaction.level(F.col("insertion"), last))
    newest = put.groupBy("level", "key").agg(F.max(F.struct("generation", "value")).alias("top"))
    return newest.groupBy("level").agg(F.count("*").alias("entries"), F.count_if(F.col("top.value").isNull()).alias("deletions"), F.min("key").alias("low"), F.max("key").alias("high"))


@registered("q71_compaction_plan", "SELECT tier, pack_id FROM (SELECT tier, pack_id, count(*) OVER (PARTITION BY tier) AS n, row_number() OVER (PARTITION BY tier ORDER BY age DESC, pack_id) AS place FROM (SELECT doc_id AS pack_id, doc_id % 97 AS age, CAST(floor(log2(n_chars)) AS BIGINT) AS tier FROM documents WHERE n_chars > 0)) WHERE n > 4 AND place <= 5")
def _(f: Facts) -> DataFrame:
    return compaction.compaction_plan(table(f.spark, f.folder, "documents").select(F.col("doc_id").alias("pack_id"), F.col("n_chars").alias("size"), (F.col("doc_id") % 97).alias("age")))


@registered("q72_reclaimable", "SELECT 'pack-' || doc_id || '.bin' AS name FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0")
def _(f: Facts) -> DataFrame:
    me = F.col("doc_id")
    name = F.concat(F.when(me % 3 == 0, "note-").otherwise("pack-"), me, F.lit(".bin"))
    docs = table(f.spark, f.folder, "documents")
    return compaction.reclaimable(docs.select(name.alias("name")), docs.where(me % 4 == 0).select(name.alias("name")), r"^pack-\d+\.bin$")





@registered(
    "q73_manifest_outcome",
    """SELECT batch_id, CASE WHEN version <> 1 THEN 'UnknownVersion' WHEN counter <= 0 THEN 'InvalidCausalDot' WHEN list_sort(heads) <> heads OR len(list_distinct(heads)) <> len(heads) THEN 'NonCanonicalCausalDependencies'
      WHEN list_contains(heads, batch_id) THEN 'CausalSelfDependency' WHEN objects[1] = objects[2] THEN 'DuplicateDescriptor' WHEN objects[1] > objects[2] THEN 'NonCanonicalDescriptors'
      WHEN o.l <= 0 THEN 'InvalidObjectLength' WHEN o.d1 = o.d2 THEN 'DuplicateObjectDigest' ELSE 'Valid' END AS outcome FROM f_manifests JOIN (SELECT event_id AS id, event_id % 9 AS l, 'd' || event_id % 4 AS d1, 'd' || event_id % 3 AS d2 FROM events) o ON o.id = batch_id""",
    "f_manifests",
)
def _(f: Facts) -> DataFrame:
    return causality.manifest_outcome(_manifests(f))


def _manifests(f: Facts) -> DataFrame:
    me = F.col("event_id")

    def descriptor(document: Column, kind: Column, digest: Column, length: Column) -> Column:
        return F.struct(F.concat(F.lit("a"), document).alias("document"), kind.cast("int").alias("kind"), F.concat(F.lit("d"), digest).alias("digest"), length.cast("long").alias("length"))

    heads = F.when(me % 5 == 0, F.array(me - 1, me - 2)).when(me % 7 == 0, F.array(me - 1, me)).otherwise(F.array(me - 2, me - 1))
    objects = F.array(descriptor(me % 3, me % 2, me % 4, me % 9), descriptor(me % 2 + 1, F.lit(1), me % 3, F.lit(5)))
    return table(f.spark, f.folder, "events").select(me.alias("batch_id"), F.when(me % 31 == 0, 2).otherwise(1).alias("version"), (me % 13).alias("counter"), heads.alias("heads"), objects.alias("objects"))


@registered("q74_required_objects", "SELECT event_id AS batch_id, 'd' || event_id % 4 AS digest, event_id % 9 AS length FROM events WHERE event_id % 3 = 1 AND event_id % 2 = 1 UNION ALL SELECT event_id, 'd' || event_id % 3, 5 FROM events WHERE event_id % 2 = 0")
def _(f: Facts) -> DataFrame:
    return causality.required_objects(_manifests(f), "a1", 1)


@registered(
    "q75_canonical_manifest",
    "SELECT event_id AS batch_id, CASE WHEN event_id % 3 = 0 THEN 'NonCanonical' WHEN event_id % 5 = 0 THEN 'Malformed' ELSE 'Canonical' END AS outcome FROM events",
)
def _(f: Facts) -> DataFrame:
    me = F.col("batch_id")
    text = causality.manifest_text()
    written = F.when(me % 3 == 0, F.replace(text, F.lit(","), F.lit(", "))).when(me % 5 == 0, F.replace(text, F.lit('"counter"'), F.lit('"count"'))).otherwise(text)
    return causality.canonical_outcome(_manifests(f).withColumn("written", written), "written")


@registered("q76_fingerprints", "SELECT doc_id, octet_length(encode(text)) AS length, sha256(encode(text)[1:64]) AS first, sha256(encode(text)[greatest(1, octet_length(encode(text)) - 63):]) AS last FROM documents WHERE text IS NOT NULL")
def _(f: Facts) -> DataFrame:
    docs = table(f.spark, f.folder, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.fingerprints(docs, "doc_id", "content", 64, 3).drop("interior")


def _frame(f: Facts) -> Column:
    return encoding.frame(F.col("device"), F.col("sequence"), F.lit(1), F.col("payload"))


@registered(
    "q77_frame_outcomes",
    "SELECT frame_id, CASE frame_id % 6 WHEN 0 THEN 'ChecksumMismatch' WHEN 1 THEN 'InvalidFrameMagic' WHEN 2 THEN 'FrameLengthMismatch' WHEN 3 THEN 'TruncatedFrame' ELSE 'Valid' END AS outcome, CASE WHEN frame_id % 6 > 3 THEN device END AS device, CASE WHEN frame_id % 6 > 3 THEN sequence END AS sequence, CASE WHEN frame_id % 6 > 3 THEN payload END AS payload FROM f_frames",
    "f_frames",
)
def _(f: Facts) -> DataFrame:
    n, whole = F.col("frame_id") % 6, F.col("frame")
    size = F.octet_length(whole)
    flipped = F.concat(whole.substr(F.lit(1), size - 1), F.unhex(F.lpad(F.hex((F.conv(F.hex(whole.substr(size, F.lit(1))), 16, 10).cast("long") + 1) % 256), 2, "0")))
    bad = F.when(n == 0, flipped).when(n == 1, F.concat(F.lit(b"X"), whole.substr(F.lit(2), size))).when(n == 2, whole.substr(F.lit(1), size - 3)).when(n == 3, whole.substr(F.lit(1), F.lit(40))).otherwise(whole)
    told = f.frames.withColumn("frame", _frame(f)).select("frame_id", bad.alias("data")).withColumn("outcome", encoding.frame_outcome(F.col("data")))
    fields = F.when(F.col("outcome") == "Valid", encoding.frame_fields(F.col("data")))
    return told.select("frame_id", "outcome", fields["device"].alias("device"), fields["sequence"].alias("sequence"), fields["payload"].cast("string").alias("payload"))


@registered(
    "q78_segment_scan",
    "SELECT device, sequence, payload, CASE WHEN device % 3 = 0 THEN 20 ELSE 0 END AS torn, CAST(NULL AS VARCHAR) AS error FROM f_frames UNION ALL SELECT device, NULL, NULL, 0, 'InvalidFrameMagic at ' || CAST(sum(103 + octet_length(encode(payload))) AS BIGINT) FROM f_frames WHERE device % 3 = 2 GROUP BY device",
    "f_frames",
)
def _(f: Facts) -> DataFrame:
    parts = f.frames.select("device", F.struct("sequence", F.hex(_frame(f)).alias("x")).alias("s")).groupBy("device").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]), "").alias("x"))
    tail = F.when(F.col("device") % 3 == 0, F.repeat(F.lit("00"), 20)).when(F.col("device") % 3 == 2, F.repeat(F.lit("00"), 60)).otherwise("")
    segments = parts.select("device", F.lit(0).cast("long").alias("base"), F.unhex(F.concat("x", tail)).alias("content"))
    return journal.read_segments(segments).select("device", "sequence", F.col("payload").cast("string").alias("payload"), "torn", "error")


@registered("q79_journal_replay", "SELECT device, sequence, payload FROM f_frames", "f_frames")
def _(f: Facts) -> DataFrame:
    """Every frame, in two appends. They are stored first, so that both appends and their checks see the same numbering."""
    held = journal.Journal(f.spark, stage_folder(f.spark))
    frames = staged(f.frames.select("device", "sequence", F.lit(1).alias("kind"), "payload"), "frames")
    held.append(frames.where("sequence < 3"))
    held.append(frames.where("sequence >= 3"))
    return held.read().select("device", "sequence", F.col("payload").cast("string").alias("payload"))


@registered("q80_block_point", "SELECT * FROM f_blocks WHERE block_id = 77", "f_blocks")
def _(f: Facts) -> DataFrame:
    return reads.point(f.blocks, "block_id", 77)


@registered("q81_pages_by_name", "SELECT * FROM f_pages WHERE name = 'Customer#000000042' ORDER BY page_id LIMIT 10", "f_pages")
def _(f: Facts) -> DataFrame:
    return reads.equal_to(f.pages, {"name": "Customer#000000042"}, ["page_id"], 10)


@registered("q82_pages_by_path", "SELECT * FROM f_pages WHERE path = 'seg/BUILDING/Customer#000000042' ORDER BY page_id LIMIT 10", "f_pages")
def _(f: Facts) -> DataFrame:
    return reads.equal_to(f.pages, {"path": "seg/BUILDING/Customer#000000042"}, ["page_id"], 10)


@registered("q83_load_batch", "SELECT * FROM f_batches WHERE batch_id = 123", "f_batches")
def _(f: Facts) -> DataFrame:
    return reads.point(f.batches, "batch_id", 123)


@registered("q84_load_batch_at_sequence", "SELECT batch_id, batch_id + 1 AS sequence, digest FROM f_batches WHERE batch_id = 76", "f_batches")
def _(f: Facts) -> DataFrame:
    return reads.point(f.batches.withColumn("sequence", F.col("batch_id") + 1), "sequence", 77, ["batch_id", "sequence", "digest"])


@registered("q85_all_batches", "SELECT * FROM f_batches ORDER BY batch_id", "f_batches")
def _(f: Facts) -> DataFrame:
    return f.batches.orderBy("batch_id")


@registered("q86_recorded_digest", "SELECT digest FROM f_batches WHERE batch_id = 500", "f_batches")
def _(f: Facts) -> DataFrame:
    return reads.point(f.batches, "batch_id", 500, ["digest"])


@registered("q87_semantic_effects", "SELECT event_id AS sequence, event_type AS effect FROM events ORDER BY event_id")
def _(f: Facts) -> DataFrame:
    return table(f.spark, f.folder, "events").select(F.col("event_id").alias("sequence"), F.col("event_type").alias("effect")).orderBy("sequence")


@registered("q88_uuid_candidates", "SELECT DISTINCT source_page FROM f_claims WHERE kind = 6 AND claim = 23 ORDER BY 1 LIMIT 100", "f_claims")
def _(f: Facts) -> DataFrame:
    return reads.candidates(reads.point(f.claims.where("kind = 6"), "claim", 23), ["source_page"], None, 100)


@registered("q89_alias_candidates", "SELECT DISTINCT source_page FROM f_aliases WHERE normalized_alias = 'nation_3' OR normalized_alias = 'france' ORDER BY 1 LIMIT 100", "f_aliases")
def _(f: Facts) -> DataFrame:
    return reads.candidates(f.aliases.where(F.col("normalized_alias").isin("nation_3", "france")), ["source_page"], None, 100)


@registered("q90_diagnostic_counts", "SELECT (SELECT count(*) FROM f_batches) AS batches, (SELECT count(DISTINCT device) FROM f_frames) AS documents", "f_batches", "f_frames")
def _(f: Facts) -> DataFrame:
    return f.batches.agg(F.count("*").alias("batches")).join(f.frames.agg(F.count_distinct("device").alias("documents")))  # one row each


@registered("q91_integrity", "SELECT 'unique' AS \"check\", 0 AS violations UNION ALL SELECT 'parent of page_id', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)")
def _(f: Facts) -> DataFrame:
    return integrity(f.blocks, ["block_id"], {"page_id": (f.pages.where("page_id % 9 <> 0"), "page_id")})


@registered("q92_block_by_uuid", "SELECT block_id, page_id, uuid, origin FROM n_blocks WHERE uuid = 'u25'", "n_blocks")
def _(f: Facts) -> DataFrame:
    return reads.point(snapshot.flattened(nested(f))["blocks"], "uuid", "u25", ["block_id", "page_id", "uuid", "origin"])


@registered("q93_retained_run_census", "SELECT event_type AS class, count(*) AS n FROM events GROUP BY 1")
def _(f: Facts) -> DataFrame:
    return compaction.census(table(f.spark, f.folder, "events").select(F.col("event_type").alias("class")))


@registered("q94_unreachable_runs", "SELECT event_id AS run_id FROM events WHERE event_id % 3 <> 0 AND event_id % 10 <> 0")
def _(f: Facts) -> DataFrame:
    me = F.col("event_id")
    events = table(f.spark, f.folder, "events")
    return compaction.unreachable(events.select(me.alias("run_id"), (me % 3 == 0).alias("leased")), events.where(me % 10 == 0).select(me.alias("run_id")))


@registered(
    "q95_sealed_outcomes",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'DigestMismatch' WHEN 1 THEN 'UnknownSchema' WHEN 2 THEN 'Malformed' ELSE 'Valid' END AS outcome, CASE WHEN event_id % 5 > 2 THEN props END AS payload FROM events",
)
def _(f: Facts) -> DataFrame:
    n, whole = F.col("event_id") % 5, F.col("whole")
    size = F.octet_length(whole)
    envelope = encoding.sealed(F.when(n < 2, 8).otherwise(7), F.col("props"))
    # The first kind has the right schema over a payload that was changed; the second another schema, the third a byte too many.
    forged = F.concat(F.lit(encoding.SEAL_MAGIC), F.unhex(F.lit("00000007")), whole.substr(F.lit(13), size - 13), F.unhex(F.when(whole.substr(size, F.lit(1)) == F.unhex(F.lit("00")), "01").otherwise("00")))
    data = F.when(n == 0, forged).when(n == 2, F.concat(whole, F.unhex(F.lit("00")))).otherwise(whole)
    told = table(f.spark, f.folder, "events").withColumn("whole", envelope).select("event_id", data.alias("data")).withColumn("outcome", encoding.sealed_outcome(F.col("data"), 7))
    return told.select("event_id", "outcome", F.when(F.col("outcome") == "Valid", encoding.sealed_fields(F.col("data"))["payload"].cast("string")).alias("payload"))


@registered("q96_packs", "SELECT digest, content FROM (SELECT DISTINCT sha256(text) AS digest, text AS content FROM documents WHERE text IS NOT NULL)")
def _(f: Facts) -> DataFrame:
    held, docs = stores.Packs(f.spark, stage_folder(f.spark)), table(f.spark, f.folder, "documents").select("doc_id", "text")
    for part in range(6):  # texts that are in two packs, and a merge of the oldest
        held.add(docs.where((F.col("doc_id") % 6 == part) | (F.col("doc_id") % 60 == 0)), "text")
    while held.compact():
        pass
    return held.read().select("digest", F.col("content").cast("string").alias("content"))


@registered(
    "q97_levels_store",
    "SELECT key, value, generation FROM (SELECT key, arg_max(v, part) AS v, max(part) + 1 AS generation FROM (SELECT user_id AS key, event_id % 5 AS part, {'v': max(CASE WHEN user_id % 7 <> event_id % 5 THEN event_type END)} AS v FROM events GROUP BY 1, 2) GROUP BY key) CROSS JOIN LATERAL (SELECT v.v AS value) WHERE value IS NOT NULL",
)
def _(f: Facts) -> DataFrame:
    held, me = stores.Levels(f.spark, stage_folder(f.spark)), F.col("event_id")
    for part in range(5):
        few = table(f.spark, f.folder, "events").where(me % 5 == part)
        held.insert_many(few.groupBy(F.col("user_id").alias("key")).agg(F.max(F.when(F.col("user_id") % 7 != part, F.col("event_type"))).alias("value")))
    return held.read()
