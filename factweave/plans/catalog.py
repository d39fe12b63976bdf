"""Registered queries and their oracle SQL, by the survey's names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import digest
from factweave.functions.limits import cursor_page, page
from factweave.operators import changes, log, reads, search, versions
from factweave.sources.facts import Facts
from factweave.sources.tables import table
from factweave.streaming import apply_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The facts in SQL, each a common table expression.
VIEWS = {
    "f_pages": "SELECT c_custkey AS page_id, c_name AS name, lower(c_name) AS name_key, 'seg/' || c_mktsegment || '/' || c_name AS path, c_nationkey % 2 AS text_kind FROM customer",
    "f_blocks": "SELECT o_orderkey AS block_id, o_custkey AS page_id, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS order_key, o_orderpriority AS content FROM orders",
    "f_tasks": "SELECT o_orderkey AS block_id, o_custkey AS page_id, o_orderstatus AS marker, o_orderpriority AS priority, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS scheduled, CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS deadline FROM orders",
    "f_tree": "SELECT conv_id AS page_id, turn AS block_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_id, role, text FROM conversations",
    "f_claims": "SELECT l_suppkey AS source_page, l_orderkey AS source_entity, l_partkey AS claim, 6 + l_linenumber % 2 AS kind, l_linenumber AS ordinal FROM lineitem",
    "f_names": "SELECT o_custkey AS source_page, o_orderkey AS source_entity, c_mktsegment AS raw_name, lower(c_mktsegment) AS normalized_name, o_orderkey % 6 AS kind FROM orders JOIN customer ON o_custkey = c_custkey",
    "f_aliases": "SELECT c_custkey AS source_page, n_name AS raw_alias, lower(n_name) AS normalized_alias FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "f_properties": "SELECT p_partkey AS owner_id, CAST(p_partkey % 2 AS INTEGER) AS owner_type, p_size AS page_id, u.name, u.ordinal, u.value, lower(u.name) AS normalized_name FROM part, LATERAL (VALUES ('Brand', 0::BIGINT, p_brand), ('Type', 1::BIGINT, p_type), ('Size', 2::BIGINT, CAST(p_size AS VARCHAR))) u(name, ordinal, value)",
    "f_tags": "SELECT owner_id, page_id, i - 1 AS ordinal, t[i] AS tag FROM (SELECT p_partkey AS owner_id, p_size AS page_id, string_split(p_name, ' ') AS t FROM part), LATERAL (SELECT unnest(generate_series(1, len(t))) AS i)",
    "f_texts": "SELECT conv_id AS page_id, turn AS entity_id, text FROM conversations",
    "f_frames": "SELECT user_id AS device, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence, event_type AS kind, props AS payload, sha256(props) AS payload_digest, event_id AS frame_id FROM events",
    "f_versions": "SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS key, CASE WHEN event_id % 7 <> 0 THEN props END AS value, event_id AS generation FROM events",
    "f_newest": "SELECT key, arg_max_null(value, generation) AS value, max(generation) AS generation FROM f_versions GROUP BY key",
    "f_batches": "SELECT event_id AS batch_id, event_id % 8 AS peer, event_id // 8 + 1 AS counter, CASE WHEN event_id > 0 THEN event_id - 1 END AS head, sha256(props) AS digest FROM events",
}
_NEEDS = {"f_newest": ["f_versions"]}
REACH = "reach(b, a) AS (SELECT batch_id, batch_id FROM f_dag UNION SELECT r.b, e.head FROM reach r JOIN dag_edges e ON e.batch_id = r.a)"


def registered(name: str, sql: str | None, *views: str):
    """Registers a function of Facts as a query, with its oracle over the named views."""

    def wrap(function: Callable[[Facts], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Facts(spark, folder))
        if sql:
            names = list(dict.fromkeys(x for v in views for x in [*_NEEDS.get(v, []), v]))
            tables = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
            if sql.startswith("RECURSIVE "):  # over all ancestors of the batches of f_dag
                ORACLE_SQL[name] = f"WITH RECURSIVE {tables}, {REACH} {sql.removeprefix('RECURSIVE ')}"
            else:
                ORACLE_SQL[name] = f"WITH {tables} {sql}" if names else sql
        return function

    return wrap


@registered("q01_page_point", "SELECT * FROM f_pages WHERE page_id = 77", "f_pages")
def _(f: Facts) -> DataFrame:
    return reads.point(f.pages, "page_id", 77)


@registered("q02_block_structure", "SELECT page_id, block_id, parent_id FROM f_tree WHERE block_id = 2", "f_tree")
def _(f: Facts) -> DataFrame:
    return reads.point(f.tree, "block_id", 2, ["page_id", "block_id", "parent_id"])


@registered("q03_pages_by_name_key", "SELECT * FROM f_pages WHERE name_key = 'customer#000000042' ORDER BY page_id LIMIT 10", "f_pages")
def _(f: Facts) -> DataFrame:
    return reads.equal_to(f.pages, {"name_key": "customer#000000042"}, ["page_id"], 10)


@registered("q04_pages_by_key_and_kind", "SELECT * FROM f_pages WHERE name_key = 'customer#000000042' AND text_kind = 1 ORDER BY page_id LIMIT 2", "f_pages")
def _(f: Facts) -> DataFrame:
    return reads.equal_to(f.pages, {"name_key": "customer#000000042", "text_kind": 1}, ["page_id"], 2)


@registered("q05_pages_list_kind", "SELECT * FROM f_pages WHERE text_kind = 0 ORDER BY path, page_id LIMIT 500", "f_pages")
def _(f: Facts) -> DataFrame:
    return reads.equal_to(f.pages, {"text_kind": 0}, ["path", "page_id"], 500)


@registered("q06_page_inventory_after", "SELECT page_id, path, name, text_kind FROM f_pages WHERE path > 'seg/BUILDING/' OR (path = 'seg/BUILDING/' AND page_id > 5) ORDER BY path, page_id LIMIT 300", "f_pages")
def _(f: Facts) -> DataFrame:
    return cursor_page(f.pages.select("page_id", "path", "name", "text_kind"), ["path", "page_id"], ("seg/BUILDING/", 5), 300, "inventory")


@registered("q07_navigation_pages_after", "SELECT page_id, path, name, name_key, text_kind FROM f_pages WHERE path > 'seg/FURNITURE/' OR (path = 'seg/FURNITURE/' AND page_id > 1) ORDER BY path, page_id LIMIT 300", "f_pages")
def _(f: Facts) -> DataFrame:
    return cursor_page(f.pages.select("page_id", "path", "name", "name_key", "text_kind"), ["path", "page_id"], ("seg/FURNITURE/", 1), 300, "navigation")


@registered("q08_blocks_on_page", "SELECT * FROM f_blocks WHERE page_id = 7 ORDER BY order_key, block_id LIMIT 100", "f_blocks")
def _(f: Facts) -> DataFrame:
    return reads.equal_to(f.blocks, {"page_id": 7}, ["order_key", "block_id"], 100, "block")


@registered("q09_referrers_to", "SELECT source_page, source_entity, kind, ordinal, claim FROM f_claims WHERE claim = 17 ORDER BY source_page, source_entity, kind, ordinal LIMIT 10000", "f_claims")
def _(f: Facts) -> DataFrame:
    return page(reads.point(f.claims, "claim", 17), ["source_page", "source_entity", "kind", "ordinal"], 10_000, "referrer").select("source_page", "source_entity", "kind", "ordinal", "claim")


@registered("q10_properties_owner", "SELECT * FROM f_properties WHERE owner_id = 5 ORDER BY name, ordinal, value LIMIT 50", "f_properties")
def _(f: Facts) -> DataFrame:
    return reads.equal_to(f.properties, {"owner_id": 5}, ["name", "ordinal", "value"], 50, "property")


@registered("q11_properties_named", "SELECT * FROM f_properties WHERE normalized_name = 'size' AND value = '7' ORDER BY page_id, owner_type, owner_id, ordinal LIMIT 200", "f_properties")
def _(f: Facts) -> DataFrame:
    return reads.equal_to(f.properties, {"normalized_name": "size", "value": "7"}, ["page_id", "owner_type", "owner_id", "ordinal"], 200, "property")


@registered(
    "q12_property_facets_after",
    "SELECT owner_type, owner_id, name, ordinal FROM f_properties WHERE owner_type = 1 AND (owner_id > 9 OR (owner_id = 9 AND name > 'Brand') OR (owner_id = 9 AND name = 'Brand' AND ordinal > 0)) ORDER BY owner_type, owner_id, name, ordinal LIMIT 400",
    "f_properties",
)
def _(f: Facts) -> DataFrame:
    keys = ["owner_type", "owner_id", "name", "ordinal"]
    return cursor_page(f.properties.where("owner_type = 1").select(*keys), keys, (1, 9, "Brand", 0), 400, "property")


@registered("q13_tags", "SELECT * FROM f_tags WHERE tag = (SELECT min(tag) FROM f_tags) ORDER BY page_id, owner_id, ordinal LIMIT 1000", "f_tags")
def _(f: Facts) -> DataFrame:
    lowest = f.tags.agg(F.min("tag")).first()[0]
    return page(f.tags_named(lowest), ["page_id", "owner_id", "ordinal"], 1000, "tag")


@registered("q14_tasks_nulls_last", "SELECT * FROM f_tasks WHERE marker = 'O' ORDER BY deadline IS NULL, deadline, scheduled IS NULL, scheduled, page_id, block_id LIMIT 200", "f_tasks")
def _(f: Facts) -> DataFrame:
    return reads.tasks(f.tasks, "O", 200)


@registered("q15_block_referrers_after", "SELECT DISTINCT source_page, source_entity FROM f_claims WHERE claim = 17 AND (source_page > 1 OR (source_page = 1 AND source_entity > 100)) ORDER BY 1, 2 LIMIT 500", "f_claims")
def _(f: Facts) -> DataFrame:
    return reads.candidates(reads.point(f.claims, "claim", 17), ["source_page", "source_entity"], (1, 100), 500)


@registered("q16_page_referrers_after", "SELECT DISTINCT source_page, source_entity FROM f_names WHERE normalized_name = 'building' AND kind <= 4 AND (source_page > 10 OR (source_page = 10 AND source_entity > 3)) ORDER BY 1, 2 LIMIT 500", "f_names")
def _(f: Facts) -> DataFrame:
    return reads.candidates(f.names.where("normalized_name = 'building' AND kind <= 4"), ["source_page", "source_entity"], (10, 3), 500)


@registered("q17_property_candidates_after", "SELECT DISTINCT page_id, owner_id FROM f_properties WHERE owner_type = 1 AND normalized_name = 'brand' AND (page_id > 3 OR (page_id = 3 AND owner_id > 9)) ORDER BY 1, 2 LIMIT 500", "f_properties")
def _(f: Facts) -> DataFrame:
    return reads.candidates(f.properties.where("owner_type = 1 AND normalized_name = 'brand'"), ["page_id", "owner_id"], (3, 9), 500)


@registered("q18_task_candidate_pages_after", "SELECT DISTINCT page_id FROM f_tasks WHERE marker = 'P' AND page_id > 20 ORDER BY 1 LIMIT 500", "f_tasks")
def _(f: Facts) -> DataFrame:
    return reads.candidates(f.tasks.where("marker = 'P'"), ["page_id"], (20,), 500)


@registered("q19_name_candidates_kind_ne_4", "SELECT DISTINCT source_page FROM f_names WHERE normalized_name = 'machinery' AND kind <> 4 ORDER BY 1 LIMIT 10000", "f_names")
def _(f: Facts) -> DataFrame:
    return reads.candidates(f.names.where("normalized_name = 'machinery' AND kind <> 4"), ["source_page"], None, 10_000)


@registered(
    "q20_task_candidate_blocks_after",
    "SELECT t.page_id, t.block_id, p.path, p.name, p.text_kind, b.order_key, b.content, t.marker, t.priority FROM f_tasks t JOIN f_blocks b ON b.block_id = t.block_id AND b.page_id = t.page_id JOIN f_pages p ON p.page_id = t.page_id WHERE t.marker = 'O' AND (t.page_id > 10 OR (t.page_id = 10 AND t.block_id > 50)) ORDER BY 1, 2 LIMIT 1000",
    "f_tasks", "f_blocks", "f_pages",
)
def _(f: Facts) -> DataFrame:
    return reads.task_candidate_blocks(f.tasks, f.blocks, f.pages, "O", (10, 50), 1000)


@registered("q21_navigation_aliases_after", "SELECT * FROM (SELECT DISTINCT path, raw_alias, page_id FROM f_aliases JOIN f_pages ON source_page = page_id) WHERE path > 'seg/BUILDING/' OR (path = 'seg/BUILDING/' AND raw_alias > 'A') OR (path = 'seg/BUILDING/' AND raw_alias = 'A' AND page_id > 0) ORDER BY 1, 2, 3 LIMIT 700", "f_aliases", "f_pages")
def _(f: Facts) -> DataFrame:
    return reads.named_pages(f.pages, f.aliases, ["raw_alias"], ("seg/BUILDING/", "A", 0), 700, "alias")


@registered("q22_navigation_reference_names_after", "SELECT DISTINCT path, raw_name, normalized_name, page_id FROM f_names JOIN f_pages ON source_page = page_id WHERE kind <= 4 AND path > 'seg/FURNITURE/' ORDER BY 1, 2, 3, 4 LIMIT 700", "f_names", "f_pages")
def _(f: Facts) -> DataFrame:
    return reads.named_pages(f.pages, f.names.where("kind <= 4"), ["raw_name", "normalized_name"], ("seg/FURNITURE/", "", "", 0), 700, "name")


@registered("q23_block_reference_counts", "SELECT claim, count(DISTINCT source_entity) AS sources FROM f_claims WHERE claim > 3 GROUP BY claim ORDER BY claim LIMIT 500", "f_claims")
def _(f: Facts) -> DataFrame:
    return reads.reference_counts(f.claims, "claim", "source_entity", None, (3,), 500)


@registered("q24_block_reference_counts_for_page", "SELECT claim, count(DISTINCT source_entity) AS sources FROM f_claims WHERE source_page = 3 GROUP BY claim ORDER BY claim LIMIT 500", "f_claims")
def _(f: Facts) -> DataFrame:
    return reads.reference_counts(f.claims, "claim", "source_entity", 3, None, 500)


@registered("q25_alias_bindings", "SELECT normalized_alias, row_number() OVER (PARTITION BY normalized_alias ORDER BY source_page) - 1 AS candidate_ordinal, source_page AS resolved_page FROM (SELECT DISTINCT normalized_alias, source_page FROM f_aliases)", "f_aliases")
def _(f: Facts) -> DataFrame:
    return reads.alias_bindings(f.aliases)


@registered("q25b_rebound_aliases", "SELECT normalized_alias, row_number() OVER (PARTITION BY normalized_alias ORDER BY source_page) - 1 AS candidate_ordinal, source_page AS resolved_page FROM (SELECT DISTINCT normalized_alias, source_page FROM f_aliases WHERE source_page % 10 <> 0)", "f_aliases")
def _(f: Facts) -> DataFrame:
    touched = f.aliases.where("source_page % 10 = 0").select("normalized_alias").distinct()
    return reads.rebound(reads.alias_bindings(f.aliases), f.aliases.where("source_page % 10 <> 0"), touched)


@registered(
    "q26_fts_left_join_mismatch",
    "SELECT count(*) FILTER (WHERE i.entity_id IS NULL) AS absent, count(*) FILTER (WHERE i.entity_id IS NOT NULL AND o.text <> i.text) AS different FROM f_texts o LEFT JOIN (SELECT page_id, entity_id, CASE WHEN page_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM f_texts WHERE entity_id <> 3) i ON o.page_id = i.page_id AND o.entity_id = i.entity_id",
    "f_texts",
)
def _(f: Facts) -> DataFrame:
    index = f.texts.where("entity_id <> 3").withColumn("text", F.when(F.col("page_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return reads.mismatches(f.texts, index, ["page_id", "entity_id"], ["text"])


@registered("q27_coverage_counts", "SELECT count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def _(f: Facts) -> DataFrame:
    return reads.coverage(table(f.spark, f.folder, "documents"), table(f.spark, f.folder, "labels"), "doc_id")


@registered("q28_uncovered_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(f: Facts) -> DataFrame:
    return table(f.spark, f.folder, "documents").select("doc_id").join(table(f.spark, f.folder, "labels").select("doc_id"), "doc_id", "left_anti")


_BM25 = """SELECT page_id, entity_id, round(-(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS rank
FROM (SELECT page_id, entity_id, dl, tf, count(*) OVER () AS n, avg(dl) OVER () AS avgdl, count(*) FILTER (WHERE tf > 0) OVER () AS df
  FROM (SELECT page_id, entity_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS tf FROM (SELECT page_id, entity_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM f_texts) WHERE len(t) > 0))
WHERE tf > 0 ORDER BY rank, page_id, entity_id LIMIT 1000"""


@registered("q29_bm25_search", _BM25, "f_texts")
def _(f: Facts) -> DataFrame:
    return search.bm25(f.texts, ["page_id", "entity_id"], "the", 1000)


@registered("q30_phrase_pages", "SELECT DISTINCT page_id FROM f_texts WHERE page_id > 2 AND contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' of the ') ORDER BY 1 LIMIT 100", "f_texts")
def _(f: Facts) -> DataFrame:
    return search.phrase_pages(f.texts, ["page_id", "entity_id"], "of-the", "page_id", (2,), 100)


@registered(
    "q30b_boolean_search",
    "SELECT page_id, entity_id FROM (SELECT page_id, entity_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM f_texts) WHERE (list_contains(t, 'the') OR list_contains(t, 'der')) AND len(list_filter(t, lambda x: starts_with(x, 'th'))) > 0 AND NOT list_contains(t, 'of') ORDER BY 1, 2 LIMIT 1000",
    "f_texts",
)
def _(f: Facts) -> DataFrame:
    return search.matching(f.texts, ["page_id", "entity_id"], [["the", "der"], ["th*"]], ["of"], 1000)


@registered("q30c_token_index", "SELECT page_id, entity_id, i - 1 AS pos, t[i] AS tok FROM (SELECT page_id, entity_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM f_texts), LATERAL (SELECT unnest(generate_series(1, len(t))) AS i)", "f_texts")
def _(f: Facts) -> DataFrame:
    return search.tokens(f.texts, ["page_id", "entity_id"]).withColumn("pos", F.col("pos").cast("long"))


@registered("q31_page_replace_snapshot", "SELECT block_id, page_id, order_key, content FROM f_blocks WHERE page_id % 10 <> 0 UNION ALL SELECT block_id, page_id + 1, order_key, lower(content) FROM f_blocks WHERE page_id % 10 = 0", "f_blocks")
def _(f: Facts) -> DataFrame:
    touched = f.pages.where("page_id % 10 = 0")
    new = f.blocks.where("page_id % 10 = 0").withColumns({"page_id": F.col("page_id") + 1, "content": F.lower("content")})
    return changes.replaced(f.blocks, touched, new, "page_id").select("block_id", "page_id", "order_key", "content")


@registered("q32_page_delete_refs", "SELECT source_page, target_page, target_block FROM (SELECT source_page, claim AS target_page, source_entity AS target_block FROM f_claims) WHERE source_page NOT IN (SELECT page_id FROM f_pages WHERE page_id % 10 IN (0, 1)) AND target_page NOT IN (SELECT page_id FROM f_pages WHERE page_id % 10 = 1) AND target_block % 10 <> 3", "f_claims", "f_pages")
def _(f: Facts) -> DataFrame:
    refs = f.claims.select("source_page", F.col("claim").alias("target_page"), F.col("source_entity").alias("target_block"))
    return changes.remaining_refs(refs, f.pages.where("page_id % 10 = 0"), f.pages.where("page_id % 10 = 1"), f.blocks.where("block_id % 10 = 3"))


@registered("q33_flatten_children", "SELECT page_id, i - 1 AS ordinal, l[i] AS line FROM (SELECT doc_id AS page_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)")
def _(f: Facts) -> DataFrame:
    nested = table(f.spark, f.folder, "documents").select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("lines"))
    return changes.flattened(nested, ["page_id"], "lines", "line")


@registered(
    "q34_metadata_preservation",
    "SELECT n.page_id, CASE WHEN o.page_id IS NULL THEN 'Incomplete' WHEN o.name IS DISTINCT FROM n.name OR o.text_kind IS DISTINCT FROM n.text_kind THEN 'Contradiction' ELSE 'Preserved' END AS outcome FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN lower(name) ELSE name END AS name, text_kind FROM f_pages) n LEFT JOIN (SELECT * FROM f_pages WHERE page_id % 7 <> 0) o ON o.page_id = n.page_id",
    "f_pages",
)
def _(f: Facts) -> DataFrame:
    new = f.pages.withColumn("name", F.when(F.col("page_id") % 9 == 0, F.lower("name")).otherwise(F.col("name")))
    return changes.preservation(f.pages.where("page_id % 7 <> 0"), new, "page_id", ["name", "text_kind"])


_REQUESTS = "SELECT batch_id, CASE WHEN batch_id % 10 = 1 THEN digest || 'x' ELSE digest END AS digest, CASE WHEN batch_id % 10 = 2 THEN -5 ELSE head END AS head, CASE WHEN batch_id % 10 IN (3, 4) THEN 501 ELSE batch_id END AS sequence FROM f_batches"


@registered(
    "q35_accepted_batch_classify",
    f"SELECT r.batch_id, CASE WHEN a.digest = r.digest THEN 'Duplicate' WHEN a.digest IS NOT NULL THEN 'BatchCollision' WHEN r.head IS NOT NULL AND h.batch_id IS NULL THEN 'MissingDependency' WHEN r.sequence <> 501 THEN 'AcceptanceOrder' ELSE 'New' END AS outcome FROM ({_REQUESTS}) r LEFT JOIN (SELECT * FROM f_batches WHERE batch_id < 500) a ON a.batch_id = r.batch_id LEFT JOIN (SELECT * FROM f_batches WHERE batch_id < 500) h ON h.batch_id = r.head",
    "f_batches",
)
def _(f: Facts) -> DataFrame:
    n = F.col("batch_id") % 10
    requests = f.batches.select("batch_id", F.when(n == 1, F.concat("digest", F.lit("x"))).otherwise(F.col("digest")).alias("digest"), F.when(n == 2, -5).otherwise(F.col("head")).alias("head"), F.when(n.isin(3, 4), 501).otherwise(F.col("batch_id")).alias("sequence"))
    return log.classified(requests, f.batches.where("batch_id < 500"), 500)


@registered("q36_clock_union", "SELECT peer, max(counter) AS counter FROM f_batches GROUP BY peer", "f_batches")
def _(f: Facts) -> DataFrame:
    return log.clock(f.batches)


@registered("q36b_batch_clocks", "SELECT batch_id, peer, counter, " + ", ".join(f"coalesce(max(CASE WHEN peer = {p} THEN counter END) OVER (ORDER BY batch_id), 0) AS p{p}" for p in range(8)) + " FROM f_batches", "f_batches")
def _(f: Facts) -> DataFrame:
    return log.clocks(f.batches, list(range(8)))


@registered("q37_descends_from", "SELECT batch_id AS descendant, CASE WHEN batch_id % 3 = 0 THEN batch_id + 7 ELSE batch_id // 2 END AS ancestor, CASE WHEN batch_id % 3 = 0 THEN false ELSE true END AS descends FROM f_batches", "f_batches")
def _(f: Facts) -> DataFrame:
    pairs = f.batches.select(F.col("batch_id").alias("descendant"), F.when(F.col("batch_id") % 3 == 0, F.col("batch_id") + 7).otherwise(F.expr("batch_id div 2")).alias("ancestor"))
    return log.descends(log.clocks(f.batches, list(range(8))), pairs, list(range(8)))


@registered("q38_latest_documents", "SELECT device, arg_max(payload, frame_id) AS payload, max(frame_id) AS frame_id FROM f_frames GROUP BY device", "f_frames")
def _(f: Facts) -> DataFrame:
    return log.latest(f.frames, "device", "payload", "frame_id")


@registered("q39_ancestor_walk", "SELECT a.page_id, a.block_id, b.block_id AS ancestor_id, a.block_id - b.block_id AS distance FROM f_tree a JOIN f_tree b ON a.page_id = b.page_id AND b.block_id < a.block_id", "f_tree")
def _(f: Facts) -> DataFrame:
    return reads.ancestors(f.tree)


@registered("q40_journal_gaps", "SELECT device, sequence, sequence - coalesce(lag(sequence) OVER (PARTITION BY device ORDER BY sequence), -1) AS gap FROM f_frames WHERE frame_id % 11 <> 0", "f_frames")
def _(f: Facts) -> DataFrame:
    return log.gaps(f.frames.where("frame_id % 11 <> 0"))


@registered("q41_journal_prefix_replay", "SELECT device, sequence, kind, payload, payload_digest, frame_id FROM f_frames WHERE sequence < 1 + device % 4", "f_frames")
def _(f: Facts) -> DataFrame:
    extents = f.frames.select("device").distinct().withColumn("extent", 1 + F.col("device") % 4)
    return log.replayed(f.frames, extents)


@registered("q42_frame_validity", "SELECT frame_id, CASE WHEN frame_id % 5 = 0 THEN 'Corrupt' WHEN frame_id % 5 = 1 THEN 'Malformed' ELSE 'Valid' END AS outcome FROM f_frames", "f_frames")
def _(f: Facts) -> DataFrame:
    n = F.col("frame_id") % 5
    return log.frame_validity(f.frames.withColumns({"payload": F.when(n == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")), "payload_digest": F.when(n == 1, F.upper("payload_digest")).otherwise(F.col("payload_digest"))}).withColumn("payload_digest", F.when(n == 1, F.concat(F.lit("X"), F.col("payload_digest"))).otherwise(F.col("payload_digest"))))


@registered("q43_lsm_lookup_newest", "SELECT * FROM f_newest", "f_newest")
def _(f: Facts) -> DataFrame:
    return versions.newest(f.versions, tombstones=True)


@registered("q44_lsm_lookup_many", "SELECT event_id AS position, CAST(event_id % 400 AS VARCHAR) || '/click' AS key, n.value FROM events LEFT JOIN f_newest n ON n.key = CAST(event_id % 400 AS VARCHAR) || '/click'", "f_newest")
def _(f: Facts) -> DataFrame:
    asked = table(f.spark, f.folder, "events").select(F.col("event_id").alias("position"), F.concat((F.col("event_id") % 400).cast("string"), F.lit("/click")).alias("key"))
    return versions.lookup_many(f.versions, asked)


@registered("q45_lsm_scan_prefix", "SELECT * FROM f_newest WHERE starts_with(key, '1') AND value IS NOT NULL", "f_newest")
def _(f: Facts) -> DataFrame:
    return versions.scan_prefix(f.versions, "1")


@registered("q46_radix_lookup_version", "SELECT key, arg_max_null(value, generation) AS value, max(generation) AS generation FROM f_versions WHERE generation <= 400 GROUP BY key HAVING arg_max_null(value, generation) IS NOT NULL", "f_versions")
def _(f: Facts) -> DataFrame:
    return versions.as_of(f.versions, 400)


@registered("q47_radix_prefix_limited", "SELECT * FROM f_newest WHERE starts_with(key, '2') AND value IS NOT NULL ORDER BY key LIMIT 25", "f_newest")
def _(f: Facts) -> DataFrame:
    return versions.first_with_prefix(f.versions, "2", 25)


@registered("q48_radix_remove", "SELECT * FROM f_newest WHERE value IS NOT NULL AND NOT ends_with(key, '/click')", "f_newest")
def _(f: Facts) -> DataFrame:
    gone = f.versions.where(F.col("key").endswith("/click")).select("key").distinct()
    return versions.newest(versions.removed(f.versions, gone, 1 << 40))


_ROW = " || '|' || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("block_id", "page_id", "marker", "scheduled", "deadline"))


@registered(
    "q49_table_digest",
    f"SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(b || d, '' ORDER BY b)) AS digest FROM (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM (SELECT sha256({_ROW}) AS h FROM f_tasks) GROUP BY 1)",
    "f_tasks",
)
def _(f: Facts) -> DataFrame:
    return digest.table_digest(f.tasks, ["block_id", "page_id", "marker", "scheduled", "deadline"])


@registered("q50_conflicting_duplicates", "SELECT device, count(*) AS copies FROM f_frames GROUP BY device HAVING count(DISTINCT kind) > 1", "f_frames")
def _(f: Facts) -> DataFrame:
    return changes.conflicts(f.frames, "device", "kind")


@registered("q51_size_tiers", "SELECT CAST(floor(log2(n_chars)) AS BIGINT) AS tier, count(*) AS n FROM documents WHERE n_chars > 0 GROUP BY 1")
def _(f: Facts) -> DataFrame:
    return versions.size_tiers(table(f.spark, f.folder, "documents"), "n_chars")


@registered("q52_sample_ranges", "SELECT key, i AS ordinal, CASE WHEN s <= 1048576 THEN 0 ELSE ((s - 16384) // 7) * i END AS offset, CASE WHEN s <= 1048576 THEN s ELSE 16384 END AS length FROM (SELECT doc_id AS key, n_chars * 997 AS s FROM documents), LATERAL (SELECT unnest(generate_series(0, CASE WHEN s <= 1048576 THEN 0 ELSE 7 END)) AS i)")
def _(f: Facts) -> DataFrame:
    return versions.sample_ranges(table(f.spark, f.folder, "documents").select(F.col("doc_id").alias("key"), (F.col("n_chars") * 997).alias("s")), "s")


@registered("q53_stream_dedup_apply", "SELECT batch_id, peer, counter, digest FROM f_batches", "f_batches")
def _(f: Facts) -> DataFrame:
    return apply_log.replay_as_stream(f.spark, f.batches.select("batch_id", "peer", "counter", "digest"))


@registered(
    "q54_manifest_validation",
    "SELECT batch_id, CASE WHEN batch_id % 7 = 0 THEN 'CounterNotPositive' WHEN batch_id % 7 = 1 THEN 'HeadsNotSortedUnique' WHEN batch_id % 7 = 2 THEN 'SelfDependency' WHEN batch_id % 7 = 3 THEN 'DuplicateObject' ELSE 'Valid' END AS outcome FROM f_batches",
    "f_batches",
)
def _(f: Facts) -> DataFrame:
    n, me = F.col("batch_id") % 7, F.col("batch_id")
    heads = F.when(n == 1, F.array(me + 2, me + 1)).when(n == 2, F.array(me - 1, me)).otherwise(F.array(me - 2, me - 1))
    objects = F.when(n == 3, F.array("digest", "digest")).otherwise(F.array("digest"))
    return log.manifest_outcome(f.batches.select("batch_id", F.when(n == 0, 0).otherwise(F.col("counter")).alias("counter"), heads.alias("heads"), objects.alias("objects")))
