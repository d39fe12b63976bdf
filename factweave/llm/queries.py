"""The registered query of each operator, over its whole table with production parameters, and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, brown, exact, langid, linedup, media, neardup, packing, pii, urls
from factweave.llm.shared import row_remainder
from factweave.sources.tables import table

#: The rules of the url query, and the key of the surrogates (a deployment passes its own secret).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
SURROGATE_KEY = "registered query"


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    made = bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.packed(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False).drop("ids"))


def op4_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replaced(table(spark, folder, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_entities")


def op5_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(row_remainder("doc_id", 7) == 2, F.lit(False))
    made = brown.scored(table(spark, folder, "documents"), ~held_out)
    return made.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op6_telephony(spark: SparkSession, folder: str) -> DataFrame:
    made = media.telephony(table(spark, folder, "documents"))
    size = F.length("payload").cast("long")
    return made.select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
    )


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"), RULES)


def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.repeats(table(spark, folder, "documents"), line_words=0)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(row_remainder("doc_id", 5) == 0, F.lit(False))
    made = langid.predicted(docs, langid.learned(docs, ~held_out))
    return made.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.classes(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_near_duplicates, op3_packing, op4_surrogates, op5_lm_scores, op6_telephony, op7_url_filter, op8_repeats, op9_language, op10_exact)
}

ORACLE_SQL = {
    "op7_url_filter": r"""
        WITH RECURSIVE seen AS (
          SELECT page_id, html, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw_host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
        ), linked AS (
          SELECT url AS a, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM seen
          UNION ALL
          SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM seen
        ), full_urls AS (
          SELECT a, CASE WHEN contains(b, '://') THEN b WHEN starts_with(b, '//') THEN regexp_extract(a, '(?s)^(.*?)://', 1) || ':' || b
            WHEN starts_with(b, '/') THEN regexp_extract(a, '(?s)^.*?://[^/?#]*') || b END AS b
          FROM (SELECT a, replace(b, '&amp;', '&') AS b FROM linked WHERE b <> '' AND contains(a, '://'))
        ), edges AS (
          SELECT regexp_extract(a, '(?s)^[^#]*') AS a, regexp_extract(b, '(?s)^[^#]*') AS b FROM full_urls WHERE b IS NOT NULL
        ), named AS (
          SELECT lower(regexp_extract(a, '(?s)^.*?://[^/?#]*')) || regexp_extract(a, '(?s)^.*?://[^/?#]*(.*)$', 1) AS a,
            lower(regexp_extract(b, '(?s)^.*?://[^/?#]*')) || regexp_extract(b, '(?s)^.*?://[^/?#]*(.*)$', 1) AS b FROM edges
        ), both_ways AS (SELECT a, b FROM named UNION SELECT b, a FROM named),
        reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
        ruled AS (
          SELECT n, CASE WHEN fits('www.example.com') AND starts_with(p, '/en/') THEN 'allow' WHEN fits('example.com') AND starts_with(p, '/en/') THEN 'block'
            WHEN fits('net') AND (starts_with(p, '/es/') OR starts_with(p, '/fr/')) THEN 'block' WHEN fits('com') AND starts_with(p, '/') THEN 'allow' END AS verdict
          FROM (SELECT n, regexp_extract(n, '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(n, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p FROM (SELECT a AS n FROM both_ways GROUP BY a))
        ), fate AS (
          SELECT reach.a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS inherited FROM reach JOIN ruled ON ruled.n = reach.b GROUP BY reach.a
        ), own AS (
          SELECT page_id, h AS host, p AS path, node,
            CASE WHEN fits('www.example.com') AND starts_with(p, '/en/') THEN 'www.example.com/en/' WHEN fits('example.com') AND starts_with(p, '/en/') THEN 'example.com/en/'
              WHEN fits('net') AND starts_with(p, '/es/') THEN 'net/es/' WHEN fits('net') AND starts_with(p, '/fr/') THEN 'net/fr/' WHEN fits('com') AND starts_with(p, '/') THEN 'com/' END AS rule
          FROM (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, path AS p,
            lower(regexp_extract(url, '(?s)^.*?://[^/?#]*')) || regexp_extract(regexp_extract(url, '(?s)^[^#]*'), '(?s)^.*?://[^/?#]*(.*)$', 1) AS node FROM seen)
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE coalesce(inherited, 'allow') END AS verdict
        FROM own LEFT JOIN fate ON own.node = fate.a
    """,
    "op10_exact": r"""
        WITH units AS (
          SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256
        FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM units)
    """,
}
# DuckDB has no parameter for a repeated condition in plain SQL, so it is written out here.
for _domain in ("www.example.com", "example.com", "net", "com"):
    ORACLE_SQL["op7_url_filter"] = ORACLE_SQL["op7_url_filter"].replace(f"fits('{_domain}')", f"(h = '{_domain}' OR ends_with(h, '.{_domain}'))")
