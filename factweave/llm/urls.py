"""URL filter: rules by host and path, carried along redirects and canonical links; DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.shared import components, stored

_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_GOTO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The resource a url names: no fragment, host in lower case. Null where there is no ``://``."""
    bare = F.regexp_extract(url, r"(?s)^[^#]*", 0)
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(bare.contains("://"), F.concat(F.lower(F.regexp_extract(bare, r"(?s)^(.*?)://", 1)), F.lit("://"), host_of(bare), rest))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``) that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, tail = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + tail)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _without_dots(path: Column) -> Column:
    """A path without its dot segments (RFC 3986, 5.2.4); it starts with ``/`` or is empty."""
    parts = F.split(F.substr(path, F.lit(2)), "/", -1)

    def step(state: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0)))).when(part == ".", state).otherwise(F.concat(state, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path == "", path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def resolved(base: Column, reference: Column) -> Column:
    """The url that a reference names on the page of the url ``base`` (RFC 3986, 5.2), without its fragment."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    start = F.concat(scheme, F.lit("://"), host_of(base))
    bare = F.regexp_extract(reference, r"(?s)^[^#]*", 0)
    path, query = F.regexp_extract(bare, r"(?s)^[^?]*", 0), F.regexp_extract(bare, r"(?s)(\?.*)$", 1)
    full = F.when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare)).otherwise(bare)
    origin, rest = F.regexp_extract(full, r"(?s)^[^?]*?://[^/?]*", 0), F.regexp_extract(full, r"(?s)^[^?]*?://[^/?]*([^?]*)", 1)
    merged = F.concat(F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"(?s)^.*/", 0), F.lit("")), F.lit("/")), path)
    return (
        F.when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(origin, _without_dots(rest), query))
        .when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), full)
        .when(bare == "", F.regexp_extract(base, r"(?s)^[^#]*", 0))
        .when(path == "", F.concat(start, path_of(base), query))
        .otherwise(F.concat(start, _without_dots(F.when(path.startswith("/"), path).otherwise(merged)), query))
    )


def link_edges(pages: DataFrame, url_column: str, html_column: str) -> DataFrame:
    """(a, b): each page's resource and those that its canonical links and refreshes name; ``<base>`` is not read."""
    url, html = F.col(url_column), F.col(html_column)
    there = pages.where(url.contains("://") & html.rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    links, metas = (F.regexp_extract_all(html, F.lit(p), F.lit(0)) for p in (_LINK, _META))
    target = F.explode(F.concat(F.transform(links, lambda x: F.regexp_extract(x, _HREF, 1)), F.transform(metas, lambda x: F.regexp_extract(x, _GOTO, 1))))
    found = there.select(url.alias("from"), target.alias("to")).where("to <> ''").withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    return found.select(node_of(F.col("from")).alias("a"), node_of(resolved(F.col("from"), F.col("to"))).alias("b")).where("a is not null and b is not null")


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None, default: str = "allow",
    id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages.

    The longest rule that fits a url decides. Urls without one share the fate of their aliases: resources joined
    by redirects (``redirects``: from_url, to_url) and canonical links, in any number of steps. If a resource of
    the component is allowed by a rule, the component is allowed; else if one is blocked by a rule, blocked; else
    ``default``. Null urls and urls without ``://`` have an empty host and path and the default verdict. Rows
    may repeat; other columns are ignored; no rows give no rows.
    """
    edges = link_edges(pages, url_column, html_column)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a is not null and b is not null"))
    nodes = components(edges, "url-components")
    own = nodes.withColumn("m", matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
    fate = own.groupBy("root").agg(F.coalesce(F.bool_or(F.col("m.verdict") == "allow"), F.lit(False)).alias("allowed"), F.coalesce(F.bool_or(F.col("m.verdict") == "block"), F.lit(False)).alias("blocked"))
    fate = fate.where("allowed or blocked").select("root", F.when(F.col("allowed"), "allow").otherwise("block").alias("inherited"))
    inherited = stored(nodes.join(fate, "root").select("node", "inherited"), "url-fates")
    url = F.col(url_column)
    seen = pages.select(F.col(id_column), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    seen = seen.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    return seen.join(inherited, "node", "left").select(id_column, "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), F.col("inherited"), F.lit(default)).alias("verdict"))
