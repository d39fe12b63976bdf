"""Full-text search over a token table: ranked terms, phrases, boolean and prefix queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.limits import InvalidQuery, after, checked_text, page

WORD = r"([\p{L}\p{N}]+)"


def tokens(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, pos, tok): runs of letters and digits in lower case. The caller normalises the text otherwise."""
    return texts.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))).alias("pos", "tok"))


def terms_of(query: str) -> list[str]:
    import re

    found = re.findall(r"[^\W_]+", checked_text(query).lower())
    if not found:
        raise InvalidQuery("no letter or digit in the query")
    return found


def _frequency(term: str) -> Column:
    return F.size(F.filter("toks", lambda x: x == term))


def bm25(texts: DataFrame, keys: Sequence[str], query: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Texts with all the query's terms; rank is BM25 with its sign turned, so the smallest comes first.

    Only the query's terms are exploded; lengths and document frequencies come from aggregates over arrays.
    """
    terms = terms_of(query)
    toks = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1))
    sized = texts.select(*keys, toks.alias("toks")).where(F.size("toks") > 0)
    counted = sized.select(*keys, F.size("toks").alias("dl"), *[_frequency(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = counted.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    rank = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}")
        rank = rank - idf * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * F.col("dl") / F.col("avgdl")))
    return page(hits.select(*keys, F.round(rank, 9).alias("rank")), ["rank", *keys], limit, "search")


def phrase_pages(texts: DataFrame, keys: Sequence[str], phrase: str, page_key: str, cursor: Sequence | None, limit: int) -> DataFrame:
    """Distinct pages with the phrase's tokens side by side; each text is tested alone, without a join."""
    wanted = terms_of(phrase)
    joined = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1)), " "), F.lit(" "))
    found = texts.where(after([page_key], cursor)).where(joined.contains(f" {' '.join(wanted)} "))
    return page(found.select(page_key).distinct(), [page_key], limit, "name")


def matching(texts: DataFrame, keys: Sequence[str], groups: Sequence[Sequence[str]], without: Sequence[str] = (), limit: int = 100) -> DataFrame:
    """Texts with a term of every group (OR within, AND between) and none of ``without``; ``abc*`` is a prefix."""

    def has(term: str):
        word = checked_text(term).lower()
        if word.endswith("*"):
            return F.exists("toks", lambda x: x.startswith(word[:-1]))
        return F.array_contains("toks", word)

    found = texts.select(*keys, F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1)).alias("toks"))
    for group in groups:
        any_of = F.lit(False)
        for term in group:
            any_of = any_of | has(term)
        found = found.where(any_of)
    for term in without:
        found = found.where(~has(term))
    return page(found.select(*keys), list(keys), limit, "search")


def indexed(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The index of texts: their keys and tokens. Kept as a table, it spares every search the work of finding tokens."""
    return texts.select(*keys, F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1)).alias("toks"))


def unindexed(index: DataFrame, owners: DataFrame, key: str = "page_id") -> DataFrame:
    """The index without the entities of some owners."""
    return index.join(owners.select(key).distinct(), key, "left_anti").select(*index.columns)


class Query:
    """A parsed query: phrases (tokens, the last one maybe a prefix), and a condition over the phrases found.

    Grammar: words and "phrases" side by side must all be there; OR, AND, NOT (binary, upper case), brackets, a star
    after a word or phrase for a prefix, NEAR(a b, n) for at most n tokens between (10 if left out). A word that
    tokenises into several is a phrase. NOT binds closest, then words side by side and AND, then OR.
    """

    def __init__(self, text: str):
        import re

        self.signs = re.findall(r'"(?:[^"]|"")*"\*?|[()]|,|[^\s()",]+', checked_text(text))
        self.at, self.phrases = 0, []
        self.near: dict[int, int] = {}
        self.tree = self._either()
        if self.at < len(self.signs):
            raise InvalidQuery(f"unexpected {self.signs[self.at]!r}")

    def _next(self) -> str | None:
        return self.signs[self.at] if self.at < len(self.signs) else None

    def _either(self) -> tuple:
        parts = [self._all()]
        while self._next() == "OR":
            self.at += 1
            parts.append(self._all())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def _all(self) -> tuple:
        parts = [self._without()]
        while self._next() not in (None, "OR", ")", ","):
            if self._next() == "AND":
                self.at += 1
            parts.append(self._without())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def _without(self) -> tuple:
        out = self._one()
        while self._next() == "NOT":
            self.at += 1
            out = ("not", [out, self._one()])
        return out

    def _one(self) -> tuple:
        sign = self._next()
        if sign in (None, "OR", "AND", "NOT", ")", ","):
            raise InvalidQuery("the query is incomplete")
        self.at += 1
        if sign == "(":
            out = self._either()
            self._expect(")")
            return out
        if sign == "NEAR" and self._next() == "(":
            self.at += 1
            first = len(self.phrases)
            while self._next() not in (None, ")", ","):
                self._one()
            gap = 10
            if self._next() == ",":
                gap = int(self.signs[self.at + 1]) if self.at + 1 < len(self.signs) and self.signs[self.at + 1].isdigit() else -1
                self.at += 2
            self._expect(")")
            if gap < 0 or len(self.phrases) - first < 1:
                raise InvalidQuery("NEAR needs phrases and a number")
            return ("near", list(range(first, len(self.phrases))), gap)
        prefix = sign.endswith("*")
        words = terms_of(sign.rstrip("*").strip('"').replace('""', '"'))
        self.phrases.append((words, prefix))
        return ("phrase", len(self.phrases) - 1)

    def _expect(self, sign: str) -> None:
        if self._next() != sign:
            raise InvalidQuery(f"{sign} is missing")
        self.at += 1

    def places(self, i: int) -> Column:
        """Where phrase i begins among the tokens."""
        words, prefix = self.phrases[i]

        def fits(_: Column, at: Column) -> Column:
            out = F.lit(True)
            for k, word in enumerate(words):
                token = F.coalesce(F.get("toks", at + k), F.lit(""))
                out = out & (token.startswith(word) if prefix and k == len(words) - 1 else token == word)
            return out

        found = F.transform("toks", lambda x, at: F.when(fits(x, at), at))
        return F.filter(found, lambda x: x.isNotNull())

    def _close(self, places: Column, before: int, after_: int, gap: int) -> Column:
        """Places of one phrase with at most ``gap`` tokens between it and one of the places of the phrase before."""
        size, own = len(self.phrases[before][0]), len(self.phrases[after_][0])
        return F.filter(f"places{after_}", lambda y: F.exists(places, lambda x: (y - x - size <= gap) & (x - y - own <= gap)))

    def holds(self, node: tuple) -> Column:
        """The condition over the columns places0, places1, ..."""
        if node[0] == "phrase":
            return F.size(f"places{node[1]}") > 0
        if node[0] == "near":
            chain = F.col(f"places{node[1][0]}")
            for before, after_ in zip(node[1], node[1][1:], strict=False):
                chain = self._close(chain, before, after_, node[2])
            return F.size(chain) > 0
        parts = [self.holds(p) for p in node[1]]
        if node[0] == "not":
            return parts[0] & ~parts[1]
        out = parts[0]
        for p in parts[1:]:
            out = out | p if node[0] == "or" else out & p
        return out


def search(index: DataFrame, keys: Sequence[str], query: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Entities of an index (keys, toks) that the query holds for, best first, then by the keys in their order.

    Rank is BM25 over all the query's phrases with its sign turned. ``keys`` begin with what breaks ties, such as
    the entity type as text and the entity id.
    """
    parsed = Query(query)
    n = range(len(parsed.phrases))
    sized = index.where(F.size("toks") > 0)
    found = sized.select(*keys, F.size("toks").alias("dl"), *[parsed.places(i).alias(f"places{i}") for i in n])
    counted = found.select(*keys, "dl", parsed.holds(parsed.tree).alias("hit"), *[F.size(f"places{i}").alias(f"tf{i}") for i in n])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in n])
    hits = counted.where("hit").join(F.broadcast(stats))  # one row
    rank = F.lit(0.0)
    for i in n:
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}")
        rank = rank - idf * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * F.col("dl") / F.col("avgdl")))
    return page(hits.select(*keys, F.round(rank, 9).alias("rank")), ["rank", *keys], limit, "search")
