"""Lookups: full text by prefixes, hosts by suffixes, symbols by rank, banned phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Exchanges whose listings come first.
PREFERRED = ("NASDAQ", "NYSE")


def query_tokens(query: str) -> list[str]:
    """Words of a query in lower case: two letters or more, or with a digit."""
    import regex

    return [t for t in regex.findall(r"[\p{L}\p{N}]+", query.lower()) if len(t) >= 2 or any(c.isdigit() for c in t)]


def fulltext(rows: DataFrame, keys: list[str], text: str, query: str) -> DataFrame:
    """Keys of the rows in which every word of the query begins a word; none for an empty query."""
    asked = query_tokens(query)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def begins(t: str):
        return F.exists(words, lambda w: w.startswith(t))

    tests = list(map(begins, asked))
    return rows.filter(reduce(lambda a, b: a & b, tests) if tests else F.lit(False)).select(keys)


def host_tier(pages: DataFrame, tiers: list[tuple[str, int]], default: int = 2) -> DataFrame:
    """(page_id, host, tier): the first listed domain that a host is or belongs to."""
    listed = pages.sparkSession.createDataFrame([(h, t, i) for i, (h, t) in enumerate(tiers)], "domain string, tier int, at int")
    hosts = pages.select("page_id", T.host(F.col("url")).alias("host"))
    by_host = hosts.select("host").distinct().withColumn("domain", F.explode(T.suffixes(F.col("host"))))
    found = by_host.join(F.broadcast(listed), "domain").groupBy("host").agg(F.min_by("tier", "at").alias("tier"))  # the list is given in the call
    return hosts.join(found, "host", "left").select("page_id", "host", F.coalesce("tier", F.lit(default)).alias("tier"))


def search_symbols(symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Tradable symbols by rank: exact, symbol prefix, name prefix, word prefix, anywhere in the name."""
    q, name_q = query.strip().lower(), " ".join("".join(c if c.isalnum() else " " for c in query.lower()).split())
    s, n = F.lower("symbol"), T.searchable(F.col("name"))
    rank = F.when(s == q, 100).when(s.startswith(q), 90).when(n.startswith(name_q), 80).when(n.contains(" " + name_q), 70).otherwise(60)
    found = symbols.filter(F.coalesce("tradable", F.lit(True)) & (s.startswith(q) | n.contains(name_q))).withColumn("rank", rank)
    preferred = F.when(F.col("exchange").isin(*PREFERRED), 0).otherwise(1)
    return found.orderBy(F.desc("rank"), preferred, F.length("symbol"), "symbol").limit(max(1, min(50, limit))).select("symbol", "name", "exchange", "rank")


def banned(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """Documents with a banned phrase, and which."""
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(low.contains(p), F.lit(p)) for p in phrases]), lambda p: p.isNotNull())
    return docs.select("doc_id", F.array_join(found, ",").alias("banned")).filter("banned <> ''")
