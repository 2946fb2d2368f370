"""Rows out of feeds and responses: each takes a DataFrame with the raw text in a column, so the fetch stays outside.

A malformed document gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

PARALLEL_BARS = "struct<symbol:string,timestamp:array<long>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>"
SERP_NEWS = "struct<news_results:array<struct<title:string,link:string,source:string,date:string>>>"
SERP_WEB = "struct<organic_results:array<struct<title:string,link:string,snippet:string,position:int>>,related_searches:array<struct<query:string>>,related_questions:array<struct<question:string>>>"
FACTS = "map<string,array<struct<unit:string,start:date,end:date,val:double,fp:string,form:string>>>"


def parallel_bars(raw: DataFrame, column: str) -> DataFrame:
    """Bars from arrays side by side: a null close drops the row, null open, high and low take the close, null volume is 0."""
    r = raw.select(F.from_json(column, PARALLEL_BARS).alias("r")).select("r.*")
    rows = r.select("symbol", F.inline(F.arrays_zip("timestamp", "open", "high", "low", "close", "volume"))).filter("close IS NOT NULL")
    price = [F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")]
    return rows.select("symbol", F.timestamp_seconds("timestamp").alias("ts"), *price, "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def positional_bars(raw: DataFrame, symbol: str, column: str) -> DataFrame:
    """Bars from [day, open, high, low, close, volume, vwap] tuples; rows without finite prices are dropped."""
    rows = raw.select(F.col(symbol).alias("symbol"), F.explode(F.from_json(column, "array<array<string>>")).alias("t"))
    names = ("open", "high", "low", "close", "volume", "vwap")
    out = rows.select("symbol", F.to_date(F.get("t", 0)).alias("day"), *[F.get("t", i + 1).try_cast("double").alias(n) for i, n in enumerate(names)])
    finite = [F.col(c).isNotNull() & ~F.isnan(c) for c in names[:4]]
    return out.filter(finite[0] & finite[1] & finite[2] & finite[3])


def multi_bars(raw: DataFrame, column: str) -> DataFrame:
    """Bars from a map of symbol to a list of {t, o, h, l, c, v, vw}."""
    bar = "map<string,array<struct<t:timestamp,o:double,h:double,l:double,c:double,v:double,vw:double>>>"
    rows = raw.select(F.explode(F.from_json(column, bar)).alias("symbol", "bars")).select("symbol", F.inline("bars"))
    return rows.select("symbol", F.col("t").alias("ts"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"), F.col("vw").alias("vwap"))


def snapshots(requested: DataFrame, raw: DataFrame, column: str) -> DataFrame:
    """One row per requested symbol, found or not."""
    got = raw.select(F.explode(F.from_json(column, "map<string,struct<price:double,prev:double>>")).alias("symbol", "s")).select("symbol", "s.*")
    return requested.join(got, "symbol", "left").select("symbol", "price", "prev")


def serp_news(raw: DataFrame, column: str) -> DataFrame:
    rows = raw.select(F.inline(F.from_json(column, SERP_NEWS)["news_results"]))
    return rows.filter("title IS NOT NULL AND link IS NOT NULL").withColumn("host", T.host(F.col("link")))


def serp_web(raw: DataFrame, column: str) -> DataFrame:
    rows = raw.select(F.inline(F.from_json(column, SERP_WEB)["organic_results"]))
    return rows.filter("link IS NOT NULL").withColumn("host", T.host(F.col("link")))


def related_searches(raw: DataFrame, column: str, longest: int = 120) -> DataFrame:
    rows = raw.select(F.explode(F.transform(F.from_json(column, SERP_WEB)["related_searches"], lambda x: F.trim(x["query"]))).alias("query"))
    return rows.filter((F.col("query") != "") & (F.char_length("query") < longest))


def _tag(block: Column, name: str) -> Column:
    inner = F.regexp_extract(block, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
    return T.markup_text(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def feed_items(raw: DataFrame, column: str) -> DataFrame:
    """(title, link, published, source) of RSS items and Atom entries; a link is needed."""
    blocks = F.concat(F.regexp_extract_all(column, F.lit(r"(?is)<item\b[^>]*>.*?</item>"), F.lit(0)), F.regexp_extract_all(column, F.lit(r"(?is)<entry\b[^>]*>.*?</entry>"), F.lit(0)))
    rows = raw.select(F.explode(blocks).alias("b"))
    href = F.regexp_extract("b", r'(?is)<link[^>]*href="([^"]+)"', 1)
    b = F.col("b")
    out = rows.select(_tag(b, "title").alias("title"), F.coalesce(F.nullif(href, F.lit("")), F.nullif(_tag(b, "link"), F.lit(""))).alias("link"), F.coalesce(F.nullif(_tag(b, "pubDate"), F.lit("")), F.nullif(_tag(b, "updated"), F.lit(""))).alias("published"), F.nullif(_tag(b, "source"), F.lit("")).alias("source"))
    return out.filter("link IS NOT NULL")


def episodes(raw: DataFrame, column: str) -> DataFrame:
    """Feed items with an enclosure of audio or video."""
    blocks = F.regexp_extract_all(column, F.lit(r"(?is)<item\b[^>]*>.*?</item>"), F.lit(0))
    rows = raw.select(F.explode(blocks).alias("b"))
    enclosure = F.regexp_extract("b", r"(?is)(<enclosure\b[^>]*>)", 1)
    out = rows.select(_tag(F.col("b"), "title").alias("title"), F.regexp_extract(enclosure, r'url="([^"]+)"', 1).alias("url"), F.regexp_extract(enclosure, r'type="([^"]+)"', 1).alias("type"))
    return out.filter("url <> '' AND type RLIKE '^(audio|video)/'")


def facts_long(raw: DataFrame, column: str) -> DataFrame:
    """Company facts as rows (symbol, concept, pos, unit, start, end, val, fp, form)."""
    rows = raw.select("symbol", F.explode(F.from_json(column, FACTS)).alias("concept", "points"))
    return rows.select("symbol", "concept", F.posexplode("points").alias("pos", "p")).select("symbol", "concept", "pos", "p.*")


def ticker_tokens(raw: DataFrame, column: str) -> DataFrame:
    """(ticker, valid): the tokens of a free list in order of first sight, once each."""
    tokens = raw.select(F.posexplode(F.split(column, r"[\s,;]+")).alias("pos", "t")).filter("t <> ''").select("pos", F.upper(F.regexp_replace("t", r"^\$", "")).alias("ticker"))
    return tokens.groupBy("ticker").agg(F.min("pos").alias("first")).select("ticker", F.col("ticker").rlike(r"^[A-Z]{1,5}(\.[A-Z]{1,2})?$").alias("valid"))


def seed_list(raw: DataFrame, column: str) -> DataFrame:
    """(ticker, url) from TICKER=URL pairs parted by commas."""
    rows = raw.select(F.explode(F.split(column, ",")).alias("x"))
    return rows.select(F.upper(F.trim(F.split_part("x", F.lit("="), F.lit(1)))).alias("ticker"), F.trim(F.expr("substr(x, instr(x, '=') + 1)")).alias("url")).filter("ticker <> '' AND url <> ''")


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of each key from the first source that has it."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        every = s if every is None else every.unionByName(s)
    best = every.groupBy(key).agg(F.min("_source").alias("_best"))
    return every.join(best, key).filter("_source = _best").drop("_source", "_best")
