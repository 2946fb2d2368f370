"""Queries of vendors' responses, filings, searches and mirrors: responses are written from the tables as their vendors would, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rulebook as B
from tidemark.operators import signals as G
from tidemark.plans.stories import LETTERS, S_LETTERS, STORIES, stories
from tidemark.plans.views import BARS, bars, table
from tidemark.sources import markets as M

PAGE = 100
TIERS = [("example.com", 1), ("news.example.org", 0), ("example.org", 2), ("shop.net", 3)]
EXCHANGES = ["NasdaqGS", "NYSEArca", "NYSE", "NYSE American", "Cboe US", "OTC Markets", "Toronto", "London Stock Exchange AIM"]


def page_of(c: str):
    return F.floor(F.col(c) / PAGE)


def as_map(rows, by, key, value, field):
    """One JSON object a page: {field: {key: value, ...}}."""
    return rows.groupBy(by.alias("page")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(field))).alias("raw"))


def pages_of_bars(s, d):
    """Bars of chunks of symbols by month, the first month sent twice."""
    b = F.struct(F.col("day").cast("timestamp").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"))
    one = bars(s, d).groupBy("symbol", F.date_trunc("month", "day").alias("m")).agg(F.collect_list(b).alias("b"))
    raw = one.groupBy(F.substring("symbol", 1, 2).alias("chunk"), "m").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("symbol", "b"))).alias("bars"), F.lit("next").alias("next_page_token"))).alias("raw"))
    return raw.unionByName(raw.filter("m = TIMESTAMP '1995-01-01'"))


def trades(s, d):
    k = F.col("p_partkey")
    return as_map(table(s, d, "part"), page_of("p_partkey"), F.concat(F.lit("P"), k.cast("string")), F.struct(F.when(k % 9 != 0, F.col("p_retailprice")).alias("p"), F.col("p_size").alias("s"), F.lit("2024-02-03T04:05:06Z").alias("t")), "trades")


def quotes(s, d):
    k = F.col("p_partkey")
    return as_map(table(s, d, "part"), page_of("p_partkey"), F.concat(F.lit("P"), k.cast("string")), F.struct(F.when(k % 6 != 0, F.col("p_retailprice")).alias("bp"), F.lit(1.0).alias("bs"), F.when(k % 4 != 0, F.col("p_retailprice") + 1).alias("ap"), F.col("p_size").alias("as"), F.lit("2024-02-03T04:05:06Z").alias("t")), "quotes")


def books(s, d):
    level = lambda sign: F.transform(F.sequence(F.lit(0), F.col("s_suppkey").cast("int") % 70), lambda i: F.struct((100 + sign * i).cast("double").alias("p"), (i + 1).cast("double").alias("s")))
    return as_map(table(s, d, "supplier"), page_of("s_suppkey"), F.concat(F.lit("C"), F.col("s_suppkey").cast("string"), F.lit("/USD")), F.struct(level(-1).alias("b"), level(1).alias("a")), "orderbooks")


def pairs(s, d):
    return table(s, d, "supplier").select(F.concat(F.lit("C"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 5 != 0, "/USD").otherwise("")).alias("symbol"), "s_suppkey", "s_acctbal")


def pair_raw(s, d):
    k, v = F.col("s_suppkey"), F.col("s_acctbal")
    price = lambda f, x: F.struct(x.alias(f))
    body = F.struct(F.when(k % 2 == 0, price("p", v)).alias("latestTrade"), F.struct(v.alias("bp"), (v + 1).alias("ap")).alias("latestQuote"), price("c", v + 2).alias("dailyBar"), F.when(k % 4 != 0, price("c", v + 3)).alias("prevDailyBar"))
    return as_map(pairs(s, d).filter("s_suppkey % 3 <> 0"), page_of("s_suppkey"), F.col("symbol"), body, "snapshots")


def charts(s, d):
    k, v = F.col("s_suppkey"), F.col("s_acctbal")
    meta = F.struct(F.col("s_name").alias("symbol"), F.when(k % 3 == 0, v).alias("regularMarketPrice"), F.when(k % 4 == 0, v + 1).alias("previousClose"))
    closes = F.when(k % 7 == 0, F.array(F.lit(None).cast("double"))).otherwise(F.array(v + 2, F.lit(None).cast("double"), F.when(k % 5 != 0, v + 3), v + 4, F.lit(None).cast("double")))
    return table(s, d, "supplier").select(F.to_json(F.struct(meta.alias("meta"), closes.alias("closes")), {"ignoreNullFields": "false"}).alias("raw"))


CHARTS = "charts AS (SELECT s_name AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal WHEN s_suppkey % 7 <> 0 THEN s_acctbal + 4 END AS last, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 WHEN s_suppkey % 7 <> 0 THEN CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal + 3 ELSE s_acctbal + 2 END END AS previous FROM supplier)"


def directory_raw(s, d):
    k = F.col("p_partkey")
    a = F.struct(F.expr(LETTERS.format(k="p_partkey")).alias("symbol"), F.when(k % 8 != 0, F.col("p_name")).alias("name"), F.lit("NYSE").alias("exchange"), F.when(k % 3 != 0, "us_equity").otherwise("crypto").alias("class"), F.when(k % 5 != 0, "active").otherwise("inactive").alias("status"), F.when(k % 7 == 0, F.lit(False)).alias("tradable"))
    return table(s, d, "part").groupBy(page_of("p_partkey").alias("page")).agg(F.to_json(F.collect_list(a)).alias("raw"))


S_ASSETS = f"assets AS (SELECT {S_LETTERS.format(k='p_partkey')} AS symbol, p_name AS name, 'NYSE' AS exchange, CASE WHEN p_partkey % 3 <> 0 THEN 'us_equity' ELSE 'crypto' END AS asset_class, CASE WHEN p_partkey % 5 <> 0 THEN 'active' ELSE 'inactive' END AS status, p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AS tradable FROM part WHERE p_partkey % 8 <> 0)"


def search_raw(s, d):
    k = F.col("p_partkey")
    symbol = F.concat(F.expr(LETTERS.format(k="p_partkey % 9999")), F.when(k % 6 == 0, "-B").when(k % 6 == 1, ".MX").otherwise(""))
    q = F.struct(symbol.alias("symbol"), F.when(k % 4 != 0, F.col("p_name")).alias("longname"), F.when(k % 8 != 0, F.lit("short")).otherwise("").alias("shortname"), F.get(F.array(*map(F.lit, ("EQUITY", "etf", "INDEX"))), (k % 3).cast("int")).alias("quoteType"), F.get(F.array(*map(F.lit, EXCHANGES)), (k % len(EXCHANGES)).cast("int")).alias("exchDisp"))
    return table(s, d, "part").groupBy(page_of("p_partkey").alias("page")).agg(F.to_json(F.struct(F.collect_list(q).alias("quotes"))).alias("raw"))


def s_exchange(n: str) -> str:
    u = f"upper({n})"
    return f"CASE WHEN contains({u}, 'NASDAQ') THEN 'NASDAQ' WHEN contains({u}, 'ARCA') THEN 'ARCA' WHEN contains({u}, 'NYSE') THEN 'NYSE' WHEN contains({u}, 'AMERICAN') OR contains({u}, 'AMEX') THEN 'AMEX' WHEN contains({u}, 'BATS') OR contains({u}, 'CBOE') THEN 'BATS' WHEN contains({u}, 'OTC') OR contains({u}, 'PINK') THEN 'OTC' ELSE substr({n}, 1, 24) END"


SEARCHED = f"""q AS (SELECT {S_LETTERS.format(k='p_partkey % 9999')} || CASE p_partkey % 6 WHEN 0 THEN '.B' WHEN 1 THEN '.MX' ELSE '' END AS symbol, CASE WHEN p_partkey % 4 <> 0 THEN p_name WHEN p_partkey % 8 <> 0 THEN 'short' END AS name, {s_exchange(f"{EXCHANGES!r}[CAST(p_partkey % {len(EXCHANGES)} AS INTEGER) + 1]")} AS exchange, p_partkey % 3 AS t FROM part)"""


def calendar_raw(s, d):
    o = table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    c = F.struct("date", F.lit("09:30").alias("open"), F.when(F.dayofmonth("date") == 24, "13:00").otherwise("16:00").alias("close"), F.when(F.dayofmonth("date") % 2 == 0, "0400").alias("session_open"))
    return o.groupBy(F.year("date").alias("y")).agg(F.to_json(F.collect_list(c)).alias("raw"))


def filings_raw(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("o_orderkey")).alias("k"), "o_orderkey", "day")))
    g = o.groupBy("o_custkey").agg(listed.alias("l"))
    accession = F.transform("l", lambda x: F.concat(F.lit("0001-24-"), F.lpad(x["o_orderkey"].cast("string"), 6, "0")))
    recent = F.struct(F.transform("l", lambda x: F.when(x["o_orderkey"] % 2 == 0, "10-K").otherwise("8-K")).alias("form"), F.transform("l", lambda x: x["day"]).alias("filingDate"), accession.alias("accessionNumber"), F.transform("l", lambda x: F.concat(F.lit("d"), x["o_orderkey"].cast("string"), F.lit(".htm"))).alias("primaryDocument"))
    return g.select(F.to_json(F.struct(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("raw"))


def tickers_raw(s, d):
    k = F.col("p_partkey")
    t = F.when(k % 40 == 0, F.lit("ceo")).when(k % 41 == 0, F.lit("F")).otherwise(F.lower(F.expr(LETTERS.format(k="p_partkey % 150"))))
    return table(s, d, "part").groupBy(page_of("p_partkey").alias("page")).agg(F.collect_list(F.struct("p_partkey", t.alias("t"), "p_name")).alias("l")).select(F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["p_partkey"].cast("string").alias("key"), F.struct(x["p_partkey"].alias("cik_str"), x["t"].alias("ticker"), x["p_name"].alias("title")).alias("value"))))).alias("raw"))


S_TICKERS = f"tick AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 40 = 0 THEN 'CEO' WHEN p_partkey % 41 = 0 THEN 'F' ELSE {S_LETTERS.format(k='p_partkey % 150')} END AS ticker, p_name AS name FROM part)"


def hits_raw(s, d):
    k = F.col("p_partkey")
    name = F.concat(F.upper("p_name"), F.lit(", INC.  ("), F.when(k % 5 == 0, F.lit("1x")).otherwise(F.substring(F.expr(LETTERS.format(k="p_partkey")), 1, 4)), F.when(k % 7 == 0, ".").otherwise(""), F.lit(")  (CIK 000"), k.cast("string"), F.lit(")"))
    source = F.struct(F.array(name).alias("display_names"), F.array(F.concat(F.lit("000"), k.cast("string"))).alias("ciks"), F.get(F.array(*map(F.lit, ("8-K", "10-Q", "DEF 14A", "S-1"))), (k % 4).cast("int")).alias("form"), F.lit("2024-03-01").alias("file_date"))
    hit = F.struct(F.concat(F.lit("00-11-"), k.cast("string"), F.when(k % 9 != 0, F.lit(":ex99.htm")).otherwise("")).alias("_id"), source.alias("_source"))
    hits = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", hit.alias("h")))), lambda x: x["h"])
    return table(s, d, "part").groupBy(page_of("p_partkey").alias("page")).agg(F.to_json(F.struct(F.struct(hits.alias("hits")).alias("hits"))).alias("raw"))


HITS = f"""hits AS (SELECT p_partkey AS k, upper(p_name) AS n, CASE WHEN p_partkey % 5 <> 0 THEN substr({S_LETTERS.format(k='p_partkey')}, 1, 4) END AS ticker, ['8-K', '10-Q', 'DEF 14A', 'S-1'][CAST(p_partkey % 4 AS INTEGER) + 1] AS form FROM part QUALIFY row_number() OVER (PARTITION BY floor(p_partkey / {PAGE}) ORDER BY p_partkey) <= 40)"""


def results(s, d):
    """Search pages over suppliers: each page repeats the first address of the one before."""
    k = F.col("s_suppkey")
    host = F.get(F.array(*map(F.lit, ("www.example.com", "a.news.example.org", "example.org", "x.shop.net", "other.io"))), (k % 5).cast("int"))
    hit = F.struct(F.concat(F.lit(" "), "s_name").alias("title"), F.when(k % 11 != 0, F.concat(F.lit("https://"), host, F.lit("/"), k.cast("string"))).alias("link"), F.lit("snip").alias("snippet"))
    own = table(s, d, "supplier").select(F.floor(k / 10).alias("page"), "s_suppkey", hit.alias("h"))
    again = own.filter("s_suppkey % 10 = 1").withColumn("page", F.col("page") + 1)
    g = own.unionByName(again).groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "h"))), lambda x: x["h"]).alias("l"), F.min(F.col("s_suppkey") + 7).alias("left"))
    related = F.struct(F.concat(F.lit(" best "), F.col("page").cast("string")).alias("query"), F.lit(None).cast("string").alias("q")), F.struct(F.lit(None).cast("string").alias("query"), F.lit("cheap").alias("q")), F.struct(F.repeat(F.lit("x"), 130).alias("query"), F.lit(None).cast("string").alias("q"))
    asked = F.array(F.struct(F.lit("why?").alias("question")), F.struct(F.concat(F.lit("who "), F.col("page").cast("string")).alias("question")))
    return g.select("page", F.to_json(F.struct(F.col("l").alias("organic_results"), F.array(*related).alias("related_searches"), F.when(F.col("page") % 2 == 0, asked).alias("related_questions"), F.when(F.col("page") % 2 == 1, asked).alias("people_also_ask"), F.struct(F.col("left").alias("remaining")).alias("credits"))).alias("raw"))


def tiers(s):
    return s.createDataFrame([(h, t, i) for i, (h, t) in enumerate(TIERS)], "domain string, tier int, at int")


WEB = "w AS (SELECT s_suppkey AS k, ['www.example.com', 'a.news.example.org', 'example.org', 'x.shop.net', 'other.io'][CAST(s_suppkey % 5 AS INTEGER) + 1] AS h, [1, 0, 2, 3, 2][CAST(s_suppkey % 5 AS INTEGER) + 1] AS tier, s_name FROM supplier WHERE s_suppkey % 11 <> 0)"


def items_raw(s, d):
    k = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, ("symbol", "news", "symbol", "history"))), (k % 4).cast("int"))
    data = F.to_json(F.struct(F.when(k % 12 != 0, F.lower(F.expr(LETTERS.format(k="p_partkey % 60")))).alias("symbol"), F.col("p_name").alias("name"), F.lit("NYSE").alias("exchange"), F.when(k % 10 == 0, "crypto").when(k % 3 == 0, "us_equity").alias("assetClass"), F.when(k % 14 == 0, "inactive").otherwise("active").alias("status"), F.when(k % 6 == 0, F.lit(False)).alias("tradable"), F.when(k % 5 == 0, F.lit("Wire")).alias("source"), F.when(k % 3 == 0, F.lit("Ann")).alias("author")))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + k * 977), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    i = F.struct(k.alias("id"), F.lit("markets").alias("collection"), kind.alias("kind"), stamp.alias("updated_at"), F.when(k % 9 != 0, F.col("p_name")).alias("title"), F.lit("sum").alias("summary"), F.when(k % 13 != 0, F.concat(F.lit("https://www.n"), (k % 3).cast("string"), F.lit(".org/"), k.cast("string"))).alias("url"), stamp.alias("published_at"), F.array(F.lit("All"), F.concat(F.lit("P:"), (k % 7).cast("string"))).alias("tags"), data.alias("data"))
    return table(s, d, "part").groupBy(page_of("p_partkey").alias("page")).agg(F.to_json(F.struct(F.collect_list(i).alias("items"))).alias("raw"))


def items(s, d):
    return M.items(items_raw(s, d), "raw")


ITEMS = f"""items AS (SELECT p_partkey AS id, ['symbol', 'news', 'symbol', 'history'][CAST(p_partkey % 4 AS INTEGER) + 1] AS kind, strftime(to_timestamp(1700000000 + p_partkey * 977) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS updated_at, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 13 <> 0 THEN 'https://www.n' || (p_partkey % 3) || '.org/' || p_partkey END AS url,
CASE WHEN p_partkey % 12 <> 0 THEN {S_LETTERS.format(k='p_partkey % 60')} END AS symbol, p_name AS name, CASE WHEN p_partkey % 10 = 0 THEN 'crypto' ELSE 'us_equity' END AS asset_class, CASE WHEN p_partkey % 14 = 0 THEN 'inactive' ELSE 'active' END AS status, p_partkey % 6 <> 0 AND p_partkey % 14 <> 0 AS tradable,
CASE WHEN p_partkey % 5 = 0 THEN 'Wire' WHEN p_partkey % 3 = 0 THEN 'Ann' ELSE 'n' || (p_partkey % 3) || '.org' END AS publisher, p_partkey % 7 AS tag FROM part)"""
SINCE = "2023-11-15T12:00:00Z"


def sync(s, d):
    """A directory after all changed items of the mirror are merged in twice, and its cursor."""
    old = M.assets(directory_raw(s, d), "raw").filter("symbol < 'AAAEA'")
    once, cursor = M.synced(old, items(s, d), SINCE)
    twice, _ = M.synced(once, items(s, d), None)
    return M.synced(twice, items(s, d), SINCE)[0].crossJoin(F.broadcast(cursor))


SYNC = f"""WITH {S_ASSETS}, {ITEMS}, sym AS (SELECT symbol, arg_max(row(name, asset_class, status, tradable), row(updated_at, name)) AS x FROM items WHERE kind = 'symbol' AND symbol IS NOT NULL AND asset_class = 'us_equity' GROUP BY symbol),
late AS (SELECT symbol, arg_max(row(name, asset_class, status, tradable), row(updated_at, name)) AS x FROM items WHERE kind = 'symbol' AND symbol IS NOT NULL AND asset_class = 'us_equity' AND updated_at > '{SINCE}' GROUP BY symbol),
m AS (SELECT symbol, coalesce(late.x, sym.x) AS x FROM sym LEFT JOIN late USING (symbol)), c AS (SELECT max(updated_at) AS cursor FROM items WHERE updated_at > '{SINCE}')
SELECT symbol, name, exchange, asset_class, status, tradable, cursor FROM (SELECT * FROM assets WHERE symbol < 'AAAEA' AND symbol NOT IN (SELECT symbol FROM m) UNION ALL SELECT symbol, x[1], 'NYSE', x[2], x[3], x[4] FROM m), c"""


def coins(s, d):
    k = F.col("s_suppkey")
    c = F.struct(F.concat(F.lit("coin"), k.cast("string")).alias("id"), F.when(k % 3 == 0, 0.0).otherwise(F.col("s_acctbal")).alias("market_cap"), F.when(k % 4 == 0, 0.0).otherwise(k.cast("double")).alias("circulating_supply"), F.col("s_acctbal").alias("ath"), (k % 2).cast("double").alias("total_volume"), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("last_updated"))
    ids = table(s, d, "supplier").filter("s_suppkey % 10 <> 0").select(F.concat(F.lit("C"), k.cast("string")).alias("base"), F.concat(F.lit("coin"), k.cast("string")).alias("id"))
    return M.coin_facts(table(s, d, "supplier").groupBy(page_of("s_suppkey").alias("page")).agg(F.to_json(F.collect_list(c)).alias("raw")), "raw", ids, "2024-01-20")


COINS = """WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 0 AND s_acctbal > 0 THEN s_acctbal END AS cap, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey::DOUBLE END AS sup, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS ath, CASE WHEN s_suppkey % 2 = 1 THEN 1.0::DOUBLE END AS vol, 19 - s_suppkey % 28 AS age FROM supplier WHERE s_suppkey % 10 <> 0),
r AS (SELECT *, CASE WHEN age > 7 THEN 'not updated in ' || age || ' days' WHEN cap IS NULL AND sup IS NULL THEN 'no circulating supply' END AS reason FROM c)
SELECT 'C' || k AS base, 'coin' || k AS id, CASE WHEN reason IS NULL THEN cap END AS market_cap, CASE WHEN reason IS NULL THEN sup END AS supply, CASE WHEN reason IS NULL THEN ath END AS ath, CASE WHEN reason IS NULL THEN vol END AS volume, reason FROM r"""


def feeds(s, d):
    """Three listings of headlines over the stories: a mirror, a feed that repeats it with a publisher's name, and a search."""
    n = stories(s, d).select("ticker", "company", "headline", "id", F.date_format("event_date", "yyyy-MM-dd").alias("day"), (F.col("id") % 5).cast("int").alias("tier"))
    url = lambda base: F.concat(F.lit(base), F.col("id").cast("string")).alias("url")
    row = lambda df, base, title: df.select("ticker", "company", url(base), title.alias("title"), "tier", "day")
    h = F.col("headline")
    return [row(n.filter("id % 3 = 0"), "https://m/", F.concat("company", F.lit(": "), h)), row(n, "https://f/", F.concat("company", F.lit(": "), h, F.lit(" - Daily Post"))), row(n.filter("id % 2 = 0"), "https://m/", h)]


NEWS = rf"""WITH {STORIES}, n AS (SELECT *, strftime(event_date, '%Y-%m-%d') AS day, CAST(id % 5 AS INTEGER) AS tier, trim(regexp_replace(company, '{B.HEADLINE_FURNITURE}', '', 'g')) AS core FROM stories),
e AS (SELECT ticker, core, 'https://m/' || id AS url, company || ': ' || headline AS title, tier, day, 0 AS src FROM n WHERE id % 3 = 0 UNION ALL SELECT ticker, core, 'https://f/' || id, company || ': ' || headline || ' - Daily Post', tier, day, 1 FROM n UNION ALL SELECT ticker, core, 'https://m/' || id, headline, tier, day, 2 FROM n WHERE id % 2 = 0),
k AS (SELECT *, trim(regexp_replace(lower(regexp_replace(title, '[\s\p{{Z}}]+[-–—|][\s\p{{Z}}]+[^-–—|]{{2,40}}\z', '')), '[^a-z0-9]+', ' ', 'g')) AS key FROM e WHERE tier <> 3 AND day >= '2024-02-01' AND (regexp_matches(title, '\b' || ticker || '\b') OR (length(core) > 3 AND contains(lower(title), lower(core)))) QUALIFY row_number() OVER (PARTITION BY url ORDER BY src, ticker, title) = 1),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ticker, key ORDER BY src, url) = 1) SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY src, url) AS INTEGER) AS rank, url, title, tier, day FROM f QUALIFY rank <= 12"""


QUERIES = {
    "src16_18_39_26_paged_bars": (lambda s, d: M.paged_bars(pages_of_bars(s, d), "raw").select("symbol", F.to_date("ts").alias("day"), F.floor(F.col("close") * 1e4 + 0.5).alias("close"), F.col("volume").cast("long").alias("volume")), f"WITH {BARS} SELECT symbol, day, CAST(floor(close * 1e4 + 0.5) AS BIGINT) AS close, CAST(volume AS BIGINT) AS volume FROM bars"),
    "src28_40_latest_trades": (lambda s, d: M.latest_trades(trades(s, d), "raw").select("symbol", "price", "size"), "SELECT 'P' || p_partkey AS symbol, p_retailprice AS price, p_size::DOUBLE AS size FROM part WHERE p_partkey % 9 <> 0"),
    "src41_latest_quotes": (lambda s, d: M.latest_quotes(quotes(s, d), "raw").select("symbol", "bid", "ask", "ask_size"), "SELECT 'P' || p_partkey AS symbol, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS bid, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice + 1 END AS ask, p_size::DOUBLE AS ask_size FROM part WHERE p_partkey % 12 <> 0"),
    "src27_arr03_order_books": (lambda s, d: M.order_books(books(s, d), "raw", 50), "SELECT 'C' || s_suppkey || '/USD' AS symbol, side, CAST(i AS INTEGER) AS level, (100 + CASE side WHEN 'bid' THEN -i ELSE i END)::DOUBLE AS price, (i + 1)::DOUBLE AS size FROM (SELECT s_suppkey, unnest(range(0, least(s_suppkey % 70 + 1, 50))) AS i FROM supplier), (VALUES ('bid'), ('ask')) v(side)"),
    "src46_pair_snapshots": (lambda s, d: M.pair_snapshots(pairs(s, d), pair_raw(s, d), "raw"), "SELECT CASE WHEN s_suppkey % 5 <> 0 THEN 'C' || s_suppkey || '/USD' ELSE 'C' || s_suppkey END AS symbol, 'C' || s_suppkey AS base, CASE WHEN s_suppkey % 5 <> 0 THEN 'USD' ELSE '' END AS quote, CASE WHEN g AND s_suppkey % 2 = 0 THEN s_acctbal END AS last, CASE WHEN g THEN s_acctbal END AS bid, CASE WHEN g THEN s_acctbal + 1 END AS ask, CASE WHEN g THEN s_acctbal + 2 END AS day_close, CASE WHEN g AND s_suppkey % 4 <> 0 THEN s_acctbal + 3 END AS previous_close FROM (SELECT *, s_suppkey % 3 <> 0 AS g FROM supplier)"),
    "src44_chart_snapshots": (lambda s, d: M.chart_snapshots(charts(s, d), "raw"), f"WITH {CHARTS} SELECT * FROM charts"),
    "src45_mid_quotes": (lambda s, d: M.mid_quotes(M.chart_snapshots(charts(s, d), "raw")), f"WITH {CHARTS} SELECT symbol, last AS bid, last AS ask FROM charts WHERE last IS NOT NULL"),
    "src20_24_directory": (lambda s, d: M.assets(directory_raw(s, d), "raw"), f"WITH {S_ASSETS} SELECT * FROM assets"),
    "src42_looked_up_assets": (lambda s, d: M.looked_up(M.assets(directory_raw(s, d), "raw"), table(s, d, "part").filter("p_size < 20").select(F.expr(LETTERS.format(k="p_partkey")).alias("symbol"))).select("symbol", "tradable"), f"WITH {S_ASSETS} SELECT symbol, tradable FROM assets WHERE symbol IN (SELECT {S_LETTERS.format(k='p_partkey')} FROM part WHERE p_size < 20)"),
    "src42_active_equities": (lambda s, d: M.active_equities(M.assets(directory_raw(s, d), "raw")).select("symbol"), f"WITH {S_ASSETS} SELECT symbol FROM assets WHERE status = 'active' AND asset_class = 'us_equity'"),
    "src21_proj06_searched_symbols": (lambda s, d: M.searched_symbols(search_raw(s, d), "raw"), f"WITH {SEARCHED} SELECT symbol, name, exchange, CASE WHEN t = 1 THEN 'us_etf' ELSE 'us_equity' END AS asset_class FROM q WHERE t < 2 AND name IS NOT NULL AND exchange IN {M.US_EXCHANGES}"),
    "proj06_chart_exchanges": (lambda s, d: table(s, d, "part").select("p_partkey", M.chart_exchange(F.get(F.array(*map(F.lit, EXCHANGES)), (F.col("p_partkey") % len(EXCHANGES)).cast("int"))).alias("exchange")), f"SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSE' WHEN 2 THEN 'NYSE' WHEN 3 THEN 'NYSE' WHEN 5 THEN 'OTC' ELSE {EXCHANGES!r}[CAST(p_partkey % 8 AS INTEGER) + 1] END AS exchange FROM part"),
    "src43_calendar": (lambda s, d: M.calendar(calendar_raw(s, d), "raw"), "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, '09:30' AS open, CASE WHEN day(o_orderdate) = 24 THEN '13:00' ELSE '16:00' END AS close, CASE WHEN day(o_orderdate) % 2 = 0 THEN '0400' ELSE '09:30' END AS session_open, CASE WHEN day(o_orderdate) = 24 THEN '13:00' ELSE '16:00' END AS session_close FROM orders"),
    "src31_filings": (lambda s, d: M.filings(filings_raw(s, d), "raw", "1999-06-30"), "SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN o_orderkey % 2 = 0 THEN '10-K' ELSE '8-K' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, '0001-24-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS accession, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/000124' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '/d' || o_orderkey || '.htm' AS url FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1999-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 50"),
    "src47_ticker_map": (lambda s, d: M.ticker_map(tickers_raw(s, d), "raw"), f"WITH {S_TICKERS} SELECT ticker, lpad(CAST(max(k) AS VARCHAR), 10, '0') AS cik, arg_max(name, k) AS name FROM tick GROUP BY ticker"),
    "src38_vocabulary": (lambda s, d: M.vocabulary(tickers_raw(s, d), "raw", B.NOT_TICKERS), f"WITH {S_TICKERS} SELECT DISTINCT ticker AS symbol FROM tick WHERE length(ticker) >= 2 AND ticker <> 'CEO'"),
    "set02_vocabulary_union": (lambda s, d: M.vocabulary(tickers_raw(s, d), "raw", B.NOT_TICKERS).union(M.assets(directory_raw(s, d), "raw").select("symbol")).distinct(), f"WITH {S_TICKERS}, {S_ASSETS} SELECT ticker AS symbol FROM tick WHERE length(ticker) >= 2 AND ticker <> 'CEO' UNION SELECT symbol FROM assets"),
    "src04_63_str30_proj04_filing_hits": (lambda s, d: M.filing_hits(hits_raw(s, d), "raw"), f"WITH {HITS} SELECT 'sec:00-11-' || k || ':ex99.htm' AS id, form || ' — ' || n || ', INC.  (' || ticker || CASE WHEN k % 7 = 0 THEN '.' ELSE '' END || ')  (CIK 000' || k || ')' AS title, 'https://www.sec.gov/Archives/edgar/data/' || k || '/0011' || k || '/ex99.htm' AS url, 'sec_exhibit' AS event_type, '2024-03-01' AS published, ticker, n || ', INC.' AS company FROM hits WHERE ticker IS NOT NULL AND k % 9 <> 0"),
    "proj04_form_events": (lambda s, d: table(s, d, "part").select("p_partkey", M.form_event(F.get(F.array(*map(F.lit, ("8-K/A", "10-q", "def 14a", "S-1"))), (F.col("p_partkey") % 4).cast("int")), F.when(F.col("p_partkey") % 3 == 0, "a_EX-99.htm").otherwise("b.htm")).alias("event")), "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 AND p_partkey % 3 <> 0 THEN 'shareholder_meeting' ELSE 'sec_exhibit' END AS event FROM part"),
    "src12_14_str48_web_hits": (lambda s, d: M.web_hits(results(s, d), "raw", "page", tiers(s)), f"WITH {WEB} SELECT 'https://' || h || '/' || k AS url, s_name AS title, regexp_replace(h, '^www\\.', '') AS host, tier, ['primary', 'reputable press', 'analysis/opinion', 'excluded'][tier + 1] AS label, 'snip' AS snippet FROM w"),
    "src14_credits_left": (lambda s, d: results(s, d).agg(F.min(F.get_json_object("raw", "$.credits.remaining").cast("long")).alias("credits")), "SELECT min(s_suppkey + 7) AS credits FROM supplier"),
    "src15_57_searches_and_questions": (lambda s, d: M.searches_and_questions(results(s, d), "raw"), "WITH p AS (SELECT floor(s_suppkey / 10)::BIGINT AS p FROM supplier UNION SELECT floor(s_suppkey / 10)::BIGINT + 1 FROM supplier WHERE s_suppkey % 10 = 1) SELECT DISTINCT kind, text FROM (SELECT 'search' AS kind, 'best ' || p AS text FROM p UNION ALL SELECT 'search', 'cheap' UNION ALL SELECT 'question', 'why?' UNION ALL SELECT 'question', 'who ' || p FROM p)"),
    "src48_52_item_query": (lambda s, d: M.item_query(items(s, d), "markets", kind="symbol", tags=("all", " P:3 "), since=SINCE, after=9, limit=500).select("id", "updated_at"), f"WITH {ITEMS} SELECT id, updated_at FROM items WHERE kind = 'symbol' AND tag = 3 AND updated_at > '{SINCE}' ORDER BY updated_at, id LIMIT 200"),
    "src49_latest_item": (lambda s, d: M.item_query(items(s, d), "markets", kind="history", tags=("p:5",), limit=1).select("id"), f"WITH {ITEMS} SELECT id FROM items WHERE kind = 'history' AND tag = 5 ORDER BY updated_at, id LIMIT 1"),
    "src51_exact_symbol": (lambda s, d: M.exact_symbol(items(s, d).filter("kind = 'symbol'"), "aaaai").select("id"), f"WITH {ITEMS} SELECT id FROM items WHERE kind = 'symbol' AND symbol = 'AAAAI' ORDER BY id LIMIT 1"),
    "src23_50_mirror_news": (lambda s, d: M.mirror_news(items(s, d).filter("kind = 'news'")), f"WITH {ITEMS} SELECT url, title, publisher, 'n' || (id % 3) || '.org' AS host, substr(updated_at, 1, 10) AS day, 'sum' AS snippet FROM items WHERE kind = 'news' AND url IS NOT NULL AND title IS NOT NULL"),
    "src24_mirror_symbols": (lambda s, d: M.mirror_symbols(items(s, d)), f"WITH {ITEMS} SELECT updated_at, symbol, name, 'NYSE' AS exchange, asset_class, status, tradable FROM items WHERE kind = 'symbol' AND symbol IS NOT NULL AND asset_class = 'us_equity'"),
    "src25_strm03_dml12_13_sync": (sync, SYNC),
    "src29_fil27_coin_facts": (coins, COINS),
    "fil20_src53_fresh_days": (lambda s, d: table(s, d, "events").select("event_id", M.fresh(F.when(F.col("event_id") % 6 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")), F.lit("2024-01-12").cast("timestamp"), 5).alias("fresh"), M.day_stamp(F.to_date("ts")).alias("stamp")), "SELECT event_id, event_id % 6 <> 0 AND CAST(ts AS DATE) >= DATE '2024-01-07' AS fresh, strftime(ts, '%Y-%m-%d') || 'T05:00:00Z' AS stamp FROM events"),
    "src07_content_addresses": (lambda s, d: M.content_rows(table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))), "SELECT CAST(page_id AS VARCHAR) AS path, sha256(html) AS checksum, substr(sha256(html), 1, 16) || '.raw' AS stored_as FROM pages"),
    "src09_news_discovery": (lambda s, d: M.news_union(feeds(s, d), G.mentions(F.col("title"), F.col("ticker"), F.col("company")), since="2024-02-01"), NEWS),
}
