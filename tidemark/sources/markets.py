"""Responses of market vendors, filings and mirrors as rows: each takes a DataFrame with the raw JSON in a column, so the fetch stays outside.

A malformed response gives no row. Rows come from every response given, so
pages and chunks of symbols are rows of one DataFrame, not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Labels of reputation tiers.
TIER_LABELS = {0: "primary", 1: "reputable press", 2: "analysis/opinion", 3: "excluded"}
#: Kinds and exchanges that a symbol search keeps.
USEFUL, US_EXCHANGES = ("EQUITY", "ETF"), ("NASDAQ", "NYSE", "ARCA", "AMEX", "BATS", "OTC")
#: Fixed value: filings of a company that are listed.
FILINGS = 50

BAR = "struct<t:timestamp,o:double,h:double,l:double,c:double,v:double,vw:double>"
ITEM = "struct<id:bigint,collection:string,kind:string,updated_at:string,title:string,summary:string,url:string,published_at:string,tags:array<string>,data:string>"


def tier_label(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == k, v) for k, v in TIER_LABELS.items()])


def paged_bars(raw: DataFrame, column: str) -> DataFrame:
    """Bars of all pages and chunks, one a (symbol, ts): a page that was fetched twice counts once."""
    rows = raw.select(F.explode(F.from_json(column, f"struct<bars:map<string,array<{BAR}>>,next_page_token:string>")["bars"]).alias("symbol", "b")).select("symbol", F.inline("b"))
    rows = rows.filter(F.col("t").isNotNull() & F.col("c").isNotNull())
    return rows.groupBy("symbol", F.col("t").alias("ts")).agg(F.min(F.struct("o", "h", "l", "c", "v", "vw")).alias("b")).select("symbol", "ts", F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.vw").alias("vwap"))


def latest_trades(raw: DataFrame, column: str) -> DataFrame:
    """(symbol, price, size, ts) of a map of trades; one without a price is dropped."""
    rows = raw.select(F.explode(F.from_json(column, "struct<trades:map<string,struct<p:double,s:double,t:timestamp>>>")["trades"]).alias("symbol", "x"))
    return rows.select("symbol", F.col("x.p").alias("price"), F.col("x.s").alias("size"), F.col("x.t").alias("ts")).filter("price IS NOT NULL")


def latest_quotes(raw: DataFrame, column: str) -> DataFrame:
    """(symbol, bid, bid_size, ask, ask_size, ts) of a map of quotes; one without either side is dropped."""
    rows = raw.select(F.explode(F.from_json(column, "struct<quotes:map<string,struct<bp:double,bs:double,ap:double,as:double,t:timestamp>>>")["quotes"]).alias("symbol", "x"))
    return rows.select("symbol", F.col("x.bp").alias("bid"), F.col("x.bs").alias("bid_size"), F.col("x.ap").alias("ask"), F.col("x.as").alias("ask_size"), F.col("x.t").alias("ts")).filter("bid IS NOT NULL OR ask IS NOT NULL")


def order_books(raw: DataFrame, column: str, depth: int = 50) -> DataFrame:
    """(symbol, side, level, price, size) of the first `depth` levels of both sides, at most 50."""
    side = "array<struct<p:double,s:double>>"
    rows = raw.select(F.explode(F.from_json(column, f"struct<orderbooks:map<string,struct<b:{side},a:{side}>>>")["orderbooks"]).alias("symbol", "x"))
    depth = max(1, min(50, depth))
    both = F.array(F.struct(F.lit("bid").alias("side"), F.slice("x.b", 1, depth).alias("l")), F.struct(F.lit("ask").alias("side"), F.slice("x.a", 1, depth).alias("l")))
    rows = rows.select("symbol", F.inline(both)).select("symbol", "side", F.posexplode("l").alias("level", "q"))
    return rows.select("symbol", "side", "level", F.col("q.p").alias("price"), F.col("q.s").alias("size"))


def pair_snapshots(requested: DataFrame, raw: DataFrame, column: str) -> DataFrame:
    """One row per requested pair, found or not: symbol, base, quote, last, bid, ask, day_close, previous_close."""
    form = "struct<latestTrade:struct<p:double>,latestQuote:struct<bp:double,ap:double>,dailyBar:struct<c:double>,prevDailyBar:struct<c:double>>"
    got = raw.select(F.explode(F.from_json(column, f"struct<snapshots:map<string,{form}>>")["snapshots"]).alias("symbol", "x"))
    part = lambda i: F.get(F.split("symbol", "/"), i)
    return requested.select("symbol").join(got, "symbol", "left").select("symbol", part(0).alias("base"), F.coalesce(part(1), F.lit("")).alias("quote"), F.col("x.latestTrade.p").alias("last"), F.col("x.latestQuote.bp").alias("bid"), F.col("x.latestQuote.ap").alias("ask"), F.col("x.dailyBar.c").alias("day_close"), F.col("x.prevDailyBar.c").alias("previous_close"))


def chart_snapshots(raw: DataFrame, column: str) -> DataFrame:
    """(symbol, last, previous): the chart's own price, else its last close; the previous close it names, else the last but one."""
    r = raw.select(F.from_json(column, "struct<meta:struct<symbol:string,regularMarketPrice:double,chartPreviousClose:double,previousClose:double>,closes:array<double>>").alias("r"))
    closes = F.filter("r.closes", lambda c: c.isNotNull())
    at = lambda n: F.get(closes, F.size(closes) - n)
    return r.select("r.meta.symbol", F.coalesce("r.meta.regularMarketPrice", F.when(F.size(closes) >= 1, at(1))).alias("last"), F.coalesce("r.meta.chartPreviousClose", "r.meta.previousClose", F.when(F.size(closes) >= 2, at(2))).alias("previous")).filter("symbol IS NOT NULL")


def mid_quotes(snapshots: DataFrame) -> DataFrame:
    """Quotes of a source that has no sides: bid and ask are the last price; symbols without one are dropped."""
    return snapshots.filter("last IS NOT NULL").select("symbol", F.col("last").alias("bid"), F.col("last").alias("ask"))


def assets(raw: DataFrame, column: str) -> DataFrame:
    """(symbol, name, exchange, asset_class, status, tradable) of a directory; rows without symbol or name are dropped."""
    rows = raw.select(F.inline(F.from_json(column, "array<struct<symbol:string,name:string,exchange:string,class:string,status:string,tradable:boolean>>")))
    tradable = F.coalesce("tradable", F.lit(True)) & (F.coalesce("status", F.lit("")) != "inactive")
    return rows.filter("coalesce(symbol, '') <> '' AND coalesce(name, '') <> ''").select("symbol", "name", "exchange", F.col("class").alias("asset_class"), "status", tradable.alias("tradable"))


def looked_up(directory: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the symbols asked for; unknown ones are dropped. Without any asked, the active equities."""
    return directory.join(asked.select("symbol").distinct(), "symbol", "left_semi")


def active_equities(directory: DataFrame) -> DataFrame:
    return directory.filter("status = 'active' AND asset_class = 'us_equity'")


def searched_symbols(raw: DataFrame, column: str) -> DataFrame:
    """(symbol, name, exchange, asset_class) of a search: equities and funds with a ticker's shape on a US exchange."""
    rows = raw.select(F.inline(F.from_json(column, "struct<quotes:array<struct<symbol:string,longname:string,shortname:string,quoteType:string,exchDisp:string>>>")["quotes"]))
    kind, name = F.upper(F.coalesce("quoteType", F.lit(""))), F.coalesce(F.nullif("longname", F.lit("")), F.nullif("shortname", F.lit("")))
    dotted = F.regexp_replace(F.upper("symbol"), r"^([A-Z]{1,5})-([A-Z]{1,2})$", "$1.$2")
    out = rows.select(dotted.alias("symbol"), name.alias("name"), display_exchange(F.col("exchDisp")).alias("exchange"), F.when(kind == "ETF", "us_etf").otherwise("us_equity").alias("asset_class"), kind.alias("kind"))
    return out.filter(F.col("kind").isin(*USEFUL) & F.col("name").isNotNull() & F.col("symbol").rlike(r"^[A-Z]{1,5}(\.[A-Z]{1,2})?$") & F.col("exchange").isin(*US_EXCHANGES)).drop("kind")


def display_exchange(name: Column) -> Column:
    """A search's exchange in the spelling of the directory; an unknown one stays, cut at 24 characters."""
    n = F.upper(name)
    return F.when(n.contains("NASDAQ"), "NASDAQ").when(n.contains("ARCA"), "ARCA").when(n.contains("NYSE"), "NYSE").when(n.contains("AMERICAN") | n.contains("AMEX"), "AMEX").when(n.contains("BATS") | n.contains("CBOE"), "BATS").when(n.contains("OTC") | n.contains("PINK"), "OTC").otherwise(F.substring(name, 1, 24))


def chart_exchange(name: Column) -> Column:
    """A chart's exchange in the spelling of the directory; an unknown one stays."""
    n = F.upper(name)
    return F.when(n.contains("NASDAQ"), "NASDAQ").when(n.contains("NYSE ARCA"), "ARCA").when(n.contains("NYSE"), "NYSE").when(n.contains("AMEX"), "AMEX").when(n.contains("OTC") | n.contains("PINK"), "OTC").otherwise(F.coalesce(name, F.lit("")))


def calendar(raw: DataFrame, column: str) -> DataFrame:
    """(date, open, close, session_open, session_close); a session without its own hours has those of the day."""
    rows = raw.select(F.inline(F.from_json(column, "array<struct<date:date,open:string,close:string,session_open:string,session_close:string>>")))
    return rows.select("date", "open", "close", F.coalesce("session_open", "open").alias("session_open"), F.coalesce("session_close", "close").alias("session_close"))


def filings(raw: DataFrame, column: str, as_of: str | None = None) -> DataFrame:
    """(cik, form, filed, accession, url) of the first FILINGS filings of each company that were there by a day."""
    form = "struct<cik:string,filings:struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>>>"
    r = raw.select(F.from_json(column, form).alias("r")).select("r.cik", "r.filings.recent.*")
    rows = F.transform(F.arrays_zip("form", "filingDate", "accessionNumber", "primaryDocument"), lambda x: x)
    there = F.filter(rows, lambda x: F.coalesce(x["filingDate"], F.lit("")) <= as_of[:10]) if as_of else rows
    out = r.select("cik", F.inline(F.slice(there, 1, FILINGS)))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("long").cast("string"), F.lit("/"), F.replace("accessionNumber", F.lit("-"), F.lit("")), F.lit("/"), F.coalesce("primaryDocument", F.lit("")))
    return out.select("cik", "form", F.col("filingDate").alias("filed"), F.col("accessionNumber").alias("accession"), url.alias("url"))


def ticker_map(raw: DataFrame, column: str) -> DataFrame:
    """(ticker, cik, name): tickers in capitals, registration numbers padded to ten digits; of two entries that of the higher number holds."""
    rows = raw.select(F.explode(F.from_json(column, "map<string,struct<cik_str:bigint,ticker:string,title:string>>")).alias("key", "x"))
    named = rows.select(F.col("key").try_cast("long").alias("pos"), F.upper("x.ticker").alias("ticker"), F.lpad(F.col("x.cik_str").cast("string"), 10, "0").alias("cik"), F.col("x.title").alias("name"))
    return named.groupBy("ticker").agg(F.max_by(F.struct("cik", "name"), "pos").alias("x")).select("ticker", "x.*")


def vocabulary(raw: DataFrame, column: str, stop: list[str]) -> DataFrame:
    """(symbol) of a ticker list: two letters or more, no common acronym."""
    rows = raw.select(F.explode(F.map_values(F.from_json(column, "map<string,struct<ticker:string>>"))).alias("x")).select(F.upper("x.ticker").alias("symbol"))
    return rows.filter((F.char_length("symbol") >= 2) & ~F.col("symbol").isin(stop)).distinct()


def display_ticker(name: Column) -> Column:
    """The ticker in a filer's display name, before its registration number; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(name, r"\(([A-Z][A-Z.]{0,5})\)\s*\(CIK", 1), r"\.$", ""), F.lit(""))


def display_company(name: Column) -> Column:
    """A filer's display name without what follows in brackets."""
    return F.trim(F.regexp_extract(name, r"(?s)^(.*?)(?:\s{2,}\(|$)", 1))


def form_event(form: Column, filename: Column) -> Column:
    """The event that a filing stands for."""
    f = F.upper(F.coalesce(form, F.lit("")))
    exhibit = filename.rlike(r"(?i)ex_?99|ex99|ex-99") | f.startswith("8-K") | f.isin("10-K", "10-Q")
    return F.when(~F.coalesce(exhibit, F.lit(False)) & f.contains("14A"), "shareholder_meeting").otherwise("sec_exhibit")


def filing_hits(raw: DataFrame, column: str, limit: int = 40) -> DataFrame:
    """Documents (id, title, url, event_type, published, ticker, company) of the first `limit` hits of each search; hits without a ticker or an address are dropped."""
    source = "struct<display_names:array<string>,ciks:array<string>,form:string,file_date:string>"
    hits = F.from_json(column, f"struct<hits:struct<hits:array<struct<_id:string,_source:{source}>>>>")["hits"]["hits"]
    rows = raw.select(F.inline(F.slice(hits, 1, limit)))
    name, cik = F.get("_source.display_names", 0), F.regexp_replace(F.coalesce(F.get("_source.ciks", 0), F.lit("")), "^0+", "")
    accession, file = F.get(F.split("_id", ":"), 0), F.get(F.split("_id", ":"), 1)
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), file)
    out = rows.select(F.concat(F.lit("sec:"), "_id").alias("id"), F.concat("_source.form", F.lit(" — "), name).alias("title"), url.alias("url"), form_event(F.col("_source.form"), file).alias("event_type"), F.col("_source.file_date").alias("published"), display_ticker(name).alias("ticker"), display_company(name).alias("company"), cik.alias("_cik"), file.alias("_file"))
    return out.filter("ticker IS NOT NULL AND _cik <> '' AND coalesce(_file, '') <> ''").drop("_cik", "_file")


def web_hits(raw: DataFrame, column: str, page: str, tiers: DataFrame, default: int = 2) -> DataFrame:
    """(url, title, host, tier, label, snippet) of result pages: one row a url, that of the first page and place. tiers: (domain, tier, at)."""
    rows = raw.select(page, F.posexplode(F.from_json(column, "struct<organic_results:array<struct<title:string,link:string,snippet:string>>>")["organic_results"]).alias("at", "r")).filter("coalesce(r.link, '') <> ''")
    one = rows.groupBy(F.col("r.link").alias("url")).agg(F.min_by("r", F.struct(page, "at")).alias("r")).select("url", F.trim(F.coalesce("r.title", F.lit(""))).alias("title"), "r.snippet", T.host(F.col("url")).alias("host"))
    return with_tier(one, tiers, default).select("url", "title", "host", "tier", tier_label(F.col("tier")).alias("label"), "snippet")


def with_tier(rows: DataFrame, tiers: DataFrame, default: int = 2) -> DataFrame:
    """rows (host, ...) with tier: that of the first listed domain a host is or belongs to."""
    hosts = rows.select("host").distinct().withColumn("domain", F.explode(T.suffixes(F.col("host"))))
    found = hosts.join(tiers.select("domain", F.col("tier").alias("_tier"), F.col("at").alias("_at")), "domain").groupBy("host").agg(F.min_by("_tier", "_at").alias("tier"))
    return rows.join(found, "host", "left").withColumn("tier", F.coalesce("tier", F.lit(default)))


def searches_and_questions(raw: DataFrame, column: str) -> DataFrame:
    """(kind, text): related searches under 120 characters and questions under 200, once each."""
    form = "struct<related_searches:array<struct<query:string,q:string>>,related_questions:array<struct<question:string>>,people_also_ask:array<struct<question:string>>>"
    r = raw.select(F.from_json(column, form).alias("r"))
    related = r.select(F.lit("search").alias("kind"), F.explode(F.transform("r.related_searches", lambda x: F.trim(F.coalesce(x["query"], x["q"], F.lit(""))))).alias("text")).filter("text <> '' AND char_length(text) < 120")
    asked = r.select(F.lit("question").alias("kind"), F.explode(F.transform(F.coalesce("r.related_questions", "r.people_also_ask"), lambda x: F.trim(F.coalesce(x["question"], F.lit(""))))).alias("text")).filter("text <> '' AND char_length(text) < 200")
    return related.unionByName(asked).distinct()


def items(raw: DataFrame, column: str) -> DataFrame:
    """Items of a mirror: id, collection, kind, updated_at, title, summary, url, published_at, tags, data (JSON text)."""
    return raw.select(F.inline(F.from_json(column, f"struct<items:array<{ITEM}>>")["items"]))


def item_query(rows: DataFrame, collection: str, kind: str | None = None, tags: tuple[str, ...] = (), since: str | None = None, after: int | None = None, published_from: str | None = None, limit: int = 50) -> DataFrame:
    """The first items by (updated_at, id) that fit every condition given: at most 200, tags in lower case and all of them held."""
    tests = [F.col("collection") == collection]
    tests += [F.col("kind") == kind] if kind else []
    tests += [F.array_contains(F.transform("tags", F.lower), t.strip().lower()) for t in tags]
    if since:
        tests.append((F.col("updated_at") > since) | ((F.col("updated_at") == since) & (F.col("id") > (after if after is not None else -1))))
    tests += [F.col("published_at") >= published_from] if published_from else []
    for t in tests:
        rows = rows.filter(t)
    return rows.orderBy("updated_at", "id").limit(max(1, min(200, limit)))


def exact_symbol(rows: DataFrame, symbol: str) -> DataFrame:
    """The one item whose own symbol is the one wanted, among fuzzy hits."""
    return rows.filter(F.upper(F.get_json_object("data", "$.symbol")) == symbol.upper()).orderBy("id").limit(1)


def mirror_news(rows: DataFrame) -> DataFrame:
    """Headlines (url, title, publisher, host, day, snippet) of items; one without url, title or host is dropped."""
    host = T.host(F.col("url"))
    publisher = F.coalesce(F.nullif(F.get_json_object("data", "$.source"), F.lit("")), F.nullif(F.get_json_object("data", "$.author"), F.lit("")), host)
    return rows.filter("coalesce(url, '') <> '' AND coalesce(title, '') <> ''").select("url", "title", publisher.alias("publisher"), host.alias("host"), F.substring("published_at", 1, 10).alias("day"), F.col("summary").alias("snippet")).filter("host <> ''")


def mirror_symbols(rows: DataFrame) -> DataFrame:
    """Directory rows of symbol items: US equities with symbol and name; tradable unless the item or its status says no."""
    d = rows.filter("kind = 'symbol'").select("updated_at", F.from_json("data", "struct<symbol:string,name:string,exchange:string,assetClass:string,status:string,tradable:boolean>").alias("d")).select("updated_at", "d.*")
    kept = d.filter("coalesce(symbol, '') <> '' AND coalesce(name, '') <> '' AND coalesce(assetClass, 'us_equity') IN ('us_equity', '')")
    return kept.select("updated_at", F.upper("symbol").alias("symbol"), "name", "exchange", F.coalesce("assetClass", F.lit("us_equity")).alias("asset_class"), "status", (F.coalesce("tradable", F.lit(True)) & (F.coalesce("status", F.lit("")) != "inactive")).alias("tradable"))


def fresh(day: Column, now: Column, most_days: int) -> Column:
    """Whether a day is at most so many days before an instant; no for a day that can't be read."""
    at = F.try_to_timestamp(day)
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(at)) <= most_days * 86_400, F.lit(False))


def day_stamp(day: Column) -> Column:
    """The stamp of a daily bar: five in the morning UTC, which lies on the same day in New York all year."""
    return F.concat(day.cast("string"), F.lit("T05:00:00Z"))


def synced(directory: DataFrame, rows: DataFrame, since: str | None) -> tuple[DataFrame, DataFrame]:
    """The directory with all symbol items changed after a cursor merged in, and (cursor): the newest change, or the old cursor without one.

    All pages are one scan behind the cursor, so it moves only when every row
    is in; running again with the new cursor changes nothing.
    """
    changed = rows.filter(F.col("updated_at") > since) if since else rows
    newest = mirror_symbols(changed).groupBy("symbol").agg(F.max_by(F.struct("name", "exchange", "asset_class", "status", "tradable"), F.struct("updated_at", "name")).alias("x")).select("symbol", "x.*")
    kept = directory.join(newest.select("symbol"), "symbol", "left_anti")
    cursor = changed.agg(F.coalesce(F.max("updated_at"), F.lit(since)).alias("cursor"))
    return kept.unionByName(newest), cursor


def coin_facts(raw: DataFrame, column: str, ids: DataFrame, now: str, most_days: int = 7) -> DataFrame:
    """(base, id, market_cap, supply, ath, volume, reason) of ids (base, id): figures that aren't positive are null, and all are, with a reason, for a stale or retired record."""
    form = "array<struct<id:string,market_cap:double,circulating_supply:double,ath:double,total_volume:double,last_updated:timestamp>>"
    r = raw.select(F.inline(F.from_json(column, form))).join(ids, "id")
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_updated")) / 86_400
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    stale = age > most_days
    reason = F.when(stale, F.concat(F.lit("not updated in "), F.floor(age + 0.5).cast("string"), F.lit(" days"))).when(pos("market_cap").isNull() & pos("circulating_supply").isNull(), "no circulating supply")
    r = r.withColumn("reason", reason)
    keep = lambda c, name: F.when(F.col("reason").isNull(), pos(c)).alias(name)
    return r.select("base", "id", keep("market_cap", "market_cap"), keep("circulating_supply", "supply"), keep("ath", "ath"), keep("total_volume", "volume"), "reason")


def content_rows(files: DataFrame) -> DataFrame:
    """Downloaded files (path, content) with checksum and content-addressed name: the first 16 digits of the SHA-256."""
    digest = F.sha2("content", 256)
    return files.select("path", digest.alias("checksum"), F.concat(F.substring(digest, 1, 16), F.lit(".raw")).alias("stored_as"))


def news_union(sources: list[DataFrame], subject: Column, since: str | None = None, per_ticker: int = 12, drop_tier: int = 3) -> DataFrame:
    """Headlines (ticker, url, title, tier, day) of several sources, best first: one a url and one a headline, about the ticker, in time, `per_ticker` of each.

    subject: whether a title is about its ticker. Sources rank by their place
    in the list and rows by url. The cap counts what is left, as it is the
    report's. A row of a known headline or url falls to the earlier one.
    """
    every = None
    for i, s in enumerate(sources):
        s = s.select("ticker", "company", "url", "title", "tier", "day").withColumn("_source", F.lit(i))
        every = s if every is None else every.unionByName(s)
    rows = every.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("tier", F.lit(2)) != drop_tier) & subject)
    if since:
        rows = rows.filter(F.coalesce(F.col("day") >= since, F.lit(True)))
    place = F.struct("_source", "ticker", "url", "title")
    rows = rows.groupBy("url").agg(F.min_by(F.struct("ticker", "title", "tier", "day", "_source"), place).alias("x")).select("url", "x.*")
    key = T.headline_key(F.col("title"))
    rows = rows.withColumn("_key", F.when(key != "", key).otherwise(F.col("url")))
    first = rows.groupBy("ticker", "_key").agg(F.min_by(F.struct("url", "title", "tier", "day", "_source"), F.struct("_source", "url")).alias("x")).select("ticker", "x.*")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("_source", "url"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= per_ticker).select("ticker", "rank", "url", "title", "tier", "day")
