"""Queries of symbols, pairs and sending times over whole tables of queries, baskets and instants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators import directory as O
from tidemark.operators import schedule as S
from tidemark.plans.records import END, OPEN, START
from tidemark.plans.stories import LETTERS, S_LETTERS
from tidemark.plans.views import SYMBOLS, symbols, table

BASES = ["BTC", "ETH", "SOL", "USDT", "AVAX", "B"]
NAMES = ["Bitcoin", "Ether", "Solana", "Tether", "Avalanche", "Bitcoin Cash"]
ALIASES = {"ether": "ETH", "cash": "B"}
SPELLINGS = ["btc/usd", " eth_usdt ", "SOL-BTC", "btc", "BTCUSDT", "doge", "b", "avaxusd", "/", "USDTUSD"]
SEARCHES = ["bit", "BTC", "ether", "sol/usd", "a", "zzz", "ana", "cash", "tether"]


def pairs(s, d):
    """The pairs of every base with the first quotes, by nation: symbol, base, quote, name."""
    k = F.col("n_nationkey")
    rows = table(s, d, "nation").select(F.get(F.array(*map(F.lit, BASES)), (k % 6).cast("int")).alias("base"), F.get(F.array(*map(F.lit, NAMES)), (k % 6).cast("int")).alias("name"), F.get(F.array(*map(F.lit, ("USD", "USDT", "BTC"))), F.floor(k / 6).cast("int") % 3).alias("quote"))
    return rows.filter("base <> quote").select(F.concat("base", F.lit("/"), "quote").alias("symbol"), "base", "quote", "name").distinct()


PAIRS = f"pairs AS (SELECT DISTINCT base || '/' || quote AS symbol, base, quote, name FROM (SELECT {BASES!r}[CAST(n_nationkey % 6 AS INTEGER) + 1] AS base, {NAMES!r}[CAST(n_nationkey % 6 AS INTEGER) + 1] AS name, ['USD', 'USDT', 'BTC'][CAST(n_nationkey // 6 % 3 AS INTEGER) + 1] AS quote FROM nation) WHERE base <> quote)"


def spelled(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, SPELLINGS)), (k % len(SPELLINGS)).cast("int")).alias("raw"))


def s_candidates(x: str) -> str:
    clean = rf"regexp_replace(upper(trim({x})), '[\s_]+', '', 'g')"
    parts = f"list_filter(string_split_regex({clean}, '[/-]'), lambda p: p <> '')"
    glued = ", ".join(f"CASE WHEN length({parts}[1]) > {len(q)} AND ends_with({parts}[1], '{q}') THEN substr({parts}[1], 1, length({parts}[1]) - {len(q)}) || '/{q}' END" for q in O.QUOTES)
    return f"CASE len({parts}) WHEN 2 THEN [{parts}[1] || '/' || {parts}[2]] WHEN 1 THEN list_filter([{parts}[1] || '/USD', {glued}], lambda c: c IS NOT NULL) ELSE [] END"


def baskets(s, d):
    k = F.col("o_custkey")
    token = F.get(F.array(*map(F.lit, SPELLINGS)), (F.col("o_orderkey") % 7 + F.when(k % 3 == 0, 5).otherwise(0)).cast("int") % len(SPELLINGS))
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", token.alias("t")))), lambda x: x["t"]).alias("t"))
    return g.select("o_custkey", F.when(k % 10 == 9, " , ").otherwise(F.array_join("t", ",")).alias("raw"))


BASKETS = f"""{PAIRS}, served AS (SELECT list(symbol) AS l FROM pairs), t AS (SELECT o_custkey, o_orderkey, {SPELLINGS!r}[CAST((o_orderkey % 7 + CASE WHEN o_custkey % 3 = 0 THEN 5 ELSE 0 END) % {len(SPELLINGS)} AS INTEGER) + 1] AS raw FROM orders WHERE o_custkey % 10 <> 9),
n AS (SELECT o_custkey, o_orderkey, trim(raw) AS raw, list_filter({s_candidates('raw')}, lambda x: list_contains(l, x))[1] AS pair FROM t, served),
f AS (SELECT o_custkey, pair, min(o_orderkey) AS at_ FROM n WHERE pair IS NOT NULL GROUP BY 1, 2), p AS (SELECT o_custkey, list(pair ORDER BY at_) AS p FROM f GROUP BY 1), r AS (SELECT o_custkey, list(raw ORDER BY o_orderkey) AS r FROM n WHERE pair IS NULL GROUP BY 1)"""


def asked(s, d):
    """Queries by part: symbols, beginnings of names and symbols, words and typing errors."""
    k = F.col("p_partkey")
    return table(s, d, "part").select(F.when(k % 5 == 0, F.concat(F.lit("p"), k.cast("string"))).when(k % 5 == 1, F.substring("p_name", 1, 6)).when(k % 5 == 2, F.concat(F.lit(" The "), "p_name", F.lit("!"))).when(k % 5 == 3, F.lit("P1")).otherwise("zz%top").alias("query"))


def s_normal(x: str) -> str:
    return rf"trim(substr(regexp_replace(regexp_replace(trim({x}), '[^\p{{L}}\p{{N}}.\-& ]', ' ', 'g'), '\s+', ' ', 'g'), 1, 64))"


def s_searchable(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), '^the ', '')"


S_ASKED = "CASE p_partkey % 5 WHEN 0 THEN 'p' || p_partkey WHEN 1 THEN substr(p_name, 1, 6) WHEN 2 THEN ' The ' || p_name || '!' WHEN 3 THEN 'P1' ELSE 'zz%top' END"
RESOLVED = f"""WITH {SYMBOLS}, q AS (SELECT DISTINCT {s_normal(S_ASKED)} AS query FROM part),
m AS (SELECT query, symbol, exchange, CASE WHEN lower(symbol) = lower(query) THEN 100 WHEN starts_with(lower(symbol), lower(query)) THEN 90 ELSE 80 END AS rank FROM q JOIN symbols ON tradable AND (starts_with(lower(symbol), lower(query)) OR starts_with({s_searchable('name')}, {s_searchable('query')}))),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank DESC, CASE WHEN exchange IN ('NASDAQ', 'NYSE') THEN 0 ELSE 1 END, length(symbol), symbol) = 1),
g AS (SELECT query, symbol, rank FROM b WHERE rank >= 100 OR NOT regexp_matches(query, '^[A-Za-z]{{1,5}}(\\.[A-Za-z]{{1,2}})?$'))
SELECT q.query, g.symbol, CAST(g.rank AS INTEGER) AS rank FROM q LEFT JOIN g USING (query)"""

SCORED = f"""WITH {PAIRS}, q AS (SELECT unnest({[x.lower() for x in SEARCHES]!r}) AS q), a AS (SELECT q, CASE q WHEN 'ether' THEN 'ETH' WHEN 'cash' THEN 'B' ELSE '' END AS alias FROM q),
s AS (SELECT q AS query, symbol, name, CASE WHEN alias <> '' AND base = alias THEN 100 WHEN lower(base) = q OR lower(symbol) = q THEN 95 WHEN lower(name) = q THEN 90 WHEN starts_with(lower(name), q) THEN 70 WHEN starts_with(lower(base), q) THEN 60 WHEN contains(lower(name), q) THEN 40 END + CASE WHEN quote = 'USD' THEN 5 ELSE 0 END AS score FROM a, pairs)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, length(name), symbol) AS INTEGER) AS place, symbol, score FROM s WHERE score IS NOT NULL QUALIFY place <= 10"""


def days(s):
    return D.trading_days(s, START, END)


def instants(s, d):
    return table(s, d, "events").select("event_id", "ts")


CALENDAR = f"""{OPEN}, cal AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous, row_number() OVER (PARTITION BY date_trunc('week', day) ORDER BY day) = 1 AS first_of_week, timezone('UTC', timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 4 HOUR)) AS opens FROM open_)"""
DUE = f"""{CALENDAR}, at_ AS (SELECT event_id, ts, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS send_date FROM events), late AS (SELECT a.*, c.*, floor(epoch(ts)) - epoch(opens) AS late FROM at_ a LEFT JOIN cal c ON c.day = send_date),
dec AS (SELECT *, CASE WHEN day IS NULL THEN 'not a trading day' WHEN late < 0 THEN 'before the pre-market open' WHEN late > 21600 THEN 'more than 6 h past the pre-market open' END AS skipped FROM late)"""


def due(s, d):
    w = S.due(instants(s, d), days(s))
    return w.select("event_id", "send_date", "skipped", F.array_join(F.transform("windows", lambda x: F.concat_ws("|", x["period_key"], F.array_join(F.transform(x["sessions"], lambda y: y.cast("string")), ","))), ";").alias("windows"))


def users(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k.alias("user_id"), F.when(k % 5 != 0, F.when(k % 3 == 0, "weekly").otherwise("daily")).alias("frequency"), (k % 7 != 0).alias("verified"), F.when(k % 11 == 0, F.lit(True)).alias("disabled"))


def lists(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 13).cast("string")).alias("ticker"))


def sent(s, d):
    return table(s, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("daily:2024-01-05").alias("period_key"))


def quotes_by_request(s, d):
    p = pairs(s, d)
    ask = table(s, d, "nation").select(F.col("n_nationkey").alias("at"), F.concat(F.get(F.array(*map(F.lit, BASES)), (F.col("n_nationkey") % 6).cast("int")), F.when(F.col("n_nationkey") % 4 == 0, "/EUR").otherwise("/USD")).alias("symbol"))
    q = p.filter("base <> 'SOL'").select("symbol", F.char_length("name").cast("double").alias("bid"), (F.char_length("name") + 1).cast("double").alias("ask"))
    t = p.filter("base <> 'ETH'").select("symbol", F.char_length("name").cast("double").alias("price"))
    return O.quoted(ask, q, t, p).withColumn("bps", F.floor(F.col("bps") * 100 + 0.5) / 100)


def annotated(s, d):
    """Tickers of every second key with a part's name and whether it has a report: joined by key, as the letters of keys beyond five digits are those of others."""
    p = table(s, d, "part")
    saved, named = p.select((F.col("p_partkey") * 2).alias("k")), p.filter("p_size > 10").select(F.col("p_partkey").alias("k"), "p_name")
    reports = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.lit(True).alias("r")).distinct()
    return saved.join(named, "k", "left").join(reports, "k", "left").select(F.expr(LETTERS.format(k="k")).alias("ticker"), "p_name", F.coalesce("r", F.lit(False)).alias("has_report"))


QUERIES = {
    "str18_normal_queries": (lambda s, d: asked(s, d).select(O.normal_query(F.col("query")).alias("query")).groupBy("query").agg(F.count("*").alias("n")), f"SELECT {s_normal(S_ASKED)} AS query, count(*) AS n FROM part GROUP BY 1"),
    "topk02_resolved_symbols": (lambda s, d: O.resolved(asked(s, d), symbols(s, d)), RESOLVED),
    "topk03_thin_lookup": (lambda s, d: O.looked_up(symbols(s, d).filter("symbol = 'P13'"), symbols(s, d).filter("symbol LIKE 'P1%'"), "p1", 25)[0].select("symbol", "rank"), f"WITH {SYMBOLS} SELECT symbol, CAST(CASE WHEN lower(symbol) = 'p1' THEN 100 ELSE 90 END AS INTEGER) AS rank FROM symbols WHERE symbol LIKE 'P1%' AND tradable ORDER BY rank DESC, CASE WHEN exchange IN ('NASDAQ', 'NYSE') THEN 0 ELSE 1 END, length(symbol), symbol LIMIT 25"),
    "str22_normal_pairs": (lambda s, d: O.normal_pairs(spelled(s, d), pairs(s, d), ["p_partkey"], "raw").select("p_partkey", "pair"), f"WITH {PAIRS}, served AS (SELECT list(symbol) AS l FROM pairs) SELECT p_partkey, list_filter({s_candidates('raw')}, lambda x: list_contains(l, x))[1] AS pair FROM (SELECT p_partkey, {SPELLINGS!r}[CAST(p_partkey % {len(SPELLINGS)} AS INTEGER) + 1] AS raw FROM part), served"),
    "topk15_fil35_baskets": (lambda s, d: O.baskets(baskets(s, d), pairs(s, d), "o_custkey", "raw").select("o_custkey", F.array_join("pairs", ",").alias("pairs"), F.array_join("rejected", ",").alias("rejected"), "error"), f"WITH {BASKETS}, u AS (SELECT DISTINCT o_custkey FROM orders), j AS (SELECT o_custkey, coalesce(p, []) AS p, coalesce(r, []) AS r FROM u LEFT JOIN p USING (o_custkey) LEFT JOIN r USING (o_custkey)) SELECT o_custkey, array_to_string(p, ',') AS pairs, array_to_string(r, ',') AS rejected, CASE WHEN len(p) = 0 AND len(r) > 0 THEN 'unsupported: ' || array_to_string(r, ', ') WHEN len(p) = 0 THEN 'missing symbols' WHEN len(p) > 25 THEN 'too many symbols; max 25' END AS error FROM j"),
    "topk04_pair_search": (lambda s, d: O.search_pairs(s.createDataFrame([(x,) for x in SEARCHES], "query string"), pairs(s, d), ALIASES), SCORED),
    "join28_pair_liveness": (lambda s, d: O.liveness(pairs(s, d), pairs(s, d).filter("quote = 'USD'")).select("symbol", "status").union(O.liveness(pairs(s, d), None).select(F.concat("symbol", F.lit("?")), "status")), f"WITH {PAIRS} SELECT symbol, CASE WHEN quote = 'USD' THEN 'live' ELSE 'idle' END AS status FROM pairs UNION ALL SELECT symbol || '?', 'unknown' FROM pairs"),
    "join19_requested_quotes": (quotes_by_request, f"WITH {PAIRS}, r AS (SELECT n_nationkey AS at_, {BASES!r}[CAST(n_nationkey % 6 AS INTEGER) + 1] || CASE WHEN n_nationkey % 4 = 0 THEN '/EUR' ELSE '/USD' END AS symbol FROM nation) SELECT at_ AS \"at\", r.symbol, name, CASE WHEN base <> 'SOL' THEN length(name) END::DOUBLE AS bid, CASE WHEN base <> 'SOL' THEN length(name) + 1 END::DOUBLE AS ask, CASE WHEN base <> 'ETH' THEN length(name) END::DOUBLE AS last, floor(CASE WHEN base <> 'SOL' THEN 1 / (length(name) + 0.5::DOUBLE) * 10000 END * 100 + 0.5) / 100 AS bps FROM r LEFT JOIN pairs USING (symbol)"),
    "date12_due_windows": (due, f"""WITH {DUE}, wk AS (SELECT c.day, string_agg(CAST(o.day AS VARCHAR), ',' ORDER BY o.day) AS l FROM cal c JOIN open_ o ON date_trunc('week', o.day) = date_trunc('week', c.previous) AND o.day <= c.previous GROUP BY c.day)
SELECT event_id, send_date, skipped, CASE WHEN skipped IS NULL THEN 'daily:' || send_date || '|' || coalesce(CAST(previous AS VARCHAR), '') || CASE WHEN first_of_week THEN ';' || CASE WHEN previous IS NULL THEN '' ELSE 'weekly:' || strftime(previous, '%G-W%V') || '|' || wk.l END ELSE '' END ELSE '' END AS windows FROM dec LEFT JOIN wk ON wk.day = dec.day"""),
    "date13_next_sends": (lambda s, d: S.next_send(instants(s, d), days(s), "daily").select("event_id", F.col("next_at").cast("timestamp_ntz").alias("daily")).join(S.next_send(instants(s, d), days(s), "weekly").select("event_id", F.col("next_at").cast("timestamp_ntz").alias("weekly")), "event_id"), f"WITH {CALENDAR} SELECT event_id, (SELECT min(opens) FROM cal WHERE opens > ts) AS daily, (SELECT min(opens) FROM cal WHERE opens > ts AND first_of_week) AS weekly FROM events"),
    "date25_premarket_opens": (lambda s, d: instants(s, d).select("event_id", D.eastern_to_utc(D.eastern_date(F.col("ts")), S.OPEN_HOUR).cast("timestamp_ntz").alias("opens")), "SELECT event_id, timezone('UTC', timezone('America/New_York', CAST(CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS TIMESTAMP) + INTERVAL 4 HOUR)) AS opens FROM events"),
    "strm05_on_time_sends": (lambda s, d: S.on_time(instants(s, d).withColumn("day", D.eastern_date(F.col("ts"))).withColumn("opens", D.eastern_to_utc(F.col("day"), S.OPEN_HOUR))).select("event_id", "day"), f"WITH {DUE} SELECT event_id, send_date AS day FROM (SELECT event_id, send_date, floor(epoch(ts)) - epoch(timezone('UTC', timezone('America/New_York', CAST(send_date AS TIMESTAMP) + INTERVAL 4 HOUR))) AS l FROM at_) WHERE l BETWEEN 0 AND 21600"),
    "strm02_poll_ticks": (lambda s, d: S.ticked(instants(s, d), days(s), users(s, d).filter("frequency IS NOT NULL")).groupBy("period_key", F.col("first_tick").cast("timestamp_ntz").alias("first_tick")).agg(F.count("*").alias("users")), f"""WITH {DUE}, w AS (SELECT ts, 'daily' AS f, 'daily:' || send_date AS k FROM dec WHERE skipped IS NULL UNION ALL SELECT ts, 'weekly', 'weekly:' || strftime(previous, '%G-W%V') FROM dec WHERE skipped IS NULL AND first_of_week), p AS (SELECT f, k, min(ts) AS t FROM w GROUP BY 1, 2),
u AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'weekly' ELSE 'daily' END AS f, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1) SELECT k AS period_key, t AS first_tick, n AS users FROM p JOIN u USING (f)"""),
    "join04_05_recipients": (lambda s, d: S.recipients(users(s, d), lists(s, d), sent(s, d), "daily:2024-01-05", "daily").select("user_id", F.array_join("tickers", ",").alias("tickers")), "SELECT c_custkey AS user_id, array_to_string(list_sort(list_distinct(list('T' || (o_orderkey % 13)))), ',') AS tickers FROM customer JOIN orders ON o_custkey = c_custkey WHERE coalesce(CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'weekly' ELSE 'daily' END END, 'daily') = 'daily' AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 4 <> 0 GROUP BY c_custkey"),
    "date08_sessions_between": (lambda s, d: S.trading_days_between(table(s, d, "events").select("event_id", F.to_date("ts").alias("a"), F.date_add(F.to_date("ts"), (F.col("event_id") % 40).cast("int") - 3).alias("b")), days(s), "a", "b"), f"WITH {OPEN} SELECT event_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) + CAST(event_id % 40 - 3 AS INTEGER) AS b, CAST((SELECT count(*) FROM open_ WHERE day BETWEEN CAST(ts AS DATE) AND CAST(ts AS DATE) + CAST(event_id % 40 - 3 AS INTEGER)) AS INTEGER) AS sessions FROM events"),
    "join26_annotated_tickers": (annotated, f"WITH a AS (SELECT p_partkey * 2 AS k FROM part) SELECT {S_LETTERS.format(k='k')} AS ticker, p_name, k % 3 = 0 AND k IN (SELECT p_partkey FROM part) AS has_report FROM a LEFT JOIN part ON p_partkey = k AND p_size > 10"),
}
