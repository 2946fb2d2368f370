"""Queries of accounts, analyses, lists and reports: what a research desk keeps, with every change given twice so that only the first one counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import records as X
from tidemark.functions import text as T
from tidemark.functions.math import round_half_up
from tidemark.operators import accounts as A
from tidemark.operators import analysis as N
from tidemark.operators import evidence as E
from tidemark.operators import folds as O
from tidemark.operators import lookup as L
from tidemark.operators import search as H
from tidemark.operators import technical as C
from tidemark.plans.stories import FIRED, STORIES, all_signals, fired, stories
from tidemark.plans.views import BARS, DOCS, SEGMENTS, bars, docs, segments, spread, table
from tidemark.session import shared_dir
from tidemark.sources import parsers as P

NOW = "1998-06-01"


def ledger(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("delta"), F.when(F.col("o_orderkey") % 2 == 0, "monthly_grant").otherwise("purchase").alias("reason"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.concat(F.lit("pay"), F.col("o_orderkey").cast("string"))).alias("idem"))


LEDGER = "led AS (SELECT o_custkey AS user_id, o_orderkey AS delta, CASE WHEN o_orderkey % 2 = 0 THEN 'monthly_grant' ELSE 'purchase' END AS reason, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE 'pay' || o_orderkey END AS idem FROM orders)"


def twice(step, ledger_, *args):
    return step(step(ledger_, *args), *args)


def users(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))


def credits(s, d):
    """Purchases that webhooks report, some again and some not positive."""
    o = table(s, d, "orders").filter("o_orderkey % 3 = 1")
    rows = o.select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50 - 5 + 0.5).alias("delta"), F.lit("purchase").alias("reason"), F.concat(F.lit("pay"), F.col("o_orderkey").cast("string")).alias("idem"))
    return rows.unionByName(rows.filter("delta > 20"))


def redeemed(s, d):
    o = table(s, d, "orders").filter("o_orderkey % 40 = 7")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("user_id"), k.alias("code"), (k % 9).alias("amount"), (k % 3 != 0).alias("monthly"), F.when(k % 2 == 0, 4).when(k % 5 == 0, 2).alias("months"), F.to_date("o_orderdate").alias("at"))


def sends(s, d):
    o = table(s, d, "orders").filter("o_orderkey % 5 = 0")
    return o.select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("daily:"), F.col("o_orderkey").cast("string")).alias("period_key"), F.when(F.col("o_orderkey") % 15 == 0, "sent").otherwise("sending").alias("status"), F.lit(None).cast("string").alias("transport"), F.lit(None).cast("timestamp").alias("sent_at"), F.lit(None).cast("string").alias("error"))


def failed(s, d):
    return table(s, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("daily:"), F.col("o_orderkey").cast("string")).alias("period_key"), F.repeat(F.lit("boom "), 100).alias("error"))


def marked(s, d):
    done = table(s, d, "orders").filter("o_orderkey % 20 = 5").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("daily:"), F.col("o_orderkey").cast("string")).alias("period_key"), F.lit("smtp").alias("transport"))
    who = users(s, d).withColumn("last_sent", F.lit(None).cast("timestamp"))
    out, reached = A.marked_sent(sends(s, d), who, done, NOW)
    return out.groupBy("status", "transport").agg(F.count("*").alias("n"), F.count("sent_at").alias("stamped")).crossJoin(F.broadcast(reached.agg(F.count("last_sent").alias("users"))))


def tokens(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("user_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"), F.when(F.col("o_orderkey") % 2 == 0, "reset").otherwise("verify").alias("kind"), F.col("o_orderdate").alias("expires"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("1995-01-01").cast("timestamp")).alias("used_at"))


def consumed(s, d):
    asked = table(s, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("token"), F.lit("reset").alias("kind"))
    first, after = A.consumed(tokens(s, d), asked, NOW)
    again, _ = A.consumed(after, asked, NOW)
    return first.withColumn("turn", F.lit(1)).unionByName(again.withColumn("turn", F.lit(2)))


def purchase_events(s, d):
    k = F.col("o_orderkey")
    e = table(s, d, "orders").select(k.alias("event_id"), F.when(k % 3 == 0, F.concat(F.lit("pay"), k.cast("string"))).alias("session"), F.when(k % 3 == 1, F.concat(F.lit("buy"), k.cast("string"))).alias("purchase"), F.when(k % 4 != 0, F.concat(F.lit("pay"), (k + 1).cast("string"))).alias("payment"), F.when(k % 5 == 0, F.lit("999999")).when(k % 5 == 1, F.col("o_custkey").cast("string")).alias("account"))
    p = table(s, d, "orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("buy"), k.cast("string")).alias("id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("pay"), k.cast("string")).alias("payment_id"))
    return A.purchases_of(e, p)


PURCHASES = """WITH e AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'pay' || o_orderkey END AS s, CASE WHEN o_orderkey % 3 = 1 THEN 'buy' || o_orderkey END AS b, CASE WHEN o_orderkey % 4 <> 0 THEN 'pay' || (o_orderkey + 1) END AS p, CASE WHEN o_orderkey % 5 = 0 THEN '999999' WHEN o_orderkey % 5 = 1 THEN CAST(o_custkey AS VARCHAR) END AS a FROM orders),
t AS (SELECT 'buy' || o_orderkey AS id, o_custkey AS u, 'pay' || o_orderkey AS pid FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT k, a, 0 AS w, id, u FROM e JOIN t ON s = pid UNION ALL SELECT k, a, 1, id, u FROM e JOIN t ON b = id UNION ALL SELECT k, a, 2, id, u FROM e JOIN t ON p = pid), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY w, id) = 1)
SELECT k AS event_id, id, u AS user_id FROM o WHERE a IS NULL OR a = CAST(u AS VARCHAR)"""


def analyses(s, d):
    """Analyses and their evidence, some replaced by a later run, given twice."""
    k = F.col("o_orderkey")
    old = table(s, d, "orders").filter("o_orderkey % 3 = 0").select(k.cast("string").alias("id"), F.lit("v1").alias("model"))
    ev = table(s, d, "lineitem").filter("l_orderkey % 3 = 0").select(F.concat_ws(":", "l_orderkey", "l_partkey").alias("id"), F.col("l_orderkey").cast("string").alias("analysis_id"), F.col("l_partkey").cast("string").alias("hash")).dropDuplicates(["id"])
    new = table(s, d, "orders").filter("o_orderkey % 6 = 0").select(k.cast("string").alias("id"), F.lit("v2").alias("model"))
    cited = table(s, d, "lineitem").filter("l_orderkey % 6 = 0 AND l_partkey % 2 = 0").select(F.col("l_orderkey").cast("string").alias("analysis_id"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("hash"))
    a, e = A.stored_analyses(*A.stored_analyses(old, ev, new, cited), new, cited)
    return e.groupBy(F.col("analysis_id").alias("id")).agg(F.count("*").alias("cited")).join(a, "id", "right").select("id", "model", F.coalesce("cited", F.lit(0)).alias("cited"))


ANALYSES = """WITH n AS (SELECT DISTINCT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'v2' ELSE 'v1' END AS model FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) FILTER (l_orderkey % 6 <> 0 OR l_partkey % 2 = 0) AS cited FROM lineitem GROUP BY 1)
SELECT CAST(n.k AS VARCHAR) AS id, model, coalesce(cited, 0) AS cited FROM n LEFT JOIN c USING (k)"""


def evidence(s, d):
    """Signals of stories as evidence texts with their tags."""
    g = all_signals(s, d)
    return g.select("ticker", F.col("signal_id").alias("id"), F.concat(F.lit("[2024] Ann ("), "event_type", F.lit("/"), "direction", F.lit("): "), "quote").alias("text"))


def facts(s, d):
    k = F.col("id")
    return stories(s, d).select("ticker", F.when(k % 3 != 0, (k % 30).cast("double")).alias("runway_months"), F.when(k % 4 != 0, (k * 70_000).cast("double")).alias("dollar_volume"), F.when(k % 5 != 0, (k % 101).cast("double")).alias("technical"))


OFFLINE = f"""WITH {FIRED.replace('@KEPT@', 'TRUE')}, ev AS (SELECT ticker, signal_id AS id, event_type || '/' || direction AS tag, '[2024] Ann (' || event_type || '/' || direction || '): ' || quote AS text, substr(trim(quote), 1, 160) AS s FROM found),
n AS (SELECT ticker, count(*) AS items, count(*) FILTER (contains(tag, 'positive')) AS pos, count(*) FILTER (contains(tag, 'negative')) AS neg, count(*) FILTER (regexp_matches(text, '{N.DILUTION}')) AS dil FROM ev GROUP BY ticker),
t AS (SELECT ticker, contains(tag, 'positive') AS p, s, min(id) AS id FROM ev WHERE contains(tag, 'positive') OR contains(tag, 'negative') GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY ticker, contains(tag, 'positive') ORDER BY min(id)) <= 6),
g AS (SELECT ticker, string_agg(s, '|' ORDER BY id) FILTER (p) AS catalysts, string_agg(s, '|' ORDER BY id) FILTER (NOT p) AS risks FROM t GROUP BY ticker),
f AS (SELECT ticker, CASE WHEN id % 3 <> 0 THEN (id % 30)::DOUBLE END AS runway, CASE WHEN id % 4 <> 0 THEN (id * 70000)::DOUBLE END AS vol, coalesce(CASE WHEN id % 5 <> 0 THEN (id % 101)::DOUBLE END, 50) AS attention FROM stories),
j AS (SELECT f.*, coalesce(items, 0) AS items, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(dil, 0) AS dil, coalesce(catalysts, '') AS catalysts, coalesce(risks, '') AS risks FROM f LEFT JOIN n USING (ticker) LEFT JOIN g USING (ticker)),
x AS (SELECT *, pos / greatest(1, pos + neg)::DOUBLE * 100 AS catalyst, least(100, dil / greatest(1, pos + neg)::DOUBLE * 100) AS dilution, CASE WHEN vol > 0 THEN greatest(0, least(100, 100 - log10(vol / 1e5) * 25)) ELSE 60.0 END AS liquidity, least(100, 30 + pos * 8.0) AS execution, CASE WHEN coalesce(runway, 0) <> 0 THEN least(100, runway * 4) ELSE 45.0 END AS financial FROM j)
SELECT ticker, pos, neg, round(catalyst, 2) AS catalyst, round(dilution, 2) AS dilution, round(liquidity, 2) AS liquidity, round(execution::DOUBLE, 2) AS execution, round(financial, 2) AS financial, round(attention, 2) AS attention,
round(greatest(0, least(100, catalyst * 0.35::DOUBLE + execution * 0.2::DOUBLE + attention * 0.15::DOUBLE + financial * 0.1::DOUBLE - dilution * 0.2::DOUBLE - liquidity * 0.1::DOUBLE + 5)), 2) AS overall, round((35 + least(30, items * 3) - CASE WHEN neg > pos THEN 15 ELSE 0 END)::DOUBLE, 2) AS confidence, catalysts, risks FROM x"""


def answers(s, d):
    """A model's answers: valid ones, broken ones, and ones that a second try mends."""
    k = F.col("p_partkey")
    body = lambda score, lists: F.to_json(F.struct(F.when(k % 11 != 0, F.lit("T")).alias("ticker"), F.col("p_name").alias("companyName"), F.lit("up").alias("thesis"), score.alias("catalystScore"), F.lit(1).alias("executionScore"), F.lit(2).alias("dilutionRiskScore"), F.lit(3).alias("overallScore"), F.lit(100).alias("confidence"), lists.alias("catalystSummary"), F.array().cast("array<string>").alias("riskSummary"), F.array(F.lit("e")).alias("evidenceIds"), F.array(F.lit("m")).alias("missingData")))
    good = body(k % 101, F.array(F.lit("a")))
    return spread(table(s, d, "part"), "p_partkey").select(k.alias("id"), F.when(k % 4 == 0, F.lit("{no")).when(k % 4 == 1, body(k % 7 * 30, F.array(F.lit("a")))).otherwise(good).alias("first"), F.when(k % 3 != 0, good).otherwise("[").alias("second"))


ANSWERS = """WITH a AS (SELECT p_partkey AS k, p_partkey % 11 = 0 AS nt FROM part), f AS (SELECT *, k % 4 <> 0 AND NOT nt AND (k % 4 <> 1 OR k % 7 * 30 <= 100) AS ok1, k % 3 <> 0 AND NOT nt AS ok2 FROM a)
SELECT k AS id, CAST(CASE WHEN ok1 THEN 1 WHEN ok2 THEN 2 END AS INTEGER) AS attempt, CASE WHEN NOT ok1 AND NOT ok2 THEN CASE WHEN k % 3 = 0 THEN '(root): invalid JSON' ELSE 'ticker: required' END END AS error FROM f"""

COERCED = ["one; two;three", " \n- first\n* second", "plain, with commas", "  ", '["a","b"]']
LINES = ['a,b,c', '"x, y",z', '"he said ""hi""",,', 'plain"quote,1', '']


def listed_csv(s, d):
    k = F.col("p_partkey")
    note = F.when(k % 4 == 0, F.concat(F.lit('"a, ""b"" '), "p_brand", F.lit('"'))).when(k % 4 == 1, "").otherwise(F.lit("plain"))
    symbol = F.when(k % 6 == 0, "not a ticker").otherwise(F.concat(F.lit(" ab"), F.substring(F.translate(k.cast("string"), "0123456789", "cdefghijkl"), 1, 3)))
    return table(s, d, "part").select(F.floor(k / 50).alias("file"), k.alias("at"), F.concat_ws(",", symbol, F.lit("x"), note).alias("line"))


def imported(s, d):
    """Rows of lists by the header symbol, price, note: valid tickers once a file with the first note, the others counted."""
    f = X.csv_fields(F.col("line"))
    rows = listed_csv(s, d).withColumn("f", f).select("file", "at", X.ticker(F.get("f", 0)).alias("ticker"), F.nullif(F.trim(F.get("f", 2)), F.lit("")).alias("note"))
    valid = rows.filter("ticker IS NOT NULL").groupBy("file", "ticker").agg(F.min_by("note", "at").alias("note"))
    return valid.join(rows.groupBy("file").agg(F.count_if(F.col("ticker").isNull()).alias("invalid")), "file")


IMPORTED = """WITH r AS (SELECT p_partkey // 50 AS file, p_partkey AS at_, CASE WHEN p_partkey % 6 <> 0 THEN 'AB' || upper(substr(translate(CAST(p_partkey AS VARCHAR), '0123456789', 'cdefghijkl'), 1, 3)) END AS ticker, CASE p_partkey % 4 WHEN 0 THEN 'a, "b" ' || p_brand WHEN 1 THEN NULL ELSE 'plain' END AS note FROM part),
v AS (SELECT file, ticker, min(at_) AS a FROM r WHERE ticker IS NOT NULL GROUP BY 1, 2), i AS (SELECT file, count(*) FILTER (ticker IS NULL) AS invalid FROM r GROUP BY 1) SELECT v.file, v.ticker, r.note, invalid FROM v JOIN r ON r.file = v.file AND r.at_ = v.a JOIN i ON i.file = v.file"""


def exported(s, d):
    """A list as CSV lines in order of ticker, unknown prices blank."""
    k = F.col("s_suppkey")
    saved = table(s, d, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("ticker"), F.when(k % 3 == 0, F.concat("s_name", F.lit(', "x"'))).alias("note"))
    price = table(s, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), k.cast("string")).alias("ticker"), X.fixed(F.col("s_acctbal"), 2).alias("price"))
    return saved.join(price, "ticker", "left").select("ticker", F.concat_ws(",", "ticker", X.csv_field(F.coalesce("note", F.lit(""))), F.coalesce("price", F.lit(""))).alias("line")).orderBy("ticker")


def rendered(s, d):
    """Ranked rows as JSON and Markdown lines."""
    k = F.col("c_custkey")
    rows = table(s, d, "customer").select(k, "c_name", round_half_up(F.col("c_acctbal") / 100).alias("score"))
    top = E.cap_per(rows.withColumn("g", F.col("c_custkey") % 8), "g", 3, F.desc("score"), k)
    return top.select("c_custkey", F.to_json(F.struct("c_name", F.col("score").cast("decimal(20,2)").alias("score"))).alias("json"), F.concat(F.lit("| "), "c_name", F.lit(" | "), X.fixed(F.col("score"), 2), F.lit(" |")).alias("markdown"))


RSI_SERIES = f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, day, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
f AS (SELECT symbol, sum(greatest(d, 0)) / 14 AS g, sum(greatest(-d, 0)) / 14 AS l FROM n WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14),
r(symbol, i, g, l) AS (SELECT symbol, 14, g, l FROM f UNION ALL SELECT r.symbol, n.i, (r.g * 13 + greatest(n.d, 0)) / 14, (r.l * 13 + greatest(-n.d, 0)) / 14 FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)
SELECT symbol, day, round(CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi FROM r JOIN n USING (symbol, i)"""

LEVELS = f"""WITH {BARS}, w AS (SELECT *, row_number() OVER o AS n, count(*) OVER (PARTITION BY symbol) AS a, max(high) OVER r AS t, min(low) OVER r AS b FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY day), r AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
i AS (SELECT * FROM w WHERE n > 5 AND n <= a - 5), p AS (SELECT symbol, high AS p FROM i WHERE high >= t UNION ALL SELECT symbol, low FROM i WHERE low <= b), l AS (SELECT symbol, arg_max(close, day) AS last FROM bars GROUP BY symbol),
c AS (SELECT symbol, last, list_reduce(list_transform(list(p ORDER BY p), lambda x: [{{'s': x, 'c': 1}}]), lambda acc, x: CASE WHEN x[1].s - acc[-1].s / acc[-1].c <= last * 0.02::DOUBLE THEN list_concat(acc[1:len(acc) - 1], [{{'s': acc[-1].s + x[1].s, 'c': acc[-1].c + 1}}]) ELSE list_concat(acc, x) END) AS c FROM p JOIN l USING (symbol) GROUP BY symbol, last),
u AS (SELECT symbol, last, x.s / x.c AS price, x.c AS touches FROM (SELECT symbol, last, unnest(c) AS x FROM c)), f AS (SELECT * FROM u WHERE touches >= 2 AND abs(price - last) / last > 0.01)
SELECT symbol, round(price, 4) AS price, touches, CASE WHEN price >= last THEN 'R' ELSE 'S' END AS kind FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY touches DESC, price) <= 6"""


def headline_phrases(s, d):
    heads = stories(s, d).select("id", F.concat("headline", F.lit(" "), "text").alias("text"))
    return O.greedy_phrases(E.phrase_frequency(heads), 24)


def niche_rows(s, d):
    items = stories(s, d).select("id", F.concat(F.lit("h"), (F.col("id") % 4).cast("string")).alias("host"), F.concat("headline", F.lit(" "), "text").alias("text"))
    return N.niches(items, headline_phrases(s, d)).select("label", "count", F.array_join("hosts", ",").alias("hosts"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def notes(s, d):
    """Notes on each symbol's last bar; some indicators are made null."""
    k = F.col("s_suppkey")
    v = lambda m: F.when(k % m != 0, F.col("s_acctbal") + k % 7 - 3)
    rows = table(s, d, "supplier").select(F.col("s_name").alias("symbol"), F.col("s_acctbal").alias("close"), v(3).alias("sma20"), v(4).alias("sma50"), v(5).alias("sma200"), F.when(k % 6 != 0, (k % 21 - 10).cast("double")).alias("momentum20"), F.when(k % 7 != 0, (k * 13 % 101).cast("double")).alias("rsi"), (k % 5).cast("double").alias("macd"), F.lit(2.0).alias("macd_signal"), (-(k % 9)).cast("double").alias("from_high"), (k % 8 == 0).alias("breakout"), (k % 10 == 0).alias("breakdown"))
    return N.indicator_notes(rows).select("symbol", F.array_join("support", "|").alias("support"), F.array_join("risks", "|").alias("risks"))


_V = lambda m: f"CASE WHEN k % {m} <> 0 THEN v + k % 7 - 3 END"
NOTES = f"""WITH i AS (SELECT s_name AS symbol, s_suppkey AS k, s_acctbal AS v FROM supplier), a AS (SELECT *, {_V(3)} AS s20, {_V(4)} AS s50, {_V(5)} AS s200, CASE WHEN k % 6 <> 0 THEN k % 21 - 10 END AS m, CASE WHEN k % 7 <> 0 THEN k * 13 % 101 END AS r FROM i),
b AS (SELECT *, list_filter([CASE WHEN v > s20 THEN '20-day' END, CASE WHEN v > s50 THEN '50-day' END, CASE WHEN v > s200 THEN '200-day' END], lambda x: x IS NOT NULL) AS up, list_filter([CASE WHEN v <= s20 THEN '20-day' END, CASE WHEN v <= s50 THEN '50-day' END, CASE WHEN v <= s200 THEN '200-day' END], lambda x: x IS NOT NULL) AS dn FROM a)
SELECT symbol, array_to_string(list_filter([CASE WHEN len(up) > 0 THEN 'Trading above its ' || array_to_string(up, ', ') || ' average' || CASE WHEN len(up) > 1 THEN 's.' ELSE '.' END END, CASE WHEN m >= 0 THEN m || '.0% over the last 20 sessions.' END, CASE WHEN r <= 30 THEN 'RSI is in oversold territory.' WHEN r < 70 THEN 'RSI is neutral.' END, CASE WHEN k % 5 > 2 THEN 'MACD is above its signal line.' END, CASE WHEN k % 9 <= 3 THEN 'Trading at or near its 52-week high.' END, CASE WHEN k % 8 = 0 THEN 'Price has broken above its recent range.' END], lambda x: x IS NOT NULL), '|') AS support,
array_to_string(list_filter([CASE WHEN len(dn) > 0 THEN 'Trading below its ' || array_to_string(dn, ', ') || ' average' || CASE WHEN len(dn) > 1 THEN 's.' ELSE '.' END END, CASE WHEN m < 0 THEN m || '.0% over the last 20 sessions.' END, CASE WHEN r >= 70 THEN 'RSI is in overbought territory.' END, CASE WHEN k % 5 <= 2 THEN 'MACD is below its signal line.' END, CASE WHEN k % 9 > 3 THEN '-' || (k % 9) || '.0% from its 52-week high.' END, CASE WHEN k % 10 = 0 THEN 'Price has broken below its recent range.' END], lambda x: x IS NOT NULL), '|') AS risks FROM b"""


def searched(s, d, query):
    """Segments that a full-text query finds, or that hold it as it stands where no word does."""
    return H.found_or_held(segments(s, d), ["document_id", "seg_index"], "text", query)


def asked(s, d):
    """A query of two words for every conversation: the third of its first turn, and the first three letters of the fifth."""
    w = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return table(s, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("query_id"), F.concat_ws(" ", F.get(w, 2), F.left(F.get(w, 4), F.lit(3))).alias("query"))


def indexed(s, d):
    """Each query's segments, by an index over their texts and speakers."""
    index = H.write_index(segments(s, d), ["document_id", "seg_index"], ["text", "speaker"], f"{shared_dir(s)}/index-{uuid.uuid4().hex}")
    return index.search(asked(s, d))


def indexed_tickers(s, d):
    """The tickers whose documents each query finds."""
    index = H.write_index(docs(s, d), ["ticker"], ["text", "ticker"], f"{shared_dir(s)}/index-{uuid.uuid4().hex}")
    return index.search(asked(s, d), once=True)


ASKED = r"""asked AS (SELECT query_id, list_filter(l, lambda t: length(t) >= 2 OR regexp_matches(t, '[0-9]')) AS l FROM (SELECT query_id, regexp_extract_all(lower(q), '[\p{L}\p{N}]+') AS l
  FROM (SELECT conv_id AS query_id, concat_ws(' ', w[3], left(w[5], 3)) AS q FROM (SELECT conv_id, regexp_extract_all(text, '\S+') AS w FROM conversations WHERE turn = 0))))"""


def finds(text: str) -> str:
    return f"SELECT * FROM (SELECT *, list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM rows_) r JOIN asked a ON len(a.l) > 0 AND len(list_filter(a.l, lambda t: len(list_filter(r.w, lambda x: starts_with(x, t))) = 0)) = 0"


def pick(values, key="p_partkey"):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def s_pick(values, key="p_partkey"):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({key} % {len(values)} AS INTEGER) + 1]"


QUERIES = {
    "dml14_monthly_grants": (lambda s, d: twice(A.granted, ledger(s, d), users(s, d), "1998-01", 25).groupBy("user_id").agg(F.sum("delta").alias("balance"), F.count_if((F.col("reason") == "monthly_grant") & (F.col("idem") == "1998-01")).alias("grants")), f"WITH {LEDGER}, h AS (SELECT DISTINCT user_id FROM led WHERE reason = 'monthly_grant' AND idem = '1998-01'), a AS (SELECT * FROM led UNION ALL SELECT c_custkey, 25, 'monthly_grant', '1998-01' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM h)) SELECT user_id, CAST(sum(delta) AS BIGINT) AS balance, count(*) FILTER (reason = 'monthly_grant' AND idem = '1998-01') AS grants FROM a GROUP BY user_id"),
    "dml15_17_credited_once": (lambda s, d: twice(A.credited, ledger(s, d).filter("delta % 9 <> 1"), credits(s, d)).groupBy("user_id").agg(F.sum("delta").alias("balance"), F.count("*").alias("n")), f"WITH {LEDGER}, o AS (SELECT * FROM led WHERE delta % 9 <> 1), c AS (SELECT DISTINCT o_custkey AS user_id, CAST(floor(o_orderkey % 50 - 5 + 1.0) AS BIGINT) AS delta, 'purchase' AS reason, 'pay' || o_orderkey AS idem FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 50 - 5 + 0.5 > 0), a AS (SELECT * FROM o UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = c.user_id AND o.reason = c.reason AND o.idem = c.idem)) SELECT user_id, CAST(sum(delta) AS BIGINT) AS balance, count(*) AS n FROM a GROUP BY user_id"),
    "dml16_refunds_appended": (lambda s, d: A.refunded(ledger(s, d), table(s, d, "orders").filter("o_orderkey % 8 = 3").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 5).alias("delta"), F.lit("report").alias("operation"), F.col("o_orderkey").alias("at"))).groupBy("reason").agg(F.count("*").alias("n"), F.sum("delta").alias("total")), f"WITH {LEDGER} SELECT reason, count(*) AS n, CAST(sum(delta) AS BIGINT) AS total FROM (SELECT reason, delta FROM led UNION ALL SELECT 'refund:report', o_orderkey % 5 FROM orders WHERE o_orderkey % 8 = 3 AND o_orderkey % 5 > 0) GROUP BY reason"),
    "dml24_reconciled_codes": (lambda s, d: twice(A.reconciled, ledger(s, d).limit(0), redeemed(s, d), NOW).select("user_id", "delta", "idem"), f"WITH r AS (SELECT o_custkey AS user_id, o_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS m, CASE WHEN o_orderkey % 2 = 0 THEN 4 WHEN o_orderkey % 5 = 0 THEN 2 END AS months FROM orders WHERE o_orderkey % 40 = 7 AND o_orderkey % 9 > 0), u AS (SELECT *, CASE WHEN months IS NULL THEN DATE '{NOW}' ELSE least(DATE '{NOW}', CAST(m + to_months(months - 1) AS DATE)) END AS e FROM r), x AS (SELECT user_id, k, CASE WHEN k % 3 = 0 THEN [NULL] WHEN e >= m THEN list_transform(range(0, datediff('month', m, e) + 1), lambda i: strftime(m + to_months(CAST(i AS INTEGER)), '%Y-%m')) ELSE [strftime(m, '%Y-%m')] END AS l FROM u) SELECT user_id, k % 9 AS delta, concat_ws(':', 'code', k, p) AS idem FROM (SELECT user_id, k, unnest(l) AS p FROM x)"),
    "dml18_marked_sent": (marked, "WITH s AS (SELECT o_custkey AS u, CASE WHEN o_orderkey % 20 = 5 OR o_orderkey % 15 = 0 THEN 'sent' ELSE 'sending' END AS status, CASE WHEN o_orderkey % 20 = 5 THEN 'smtp' END AS transport FROM orders WHERE o_orderkey % 5 = 0) SELECT status, transport, count(*) AS n, count(transport) AS stamped, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 20 = 5) AS users FROM s GROUP BY ALL"),
    "dml19_released_claims": (lambda s, d: twice(A.released, sends(s, d), failed(s, d), NOW).groupBy("status").agg(F.count("*").alias("n"), F.max(F.char_length("error")).alias("longest")), "SELECT status, count(*) AS n, max(e) AS longest FROM (SELECT CASE WHEN o_orderkey % 15 = 0 THEN 'sent' ELSE 'sending' END AS status, NULL::INTEGER AS e FROM orders WHERE o_orderkey % 5 = 0 AND (o_orderkey % 10 <> 0 OR o_orderkey % 15 = 0) UNION ALL SELECT 'failed', 400 FROM orders WHERE o_orderkey % 10 = 0) GROUP BY status"),
    "dml20_frequencies": (lambda s, d: A.with_frequency(users(s, d).withColumn("frequency", F.lit("daily")), table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), pick(("weekly", "off", "hourly"), "o_orderkey").alias("frequency"), F.col("o_orderkey").alias("at"))), f"WITH w AS (SELECT o_custkey, {s_pick(('weekly', 'off', 'hourly'), 'o_orderkey')} AS f, o_orderkey AS k FROM orders) SELECT c_custkey AS user_id, coalesce((SELECT arg_max(f, k) FROM w WHERE o_custkey = c_custkey AND f <> 'hourly'), 'daily') AS frequency FROM customer"),
    "dml21_settled_invites": (lambda s, d: (lambda p: p[0].withColumn("state", F.lit("claimed")).unionByName(p[1].withColumn("state", F.lit("left"))))(A.settled(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id")))), "SELECT c_custkey AS user_id, c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'claimed' ELSE 'left' END AS state FROM customer"),
    "dml23_removed_items": (lambda s, d: A.removed(table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 9).cast("string")).alias("ticker")).distinct(), table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit(" t"), (F.col("c_custkey") % 9).cast("string")).alias("ticker"))), "SELECT DISTINCT o_custkey AS user_id, 'T' || (o_orderkey % 9) AS ticker FROM orders WHERE o_orderkey % 9 <> o_custkey % 9"),
    "join31_consumed_tokens": (consumed, f"SELECT o_custkey AS user_id, sha256(CAST(o_orderkey AS VARCHAR)) AS hash, CAST(1 AS INTEGER) AS turn FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 AND o_orderdate > TIMESTAMP '{NOW}'"),
    "join32_purchases_of_events": (purchase_events, PURCHASES),
    "dml04_stored_analyses": (analyses, ANALYSES),
    "dml05_stored_links": (lambda s, d: twice(A.stored_links, table(s, d, "lineitem").limit(0).select(F.lit("").alias("key"), F.lit(0).cast("long").alias("n")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("doc_id")).groupBy("id", "doc_id").agg(F.count("*").alias("n"))), "SELECT 'cor:' || substr(sha256(l_orderkey || '|' || l_partkey), 1, 20) AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey"),
    "strm07_capped_fan_out": (lambda s, d: A.fanned_out(A.capped_events(all_signals(s, d), 4), table(s, d, "orders").join(stories(s, d).select("id", "ticker"), F.col("o_orderkey") % 50 + 1 == F.col("id")).select(F.col("o_custkey").alias("user_id"), "ticker")).groupBy("user_id").agg(F.count("*").alias("events")), f"WITH {fired('TRUE')}, c AS (SELECT DISTINCT id, ticker, signal_id, strength FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY strength DESC, signal_id) <= 4), w AS (SELECT DISTINCT o_custkey, ticker FROM orders JOIN stories ON o_orderkey % 50 + 1 = id) SELECT o_custkey AS user_id, count(DISTINCT signal_id) AS events FROM w JOIN c USING (ticker) GROUP BY 1"),
    "fil05_08_when_given": (lambda s, d: A.when_given(stories(s, d), "event_date", "2024-03-01", None, rival=None).select("id").withColumn("q", F.lit(1)).unionByName(A.when_given(stories(s, d), "event_date", None, "2024-02-01", ticker=None).select("id").withColumn("q", F.lit(2))).unionByName(A.when_given(stories(s, d), "event_date", id=7).select("id").withColumn("q", F.lit(3))), f"WITH {STORIES} SELECT id, CAST(1 AS INTEGER) AS q FROM stories WHERE event_date >= DATE '2024-03-01' UNION ALL SELECT id, 2 FROM stories WHERE event_date <= DATE '2024-02-01' UNION ALL SELECT id, 3 FROM stories WHERE id = 7"),
    "math05_json_offline_scores": (lambda s, d: N.offline_scores(evidence(s, d), facts(s, d)), OFFLINE),
    "str40_agg40_evidence_tags": (lambda s, d: evidence(s, d).select("id", "ticker", N.tag_of(F.col("text")).alias("tag"), N.summary_of(F.col("text")).alias("summary")), f"WITH {fired('TRUE')} SELECT signal_id AS id, ticker, event_type || '/' || direction AS tag, substr(trim(quote), 1, 160) AS summary FROM found"),
    "json07_11_repaired_answers": (lambda s, d: N.repaired(answers(s, d)).select("id", "attempt", "error"), ANSWERS),
    "json06_coerced_lists": (lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(N.as_list(pick(COERCED)), "|").alias("list")), "SELECT p_partkey, ['one|two|three', 'first|second', 'plain, with commas', '', 'a|b'][CAST(p_partkey % 5 AS INTEGER) + 1] AS list FROM part"),
    "topk12_model_aliases": (lambda s, d: N.model_for(s.createDataFrame([(x,) for x in ("latest", "deep", "fast", "balanced", "m3", "none")], "request string"), table(s, d, "supplier").filter("s_suppkey BETWEEN 1 AND 9").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("2024-0"), (F.col("s_suppkey") * 4 % 9 + 1).cast("string")).alias("created")), {"deep": "m[12]$", "fast": "zzz"}), "SELECT * FROM (VALUES ('latest', 'm2'), ('deep', 'm2'), ('fast', 'm9'), ('balanced', 'm1'), ('m3', 'm3'), ('none', NULL)) v(request, id)"),
    "src34_csv_fields": (lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(X.csv_fields(pick(LINES)), "|").alias("fields")), "SELECT p_partkey, ['a|b|c', 'x, y|z', 'he said \"hi\"||', 'plain\"quote|1', ''][CAST(p_partkey % 5 AS INTEGER) + 1] AS fields FROM part"),
    "src61_imported_lists": (imported, IMPORTED),
    "src35_str54_exported_list": (exported, "SELECT 'S' || s_suppkey AS ticker, 'S' || s_suppkey || ',' || CASE WHEN s_suppkey % 3 = 0 THEN '\"' || s_name || ', \"\"x\"\"\"' ELSE '' END || ',' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(CAST(s_acctbal AS DECIMAL(20, 2)) AS VARCHAR) ELSE '' END AS line FROM supplier"),
    "src36_65_rendered_ranking": (rendered, "WITH r AS (SELECT c_custkey, c_name, CAST(round(c_acctbal / 100, 2) AS DECIMAL(20, 2)) AS score FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 8 ORDER BY round(c_acctbal / 100, 2) DESC, c_custkey) <= 3) SELECT c_custkey, '{\"c_name\":\"' || c_name || '\",\"score\":' || score || '}' AS json, '| ' || c_name || ' | ' || score || ' |' AS markdown FROM r"),
    "str42_formats": (lambda s, d: table(s, d, "part").select("p_partkey", X.money(F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 8)).alias("money"), X.signed_percent(F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") / 4 - 5)).alias("percent"), X.short_volume(F.when(F.col("p_partkey") % 5 != 0, (F.col("p_size") * F.pow(F.lit(10.0), F.col("p_partkey") % 9)))).alias("volume")), "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '—' WHEN p_size < 8 THEN '$' || CAST(CAST(p_size / 8 AS DECIMAL(20, 4)) AS VARCHAR) ELSE '$' || CAST(CAST(p_size / 8 + 1e-9 AS DECIMAL(20, 2)) AS VARCHAR) END AS money, CASE WHEN p_partkey % 4 = 0 THEN '—' ELSE CASE WHEN p_size > 20 THEN '+' ELSE '' END || CAST(CAST(p_size / 4 - 5 AS DECIMAL(20, 2)) AS VARCHAR) || '%' END AS percent, CASE WHEN p_partkey % 5 = 0 THEN '—' WHEN v >= 1e9 THEN CAST(CAST(v / 1e9 AS DECIMAL(20, 1)) AS VARCHAR) || 'B' WHEN v >= 1e6 THEN CAST(CAST(v / 1e6 AS DECIMAL(20, 1)) AS VARCHAR) || 'M' WHEN v >= 1e3 THEN CAST(CAST(v / 1e3 AS DECIMAL(20, 0)) AS VARCHAR) || 'K' ELSE CAST(CAST(v AS DECIMAL(20, 0)) AS VARCHAR) END AS volume FROM (SELECT *, p_size * pow(10, p_partkey % 9) AS v FROM part)"),
    "str32_comma_lists": (lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(X.listed(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(" a ,, "), "p_brand", F.lit(",")))), "|").alias("list")), "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'A|' || upper(p_brand) ELSE '' END AS list FROM part"),
    "win06_rsi_series": (lambda s, d: C.rsi_series(bars(s, d)).select("symbol", "day", round_half_up(F.col("rsi"), 4).alias("rsi")), RSI_SERIES),
    "agg32_levels": (lambda s, d: N.levels(bars(s, d)).select("symbol", round_half_up(F.col("price"), 4).alias("price"), "touches", "kind"), LEVELS),
    "agg33_str52_53_niches": (niche_rows, None),
    "math15_indicator_notes": (notes, NOTES),
    "fil09_indexed_search": (indexed, f"WITH {SEGMENTS}, {ASKED}, rows_ AS (SELECT * FROM segments) SELECT query_id, document_id, seg_index FROM ({finds("concat_ws(' ', text, speaker)")})"),
    "join12_indexed_tickers": (indexed_tickers, f"WITH {DOCS}, {ASKED}, rows_ AS (SELECT ticker, text FROM docs) SELECT DISTINCT query_id, ticker FROM ({finds("concat_ws(' ', text, ticker)")})"),
    "fil11_search_fallback": (lambda s, d: searched(s, d, "the th").withColumn("q", F.lit(1)).unionByName(searched(s, d, ". ").withColumn("q", F.lit(2))), f"WITH {SEGMENTS}, t AS (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM segments) SELECT document_id, seg_index, CAST(1 AS INTEGER) AS q FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'the'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0 UNION ALL SELECT document_id, seg_index, 2 FROM t WHERE contains(lower(text), '. ')"),
    "join12_fulltext_tickers": (lambda s, d: stories(s, d).join(L.fulltext(stories(s, d).select("id", F.concat_ws(" ", "text", "company", "ticker").alias("all_")), ["id"], "all_", "zela backlog"), "id", "left_semi").select("ticker").distinct().orderBy("ticker").limit(25), f"WITH {STORIES}, t AS (SELECT ticker, regexp_extract_all(lower(text || ' ' || company || ' ' || ticker), '[\\p{{L}}\\p{{N}}]+') AS w FROM stories) SELECT DISTINCT ticker FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'zela'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'backlog'))) > 0 ORDER BY ticker LIMIT 25"),
    "agg39_session_closes": (lambda s, d: table(s, d, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("session")).agg(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")).alias("close")), "SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS session, arg_max(l_extendedprice, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS close FROM lineitem GROUP BY 1, 2"),
    "src12_serp_web_rows": (lambda s, d: P.serp_web(table(s, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 20).alias("p")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("https://www.H"), F.col("s_suppkey").cast("string"), F.lit(".com/x"))).alias("link"))).alias("organic_results"))).alias("raw")), "raw").select("title", "link", "host"), "SELECT s_name AS title, 'https://www.H' || s_suppkey || '.com/x' AS link, 'h' || s_suppkey || '.com' AS host FROM supplier WHERE s_suppkey % 4 <> 0"),
    "topk18_sitemap": (lambda s, d: table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), "s_name").orderBy("ticker").limit(50_000), "SELECT 'S' || s_suppkey AS ticker, s_name FROM supplier ORDER BY ticker LIMIT 50000"),
}
