"""Queries of what reports and lists show."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.math import round_half_up
from tidemark.operators import ledger as L
from tidemark.operators import reports as R
from tidemark.operators import rules as U
from tidemark.operators import technical as C
from tidemark.plans.feeds import facts_raw
from tidemark.plans import feeds, technical
from tidemark.plans.technical import CRITERIA
from tidemark.plans.views import BARS, bars, table
from tidemark.sources import markets as M
from tidemark.sources import parsers as S


def documents(s, d):
    k = F.col("doc_id")
    meta = F.when(k % 5 == 0, F.lit("{bad")).when(k % 3 == 0, F.to_json(F.struct(F.lit(" ").alias("companyName")))).otherwise(F.to_json(F.struct(F.concat(F.lit("Co "), k.cast("string")).alias("companyName"))))
    return table(s, d, "documents").select(k.alias("id"), F.col("source").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).alias("published"), meta.alias("meta"), F.timestamp_seconds(F.lit(1_704_067_200) + k * 300).alias("fetched"))


NAMES = "WITH m AS (SELECT source AS ticker, doc_id AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id % 50 DESC, doc_id DESC) AS r FROM documents) SELECT ticker, 'Co ' || arg_min(k, r) AS name FROM m WHERE r <= 20 AND k % 5 <> 0 AND k % 3 <> 0 GROUP BY ticker"


def watched(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(F.concat(F.lit("T"), k.cast("string")).alias("ticker"), F.col("c_name").alias("company"), F.when(k % 3 == 0, F.lit("Check MARGIN")).alias("note"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("class"))


def summary(s, d):
    t = table(s, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise("s"), F.col("s_suppkey").cast("string")).alias("ticker"))
    return R.session_summary(bars(s, d), t.union(t), "1998-06-01", "1998-06-30").select("ticker", round_half_up(F.col("close"), 4).alias("close"), round_half_up(F.col("change"), 4).alias("change"), "available")


SUMMARY = f"""WITH {BARS}, t AS (SELECT DISTINCT CASE WHEN s_suppkey % 4 = 0 THEN 'X' ELSE 'S' END || s_suppkey AS ticker FROM supplier), o AS (SELECT symbol AS ticker, arg_max(close, day) AS close, max(day) AS m, arg_max(close, day) FILTER (day < DATE '1998-06-01') AS base FROM bars WHERE day <= DATE '1998-06-30' GROUP BY 1),
j AS (SELECT t.ticker, close, base, coalesce(m >= DATE '1998-06-01', FALSE) AS ok FROM t LEFT JOIN o USING (ticker)) SELECT ticker, round(CASE WHEN ok THEN close END, 4) AS close, round(CASE WHEN ok AND base <> 0 THEN (close - base) / base * 100 END, 4) AS change, ok AS available FROM j"""


def drawn(s, d):
    v = F.transform(F.sequence(F.lit(0), F.col("p_partkey").cast("int") % 6), lambda i: ((F.col("p_partkey") * (i + 1)) % 5).cast("double"))
    return table(s, d, "part").select("p_partkey", R.drawn(v).alias("line"))


DRAWN = """WITH v AS (SELECT p_partkey, list_transform(range(0, p_partkey % 6 + 1), lambda i: (p_partkey * (i + 1) % 5)::DOUBLE) AS v FROM part), m AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM v)
SELECT p_partkey, CASE WHEN len(v) >= 2 THEN array_to_string(list_transform(range(1, len(v) + 1), lambda i: (floor((i - 1) * 100.0::DOUBLE / (len(v) - 1) * 10 + 0.5) / 10) || ',' || CASE WHEN hi = lo THEN 15.0::DOUBLE ELSE floor((30 - (v[i] - lo) / (hi - lo) * 30) * 10 + 0.5) / 10 END), ' ') END AS line FROM m"""


def pair_rows(s, d):
    k = F.col("s_suppkey")
    base = F.concat(F.lit("C"), k.cast("string"))
    p = table(s, d, "supplier").select(F.concat(base, F.lit("/USD")).alias("symbol"), base.alias("base"), "s_suppkey", "s_acctbal")
    return R.pair_reports(p.select("symbol", "base"), p.filter("s_suppkey % 2 = 0").select("symbol", F.col("s_acctbal").alias("last")), p.filter("s_suppkey % 3 <> 0").select("symbol", (k % 4).alias("bars"), (k % 100).alias("score")), p.filter("s_suppkey % 5 <> 0").select("base", F.col("s_acctbal").alias("market_cap")))


SCREENED = technical.QUERIES["fil01_screen"][1]
QUERIES = {
    "fil02_last_prices": (lambda s, d: table(s, d, "part").select("p_partkey", R.last_price(F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")), F.col("p_size").cast("double")).alias("last")), "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice ELSE p_size END::DOUBLE AS last FROM part"),
    "fil25_visible_rows": (lambda s, d: R.visible(watched(s, d), "unclassified", " margin").select("ticker", F.lit(1).alias("q")).unionByName(R.visible(watched(s, d), None, "T1").select("ticker", F.lit(2).alias("q"))), "SELECT 'T' || c_custkey AS ticker, CAST(1 AS INTEGER) AS q FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 = 0 UNION ALL SELECT 'T' || c_custkey, 2 FROM customer WHERE contains(lower('T' || c_custkey || ' ' || c_name), 't1')"),
    "fil33_36_keys": (lambda s, d: table(s, d, "part").select("p_partkey", R.valid_period(F.get(F.array(*map(F.lit, (" 1W", "2w", "", "ALL"))), (F.col("p_partkey") % 4).cast("int"))).alias("period"), R.report_symbol(F.get(F.array(*map(F.lit, ("btc/usd", " brk.b", "way too long name", "A1"))), (F.col("p_partkey") % 4).cast("int"))).alias("symbol")), "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS period, ['BTC/USD', 'BRK.B', NULL, 'A1'][CAST(p_partkey % 4 AS INTEGER) + 1] AS symbol FROM part"),
    "json02_03_company_names": (lambda s, d: R.company_names(documents(s, d)), NAMES),
    "json01_stored_payloads": (lambda s, d: R.stored_payload(table(s, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("score")), ["s_name", "score"]).select("s_suppkey", "payload", F.get_json_object(F.when(F.col("s_suppkey") % 5 == 0, F.lit("{")).otherwise(F.col("payload")), "$.score").cast("long").alias("back")), "SELECT s_suppkey, '{\"s_name\":\"' || s_name || '\",\"score\":' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'null' END || '}' AS payload, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN s_suppkey END AS back FROM supplier"),
    "json13_report_events": (lambda s, d: table(s, d, "supplier").select(R.report_event(F.col("s_name"), F.when(F.col("s_suppkey") % 6 == 0, F.lit("{x")).otherwise(F.to_json(F.struct(F.lit("Co").alias("companyName"), F.col("s_suppkey").alias("overallScore"), F.lit("n/a").alias("confidence"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("signals"))))).alias("e")).select("e.*"), "SELECT s_name AS ticker, CASE WHEN s_suppkey % 6 <> 0 THEN 'Co' END AS company_name, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey END::DOUBLE AS overall_score, NULL::DOUBLE AS confidence, CAST(CASE WHEN s_suppkey % 6 <> 0 AND s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS signal_count, CAST(0 AS INTEGER) AS source_count FROM supplier"),
    "agg38_session_summary": (summary, SUMMARY),
    "math16_drawn_series": (drawn, DRAWN),
    "join29_win38_pair_reports": (pair_rows, "SELECT 'C' || s_suppkey || '/USD' AS symbol, 'C' || s_suppkey AS base, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS last, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 4 >= 2 THEN s_suppkey % 100 END AS score, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS market_cap FROM supplier"),
    "strm04_freshness_gate": (lambda s, d: R.refreshed(documents(s, d), "2024-01-02 00:00:00").select("ticker", F.col("newest").cast("timestamp_ntz").alias("newest"), "stale"), "WITH n AS (SELECT source AS ticker, max(1704067200 + doc_id * 300) AS t FROM documents GROUP BY 1) SELECT ticker, make_timestamp(t * 1000000) AS newest, 1704153600 - t > 21600 AS stale FROM n"),
    "math13_asr_costs": (lambda s, d: table(s, d, "part").select("p_partkey", round_half_up(F.col("p_size") * 60_000 / 3_600_000 * F.coalesce(*[F.when(F.col("p_partkey") % 3 == i, r) for i, r in enumerate(R.ASR_RATES.values())]), 6).alias("cost")), "SELECT p_partkey, round(p_size * 60000 / 3600000::DOUBLE * [0.04, 0.36, 0.4][CAST(p_partkey % 3 AS INTEGER) + 1]::DOUBLE, 6) AS cost FROM part"),
    "topk20_packages": (lambda s, d: table(s, d, "part").select("p_partkey", F.element_at(F.create_map(*[F.lit(x) for kv in R.PACKAGES.items() for x in kv]), F.get(F.array(*map(F.lit, ("small", "large", "none"))), (F.col("p_partkey") % 3).cast("int"))).alias("credits")), "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 2000 END AS INTEGER) AS credits FROM part"),
    "agg20_mirror_growth": (lambda s, d: U.yearly_growth(S.facts_long(facts_raw(s, d), "raw").withColumn("form", F.when(F.col("form") == "10-K", "10-K/A").otherwise(F.col("form"))), "2001-12-31", forms="^10-K"), feeds.QUERIES["agg19_yearly_growth"][1]),
    "dml22_added_items": (lambda s, d: L.add_within(table(s, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 30).alias("t"), F.col("o_orderkey").alias("at")).groupBy("u", "t").agg(F.min("at").alias("at")), table(s, d, "customer").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") % 30).alias("t"), F.col("c_custkey").alias("at")), "u", "t", 4, F.col("at")).select("u", "t"), "WITH h AS (SELECT o_custkey AS u, o_orderkey % 30 AS t FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2), n AS (SELECT u, count(*) AS n FROM h GROUP BY u) SELECT c_custkey AS u, c_custkey % 30 AS t FROM customer LEFT JOIN n ON u = c_custkey WHERE coalesce(n, 0) < 4 AND NOT EXISTS (SELECT 1 FROM h WHERE h.u = c_custkey AND h.t = c_custkey % 30)"),
    "src56_tiered_news": (lambda s, d: M.with_tier(table(s, d, "pages").select("page_id", F.get(F.array(*map(F.lit, ("a.example.com", "shop.net", "z.org"))), (F.col("page_id") % 3).cast("int")).alias("host")), s.createDataFrame([("example.com", 1, 0), ("shop.net", 3, 1)], "domain string, tier int, at int")).select("page_id", "tier", M.tier_label(F.col("tier")).alias("label")), "SELECT page_id, CAST(CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS INTEGER) AS tier, CASE page_id % 3 WHEN 0 THEN 'reputable press' WHEN 1 THEN 'excluded' ELSE 'analysis/opinion' END AS label FROM pages"),
    "proj01_fil04_screen": (lambda s, d: C.screen(C.indicators(bars(s, d)), R.criteria({}, CRITERIA)).select("symbol", F.array_join("reasons", "; ").alias("reasons"), "passed"), SCREENED),
}
