"""Queries of parsers, folds and rules: responses are written from the tables as their vendors would, then parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.math import round_half_up
from tidemark.operators import evidence as E
from tidemark.operators import folds as O
from tidemark.operators import rules as R
from tidemark.plans.text import s_sentences
from tidemark.plans.views import BARS, DOCS, SEGMENTS, bars, docs, segments, table
from tidemark.sources import parsers as S

#: Ids of documents that share a feed or page, so that feeds grow in number and not in size.
ITEMS = 500


def bar_arrays(s, d):
    g = bars(s, d).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("day", "open", "high", "low", "close", "volume"))).alias("b"))
    null_close = lambda b: F.when(F.dayofmonth(b["day"]) != 13, b["close"])
    cols = {"open": F.transform("b", lambda b: F.when(F.dayofmonth(b["day"]) != 7, b["open"])), "high": F.transform("b", lambda b: b["high"]), "low": F.transform("b", lambda b: b["low"]), "close": F.transform("b", null_close), "volume": F.transform("b", lambda b: F.when(F.dayofmonth(b["day"]) != 9, b["volume"]))}
    stamp = F.transform("b", lambda b: F.unix_timestamp(b["day"].cast("timestamp")))
    return g.select(F.to_json(F.struct("symbol", stamp.alias("timestamp"), *[c.alias(n) for n, c in cols.items()]), {"ignoreNullFields": "false"}).alias("raw"))


def r6(df):
    return df.select(*[round_half_up(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tuples(s, d):
    b = bars(s, d)
    row = F.array(*[F.col(c).cast("string") for c in ("day", "open", "high", "low", "close", "volume")], F.when(F.dayofmonth("day") != 3, F.col("vwap").cast("string")))
    return b.groupBy("symbol").agg(F.to_json(F.collect_list(row)).alias("raw"))


def news_body(s, d):
    hit = F.struct(F.concat("source", F.lit(" story "), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("https://www.host"), (F.col("doc_id") % 7).cast("string"), F.lit(".com/a?d="), F.col("doc_id").cast("string"))).alias("link"), F.col("source"), F.lit("2 days ago").alias("date"))
    return table(s, d, "documents").groupBy(F.floor(F.col("doc_id") / ITEMS).alias("page")).agg(F.to_json(F.struct(F.collect_list(hit).alias("news_results"))).alias("raw"))


def rss(s, d):
    item = F.concat(F.lit("<item><title><![CDATA["), F.col("source"), F.lit(" & "), F.col("doc_id").cast("string"), F.lit("]]></title><link>https://h.com/"), F.col("doc_id").cast("string"), F.lit("</link><pubDate>Mon</pubDate><source url='x'>"), F.col("lang"), F.lit("</source>"), F.when(F.col("doc_id") % 2 == 0, F.lit('<enclosure url="https://h.com/a.mp3" length="1" type="audio/mpeg"/>')).otherwise(F.lit('<enclosure url="https://h.com/a.png" type="image/png"/>')), F.lit("</item>"))
    return table(s, d, "documents").groupBy(F.floor(F.col("doc_id") / ITEMS).alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("raw"))


def facts_raw(s, d):
    o = table(s, d, "orders")
    point = F.struct(F.lit("USD").alias("unit"), F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 2 * 300 + 80).cast("int")).alias("start"), F.to_date("o_orderdate").alias("end"), F.floor("o_totalprice").cast("double").alias("val"), F.when(F.col("o_orderkey") % 2 == 1, "FY").otherwise("Q1").alias("fp"), F.when(F.col("o_orderkey") % 2 == 1, "10-K").otherwise("10-Q").alias("form"))
    per = o.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", point.alias("p")))), lambda x: x["p"]).alias("points"))
    return per.select("symbol", F.to_json(F.create_map(F.lit("Revenues"), F.col("points"))).alias("raw"))


FACTS = """facts AS (SELECT 'C' || o_custkey AS symbol, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 2 * 300 + 80 AS INTEGER) AS start, CAST(o_orderdate AS DATE) AS "end", floor(o_totalprice) AS val, CASE WHEN o_orderkey % 2 = 1 THEN 'FY' ELSE 'Q1' END AS fp, CASE WHEN o_orderkey % 2 = 1 THEN '10-K' ELSE '10-Q' END AS form FROM orders)"""


def scored(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    part = lambda m, a: (k * m % 101).cast("double").alias(a)
    rows = c.select("c_custkey", part(3, "catalyst"), part(5, "execution"), part(7, "management"), part(11, "financial"), part(13, "valuation"), part(17, "attention"), F.when(k % 4 != 0, (k * 19 % 101).cast("double")).alias("technical"), part(23, "dilution"), part(29, "liquidity"), ((k % 5) / 4).alias("severity"), (k % 6).cast("double").alias("sources"), (k % 7).cast("int").alias("missing"), F.when(k % 3 == 0, (k % 11) / 10).alias("disagreement"), ((k * 31) % 101).cast("double").alias("confidence"), F.when(k % 8 != 0, (k % 20).cast("double")).alias("price"))
    return R.risk_class(R.composite(rows)).select("c_custkey", "overall", "sure", "risk")


COMPOSITE = """WITH k AS (SELECT c_custkey AS k FROM customer), p AS (SELECT k, (k * 3 % 101) * 0.2::DOUBLE AS a, (k * 5 % 101) * 0.15::DOUBLE AS b, (k * 7 % 101) * 0.1::DOUBLE AS c, (k * 11 % 101) * 0.1::DOUBLE AS d, (k * 13 % 101) * 0.1::DOUBLE AS e, (k * 17 % 101) * 0.05::DOUBLE AS f,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, (k % 6)::DOUBLE / 3 * 100)) * 0.15::DOUBLE AS g, CASE WHEN k % 4 <> 0 THEN k * 19 % 101 ELSE k * 17 % 101 END * 0.05::DOUBLE AS h,
  (k * 23 % 101) * 0.2::DOUBLE + (k * 29 % 101) * 0.2::DOUBLE + (k % 5)::DOUBLE / 4 * 0.25::DOUBLE * 100 AS pen, least(15.0, (k % 7) * 3)::DOUBLE AS mis, coalesce(CASE WHEN k % 3 = 0 THEN (k % 11)::DOUBLE / 10 END, 0) * 20 AS dis FROM k),
z AS (SELECT k, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, g + a + b + c + d + e + f + h - pen - mis - dis)) * 100 + 0.5) / 100 AS overall,
  floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (k * 31 % 101) + least(15.0, (k % 6) * 5)::DOUBLE - mis - dis - (k % 5)::DOUBLE / 4 * 15)) * 100 + 0.5) / 100 AS sure FROM p)
SELECT k AS c_custkey, overall, sure, CASE WHEN (k % 8 <> 0 AND k % 20 < 5) OR sure < 60 THEN 'high-risk speculative' WHEN sure < 75 THEN 'speculative' ELSE 'conservative' END AS risk FROM z"""


QUERIES = {
    "src19_parallel_bars": (lambda s, d: r6(S.parallel_bars(bar_arrays(s, d), "raw").select("symbol", F.to_date("ts").alias("day"), "open", "high", "low", "close", "volume")), f"WITH {BARS} SELECT symbol, day, round(CASE WHEN day(day) <> 7 THEN open ELSE close END, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CASE WHEN day(day) <> 9 THEN volume ELSE 0 END::DOUBLE AS volume FROM bars WHERE day(day) <> 13"),
    "src22_positional_bars": (lambda s, d: r6(S.positional_bars(tuples(s, d), "symbol", "raw").withColumn("vwap", F.col("vwap").isNotNull())), f"WITH {BARS} SELECT symbol, day, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, day(day) <> 3 AS vwap FROM bars"),
    "src16_multi_bars": (lambda s, d: r6(S.multi_bars(bars(s, d).groupBy("symbol").agg(F.collect_list(F.struct(F.col("day").cast("timestamp").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"))).alias("b")).select(F.to_json(F.create_map("symbol", "b")).alias("raw")), "raw").select("symbol", F.to_date("ts").alias("day"), "close", "volume")), f"WITH {BARS} SELECT symbol, day, round(close, 6) AS close, volume FROM bars"),
    "src17_snapshots": (lambda s, d: S.snapshots(table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol")), table(s, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.to_json(F.create_map(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.struct(F.col("s_acctbal").alias("price"), F.lit(1.5).alias("prev")))).alias("raw")), "raw"), "SELECT 'S' || s_suppkey AS symbol, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS price, CASE WHEN s_suppkey % 3 <> 0 THEN 1.5 END::DOUBLE AS prev FROM supplier"),
    "src13_serp_news": (lambda s, d: S.serp_news(news_body(s, d), "raw").select("title", "link", "source", "host"), "SELECT source || ' story ' || doc_id AS title, 'https://www.host' || (doc_id % 7) || '.com/a?d=' || doc_id AS link, source, 'host' || (doc_id % 7) || '.com' AS host FROM documents WHERE doc_id % 9 <> 0"),
    "src10_feed_items": (lambda s, d: S.feed_items(rss(s, d), "raw"), "SELECT source || ' & ' || doc_id AS title, 'https://h.com/' || doc_id AS link, 'Mon' AS published, lang AS source FROM documents"),
    "src11_episodes": (lambda s, d: S.episodes(rss(s, d), "raw"), "SELECT source || ' & ' || doc_id AS title, 'https://h.com/a.mp3' AS url, 'audio/mpeg' AS type FROM documents WHERE doc_id % 2 = 0"),
    "src30_agg18_latest_value": (lambda s, d: R.latest_value(S.facts_long(facts_raw(s, d), "raw"), "1999-12-31"), f"WITH {FACTS} SELECT symbol, 'Revenues' AS concept, arg_max(val, row(\"end\", pos)) AS val FROM facts WHERE \"end\" <= DATE '1999-12-31' GROUP BY symbol"),
    "agg19_yearly_growth": (lambda s, d: r6(R.yearly_growth(S.facts_long(facts_raw(s, d), "raw"), "2001-12-31")), f"WITH {FACTS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY \"end\" DESC, pos DESC) AS r FROM facts WHERE form = '10-K' AND fp = 'FY' AND \"end\" - start >= 300 AND \"end\" <= DATE '2001-12-31') SELECT x.symbol, 'Revenues' AS concept, round(CASE WHEN y.val <> 0 THEN floor((x.val - y.val) / abs(y.val) * 1000 + 0.5) / 10 END, 6) AS growth FROM a x JOIN a y ON x.symbol = y.symbol AND x.r = 1 AND y.r = 2"),
    "src33_ticker_tokens": (lambda s, d: S.ticker_tokens(table(s, d, "customer").select(F.concat(F.lit(" $"), F.lower(F.substring("c_mktsegment", 1, 4)), F.lit(";"), F.col("c_custkey").cast("string"), F.lit(" BRK.B")).alias("raw")), "raw"), "WITH t AS (SELECT upper(substr(c_mktsegment, 1, 4)) AS t FROM customer UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION SELECT 'BRK.B' FROM customer) SELECT t AS ticker, regexp_full_match(t, '[A-Z]{1,5}(\\.[A-Z]{1,2})?') AS valid FROM t"),
    "src05_seed_list": (lambda s, d: S.seed_list(table(s, d, "nation").agg(F.array_join(F.collect_list(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("=https://x/?a="), F.col("n_name"))), ",").alias("raw")), "raw"), "SELECT 'N' || n_nationkey AS ticker, 'https://x/?a=' || n_name AS url FROM nation"),
    "src37_first_source": (lambda s, d: S.first_source([bars(s, d).filter("symbol < 'S5'").select("symbol", "day", "volume"), bars(s, d).select("symbol", "day", F.lit(0.0).alias("volume"))], "symbol"), f"WITH {BARS} SELECT symbol, day, CASE WHEN symbol < 'S5' THEN volume ELSE 0 END::DOUBLE AS volume FROM bars"),
    "math03_05_composite": (scored, COMPOSITE),
    "win27_pack_sentences": (lambda s, d: table(s, d, "documents").select("doc_id", F.size(O.pack_sentences(T.sentences(F.col("text")))).alias("paragraphs"), F.sha2(F.array_join(O.pack_sentences(T.sentences(F.col("text"))), "|"), 256).alias("digest")), f"""WITH l AS (SELECT doc_id, {s_sentences('text')} AS l FROM documents), p AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] ELSE list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN length(acc[-1]) < 600 THEN list_concat(acc[1:len(acc) - 1], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END) END AS p FROM l)
SELECT doc_id, CAST(len(p) AS INTEGER) AS paragraphs, sha256(array_to_string(p, '|')) AS digest FROM p"""),
    "win24_str37_rolled_turns": (lambda s, d: segments(s, d).groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seg_index", "text"))), lambda x: x["text"]).alias("cues")).select("document_id", F.array_join(O.strip_roll(F.col("cues")), "|").alias("kept")), None),
    "topk05_greedy_phrases": (lambda s, d: O.greedy_phrases(E.phrase_frequency(docs(s, d))), None),
}
