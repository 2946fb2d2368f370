"""Queries over accounts, ledgers, calendars and the joins of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions.math import percent_change, round_half_up
from tidemark.operators import evidence as E
from tidemark.operators import ledger as L
from tidemark.plans.views import LEDGER, TABLES, ledger, table

SINCE, START, END = "2000-01-01", "2024-01-01", "2027-12-31"


def years(s, d):
    """(event_id, year): a year of 1990 to 2060 for each event."""
    return table(s, d, "events").select("event_id", (1990 + F.col("event_id") % 71).cast("int").alias("year"))


def event_days(s, d):
    """(event_id, day): a day of some four years for each event."""
    return table(s, d, "events").select("event_id", F.date_add(F.to_date("ts"), (F.col("event_id") % 1400).cast("int")).alias("day"))


def on_trading_days(s, d):
    """Events on trading days, with the calendar's columns."""
    return event_days(s, d).join(F.broadcast(D.trading_days(s, START, END)), "day")  # a calendar of four years


def opens(s, d):
    """(event_id, day, trading, opens): the instant of 4:00 in New York on the day of every event, and on every trading day that has none."""
    calendar, events = D.trading_days(s, START, END).select("day", F.lit(True).alias("trading")), event_days(s, d)  # a calendar of four years
    idle = calendar.join(events.select("day").distinct(), "day", "left_anti").select(F.lit(None).cast("long").alias("event_id"), "day", "trading")
    rows = events.join(F.broadcast(calendar), "day", "left").select("event_id", "day", F.coalesce("trading", F.lit(False)).alias("trading")).unionByName(idle)
    return rows.withColumn("opens", D.eastern_to_utc(F.col("day"), 4).cast("timestamp_ntz"))


def holidays_of_events(s, d):
    """(day, name, events): holidays of the years that events name, and how many do."""
    held = years(s, d).groupBy("year").agg(F.count("*").alias("events"))
    return D.holidays(held.select("year")).withColumn("year", F.year("day")).join(held, "year").drop("year")


YEARS = "years AS (SELECT event_id, CAST(1990 + event_id % 71 AS INTEGER) AS year FROM events)"
EVENT_DAYS = "event_days AS (SELECT event_id, CAST(ts AS DATE) + CAST(event_id % 1400 AS INTEGER) AS day FROM events)"


EASTER = """easter_ AS (SELECT y AS year, make_date(y, (h + m - 7 * n + 114) // 31, (h + m - 7 * n + 114) % 31 + 1) AS easter FROM (SELECT *, (a + 11 * h + 22 * m) // 451 AS n FROM (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m
  FROM (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT unnest(range(1990, 2061)) AS y))))))"""


def s_nth(month: int, weekday: int, n: int) -> str:
    return f"make_date(year, {month}, 1) + CAST((({weekday} - dayofweek(make_date(year, {month}, 1)) + 7) % 7 + {7 * (n - 1)}) AS INTEGER)"


def s_observed(month: int, day: int, friday: bool = True) -> str:
    d = f"make_date(year, {month}, {day})"
    return f"CASE dayofweek({d}) WHEN 6 THEN {f'{d} - 1' if friday else 'NULL'} WHEN 0 THEN {d} + 1 ELSE {d} END"


HOLIDAYS = f"""{EASTER}, holidays AS (SELECT * FROM (
  SELECT {s_observed(1, 1, False)} AS day, 'new_year' AS name FROM easter_ UNION ALL SELECT {s_nth(1, 1, 3)}, 'king' FROM easter_ UNION ALL SELECT {s_nth(2, 1, 3)}, 'presidents' FROM easter_
  UNION ALL SELECT easter - 2, 'good_friday' FROM easter_ UNION ALL SELECT make_date(year, 5, 31) - CAST((dayofweek(make_date(year, 5, 31)) + 6) % 7 AS INTEGER), 'memorial' FROM easter_
  UNION ALL SELECT {s_observed(6, 19)}, 'juneteenth' FROM easter_ WHERE year >= 2022 UNION ALL SELECT {s_observed(7, 4)}, 'independence' FROM easter_ UNION ALL SELECT {s_nth(9, 1, 1)}, 'labor' FROM easter_
  UNION ALL SELECT {s_nth(11, 4, 4)}, 'thanksgiving' FROM easter_ UNION ALL SELECT {s_observed(12, 25)}, 'christmas' FROM easter_) WHERE day IS NOT NULL)"""
OPEN = f"""{HOLIDAYS}, days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS day), open_ AS (SELECT day FROM days WHERE dayofweek(day) NOT IN (0, 6) AND day NOT IN (SELECT day FROM holidays))"""


def orders(s, d):
    return table(s, d, "orders")


def old_and_new(s, d):
    """A stored table and what arrives: two overlapping halves of the customers."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return c.filter("key % 4 <> 0"), c.filter("key % 3 <> 1").withColumn("value", F.col("value") + 1).withColumn("segment", F.when(F.col("key") % 2 == 0, F.col("segment")))


OLD_NEW = """c AS (SELECT c_custkey AS key, c_name AS name, c_acctbal AS value, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer),
old AS (SELECT * FROM c WHERE key % 4 <> 0), new AS (SELECT key, name, value + 1 AS value, CASE WHEN key % 2 = 0 THEN segment END AS segment FROM c WHERE key % 3 <> 1)"""


def counts(s, d):
    out = None
    for t in TABLES:
        one = table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def watch(s, d):
    return orders(s, d).select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 37).cast("string")).alias("ticker"), F.col("o_orderkey").alias("at")).groupBy("user_id", "ticker").agg(F.min("at").alias("at"))


WATCH = "watch AS (SELECT o_custkey AS user_id, 'T' || (o_orderkey % 37) AS ticker, min(o_orderkey) AS at_ FROM orders GROUP BY 1, 2)"


def consensus(s, d):
    g = orders(s, d).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"), F.var_pop("o_totalprice").alias("variance"), F.stddev_pop("o_totalprice").alias("sd"))
    penalty = F.least(F.lit(1.0), F.col("sd") / 25)
    return g.select("o_custkey", round_half_up(F.col("mean"), 4).alias("mean"), round_half_up(F.col("sd"), 4).alias("sd"), round_half_up(F.greatest(F.lit(0.0), F.col("mean") - penalty * 20), 4).alias("score"))


QUERIES = {
    "agg01_table_counts": (counts, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES)),
    "agg06_distinct_users": (lambda s, d: orders(s, d).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).agg(F.countDistinct("c_custkey").alias("users")), "SELECT count(DISTINCT c_custkey) AS users FROM orders JOIN customer ON o_custkey = c_custkey"),
    "agg07_default_frequency": (lambda s, d: table(s, d, "customer").groupBy(F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.lit("daily")).alias("frequency")).agg(F.count("*").alias("n")), "SELECT coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'daily') AS frequency, count(*) AS n FROM customer GROUP BY 1"),
    "agg10_join04_user_lists": (lambda s, d: watch(s, d).join(table(s, d, "customer"), F.col("user_id") == F.col("c_custkey")).groupBy("user_id", "c_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "ticker")), False), lambda x: x["ticker"]), ",").alias("tickers")), f"WITH {WATCH} SELECT user_id, c_name, string_agg(ticker, ',' ORDER BY at_ DESC, ticker DESC) AS tickers FROM watch JOIN customer ON user_id = c_custkey GROUP BY ALL"),
    "agg11_balances": (lambda s, d: L.balances(ledger(s, d), SINCE), f"WITH {LEDGER} SELECT user_id, CAST(sum(delta) AS BIGINT) AS balance, CAST(-coalesce(sum(delta) FILTER (delta < 0 AND created >= TIMESTAMP '{SINCE}'), 0) AS BIGINT) AS spent FROM ledger GROUP BY user_id"),
    "agg11_running_balance": (lambda s, d: L.running_balance(ledger(s, d)).select("id", "user_id", "balance"), f"WITH {LEDGER} SELECT id, user_id, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY created, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM ledger"),
    "agg12_affordable_spends": (lambda s, d: L.affordable(ledger(s, d)).select("id", "user_id", "delta", "before"), f"WITH {LEDGER}, b AS (SELECT *, CAST(coalesce(sum(delta) OVER (PARTITION BY user_id ORDER BY created, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM ledger) SELECT id, user_id, delta, before FROM b WHERE delta < 0 AND before >= -delta"),
    "agg13_throttle": (lambda s, d: L.throttle(table(s, d, "events"), 86_400, 3).select("event_id", "user_id", "in_window", "allowed"), "WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_window FROM e) SELECT *, in_window <= 3 AS allowed FROM w"),
    "agg25_consensus": (consensus, "SELECT o_custkey, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, round(greatest(0, avg(o_totalprice) - least(1.0, stddev_pop(o_totalprice) / 25) * 20), 4) AS score FROM orders GROUP BY o_custkey"),
    "agg29_by_reason": (lambda s, d: table(s, d, "customer").select(F.explode(F.filter(F.array(F.when(F.col("c_acctbal") < 0, "negative"), F.when(F.col("c_acctbal") > 9000, "rich"), F.when(F.col("c_nationkey") < 5, "near")), lambda x: x.isNotNull())).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")), "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_acctbal > 9000 THEN 'rich' END, CASE WHEN c_nationkey < 5 THEN 'near' END], lambda x: x IS NOT NULL)) AS reason FROM customer) GROUP BY reason"),
    "join01_inner": (lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id").filter("source = 'src1'").select("doc_id", "quality"), "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE source = 'src1'"),
    "join03_fanout": (lambda s, d: orders(s, d).select("o_custkey", "o_orderkey").join(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n")), "SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey"),
    "join05_anti": (lambda s, d: table(s, d, "customer").join(orders(s, d).filter(F.col("o_orderdate") >= SINCE).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name"), f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{SINCE}')"),
    "join06_left": (lambda s, d: table(s, d, "customer").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name"), "c_custkey", "left").select("c_custkey", "s_name"), "SELECT c_custkey, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"),
    "join08_broadcast_names": (lambda s, d: table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"), "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join09_topk07_latest_per_key": (lambda s, d: E.latest_per(orders(s, d), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice"), "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "join13_semi": (lambda s, d: table(s, d, "customer").join(orders(s, d).filter("o_totalprice > 40000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 40000)"),
    "join14_report_flag": (lambda s, d: table(s, d, "customer").join(orders(s, d).filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("f")).distinct(), "c_custkey", "left").select("c_custkey", F.col("f").isNotNull().alias("has_report")), "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS has_report FROM customer"),
    "join21_watchers": (lambda s, d: watch(s, d).filter("ticker = 'T5'").select("user_id").distinct(), f"WITH {WATCH} SELECT DISTINCT user_id FROM watch WHERE ticker = 'T5'"),
    "join24_correlated_count": (lambda s, d: table(s, d, "customer").join(orders(s, d).filter(F.col("o_orderdate") >= SINCE).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n")), f"SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '{SINCE}') AS n FROM customer"),
    "topk06_nulls_last": (lambda s, d: orders(s, d).select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.floor("o_totalprice")).alias("score")).orderBy(F.desc_nulls_last("score"), "o_orderkey").offset(10).limit(50), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS score FROM orders ORDER BY score DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10"),
    "topk09_ranking": (lambda s, d: E.cap_per(table(s, d, "customer").withColumn("all_", F.col("c_mktsegment")), "all_", 20, F.desc("c_acctbal"), F.col("c_custkey")).select("c_mktsegment", "c_custkey", "c_acctbal"), "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 20"),
    "topk16_shortlist_then_filter": (lambda s, d: table(s, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).filter("p_size < 25").select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) WHERE p_size < 25"),
    "topk17_recent_ledger": (lambda s, d: ledger(s, d).orderBy(F.desc("created"), F.desc("id")).limit(50).select("id", "user_id", "delta"), f"WITH {LEDGER} SELECT id, user_id, delta FROM ledger ORDER BY created DESC, id DESC LIMIT 50"),
    "topk19_biggest_move": (lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct(F.abs("c_acctbal"), F.col("c_custkey"))).alias("mover")), "SELECT c_mktsegment, arg_max(c_custkey, row(abs(c_acctbal), c_custkey)) AS mover FROM customer GROUP BY c_mktsegment"),
    "set05_difference": (lambda s, d: old_and_new(s, d)[1].select("key").subtract(old_and_new(s, d)[0].select("key")), f"WITH {OLD_NEW} SELECT key FROM new EXCEPT SELECT key FROM old"),
    "dml01_insert_ignore": (lambda s, d: L.append_new(*old_and_new(s, d), ["key"], F.col("name")), f"WITH {OLD_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE key NOT IN (SELECT key FROM old)"),
    "dml02_upsert_fill": (lambda s, d: L.merge(*old_and_new(s, d), "key", fill=["segment"]), f"WITH {OLD_NEW} SELECT key, CASE WHEN n.key IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.key IS NOT NULL THEN n.value ELSE o.value END AS value, coalesce(n.segment, o.segment) AS segment FROM old o FULL OUTER JOIN new n USING (key)"),
    "dml03_upsert_keep_first": (lambda s, d: L.merge(*old_and_new(s, d), "key", keep_old=["value"]), f"WITH {OLD_NEW} SELECT key, CASE WHEN n.key IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN o.key IS NOT NULL THEN o.value ELSE n.value END AS value, CASE WHEN n.key IS NOT NULL THEN n.segment ELSE o.segment END AS segment FROM old o FULL OUTER JOIN new n USING (key)"),
    "dml06_delete": (lambda s, d: old_and_new(s, d)[0].join(old_and_new(s, d)[1].select("key"), "key", "left_anti"), f"WITH {OLD_NEW} SELECT * FROM old WHERE key NOT IN (SELECT key FROM new)"),
    "dml09_claim": (lambda s, d: L.claim(orders(s, d).select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period")), orders(s, d).filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period")), ["user_id", "period"]), "SELECT DISTINCT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS period FROM orders EXCEPT SELECT o_custkey, strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderstatus = 'F'"),
    "dml10_monthly_grant": (lambda s, d: ledger(s, d).filter("reason = 'spend'").select("user_id", F.date_format("created", "yyyy-MM").alias("period")).distinct().join(ledger(s, d).filter("reason = 'grant'").select("user_id", F.date_format("created", "yyyy-MM").alias("period")), ["user_id", "period"], "left_anti").withColumn("delta", F.lit(100)), f"WITH {LEDGER} SELECT *, 100 AS delta FROM (SELECT user_id, strftime(created, '%Y-%m') AS period FROM ledger WHERE reason = 'spend' EXCEPT SELECT user_id, strftime(created, '%Y-%m') FROM ledger WHERE reason = 'grant')"),
    "dml11_add_within_cap": (lambda s, d: L.add_within(watch(s, d).filter("at % 2 = 0"), watch(s, d).filter("at % 2 = 1"), "user_id", "ticker", 6, F.col("at")).select("user_id", "ticker"), f"WITH {WATCH}, t AS (SELECT * FROM watch WHERE at_ % 2 = 0), a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_) AS r FROM watch w WHERE at_ % 2 = 1 AND (user_id, ticker) NOT IN (SELECT (user_id, ticker) FROM t)) SELECT user_id, ticker FROM a LEFT JOIN (SELECT user_id, count(*) AS h FROM t GROUP BY 1) USING (user_id) WHERE r <= 6 - coalesce(h, 0)"),
    "date02_eastern_day": (lambda s, d: table(s, d, "events").select("event_id", D.eastern_date(F.col("ts")).alias("day")), "SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day FROM events"),
    "date03_wall_to_utc": (opens, f"WITH {OPEN}, {EVENT_DAYS}, d AS (SELECT event_id, CAST(coalesce(e.day, o.day) AS DATE) AS day, o.day IS NOT NULL AS trading FROM event_days e FULL OUTER JOIN open_ o ON o.day = e.day) SELECT event_id, day, trading, timezone('UTC', timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 4 HOUR)) AS opens FROM d"),
    "date04_holidays": (holidays_of_events, f"WITH {HOLIDAYS}, {YEARS} SELECT CAST(day AS DATE) AS day, name, count(*) AS events FROM holidays JOIN years ON year(day) = year GROUP BY ALL"),
    "date05_easter": (lambda s, d: years(s, d).select("event_id", "year", D.easter(F.col("year")).alias("easter")), f"WITH {EASTER}, {YEARS} SELECT event_id, years.year, easter FROM years JOIN easter_ ON easter_.year = years.year"),
    "date06_09_trading_days": (on_trading_days, f"WITH {OPEN}, {EVENT_DAYS}, c AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous, row_number() OVER (PARTITION BY date_trunc('week', day) ORDER BY day) = 1 AS first_of_week FROM open_) SELECT event_id, c.* FROM event_days JOIN c USING (day)"),
    "date10_11_weeks": (lambda s, d: table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", D.week_key(F.col("day")).alias("week"), F.to_date(F.date_trunc("week", "day")).alias("monday")), "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(CAST(o_orderdate AS DATE), '%G-W%V') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders"),
    "date14_15_periods": (lambda s, d: orders(s, d).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("period"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - (1995 * 12 + 1)).alias("months"), F.date_add(F.to_date("o_orderdate"), F.ceil(F.col("o_orderkey") % 60 * 1.45).cast("int")).alias("due")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 23941 AS INTEGER) AS months, CAST(o_orderdate AS DATE) + CAST(ceil(o_orderkey % 60 * 1.45) AS INTEGER) AS due FROM orders"),
    "date16_relative": (lambda s, d: table(s, d, "part").select("p_partkey", D.relative_date(F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, (" day ago", " days ago", " weeks ago", " months ago", " years ago", " moons ago"))), (F.col("p_partkey") % 6 + 1).cast("int"))), F.lit("2026-01-15").cast("date")).alias("day")), "SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN DATE '2026-01-15' - CAST(p_size * CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 30 ELSE 365 END AS INTEGER) END AS day FROM part"),
    "math01_round_half_up": (lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", round_half_up(F.col("l_discount") * F.col("l_tax") * 100 + 1.005).alias("x")), "SELECT l_orderkey, l_linenumber, l_partkey, floor((l_discount * l_tax * 100 + 1.005::DOUBLE) * 100 + 0.5) / 100 AS x FROM lineitem"),
    "math09_change": (lambda s, d: table(s, d, "customer").select("c_custkey", round_half_up(percent_change(F.col("c_acctbal"), F.col("c_nationkey").cast("double")), 6).alias("change")), "SELECT c_custkey, round(CASE WHEN c_nationkey <> 0 THEN (c_acctbal - c_nationkey) / c_nationkey * 100 END, 6) AS change FROM customer"),
    "strm07_dedupe_events": (lambda s, d: E.latest_per(table(s, d, "events"), "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id"), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"),
    "strm08_interval_join": (lambda s, d: E.within_hours(table(s, d, "events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("a"), "ts"), table(s, d, "events").filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), "ts"), "user_id", 1).select("user_id", "a", "b"), "SELECT x.user_id, x.event_id AS a, y.event_id AS b FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_type = 'view' AND y.event_type = 'purchase' AND y.ts BETWEEN x.ts AND x.ts + INTERVAL 1 HOUR"),
}
