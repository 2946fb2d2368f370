"""Queries of many small expressions at once, and of the remaining joins and groupings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import records as X
from tidemark.functions import text as T
from tidemark.functions.math import clamp, round_half_up
from tidemark.operators import evidence as E
from tidemark.operators import performance as P
from tidemark.operators.selection import median
from tidemark.plans.records import EVENT_DAYS, HOLIDAYS, OPEN, YEARS, on_trading_days, years
from tidemark.plans.text import s_fingerprint, s_markup, s_ngrams, s_sentences
from tidemark.plans.views import BARS, DOCS, LEDGER, SEGMENTS, SYMBOLS, bars, docs, ledger, segments, symbols, table
from tidemark.session import settle_table

PROMO, BLOCKED = (*X.PROMOTIONAL, "host3.com"), (*X.BLOCKED, "host5.com")
URL = "concat('https://', CASE WHEN id % 3 = 0 THEN 'www.' ELSE '' END, host, '/r?url=https%3A%2F%2Fx.com%2F', id)"
S_URL = "'https://' || CASE WHEN id % 3 = 0 THEN 'www.' ELSE '' END || host || '/r?url=https%3A%2F%2Fx.com%2F' || id"
MAIL = "concat(' ', c_name, CASE WHEN c_custkey % 3 = 0 THEN '+tag' ELSE '' END, '.x@', CASE c_custkey % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'a.mailinator.com' WHEN 2 THEN 'corp.example.org' ELSE 'broken' END)"
S_MAIL = "' ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '+tag' ELSE '' END || '.x@' || CASE c_custkey % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'a.mailinator.com' WHEN 2 THEN 'corp.example.org' ELSE 'broken' END"


def s_belongs(h: str, domains) -> str:
    return "(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in domains) + ")"


def addresses(s, d):
    u = docs(s, d).withColumn("url", F.expr(URL))
    h = T.host(F.col("url"))
    return u.select("id", h.alias("host"), X.belongs(h, PROMO).alias("promo"), X.belongs(h, BLOCKED).alias("blocked"), X.issuer_owned(h, F.concat(F.lit("Host "), (F.col("id") % 9).cast("string"), F.lit(" Inc"))).alias("own"), X.looks_like_url(F.col("url")).alias("is_url"), X.unwrap_redirect(F.col("url")).alias("target"), X.allowed_by_robots(F.concat(F.lit("/r"), F.col("tier").cast("string")), F.array(F.lit("/r3"), F.lit("/private"))).alias("allowed"), X.source_kind(F.concat("url", F.when(F.col("id") % 5 == 0, ".mp4").otherwise("")), F.when(F.col("tier") == 0, "news").otherwise("other")).alias("kind"))


ADDRESSES = f"""WITH {DOCS}, u AS (SELECT *, {S_URL} AS url, 'host ' || (id % 9) || ' inc' AS c FROM docs) SELECT id, host, {s_belongs('host', PROMO)} AS promo, {s_belongs('host', BLOCKED)} AS blocked,
contains(string_split(host, '.')[-2], replace(c, ' ', '')) OR contains(replace(c, ' ', ''), string_split(host, '.')[-2]) AS own, regexp_full_match(url, '(https?://)?[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+(/\\S*)?') AS is_url, 'https://x.com/' || id AS target, tier <> 3 AS allowed,
CASE WHEN tier = 0 THEN 'news' WHEN id % 5 = 0 THEN 'video' ELSE 'transcript' END AS kind FROM u"""


def accounts(s, d):
    c = table(s, d, "customer").withColumn("m", F.expr(MAIL))
    m = F.col("m")
    return c.select("c_custkey", X.email(m).alias("email"), X.valid_email(m).alias("valid"), X.mailbox(m).alias("mailbox"), X.belongs(F.split_part(X.email(m), F.lit("@"), F.lit(2)), X.DISPOSABLE).alias("throwaway"), F.sha2(m, 256).alias("token"), X.frequency(F.when(F.col("c_custkey") % 2 == 0, "weekly").otherwise("hourly")).alias("frequency"))


ACCOUNTS = f"""WITH m AS (SELECT c_custkey, {S_MAIL} AS m, lower(trim({S_MAIL})) AS e FROM customer), p AS (SELECT *, split_part(e, '@', 1) AS l, split_part(e, '@', 2) AS d FROM m)
SELECT c_custkey, e AS email, regexp_full_match(e, '[^\\s@]+@[^\\s@.]+(\\.[^\\s@.]+)+') AS valid, CASE WHEN d = 'gmail.com' THEN replace(split_part(l, '+', 1), '.', '') ELSE split_part(l, '+', 1) END || '@' || d AS mailbox, {s_belongs('d', X.DISPOSABLE)} AS throwaway, sha256(m) AS token, CASE WHEN c_custkey % 2 = 0 THEN 'weekly' ELSE 'daily' END AS frequency FROM p"""


def numbers(s, d):
    c, v = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    return table(s, d, "customer").select("c_custkey", round_half_up(clamp(c, 0, 5000), 4).alias("clamped"), round_half_up(X.positive(c), 4).alias("positive"), round_half_up(X.runway_months(c, v - 12), 4).alias("runway"), round_half_up(X.spread_bps(v, v + 1), 4).alias("bps"), round_half_up(F.coalesce(F.when(F.col("c_custkey") % 2 == 0, c), v * 3), 4).alias("cap"), round_half_up(v * 60_000 / 3_600_000 * 0.04, 6).alias("cost"))


NUMBERS = "SELECT c_custkey, round(greatest(0, least(5000, c_acctbal)), 4) AS clamped, round(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 4) AS positive, round(CASE WHEN c_nationkey < 12 THEN floor(c_acctbal / (abs(c_nationkey::DOUBLE - 12) / 12) * 10 + 0.5) / 10 END, 4) AS runway, round(CASE WHEN c_nationkey > 0 THEN (c_nationkey::DOUBLE + 1 - c_nationkey) / ((c_nationkey::DOUBLE + c_nationkey + 1) / 2) * 10000 END, 4) AS bps, round(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, c_nationkey::DOUBLE * 3), 4) AS cap, round(c_nationkey::DOUBLE * 60000 / 3600000 * 0.04::DOUBLE, 6) AS cost FROM customer"


def speech(s, d):
    seg = segments(s, d).withColumn("line", F.concat(F.element_at(F.array(*map(F.lit, ("JANE DOE: ", "Bob Ray -- ", "The man: ", "no name ", "<c>Q: "))), (F.col("seg_index") % 5 + 1).cast("int")), F.col("text")))
    return seg.select("document_id", "seg_index", X.speaker(F.col("line")).alias("speaker"), X.cue(F.col("line")).alias("cue"), F.col("text").rlike(r"\d").alias("numeric"))


SPEECH = f"""WITH {SEGMENTS}, l AS (SELECT *, ['JANE DOE: ', 'Bob Ray -- ', 'The man: ', 'no name ', '<c>Q: '][CAST(seg_index % 5 + 1 AS INTEGER)] || text AS line FROM segments)
SELECT document_id, seg_index, CASE seg_index % 5 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'Bob Ray' END AS speaker, trim(regexp_replace(regexp_replace({s_markup('line')}, '\\{{[^}}]*\\}}', '', 'g'), '\\s+', ' ', 'g')) AS cue, regexp_matches(text, '\\d') AS numeric FROM l"""


def clocks(s, d):
    e = table(s, d, "events")
    age = F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp("ts")
    local = F.from_utc_timestamp("ts", D.ZONE)
    return e.select("event_id", X.duration_ms(F.concat((F.col("event_id") % 3).cast("string"), F.lit(":0"), (F.col("event_id") % 7).cast("string"), F.lit(":11"))).alias("ms"), X.age_text(age).alias("age"), F.date_add(F.to_date("ts"), 3).alias("later"), (F.dayofweek("ts") - 1).alias("weekday"), ((F.unix_timestamp(local) - F.unix_timestamp("ts")) / 60).cast("int").alias("offset"), F.date_format("ts", "yyyy-MM").alias("period"), F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).alias("days"))


CLOCKS = """SELECT event_id, ((event_id % 3) * 3600 + (event_id % 7) * 60 + 11) * 1000 AS ms, CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' ELSE (a // 86400) || 'd ago' END AS age, CAST(ts AS DATE) + 3 AS later, CAST(dayofweek(ts) AS INTEGER) AS weekday, -300 AS "offset", strftime(ts, '%Y-%m') AS period, CAST(DATE '2024-02-01' - CAST(ts AS DATE) AS INTEGER) AS days
FROM (SELECT *, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS BIGINT) AS a FROM events)"""


def weekdays(s, d):
    y = F.col("year")
    return years(s, d).select("event_id", "year", D.nth_weekday(y, 11, 4, 4).alias("thanksgiving"), D.last_weekday(y, 5, 1).alias("memorial"), D.observed(F.make_date(y, F.lit(12), F.lit(25))).alias("christmas"))


def watch_stats(s, d):
    r = settle_table(P.range_change(bars(s, d), "2000-01-01"))
    middle = F.lit(median(r, "change")).cast("double")
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("change") > 0).alias("gainers"), F.count_if(F.col("change") < 0).alias("losers"), round_half_up(F.avg("change"), 5).alias("mean"), round_half_up(middle, 5).alias("median"), F.max_by("symbol", "change").alias("best"), F.min_by("symbol", "change").alias("worst"))


CHANGE = "c AS (SELECT symbol, CASE WHEN count(*) >= 2 AND arg_min(close, day) <> 0 THEN (arg_max(close, day) - arg_min(close, day)) / arg_min(close, day) * 100 END AS change FROM bars WHERE day >= DATE '2000-01-01' GROUP BY symbol)"


def membership(s, d):
    """Sentences of which 0.6 of the shingles repeat across issuers."""
    return E.repeated_sentences(docs(s, d))


MEMBERSHIP = f"""WITH {DOCS}, s AS (SELECT id, ticker, pos, {s_fingerprint('l[pos + 1]')} AS f FROM (SELECT id, ticker, l, unnest(range(0, len(l)))::INTEGER AS pos FROM (SELECT id, ticker, {s_sentences('text')} AS l FROM docs))),
w AS (SELECT id, ticker, pos, f, string_split(f, ' ') AS w FROM s WHERE f <> ''), h AS (SELECT id, ticker, pos, unnest(CASE WHEN len(w) < 8 THEN [f] ELSE {s_ngrams('w', 8)} END) AS shingle FROM w),
c AS (SELECT shingle FROM h GROUP BY shingle HAVING count(DISTINCT ticker) >= 3) SELECT id, pos FROM h LEFT JOIN c ON h.shingle = c.shingle GROUP BY id, pos HAVING avg(CASE WHEN c.shingle IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.6"""

def payload(s, d):
    j = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_type", "value", F.struct("user_id").alias("user")))).alias("raw"))
    p = F.from_json("raw", "struct<event_type:string,value:double,user:struct<user_id:long>>")
    return j.select("event_id", p["event_type"].alias("event_type"), round_half_up(p["value"], 4).alias("value"), F.get_json_object("raw", "$.user.user_id").cast("long").alias("user_id"))


def overview(s, d):
    """A saved list with reports and the last bar, missing ones kept."""
    saved = table(s, d, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("symbol"), F.col("c_custkey").alias("at"))
    last = bars(s, d).groupBy("symbol").agg(F.max_by("close", "day").alias("close"), F.max("day").alias("day"))
    reports = table(s, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_acctbal").alias("score"))
    return saved.join(last, "symbol", "left").join(reports, "symbol", "left").select("symbol", "at", "close", "day", "score", F.col("score").isNotNull().alias("has_report"))


OVERVIEW = f"""WITH {BARS}, l AS (SELECT symbol, arg_max(close, day) AS close, max(day) AS day FROM bars GROUP BY symbol), r AS (SELECT 'S' || s_suppkey AS symbol, s_acctbal AS score FROM supplier WHERE s_suppkey % 2 = 0)
SELECT c.symbol, c.at_ AS "at", close, day, score, score IS NOT NULL AS has_report FROM (SELECT 'S' || c_custkey AS symbol, c_custkey AS at_ FROM customer) c LEFT JOIN l USING (symbol) LEFT JOIN r USING (symbol)"""


def sessions(s, d):
    """Sessions of users that are neither expired nor revoked."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderdate").alias("expires"), (F.col("o_orderstatus") == "F").alias("revoked"))
    return o.filter((F.col("expires") > F.lit("1999-01-01").cast("timestamp")) & ~F.col("revoked")).join(table(s, d, "customer"), "c_custkey").select("o_orderkey", "c_custkey", "c_name")


def cursor(s, d):
    """An incremental page: rows after a cursor in (time, id) order."""
    e = table(s, d, "events").filter("ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 5)")
    return e.orderBy("ts", "event_id").limit(200).select("event_id", "user_id")


def assets(s, d):
    return symbols(s, d).filter("tradable AND name IS NOT NULL").select("symbol", X.exchange_name(F.col("exchange")).alias("exchange"), X.dot_class(F.concat(F.lit("BRK-"), F.substring("exchange", 1, 1))).alias("dotted"), X.ticker(F.concat(F.lit(" ab"), F.substring("symbol", 1, 1))).alias("ticker"), T.searchable(F.col("name")).alias("searchable"))


QUERIES = {
    "fil14_15_16_21_23_str29_proj02_addresses": (addresses, ADDRESSES),
    "fil30_31_str36_55_56_date28_accounts": (accounts, ACCOUNTS),
    "math02_08_11_13_14_fil26_numbers": (numbers, NUMBERS),
    "str09_11_12_43_fil29_speech": (speech, SPEECH),
    "date01_17_18_19_23_24_26_27_clocks": (clocks, CLOCKS),
    "date20_21_22_weekdays": (weekdays, f"WITH {HOLIDAYS}, {YEARS} SELECT event_id, v.year, CAST(t.day AS DATE) AS thanksgiving, CAST(m.day AS DATE) AS memorial, CAST(c.day AS DATE) AS christmas FROM years v JOIN easter_ e ON e.year = v.year JOIN holidays t ON t.name = 'thanksgiving' AND year(t.day) = e.year JOIN holidays m ON m.name = 'memorial' AND year(m.day) = e.year JOIN holidays c ON c.name = 'christmas' AND year(c.day) = e.year"),
    "date07_08_previous_day": (lambda s, d: on_trading_days(s, d).filter("day BETWEEN DATE '2025-01-01' AND DATE '2025-12-31'").select("event_id", "day", "previous"), f"WITH {OPEN}, {EVENT_DAYS}, c AS (SELECT CAST(day AS DATE) AS day, lag(day) OVER (ORDER BY day) AS previous FROM open_) SELECT event_id, c.* FROM event_days JOIN c USING (day) WHERE c.day BETWEEN DATE '2025-01-01' AND DATE '2025-12-31'"),
    "agg23_watch_statistics": (watch_stats, f"WITH {BARS}, {CHANGE} SELECT count(*) AS n, count(*) FILTER (change > 0) AS gainers, count(*) FILTER (change < 0) AS losers, round(avg(change), 5) AS mean, round(median(change), 5) AS median, arg_max(symbol, change) AS best, arg_min(symbol, change) AS worst FROM c"),
    "join23_repeated_sentences": (membership, MEMBERSHIP),
    "json01_02_13_14_payload": (payload, "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type, round(CASE WHEN event_id % 10 <> 0 THEN value END, 4) AS value, CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id FROM events"),
    "join10_25_26_27_30_overview": (overview, OVERVIEW),
    "join07_sessions": (sessions, "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate > TIMESTAMP '1999-01-01' AND o_orderstatus <> 'F'"),
    "src25_strm03_cursor_page": (cursor, "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 5) ORDER BY ts, event_id LIMIT 200"),
    "src20_24_str19_20_21_proj06_assets": (assets, f"WITH {SYMBOLS} SELECT symbol, exchange, 'BRK.' || substr(exchange, 1, 1) AS dotted, 'ABP' AS ticker, regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), '^the ', '') AS searchable FROM symbols WHERE tradable AND name IS NOT NULL"),
    "src28_40_41_latest_per_symbol": (lambda s, d: bars(s, d).groupBy("symbol").agg(F.max_by(F.struct("close", "volume"), "day").alias("x")).select("symbol", "x.*"), f"WITH {BARS} SELECT symbol, arg_max(close, day) AS close, arg_max(volume, day) AS volume FROM bars GROUP BY symbol"),
    "src08_54_55_document_rows": (lambda s, d: docs(s, d).select(F.concat(F.lit("news:"), F.substring(F.sha2(F.concat(F.lit("u"), F.col("id").cast("string")), 256), 1, 24)).alias("key"), F.when(F.col("tier") == 0, "press_release").otherwise("news").alias("event"), F.coalesce(F.when(F.col("id") % 3 == 0, F.col("published")), F.lit("2024-06-01").cast("date")).alias("event_date"), F.coalesce("lang", F.lit("en")).alias("language")), f"WITH {DOCS} SELECT 'news:' || substr(sha256('u' || id), 1, 24) AS key, CASE WHEN tier = 0 THEN 'press_release' ELSE 'news' END AS event, coalesce(CASE WHEN id % 3 = 0 THEN published END, DATE '2024-06-01') AS event_date, coalesce(lang, 'en') AS language FROM docs"),
    "agg17_hosts": (lambda s, d: docs(s, d).groupBy("host").agg(F.count("*").alias("n"), F.min_by("tier", "id").alias("first_tier")), f"WITH {DOCS} SELECT host, count(*) AS n, arg_min(tier, id) AS first_tier FROM docs GROUP BY host"),
    "agg35_36_37_directory": (lambda s, d: symbols(s, d).agg(F.count("*").alias("n"), F.max("symbol").alias("newest"), F.count_if("tradable").alias("tradable")), f"WITH {SYMBOLS} SELECT count(*) AS n, max(symbol) AS newest, count(*) FILTER (tradable) AS tradable FROM symbols"),
    "topk11_18_nulls_last_listing": (lambda s, d: overview(s, d).orderBy(F.asc_nulls_last("score"), "symbol").limit(50).select("symbol", "score"), f"SELECT symbol, score FROM ({OVERVIEW}) ORDER BY score ASC NULLS LAST, symbol LIMIT 50"),
    "win36_dated_points": (lambda s, d: bars(s, d).groupBy("symbol").agg(F.sort_array(F.collect_list("day")).alias("d")).select("symbol", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.get("d", F.floor(i * (F.size("d") - 1) / 9 + 0.5).cast("int"))))).alias("day")), f"WITH {BARS}, l AS (SELECT symbol, list(day ORDER BY day) AS d FROM bars GROUP BY symbol) SELECT symbol, unnest(list_distinct(list_transform(range(0, 10), lambda i: d[CAST(floor(i * (len(d) - 1) / 9 + 0.5) AS BIGINT) + 1]))) AS day FROM l"),
    "arr01_02_03_slices": (lambda s, d: segments(s, d).groupBy("document_id").agg(F.sort_array(F.collect_set("speaker")).alias("who"), F.sort_array(F.collect_list("seg_index")).alias("i")).select("document_id", F.array_join("who", ",").alias("who"), F.array_join(F.transform(F.slice("i", 1, 3), lambda x: x.cast("string")), ",").alias("first")), f"WITH {SEGMENTS} SELECT document_id, coalesce(array_to_string(list_sort(list_distinct(list(speaker) FILTER (speaker IS NOT NULL))), ','), '') AS who, array_to_string(list_sort(list(seg_index))[1:3], ',') AS first FROM segments GROUP BY document_id"),
}
