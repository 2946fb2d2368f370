"""Queries of indicators, scores, screens and performance over `bars`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.math import percent_change, round_half_up
from tidemark.operators import performance as P
from tidemark.operators import technical as T
from tidemark.operators.halos import own, recent
from tidemark.operators.known import with_around
from tidemark.plans.views import BARS, bars, table

CRITERIA = {"price_min": 900, "price_max": 2000, "avg_volume_min": 20, "rsi_min": 30, "rsi_max": 70, "above_sma_20": True, "above_sma_200": True, "golden_cross": True, "relative_volume_min": 0.5, "momentum_20_min": -20, "trend": "bullish"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums of doubles depend on the engine's order in the last bits."""
    return df.select(*[round_half_up(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def over(fn, *columns: str, last: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = bars(spark, sf_dir)
        out = T.latest(own(fn(recent(rows, T.YEAR)))) if last else fn(rows)
        return rounded(out.select("symbol", *([] if last else ["day"]), *columns))

    return run


def plain(fn):
    return lambda spark, sf_dir: rounded(fn(bars(spark, sf_dir)))


W = "(PARTITION BY symbol ORDER BY day)"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gated(value: str, n: int) -> str:
    return f"CASE WHEN row_number() OVER {W} >= {n} THEN {value} OVER {frame(n)} END"


def r(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def pct(now: str, base: str) -> str:
    return f"(CASE WHEN ({base}) <> 0 THEN (({now}) - ({base})) / ({base}) * 100 END)"


LISTS = """lists AS (SELECT symbol, list(close ORDER BY day) AS c, list(high ORDER BY day) AS h, list(low ORDER BY day) AS l FROM bars GROUP BY symbol),
moves AS (SELECT *, list_transform(range(2, len(c) + 1), lambda i: c[i] - c[i - 1]) AS d, list_transform(range(2, len(c) + 1), lambda i: greatest(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1]))) AS tr FROM lists)"""


def ema_sql(v: str, n: int) -> str:
    k = 2 / (n + 1)
    return f"CASE WHEN len({v}) >= {n} THEN list_reduce(list_concat([list_sum({v}[1:{n}]) / {n}], {v}[{n + 1}:]), lambda p, x: x * {k!r}::DOUBLE + p * (1 - {k!r}::DOUBLE)) END"


def wilder_sql(v: str, n: int) -> str:
    return f"CASE WHEN len({v}) >= {n} THEN list_reduce(list_concat([list_sum({v}[1:{n}]) / {n}], {v}[{n + 1}:]), lambda p, x: (p * {n - 1} + x) / {n}) END"


GAIN, LOSS = wilder_sql("list_transform(d, lambda x: greatest(x, 0.0::DOUBLE))", 14), wilder_sql("list_transform(d, lambda x: greatest(-x, 0.0::DOUBLE))", 14)

FRAMES = f"""frames AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back, {gated("avg(close)", 20)} AS sma_20, {gated("avg(close)", 50)} AS sma_50, {gated("avg(close)", 200)} AS sma_200,
  {pct("close", f"lag(close, 20) OVER {W}")} AS momentum_20, {pct("close", f"lag(close, 60) OVER {W}")} AS momentum_60, {pct("close", f"lag(close, 120) OVER {W}")} AS momentum_120,
  {gated("avg(volume)", 20)} AS avg_volume, max(high) OVER {frame(252)} AS high_52w, min(low) OVER {frame(252)} AS low_52w,
  coalesce(close > max(high) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), false) AS breakout,
  coalesce(close < min(low) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), false) AS breakdown FROM bars)"""
IND = f"""ind AS (SELECT f.*, CASE WHEN avg_volume <> 0 AND volume <> 0 THEN volume / avg_volume END AS relative_volume, avg_volume * close AS avg_dollar_volume,
  coalesce(sma_50 > sma_200, false) AS golden_cross, coalesce(sma_50 < sma_200, false) AS death_cross, {wilder_sql("tr", 14)} AS atr_14, {GAIN} AS gain, {LOSS} AS loss FROM frames f JOIN moves USING (symbol) WHERE back = 1),
ind2 AS (SELECT *, CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi_14,
  CASE WHEN atr_14 / close * 100 < 2 THEN 'low' WHEN atr_14 / close * 100 > 6 THEN 'high' ELSE 'normal' END AS volatility,
  CASE WHEN coalesce(close > sma_20, false) AND coalesce(close > sma_200, false) AND golden_cross THEN 'bullish' WHEN NOT coalesce(close > sma_20, false) AND NOT coalesce(close > sma_200, false) AND death_cross THEN 'bearish' ELSE 'neutral' END AS trend FROM ind)"""


def half_up(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


SCORE = f"""score AS (SELECT *, {half_up("CASE WHEN close > sma_20 THEN 20 / 3 ELSE 0 END + CASE WHEN close > sma_50 THEN 20 / 3 ELSE 0 END + CASE WHEN close > sma_200 THEN 20 / 3 ELSE 0 END")} AS averages,
  {half_up("coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (relative_volume - 0.5) / 1.5)) * 15 + CASE WHEN relative_volume IS NULL THEN NULL ELSE 0 END, 0.0)")} AS relative,
  {half_up("coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_avg(list_filter([momentum_20, momentum_60, momentum_120], lambda x: x IS NOT NULL)) / 30)) * 20 + CASE WHEN momentum_20 IS NULL THEN NULL ELSE 0 END, 0.0)")} AS momentum,
  CASE WHEN breakout THEN 15.0 WHEN breakdown THEN 0.0 ELSE 6.0 END::DOUBLE AS break_, CASE trend WHEN 'bullish' THEN 10.0 WHEN 'neutral' THEN 5.0 ELSE 0.0 END::DOUBLE AS trending,
  CASE volatility WHEN 'normal' THEN 10.0 WHEN 'low' THEN 7.0 ELSE 3.0 END::DOUBLE AS volatile,
  {half_up("coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, log10(CASE WHEN avg_dollar_volume = 0 THEN 1 ELSE avg_dollar_volume END / 1e6))) * 10 + CASE WHEN avg_dollar_volume IS NULL THEN NULL ELSE 0 END, 0.0)")} AS liquidity FROM ind2)"""
PARTS = ("averages", "relative", "momentum", "break_", "trending", "volatile", "liquidity")
TOTAL = half_up(" + ".join(PARTS))


def score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.technical_score(T.indicators(bars(spark, sf_dir))).select("symbol", *PARTS, "score"))


def screen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.screen(T.indicators(bars(spark, sf_dir)), CRITERIA)
    return out.select("symbol", F.array_join("reasons", "; ").alias("reasons"), "passed")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars to indicators to screen to score to rank."""
    from pyspark.sql import Window

    screened = T.technical_score(T.screen(T.indicators(bars(spark, sf_dir)), {"avg_volume_min": 10, "rsi_max": 80}))
    order = Window.partitionBy("passed").orderBy(F.desc("score"), "symbol")
    return rounded(screened.select("symbol", "close", "trend", "passed", "score", F.row_number().over(order).alias("rank")))


SCREEN_SQL = """SELECT symbol, array_to_string(list_filter([
  CASE WHEN close IS NULL OR close < 900 THEN 'price < 900' END, CASE WHEN close IS NULL OR close > 2000 THEN 'price > 2000' END, CASE WHEN avg_volume < 20 THEN 'avgVolume < 20' END,
  CASE WHEN rsi_14 < 30 THEN 'RSI < 30' END, CASE WHEN rsi_14 > 70 THEN 'RSI > 70' END, CASE WHEN NOT coalesce(close > sma_20, false) THEN 'not above SMA20' END,
  CASE WHEN NOT coalesce(close > sma_200, false) THEN 'not above SMA200' END, CASE WHEN NOT golden_cross THEN 'no golden cross' END, CASE WHEN relative_volume < 0.5 THEN 'relVol < 0.5' END,
  CASE WHEN momentum_20 < -20 THEN 'mom20 < -20' END, CASE WHEN trend <> 'bullish' THEN 'trend != bullish' END], lambda x: x IS NOT NULL), '; ') AS reasons, reasons = '' AS passed FROM ind2"""

FULL = f"WITH {BARS},\n{LISTS},\n{FRAMES},\n{IND}\n"

MACD_SQL = f"""WITH RECURSIVE {BARS},
rows_ AS (SELECT symbol, day, close, row_number() OVER {W} AS i FROM bars),
seed AS (SELECT symbol, avg(close) FILTER (i <= 12) AS f, avg(close) FILTER (i <= 26) AS s, count(*) AS n FROM rows_ GROUP BY symbol),
fast AS (SELECT symbol, 12::BIGINT AS i, f AS e FROM seed WHERE n >= 12 UNION ALL SELECT r.symbol, r.i, r.close * (2 / 13.0::DOUBLE) + e * (1 - 2 / 13.0::DOUBLE) FROM fast JOIN rows_ r ON r.symbol = fast.symbol AND r.i = fast.i + 1),
slow AS (SELECT symbol, 26::BIGINT AS i, s AS e FROM seed WHERE n >= 26 UNION ALL SELECT r.symbol, r.i, r.close * (2 / 27.0::DOUBLE) + e * (1 - 2 / 27.0::DOUBLE) FROM slow JOIN rows_ r ON r.symbol = slow.symbol AND r.i = slow.i + 1),
line AS (SELECT symbol, i, fast.e - slow.e AS m FROM fast JOIN slow USING (symbol, i)),
sig AS (SELECT symbol, 34::BIGINT AS i, avg(m) AS e FROM line WHERE i <= 34 GROUP BY symbol HAVING count(*) = 9 UNION ALL SELECT l.symbol, l.i, l.m * 0.2::DOUBLE + e * (1 - 0.2::DOUBLE) FROM sig JOIN line l ON l.symbol = sig.symbol AND l.i = sig.i + 1)
SELECT r.symbol, r.day, round(m, 6) AS macd, round(e, 6) AS signal, round(m - e, 6) AS histogram FROM rows_ r LEFT JOIN line USING (symbol, i) LEFT JOIN sig USING (symbol, i)"""

EMA_SERIES_SQL = f"""WITH RECURSIVE {BARS},
rows_ AS (SELECT symbol, day, close, row_number() OVER {W} AS i FROM bars),
e AS (SELECT symbol, 9::BIGINT AS i, avg(close) AS e FROM rows_ WHERE i <= 9 GROUP BY symbol HAVING count(*) = 9 UNION ALL SELECT r.symbol, r.i, r.close * 0.2::DOUBLE + e * (1 - 0.2::DOUBLE) FROM e JOIN rows_ r ON r.symbol = e.symbol AND r.i = e.i + 1)
SELECT symbol, day, round(e, 6) AS ema FROM e JOIN rows_ USING (symbol, i)"""

PERIODS = (7, 30, 90, 365)
AS_OF = "2000-01-01"


def _asof_sql() -> str:
    parts = ", ".join(f"round({pct('last_close', f'arg_max(close, day) FILTER (day <= last_day - {n})')}, 6) AS change_{n}" for n in PERIODS)
    return f"WITH {BARS}, l AS (SELECT *, max(day) OVER (PARTITION BY symbol) AS last_day, last_value(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_close FROM bars) SELECT symbol, {parts} FROM l GROUP BY symbol, last_close, last_day"


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with its supplier's last close on or before the order's day, the first on or after it, and the change between them."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = lines.select("l_orderkey", "l_linenumber", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("ordered"))
    closes = bars(spark, sf_dir).select("symbol", "day", "close")
    found = with_around(asked, closes, "ordered", {"day": "known_day", "close": "known_close"}, {"day": "next_day", "close": "next_close"}, daily=True)
    return rounded(found.withColumn("change", percent_change(F.col("next_close"), F.col("known_close"))))


PRICED_ORDERS = f"""WITH {BARS}, a AS (SELECT l_orderkey, l_linenumber, 'S' || l_suppkey AS symbol, CAST(o_orderdate AS DATE) AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT a.*, b.day AS known_day, b.close AS known_close FROM a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.ordered >= b.day)
SELECT k.l_orderkey, k.l_linenumber, k.symbol, k.ordered, known_day, round(known_close, 6) AS known_close, b.day AS next_day, round(b.close, 6) AS next_close, round({pct('b.close', 'known_close')}, 6) AS change FROM k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.ordered <= b.day"""


QUERIES = {
    "win01_sma": (over(lambda b: T.with_sma(b), "sma_20", "sma_50", "sma_200", last=True), f"WITH {BARS},\n{FRAMES} SELECT symbol, round(sma_20, 6) AS sma_20, round(sma_50, 6) AS sma_50, round(sma_200, 6) AS sma_200 FROM frames WHERE back = 1"),
    "win02_sma_series": (over(lambda b: T.with_sma(b), "sma_20", "sma_50", "sma_200"), f"WITH {BARS},\n{FRAMES} SELECT symbol, day, round(sma_20, 6) AS sma_20, round(sma_50, 6) AS sma_50, round(sma_200, 6) AS sma_200 FROM frames"),
    "win03_ema": (plain(T.ema), f"WITH {BARS}, {LISTS} SELECT symbol, {r(ema_sql('c', 9), 'ema_9')}, {r(ema_sql('c', 21), 'ema_21')} FROM moves"),
    "win04_ema_series": (plain(T.ema_series), EMA_SERIES_SQL),
    "win05_rsi": (plain(T.rsi), f"WITH {BARS}, {LISTS}, m AS (SELECT symbol, {GAIN} AS g, {LOSS} AS s FROM moves) SELECT symbol, {r('CASE WHEN s = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / s) END', 'rsi_14')} FROM m"),
    "win08_macd_series": (plain(T.macd_series), MACD_SQL),
    "win07_macd": (lambda s, d: rounded(T.latest(T.macd_series(bars(s, d))).select("symbol", "macd", "signal", "histogram")), f"SELECT symbol, arg_max(macd, day) AS macd, arg_max(signal, day) AS signal, arg_max(histogram, day) AS histogram FROM ({MACD_SQL}) GROUP BY symbol"),
    "win09_bollinger": (over(T.with_bollinger, "middle", "upper", "lower"), f"WITH {BARS}, b AS (SELECT symbol, day, {gated('avg(close)', 20)} AS m, {gated('stddev_pop(close)', 20)} AS s FROM bars) SELECT symbol, day, {r('m', 'middle')}, {r('m + 2 * s', 'upper')}, {r('m - 2 * s', 'lower')} FROM b"),
    "win10_atr": (plain(T.atr), f"WITH {BARS}, {LISTS} SELECT symbol, {r(wilder_sql('tr', 14), 'atr_14')} FROM moves"),
    "win11_momentum": (over(T.with_momentum, "momentum_20", "momentum_60", "momentum_120"), f"WITH {BARS},\n{FRAMES} SELECT symbol, day, {r('momentum_20', 'momentum_20')}, {r('momentum_60', 'momentum_60')}, {r('momentum_120', 'momentum_120')} FROM frames"),
    "win12_year_range": (over(T.with_year_range, "high_52w", "low_52w", "from_high", "from_low"), f"WITH {BARS},\n{FRAMES} SELECT symbol, day, {r('high_52w', 'high_52w')}, {r('low_52w', 'low_52w')}, {r(pct('close', 'high_52w'), 'from_high')}, {r(pct('close', 'low_52w'), 'from_low')} FROM frames"),
    "win13_volume": (over(T.with_volume, "avg_volume", "relative_volume"), f"WITH {BARS},\n{FRAMES} SELECT symbol, day, {r('avg_volume', 'avg_volume')}, {r('CASE WHEN avg_volume <> 0 AND volume <> 0 THEN volume / avg_volume END', 'relative_volume')} FROM frames"),
    "win14_cross": (lambda s, d: T.indicators(bars(s, d)).select("symbol", "golden_cross", "death_cross"), FULL + "SELECT symbol, golden_cross, death_cross FROM ind"),
    "win15_breakout": (over(T.with_breakout, "breakout", "breakdown"), f"WITH {BARS},\n{FRAMES} SELECT symbol, day, breakout, breakdown FROM frames"),
    "win16_gap": (over(T.with_gap, "gap_percent"), f"WITH {BARS} SELECT symbol, day, {r(pct('open', f'lag(close) OVER {W}'), 'gap_percent')} FROM bars"),
    "win17_18_regime_trend": (lambda s, d: T.indicators(bars(s, d)).select("symbol", "volatility", "trend"), FULL + "SELECT symbol, volatility, trend FROM ind2"),
    "win19_technical_score": (score_query, f"{FULL}, {SCORE} SELECT symbol, " + ", ".join(f"round({p}, 6) AS {p}" for p in PARTS) + f", round({TOTAL}, 6) AS score FROM score"),
    "fil01_screen": (screen_query, FULL + SCREEN_SQL),
    "flagship_screen": (flagship, f"{FULL}, {SCORE}, z AS (SELECT symbol, close, trend, NOT coalesce(avg_volume < 10, false) AND NOT coalesce(rsi_14 > 80, false) AS passed, {TOTAL} AS score FROM score) SELECT symbol, round(close, 6) AS close, trend, passed, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY passed ORDER BY score DESC, symbol) AS INTEGER) AS rank FROM z"),
    "join15_asof_changes": (plain(lambda b: P.period_changes(b, PERIODS)), _asof_sql()),
    "join16_asof_forward": (plain(lambda b: P.forward_return(b, AS_OF)), f"WITH {BARS} SELECT symbol, round(coalesce(arg_min(close, day) FILTER (day >= DATE '{AS_OF}'), arg_min(close, day)), 6) AS entry, round(arg_max(close, day), 6) AS exit, round({pct('arg_max(close, day)', f'coalesce(arg_min(close, day) FILTER (day >= DATE {chr(39)}{AS_OF}{chr(39)}), arg_min(close, day))')}, 6) AS return_percent FROM bars GROUP BY symbol"),
    "join15_16_priced_orders": (priced_orders, PRICED_ORDERS),
    "join17_18_carry_forward": (plain(lambda b: P.on_calendar(b, AS_OF)), f"""WITH {BARS}, grid AS (SELECT symbol, day FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN (SELECT DISTINCT day FROM bars WHERE day >= DATE '{AS_OF}'))
SELECT g.symbol, g.day, round(last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS close FROM grid g LEFT JOIN bars b USING (symbol, day)"""),
    "agg24_equal_weight_index": (plain(lambda b: P.equal_weight_index(b, AS_OF)), f"""WITH {BARS}, grid AS (SELECT symbol, day FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN (SELECT DISTINCT day FROM bars WHERE day >= DATE '{AS_OF}')),
f AS (SELECT g.symbol, g.day, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM grid g LEFT JOIN bars b USING (symbol, day)),
b AS (SELECT *, first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM f)
SELECT day, round(avg(c / base) * 100, 6) AS level, count(c) AS members FROM b GROUP BY day"""),
    "win32_performance": (plain(P.extremes), f"""WITH {BARS}, w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM bars)
SELECT symbol, round(max(high) FILTER (back <= 365), 6) AS high_365, round(min(low) FILTER (back <= 365), 6) AS low_365, min(day) FILTER (back <= 365 AND high = mh) AS high_day, min(day) FILTER (back <= 365 AND low = ml) AS low_day,
  round(max(volume * close) FILTER (back = 1), 6) AS volume_quote, count(*) AS bars FROM (SELECT *, max(high) FILTER (back <= 365) OVER (PARTITION BY symbol) AS mh, min(low) FILTER (back <= 365) OVER (PARTITION BY symbol) AS ml FROM w) GROUP BY symbol"""),
    "win33_range_change": (plain(lambda b: P.range_change(b, AS_OF)), f"WITH {BARS} SELECT symbol, round(CASE WHEN count(*) >= 2 THEN {pct('arg_max(close, day)', 'arg_min(close, day)')} END, 6) AS change FROM bars WHERE day >= DATE '{AS_OF}' GROUP BY symbol"),
    "win34_average_volume": (plain(lambda b: P.average_volume(b, 20)), f"WITH {BARS} SELECT symbol, round(avg(volume), 6) AS average_volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM bars) WHERE back <= 20 GROUP BY symbol"),
    "win30_31_spark_series": (plain(lambda b: P.spark_series(b, 32)), f"""WITH {BARS}, l AS (SELECT symbol, list(close ORDER BY day) AS c, min(day) AS start_day, max(day) AS end_day FROM bars GROUP BY symbol)
SELECT symbol, array_to_string(list_transform(CASE WHEN len(c) <= 32 THEN c ELSE list_transform(range(0, 32), lambda i: c[CAST(floor(i * ((len(c) - 1) / 31) + 0.5) AS BIGINT) + 1]) END, lambda x: CAST(CAST(floor(x * 100 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS points, round(c[1], 6) AS first, round(c[-1], 6) AS last, round({pct('c[-1]', 'c[1]')}, 6) AS change, start_day, end_day FROM l"""),
    "agg21_window_performance": (plain(lambda b: P.window_performance(b, "2000-01-01", "2000-03-31")), f"""WITH {BARS} SELECT symbol, round(arg_min(open, day) FILTER (i), 6) AS open, round(max(high) FILTER (i), 6) AS high, round(min(low) FILTER (i), 6) AS low, round(arg_max(close, day) FILTER (i), 6) AS close, sum(volume) FILTER (i) AS volume, count(*) FILTER (i) AS sessions,
 round(arg_max(close, day) FILTER (day < DATE '2000-01-01'), 6) AS previous_close, round({pct('arg_max(close, day) FILTER (i)', "coalesce(arg_max(close, day) FILTER (day < DATE '2000-01-01'), arg_min(open, day) FILTER (i))")}, 6) AS change_percent
 FROM (SELECT *, day BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' AS i FROM bars) GROUP BY symbol HAVING count(*) FILTER (i) > 0"""),
    "agg22_backtest_metrics": (lambda s, d: rounded(P.backtest_metrics(P.forward_return(bars(s, d), AS_OF).withColumnRenamed("return_percent", "value"))), f"""WITH {BARS}, p AS (SELECT {pct('arg_max(close, day)', f"coalesce(arg_min(close, day) FILTER (day >= DATE '{AS_OF}'), arg_min(close, day))")} AS v FROM bars GROUP BY symbol)
SELECT count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(avg(CASE WHEN v > 0 THEN 100.0 ELSE 0 END), 6) AS win_rate, round(least(0, min(v)), 6) AS max_drawdown, round(avg(CASE WHEN v >= 25 THEN 100.0 ELSE 0 END), 6) AS hit_25, round(avg(CASE WHEN v >= 50 THEN 100.0 ELSE 0 END), 6) AS hit_50, round(avg(CASE WHEN v >= 100 THEN 100.0 ELSE 0 END), 6) AS hit_100 FROM p WHERE v IS NOT NULL"""),
    "topk10_movers": (plain(lambda b: P.movers(b, AS_OF, 10)), f"WITH {BARS}, c AS (SELECT symbol, CASE WHEN count(*) >= 2 THEN {pct('arg_max(close, day)', 'arg_min(close, day)')} END AS change FROM bars WHERE day >= DATE '{AS_OF}' GROUP BY symbol) SELECT symbol, round(change, 6) AS change FROM c WHERE change IS NOT NULL ORDER BY abs(change) DESC, symbol LIMIT 10"),
    "agg31_volume_profile": (plain(lambda b: P.volume_profile(b, 24)), f"""WITH {BARS}, x AS (SELECT *, min(low) OVER (PARTITION BY symbol) AS lo, max(high) OVER (PARTITION BY symbol) AS hi FROM bars),
t AS (SELECT symbol, volume, CAST(least(23, greatest(0, floor((low - lo) / ((hi - lo) / 24)))) AS INTEGER) AS a, CAST(least(23, greatest(0, floor((high - lo) / ((hi - lo) / 24)))) AS INTEGER) AS z FROM x WHERE hi > lo)
SELECT symbol, bin, round(sum(volume / (z - a + 1)), 6) AS volume FROM (SELECT symbol, volume, a, z, unnest(range(a, z + 1))::INTEGER AS bin FROM t) GROUP BY symbol, bin"""),
}
