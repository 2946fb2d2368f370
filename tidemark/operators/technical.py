"""Technical indicators over daily bars: frames over blocks of rows where a frame says it, folds where a value depends on the one before.

Bars have (symbol, day, open, high, low, close, volume, vwap). Warm-up gives
null, never a partial value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.math import clamp, percent_change, round_half_up
from tidemark.operators.halos import back, frame, framed, full, own, recent
from tidemark.operators.scans import exponential, numbered, wilder, with_means
from tidemark.session import settle_table


#: Rows of a year of sessions: the longest frame of `indicators`.
YEAR = 252


def sma(n: int, column: str = "close") -> Column:
    return full(F.avg(column).over(back(n)), n)


def momentum(n: int, column: str = "close") -> Column:
    return percent_change(F.col(column), F.lag(column, n).over(frame()))


@framed(lambda periods=(20, 50, 200): max(periods))
def with_sma(bars: DataFrame, periods: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    return bars.withColumns({f"sma_{n}": sma(n) for n in periods})


@framed(lambda n=20, k=2.0: n)
def with_bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    middle, sd = sma(n), full(F.stddev_pop("close").over(back(n)), n)
    return bars.withColumns({"middle": middle, "upper": middle + k * sd, "lower": middle - k * sd})


@framed(lambda periods=(20, 60, 120): max(periods) + 1)
def with_momentum(bars: DataFrame, periods: tuple[int, ...] = (20, 60, 120)) -> DataFrame:
    return bars.withColumns({f"momentum_{n}": momentum(n) for n in periods})


@framed(lambda rows=YEAR: rows)
def with_year_range(bars: DataFrame, rows: int = YEAR) -> DataFrame:
    """High and low of the last 252 rows and the close's distance from either in percent."""
    high, low = F.max("high").over(back(rows)), F.min("low").over(back(rows))
    return bars.withColumns({"high_52w": high, "low_52w": low}).withColumns({"from_high": percent_change(F.col("close"), F.col("high_52w")), "from_low": percent_change(F.col("close"), F.col("low_52w"))})


@framed(lambda n=20: n)
def with_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean volume, volume relative to it (null when either is 0) and mean turnover at the last close."""
    bars = bars.withColumn("avg_volume", full(F.avg("volume").over(back(n)), n))
    relative = F.when((F.col("avg_volume") != 0) & (F.col("volume") != 0), F.col("volume") / F.col("avg_volume"))
    return bars.withColumns({"relative_volume": relative, "avg_dollar_volume": F.col("avg_volume") * F.col("close")})


@framed(lambda n=20: n + 1)
def with_breakout(bars: DataFrame, n: int = 20) -> DataFrame:
    """Close above the highest or below the lowest of the n rows before."""
    before = frame().rowsBetween(-n, -1)
    above, below = F.col("close") > F.max("high").over(before), F.col("close") < F.min("low").over(before)
    return bars.withColumns({"breakout": F.coalesce(above, F.lit(False)), "breakdown": F.coalesce(below, F.lit(False))})


@framed(2)
def with_gap(bars: DataFrame) -> DataFrame:
    return bars.withColumn("gap_percent", percent_change(F.col("open"), F.lag("close").over(frame())))


def closes(bars: DataFrame) -> DataFrame:
    """(symbol, bars): each symbol's bars in order, one row a symbol."""
    return bars.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("day", "open", "high", "low", "close", "volume"))).alias("bars"))


def ema_of(values: Column, n: int) -> Column:
    """The last exponential mean of an array, seeded with the plain mean of its first n."""
    k = 2 / (n + 1)
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(rest, seed, lambda p, v: v * k + p * (1 - k)))


def wilder_of(values: Column, n: int) -> Column:
    """The last Wilder mean of an array, seeded with the plain mean of its first n."""
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(rest, seed, lambda p, v: (p * (n - 1) + v) / n))


def changes_of(values: Column) -> Column:
    """Differences between neighbours of an array."""
    tail = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.zip_with(tail, F.slice(values, 1, F.size(tail)), lambda now, then: now - then)


def ema(bars: DataFrame, periods: tuple[int, ...] = (9, 21)) -> DataFrame:
    c = F.transform("bars", lambda b: b["close"])
    return closes(bars).select("symbol", *[ema_of(c, n).alias(f"ema_{n}") for n in periods])


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength of gains to losses under Wilder's mean; 100 without losses."""
    change = closes(bars).select("symbol", changes_of(F.transform("bars", lambda b: b["close"])).alias("change"))
    means = change.select("symbol", wilder_of(F.transform("change", lambda x: F.greatest(x, F.lit(0.0))), n).alias("gain"), wilder_of(F.transform("change", lambda x: F.greatest(-x, F.lit(0.0))), n).alias("loss"))
    return means.select("symbol", F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss"))).alias(f"rsi_{n}"))


def true_ranges(bars: Column) -> Column:
    tail = F.slice(bars, 2, F.greatest(F.size(bars) - 1, F.lit(0)))
    return F.zip_with(tail, F.slice(bars, 1, F.size(tail)), lambda b, p: F.greatest(b["high"] - b["low"], F.abs(b["high"] - p["close"]), F.abs(b["low"] - p["close"])))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's mean of true ranges."""
    ranges = closes(bars).select("symbol", true_ranges(F.col("bars")).alias("ranges"))
    return ranges.select("symbol", wilder_of(F.col("ranges"), n).alias(f"atr_{n}"))


def rsi_series(bars: DataFrame, n: int = 14) -> DataFrame:
    """(symbol, day, rsi) for every bar after the n-th: gains against losses under Wilder's mean; 100 without losses."""
    change = F.col("x") - F.col("previous")
    means = {"gain": wilder(F.greatest(change, F.lit(0.0)), n, 1), "loss": wilder(F.greatest(-change, F.lit(0.0)), n, 1)}
    found = with_means(numbered(bars), means).filter("gain IS NOT NULL")
    return found.select("symbol", "day", F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss"))).alias("rsi"))


def macd_series(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(symbol, day, macd, signal, histogram) for every bar."""
    x = F.col("x")
    lines = with_means(numbered(bars), {"fast": exponential(x, fast), "slow": exponential(x, slow)}).withColumn("macd", F.col("fast") - F.col("slow"))
    lines = settle_table(lines.select("symbol", "day", "block", "j", "k", "macd"))
    found = with_means(lines, {"signal": exponential(F.col("macd"), signal, max(fast, slow) - 1)})
    return found.select("symbol", "day", "macd", "signal", (F.col("macd") - F.col("signal")).alias("histogram"))


def ema_series(bars: DataFrame, n: int = 9) -> DataFrame:
    """(symbol, day, ema) for every bar from the n-th on."""
    return with_means(numbered(bars), {"ema": exponential(F.col("x"), n)}).filter("ema IS NOT NULL").select("symbol", "day", "ema")


def latest(bars: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))
    return bars.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def indicators(bars: DataFrame) -> DataFrame:
    """The whole set for each symbol's last bar, one row a symbol."""
    frames = with_gap(with_breakout(with_volume(with_year_range(with_momentum(with_bollinger(with_sma(recent(bars, YEAR))))))))
    last = latest(own(frames))
    folds = closes(bars).withColumn("c", F.transform("bars", lambda b: b["close"])).withColumn("change", changes_of(F.col("c")))
    up, down = F.transform("change", lambda x: F.greatest(x, F.lit(0.0))), F.transform("change", lambda x: F.greatest(-x, F.lit(0.0)))
    folds = folds.select("symbol", ema_of(F.col("c"), 9).alias("ema_9"), ema_of(F.col("c"), 21).alias("ema_21"), wilder_of(up, 14).alias("gain"), wilder_of(down, 14).alias("loss"), wilder_of(true_ranges(F.col("bars")), 14).alias("atr_14"))
    folds = folds.withColumn("rsi_14", F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss")))).drop("gain", "loss")
    out = last.join(folds, "symbol")
    golden = F.coalesce(F.col("sma_50") > F.col("sma_200"), F.lit(False))
    death = F.coalesce(F.col("sma_50") < F.col("sma_200"), F.lit(False))
    atr_percent = F.when(F.col("close") != 0, F.col("atr_14") / F.col("close") * 100)
    short, long_ = F.coalesce(F.col("close") > F.col("sma_20"), F.lit(False)), F.coalesce(F.col("close") > F.col("sma_200"), F.lit(False))
    out = out.withColumns({"golden_cross": golden, "death_cross": death, "volatility": F.when(atr_percent < 2, "low").when(atr_percent > 6, "high").otherwise("normal")})
    trend = F.when(short & long_ & F.col("golden_cross"), "bullish").when(~short & ~long_ & F.col("death_cross"), "bearish").otherwise("neutral")
    return out.withColumn("trend", trend)


def technical_score(ind: DataFrame) -> DataFrame:
    """(symbol, seven parts, score): 0-100, each part rounded before the sum."""
    above = sum((F.when(F.col("close") > F.col(f"sma_{n}"), 20 / 3).otherwise(0.0) for n in (20, 50, 200)), F.lit(0.0))
    moves = F.filter(F.array("momentum_20", "momentum_60", "momentum_120"), lambda x: x.isNotNull())
    mean = F.when(F.size(moves) > 0, F.aggregate(moves, F.lit(0.0), lambda a, x: a + x) / F.size(moves))
    dollars = F.when(F.col("avg_dollar_volume") == 0, 1.0).otherwise(F.col("avg_dollar_volume"))
    parts = {
        "averages": round_half_up(above),
        "relative": round_half_up(F.coalesce(clamp((F.col("relative_volume") - 0.5) / 1.5, 0, 1) * 15, F.lit(0.0))),
        "momentum": round_half_up(F.coalesce(clamp(mean / 30, 0, 1) * 20, F.lit(0.0))),
        "break_": F.when(F.col("breakout"), 15.0).when(F.col("breakdown"), 0.0).otherwise(6.0),
        "trending": F.when(F.col("trend") == "bullish", 10.0).when(F.col("trend") == "neutral", 5.0).otherwise(0.0),
        "volatile": F.when(F.col("volatility") == "normal", 10.0).when(F.col("volatility") == "low", 7.0).otherwise(3.0),
        "liquidity": round_half_up(F.coalesce(clamp(F.log10(dollars / 1e6), 0, 1) * 10, F.lit(0.0))),
    }
    scored = ind.withColumns(parts)
    return scored.withColumn("score", round_half_up(sum((F.col(c) for c in parts), F.lit(0.0))))


def screen(ind: DataFrame, criteria: dict) -> DataFrame:
    """ind with reasons (criteria not met, in order) and passed.

    A missing price fails its bounds and a missing average fails "above";
    other missing values pass.
    """
    c, price = criteria, F.col("close")
    checks = []

    def fails(key: str, condition, text: str):
        if key in c and c[key] not in (None, False, []):
            checks.append(F.when(condition(c[key]), F.lit(text.format(c[key]))))

    fails("price_min", lambda v: price.isNull() | (price < v), "price < {}")
    fails("price_max", lambda v: price.isNull() | (price > v), "price > {}")
    fails("avg_volume_min", lambda v: F.col("avg_volume") < v, "avgVolume < {}")
    fails("avg_dollar_volume_min", lambda v: F.col("avg_dollar_volume") < v, "avgDollarVolume < {}")
    fails("max_spread_percent", lambda v: F.col("spread_percent") > v, "spread > {}")
    fails("exchanges", lambda v: F.upper("exchange").isNotNull() & ~F.upper("exchange").isin([x.upper() for x in v]), "exchange not in {}")
    fails("rsi_min", lambda v: F.col("rsi_14") < v, "RSI < {}")
    fails("rsi_max", lambda v: F.col("rsi_14") > v, "RSI > {}")
    for n in (20, 50, 200):
        fails(f"above_sma_{n}", lambda v, n=n: ~F.coalesce(price > F.col(f"sma_{n}"), F.lit(False)), f"not above SMA{n}")
    fails("golden_cross", lambda v: ~F.col("golden_cross"), "no golden cross")
    fails("relative_volume_min", lambda v: F.col("relative_volume") < v, "relVol < {}")
    fails("momentum_20_min", lambda v: F.col("momentum_20") < v, "mom20 < {}")
    fails("momentum_60_min", lambda v: F.col("momentum_60") < v, "mom60 < {}")
    fails("trend", lambda v: F.col("trend") != v, "trend != {}")
    reasons = F.filter(F.array(*checks), lambda r: r.isNotNull()) if checks else F.array().cast("array<string>")
    return ind.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
