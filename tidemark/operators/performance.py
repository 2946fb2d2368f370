"""Returns, as-of joins, indices and summaries over daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.math import percent_change
from tidemark.operators.selection import median
from tidemark.session import settle_table


def beside(bars: DataFrame, facts: DataFrame) -> DataFrame:
    """bars with a row of facts for each symbol, null as one of them: facts are combined before they are shuffled, so a busy symbol's rows meet in no window."""
    return bars.join(facts.withColumnRenamed("symbol", "_of"), F.col("symbol").eqNullSafe(F.col("_of"))).drop("_of")


def period_changes(bars: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """Percent change of the last close against the latest close at least n days before it: an as-of join by one aggregation."""
    ends = beside(bars, bars.groupBy("symbol").agg(F.max("day").alias("last_day"), F.max_by("close", "day").alias("last_close")))
    then = [F.max_by(F.when(F.col("day") <= F.date_sub("last_day", n), F.col("close")), F.when(F.col("day") <= F.date_sub("last_day", n), F.col("day"))).alias(f"c{n}") for n in days]
    out = ends.groupBy("symbol", "last_close").agg(*then)
    return out.select("symbol", *[percent_change(F.col("last_close"), F.col(f"c{n}")).alias(f"change_{n}") for n in days])


def forward_return(bars: DataFrame, as_of: str) -> DataFrame:
    """From the first close on or after a day (else the first of all) to the last."""
    at = F.when(F.col("day") >= F.lit(as_of).cast("date"), F.col("day"))
    found = bars.groupBy("symbol").agg(F.min_by(F.when(at.isNotNull(), F.col("close")), at).alias("after"), F.min_by("close", "day").alias("first"), F.max_by("close", "day").alias("exit"))
    out = found.select("symbol", F.coalesce("after", "first").alias("entry"), "exit")
    return out.withColumn("return_percent", percent_change(F.col("exit"), F.col("entry")))


def on_calendar(bars: DataFrame, since: str) -> DataFrame:
    """Each symbol's last known close on every session since a day; null before its first."""
    recent = bars.filter(F.col("day") >= F.lit(since).cast("date"))
    # sessions of the range: a row a trading day, whatever the number of symbols
    grid = bars.select("symbol").distinct().crossJoin(F.broadcast(recent.select("day").distinct()))
    known = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(recent.select("symbol", "day", "close"), ["symbol", "day"], "left")
    return filled.withColumn("close", F.last("close", ignorenulls=True).over(known))


def equal_weight_index(bars: DataFrame, since: str) -> DataFrame:
    """Mean over members of close to first close, times 100, by session."""
    base = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = on_calendar(bars, since).withColumn("base", F.first("close", ignorenulls=True).over(base))
    return placed.groupBy("day").agg((F.avg(F.col("close") / F.col("base")) * 100).alias("level"), F.count("close").alias("members"))


def extremes(bars: DataFrame, rows: int = 365) -> DataFrame:
    """High and low of the last rows with their first days, last turnover, number of bars."""
    back = bars.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))).filter(F.col("back") <= rows)
    first_high = F.min(F.struct((-F.col("high")).alias("x"), F.col("day")))
    first_low = F.min(F.struct(F.col("low").alias("x"), F.col("day")))
    found = back.groupBy("symbol").agg(first_high.alias("h"), first_low.alias("l"), F.max(F.when(F.col("back") == 1, F.col("volume") * F.col("close"))).alias("volume_quote"))
    out = beside(found, bars.groupBy("symbol").agg(F.count("*").alias("bars")))
    return out.select("symbol", (-F.col("h.x")).alias("high_365"), F.col("l.x").alias("low_365"), F.col("h.day").alias("high_day"), F.col("l.day").alias("low_day"), "volume_quote", "bars")


def range_change(bars: DataFrame, since: str) -> DataFrame:
    """Percent change from the first close since a day to the last; null with fewer than two."""
    recent = bars.filter(F.col("day") >= F.lit(since).cast("date"))
    out = recent.groupBy("symbol").agg(F.min_by("close", "day").alias("a"), F.max_by("close", "day").alias("z"), F.count("*").alias("n"))
    return out.select("symbol", F.when(F.col("n") >= 2, percent_change(F.col("z"), F.col("a"))).alias("change"))


def average_volume(bars: DataFrame, sessions: int) -> DataFrame:
    """Mean volume of the last sessions; fewer count as they are."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))
    return bars.withColumn("back", back).filter(F.col("back") <= sessions).groupBy("symbol").agg(F.avg("volume").alias("average_volume"))


def spark_series(bars: DataFrame, points: int) -> DataFrame:
    """At most `points` closes spread evenly, first and last among them, in whole hundredths; ends and change."""
    lists = bars.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("day", "close"))).alias("b"))
    c = F.transform("b", lambda x: x["close"])
    lists = lists.select("symbol", c.alias("c"), F.element_at("b", 1)["day"].alias("start_day"), F.element_at("b", -1)["day"].alias("end_day"))
    step = (F.size("c") - 1) / (points - 1)
    picked = F.when(F.size("c") <= points, F.col("c")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.get("c", F.floor(i * step + 0.5).cast("int"))))
    text = F.array_join(F.transform(picked, lambda x: F.floor(x * 100 + 0.5).cast("string")), ",")
    first, last = F.element_at("c", 1), F.element_at("c", -1)
    return lists.select("symbol", text.alias("points"), first.alias("first"), last.alias("last"), percent_change(last, first).alias("change"), "start_day", "end_day")


def window_performance(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Open, high, low, close, volume and sessions of a window, and its change from the close before it."""
    inside = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    before = F.col("day") < F.lit(start).cast("date")

    def of(column: str, cond=inside):
        return F.when(cond, F.col(column))

    out = bars.groupBy("symbol").agg(
        F.min_by(of("open"), of("day")).alias("open"), F.max(of("high")).alias("high"), F.min(of("low")).alias("low"), F.max_by(of("close"), of("day")).alias("close"),
        F.sum(of("volume")).alias("volume"), F.count(of("day")).alias("sessions"), F.max_by(of("close", before), of("day", before)).alias("previous_close"),
    )
    return out.filter("sessions > 0").withColumn("change_percent", percent_change(F.col("close"), F.coalesce("previous_close", "open")))


def backtest_metrics(returns: DataFrame) -> DataFrame:
    """Count, mean, exact median, win rate, worst loss and hit rates of `value`; the median is selected by counts of rows before this returns."""
    returns, v = settle_table(returns.select("value")), F.col("value")
    middle = F.lit(median(returns, "value")).cast("double")

    def rate(cond):
        return F.avg(F.when(cond, 100.0).otherwise(0.0))

    return returns.filter(v.isNotNull()).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), middle.alias("median"), rate(v > 0).alias("win_rate"), F.least(F.lit(0.0), F.min(v)).alias("max_drawdown"),
        rate(v >= 25).alias("hit_25"), rate(v >= 50).alias("hit_50"), rate(v >= 100).alias("hit_100"),
    )


def movers(bars: DataFrame, since: str, n: int) -> DataFrame:
    """The n largest moves either way."""
    return range_change(bars, since).filter("change IS NOT NULL").orderBy(F.desc(F.abs("change")), "symbol").limit(n)


def volume_profile(bars: DataFrame, bins: int) -> DataFrame:
    """Volume by price: each bar's volume spread evenly over the bins that it touches."""
    ends = beside(bars, bars.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).filter("hi > lo"))
    width = (F.col("hi") - F.col("lo")) / bins

    def bin_of(x):
        return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - F.col("lo")) / width))).cast("int")

    touched = ends.withColumns({"a": bin_of(F.col("low")), "z": bin_of(F.col("high"))})
    spread = touched.select("symbol", (F.col("volume") / (F.col("z") - F.col("a") + 1)).alias("v"), F.explode(F.sequence("a", "z")).alias("bin"))
    return spread.groupBy("symbol", "bin").agg(F.sum("v").alias("volume"))
