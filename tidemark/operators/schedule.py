"""What is to be sent when: digests due at an instant, the next send, claims that make a send happen once at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D

#: New York hour of the pre-market open, and hours after it in which a digest is still sent.
OPEN_HOUR, CATCH_UP = 4, 6


def calendar(days: DataFrame) -> DataFrame:
    """Trading days (day, previous, first_of_week) with their opening instant and the sessions of the week of the day before."""
    monday = F.to_date(F.date_trunc("week", F.col("previous")))
    sessions = days.select(F.col("day").alias("session"), F.to_date(F.date_trunc("week", "day")).alias("_week"))
    week = days.filter("previous IS NOT NULL").select("day", F.col("previous").alias("_last"), monday.alias("_week")).join(sessions, "_week").filter("session <= _last")
    lists = week.groupBy("day").agg(F.sort_array(F.collect_list("session")).alias("week_sessions"))  # five days at most
    return days.join(lists, "day", "left").withColumn("opens", D.eastern_to_utc(F.col("day"), OPEN_HOUR))


def due(instants: DataFrame, days: DataFrame, at: str = "ts", hours: int = CATCH_UP) -> DataFrame:
    """instants with skipped (why nothing is due) and windows: structs (frequency, period_key, sessions).

    The calendar is a row a trading day, some 250 a year.
    """
    rows = instants.withColumn("send_date", D.eastern_date(F.col(at))).join(F.broadcast(calendar(days)), F.col("send_date") == F.col("day"), "left")
    late = F.unix_timestamp(at) - F.unix_timestamp("opens")
    skipped = F.when(F.col("day").isNull(), "not a trading day").when(late < 0, "before the pre-market open").when(late > hours * 3600, f"more than {hours} h past the pre-market open")
    daily = F.struct(F.lit("daily").alias("frequency"), F.concat(F.lit("daily:"), F.col("send_date").cast("string")).alias("period_key"), F.array("previous").alias("sessions"))
    weekly = F.struct(F.lit("weekly").alias("frequency"), F.concat(F.lit("weekly:"), D.week_key(F.col("previous"))).alias("period_key"), F.coalesce("week_sessions", F.array("previous")).alias("sessions"))
    windows = F.when(F.col("first_of_week"), F.array(daily, weekly)).otherwise(F.array(daily))
    return rows.withColumn("skipped", skipped).withColumn("windows", F.when(skipped.isNull(), windows).otherwise(F.array().cast("array<struct<frequency:string,period_key:string,sessions:array<date>>>"))).select(*instants.columns, "send_date", "skipped", "windows")


def next_send(instants: DataFrame, days: DataFrame, frequency: str, at: str = "ts", within: int = 30) -> DataFrame:
    """instants with next_at: the first opening after them of a trading day, or of a week's first one; null for 'off' or none within so many days."""
    if frequency == "off":
        return instants.withColumn("next_at", F.lit(None).cast("timestamp"))
    opens = days.filter("first_of_week") if frequency == "weekly" else days
    opens = opens.select(D.eastern_to_utc(F.col("day"), OPEN_HOUR).alias("next_at"))
    # an opening lies in the buckets of the days before it, from which it may be the next one
    near = opens.withColumn("_day", F.explode(F.sequence(F.date_sub(F.to_date("next_at"), 5 if frequency == "daily" else 11), F.to_date("next_at"))))
    rows = instants.withColumn("_id", F.struct(*instants.columns)).withColumn("_day", F.to_date(at))
    found = rows.join(F.broadcast(near), "_day").filter(F.col("next_at") > F.col(at)).filter(F.datediff("next_at", at) <= within).groupBy("_id").agg(F.min("next_at").alias("next_at"))
    return rows.join(found, "_id", "left").select(*instants.columns, "next_at")


def on_time(sends: DataFrame, at: str = "ts", opens: str = "opens", hours: int = CATCH_UP) -> DataFrame:
    """Sends that aren't later than so many hours past their opening; the others are dropped, as late events behind a watermark are."""
    return sends.filter((F.col(at) >= F.col(opens)) & (F.unix_timestamp(at) - F.unix_timestamp(opens) <= hours * 3600))


def recipients(users: DataFrame, lists: DataFrame, sent: DataFrame, period: str, frequency: str) -> DataFrame:
    """(user_id, tickers) of verified users with a list and that frequency whom the period's digest hasn't reached."""
    asked = users.filter((F.coalesce("frequency", F.lit("daily")) == frequency) & F.col("verified") & ~F.coalesce("disabled", F.lit(False))).select("user_id")
    left = asked.join(sent.filter(F.col("period_key") == period).select("user_id"), "user_id", "left_anti")
    return left.join(lists, "user_id").groupBy("user_id").agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))


def ticked(ticks: DataFrame, days: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, period_key, first_tick): what a poll at each tick sends, each period once to a user, at the first tick that finds it due."""
    open_ = due(ticks, days).select("ts", F.explode("windows").alias("w")).select("ts", "w.frequency", "w.period_key")
    first = open_.groupBy("frequency", "period_key").agg(F.min("ts").alias("first_tick"))  # a row a period
    return users.select("user_id", "frequency").join(F.broadcast(first), "frequency").select("user_id", "period_key", "first_tick")


def trading_days_between(rows: DataFrame, days: DataFrame, start: str, end: str) -> DataFrame:
    """rows with sessions: how many trading days lie in start..end, both dates; 0 if one is null.

    The calendar is one row: how many trading days have passed by each date
    from its first to its last, so a row looks up two places, whatever the
    calendar's length.
    """
    every = days.agg(F.sort_array(F.collect_list("day")).alias("_days"))  # a calendar: some 250 rows a year
    until_next = lambda d, i: F.coalesce(F.datediff(F.get("_days", i + 1), d), F.lit(1))
    passed = F.flatten(F.transform("_days", lambda d, i: F.array_repeat(i + 1, until_next(d, i))))
    every = every.select(F.get("_days", F.lit(0)).alias("_first"), F.size("_days").alias("_n"), passed.alias("_passed"))
    upto = lambda d: F.when(d < F.col("_first"), 0).otherwise(F.coalesce(F.get("_passed", F.datediff(d, F.col("_first"))), F.when(d.isNotNull(), F.col("_n"))))
    out = rows.join(F.broadcast(every))
    return out.withColumn("sessions", F.greatest(upto(F.col(end)) - upto(F.date_sub(F.col(start), 1)), F.lit(0))).drop("_first", "_n", "_passed")
