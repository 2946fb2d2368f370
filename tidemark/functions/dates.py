"""Exchange calendar and date arithmetic as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"


def eastern_date(instant: Column) -> Column:
    """The calendar day in New York of an instant in UTC."""
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def eastern_to_utc(day: Column, hour: int, minute: int = 0) -> Column:
    """The UTC instant of a New York wall time."""
    return F.to_utc_timestamp(F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(hour), F.lit(minute), F.lit(0)), ZONE)


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year by integer arithmetic on golden number, century and epact."""
    def div(a, b):
        return F.floor(a / b)

    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 22 * m, 451)
    month, day = div(h + m - 7 * n + 114, 31), (h + m - 7 * n + 114) % 31 + 1
    return F.make_date(year, month.cast("int"), day.cast("int"))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (0 is Sunday) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, (F.pmod(F.lit(weekday) - (F.dayofweek(first) - 1), F.lit(7)) + 7 * (n - 1)).cast("int"))


def last_weekday(year: Column, month: int, weekday: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.dayofweek(last) - 1 - weekday, F.lit(7)).cast("int"))


def observed(day: Column, friday: bool = True) -> Column:
    """A holiday on a Saturday is kept on Friday, on a Sunday on Monday."""
    before = F.date_sub(day, 1) if friday else F.lit(None).cast("date")
    return F.when(F.dayofweek(day) == 7, before).when(F.dayofweek(day) == 1, F.date_add(day, 1)).otherwise(day)


def holidays(years: DataFrame) -> DataFrame:
    """(day, name) of exchange holidays in the years of a table (year); New Year has no Friday observance."""
    y = F.col("year")

    def fixed(month: int, day: int) -> Column:
        return F.make_date(y, F.lit(month), F.lit(day))

    rules = {
        "new_year": observed(fixed(1, 1), friday=False), "king": nth_weekday(y, 1, 1, 3), "presidents": nth_weekday(y, 2, 1, 3), "good_friday": F.date_sub(easter(y), 2), "memorial": last_weekday(y, 5, 1),
        "juneteenth": F.when(y >= 2022, observed(fixed(6, 19))), "independence": observed(fixed(7, 4)), "labor": nth_weekday(y, 9, 1, 1), "thanksgiving": nth_weekday(y, 11, 4, 4), "christmas": observed(fixed(12, 25)),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), d.alias("day")) for n, d in rules.items()]))
    return years.select(rows.alias("h")).select("h.day", "h.name").filter("day IS NOT NULL")


def trading_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(day, previous, first_of_week): weekdays that are no holidays, the one before, and whether it is the first of its week."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    years = spark.range(int(start[:4]), int(end[:4]) + 1).select(F.col("id").cast("int").alias("year"))
    open_ = days.filter(~F.dayofweek("day").isin(1, 7)).join(holidays(years), "day", "left_anti")
    order = Window.partitionBy(F.lit(0)).orderBy("day")  # a calendar: some 250 rows a year
    first = F.row_number().over(Window.partitionBy(F.date_trunc("week", "day")).orderBy("day")) == 1
    return open_.select("day", F.lag("day").over(order).alias("previous"), first.alias("first_of_week"))


def week_key(day: Column) -> Column:
    """ISO week as YYYY-Www."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def relative_date(text: Column, as_of: Column) -> Column:
    """'2 days ago' as a date before an anchor; a month is 30 days, a year 365; else the text as a date, else null."""
    n = F.regexp_extract(F.lower(text), r"^(\d+) (day|week|month|year)s? ago$", 1)
    unit = F.regexp_extract(F.lower(text), r"^(\d+) (day|week|month|year)s? ago$", 2)
    days = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)
    return F.when(n != "", F.date_sub(as_of, (n.cast("int") * days))).otherwise(F.to_date(F.try_to_timestamp(text)))
