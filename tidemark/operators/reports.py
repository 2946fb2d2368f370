"""What a report or a list shows: names, prices, payloads, filtered rows and drawn series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.math import percent_change, round_half_up

#: Keys of the periods that a small chart may show.
PERIODS = ("1d", "1w", "1m", "3m", "6m", "1y", "all")
#: US dollars per hour of recognised audio, by service.
ASR_RATES = {"groq": 0.04, "openai": 0.36, "elevenlabs": 0.4}
#: Packages of credits by id.
PACKAGES = {"small": 100, "medium": 500, "large": 2000}


def last_price(trade: Column, close: Column) -> Column:
    """The latest trade, else the day's close."""
    return F.coalesce(trade, close)


def valid_period(key: Column) -> Column:
    return F.coalesce(F.lower(F.trim(key)).isin(*PERIODS), F.lit(False))


def report_symbol(x: Column) -> Column:
    """A symbol that a report may be stored under, in capitals; null for another shape."""
    s = F.upper(F.trim(x))
    return F.when(s.rlike(r"^[A-Z0-9]{1,10}([./-][A-Z0-9]{1,6})?$"), s)


def visible(rows: DataFrame, kind: str | None, query: str) -> DataFrame:
    """Rows (ticker, company, note, class) of one class, where none counts as 'unclassified', that hold a query anywhere, in any case."""
    if kind:
        rows = rows.filter(F.coalesce("class", F.lit("unclassified")) == kind)
    q = query.strip().lower()
    return rows.filter(F.lower(F.concat_ws(" ", "ticker", "company", "note")).contains(q)) if q else rows


def company_names(docs: DataFrame, newest: int = 20) -> DataFrame:
    """(ticker, name): the company's name in the newest document of each ticker that has a readable one, among its `newest` documents."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("published"), F.desc("id")))
    rows = docs.withColumn("_r", rank).filter(F.col("_r") <= newest)
    name = F.when(F.try_parse_json("meta").isNotNull(), F.trim(F.get_json_object("meta", "$.companyName")))
    rows = rows.select("ticker", "_r", F.nullif(name, F.lit("")).alias("name")).filter("name IS NOT NULL")
    return rows.groupBy("ticker").agg(F.min_by("name", "_r").alias("name"))


def stored_payload(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with their columns as one JSON text, nulls kept."""
    return rows.withColumn("payload", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def report_event(ticker: Column, payload: Column) -> Column:
    """The summary that is sent when a report is made, from its payload; nulls where it is malformed."""
    get = lambda f: F.get_json_object(payload, f"$.{f}")
    count = lambda f: F.coalesce(F.size(F.from_json(get(f), "array<string>")), F.lit(0))
    return F.struct(ticker.alias("ticker"), get("companyName").alias("company_name"), get("overallScore").try_cast("double").alias("overall_score"), get("confidence").try_cast("double").alias("confidence"), F.greatest(count("signals"), F.lit(0)).alias("signal_count"), F.greatest(count("sources"), F.lit(0)).alias("source_count"))


def session_summary(bars: DataFrame, tickers: DataFrame, first: str, last: str) -> DataFrame:
    """(ticker, close, change, available) of each ticker once: the last session's close against the session before the first."""
    b = bars.filter(F.col("day") <= F.lit(last).cast("date"))
    own = b.groupBy("symbol").agg(F.max_by("close", "day").alias("close"), F.max("day").alias("_day"), F.max_by(F.when(F.col("day") < F.lit(first).cast("date"), F.col("close")), F.when(F.col("day") < F.lit(first).cast("date"), F.col("day"))).alias("_base"))
    rows = tickers.select(F.upper("ticker").alias("ticker")).distinct().join(own.withColumnRenamed("symbol", "ticker"), "ticker", "left")
    ok = F.coalesce(F.col("_day") >= F.lit(first).cast("date"), F.lit(False))
    return rows.select("ticker", F.when(ok, F.col("close")).alias("close"), F.when(ok, percent_change(F.col("close"), F.col("_base"))).alias("change"), ok.alias("available"))


def drawn(values: Column, width: float = 100.0, height: float = 30.0) -> Column:
    """Points 'x,y' of a series scaled into a box, highest on top; a flat one lies in the middle, one of fewer than two points is not drawn."""
    low, high = F.array_min(values), F.array_max(values)
    x = lambda i: round_half_up(i * width / (F.size(values) - 1), 1)
    y = lambda v: F.when(high == low, height / 2).otherwise(round_half_up(height - (v - low) / (high - low) * height, 1))
    return F.when(F.size(values) >= 2, F.array_join(F.transform(values, lambda v, i: F.concat(x(i).cast("string"), F.lit(","), y(v).cast("string"))), " "))


def pair_reports(pairs: DataFrame, snapshots: DataFrame, technicals: DataFrame, facts: DataFrame, least: int = 2) -> DataFrame:
    """Pairs with last price, score and market cap; a score counts from `least` bars on, and what is missing stays null."""
    t = technicals.select("symbol", F.when(F.col("bars") >= least, F.col("score")).alias("score"))
    return pairs.join(snapshots.select("symbol", "last"), "symbol", "left").join(t, "symbol", "left").join(facts.select("base", "market_cap"), "base", "left").select("symbol", "base", "last", "score", "market_cap")


def refreshed(docs: DataFrame, now: str, hours: int = 6) -> DataFrame:
    """(ticker, newest, stale): whether a ticker's newest document is older than so many hours."""
    at = F.lit(now).cast("timestamp")
    return docs.groupBy("ticker").agg(F.max("fetched").alias("newest")).withColumn("stale", F.unix_timestamp(at) - F.unix_timestamp("newest") > hours * 3600)


def criteria(options: dict, defaults: dict) -> dict:
    """Screening criteria from options, with defaults where one is missing; unknown options are refused."""
    unknown = set(options) - set(defaults)
    if unknown:
        raise ValueError(f"unknown criteria: {', '.join(sorted(unknown))}")
    return defaults | {k: v for k, v in options.items() if v is not None}
