"""Assessments made without a model: scores from evidence counts, notes from indicators, levels and niches, and checks of what a model returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.math import clamp, round_half_up

#: Fields of an analysis that are lists of strings, that are scores of 0-100, and that are texts.
LISTS = ("catalystSummary", "riskSummary", "evidenceIds", "missingData")
SCORES = ("catalystScore", "executionScore", "dilutionRiskScore", "overallScore", "confidence")
TEXTS = ("ticker", "companyName", "thesis")
#: Fixed value: what in an evidence text speaks of dilution.
DILUTION = r"(?i)atm|dilut|reverse_split|financing_need|going_concern"


def tag_of(text: Column) -> Column:
    """The (type/direction) tag of an evidence text, without its brackets; '' without one."""
    return F.regexp_extract(text, r"\(([^)]*)\):", 1)


def summary_of(text: Column, longest: int = 160) -> Column:
    """An evidence text after its date, speaker and tag, cut at `longest` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"(?s)^\[[^\]]*\]\s*[^(]*\([^)]*\):\s*", "")), 1, longest)


def offline_scores(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """Scores of each ticker from its evidence (ticker, id, text) and facts (ticker, runway_months, dollar_volume, technical).

    Sentiment is read from the tags. A ticker without evidence has the scores
    of none. The summaries are up to six distinct texts in order of id.
    """
    tag = tag_of(F.col("text"))
    rows = evidence.withColumns({"_p": tag.rlike("(?i)positive"), "_n": tag.rlike("(?i)negative"), "_d": F.col("text").rlike(DILUTION), "_s": summary_of(F.col("text"))})
    # evidence is read once: a group holds distinct texts with their counts, and a summary is kept by its first id
    texts = rows.groupBy("ticker", "_p", "_s").agg(F.count("*").alias("_items"), F.count_if("_n").alias("_neg"), F.count_if("_d").alias("_dil"), F.min(F.when(F.col("_p") | F.col("_n"), F.col("id"))).alias("id"))
    place = F.row_number().over(Window.partitionBy("ticker", "_p").orderBy(F.asc_nulls_last("id")))
    first = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("_r") <= 6) & F.col("id").isNotNull() & test, F.struct("id", "_s")))), lambda x: x["_s"]), "|")
    n = texts.withColumn("_r", place).groupBy("ticker").agg(
        F.sum("_items").alias("items"), F.coalesce(F.sum(F.when(F.col("_p"), F.col("_items"))), F.lit(0)).alias("pos"), F.sum("_neg").alias("neg"), F.sum("_dil").alias("dil"), first(F.col("_p")).alias("catalysts"), first(~F.col("_p")).alias("risks")
    )
    j = facts.join(n.hint("merge"), "ticker", "left").na.fill(0, ["items", "pos", "neg", "dil"])  # a ticker's row holds texts: too large to broadcast at size
    total = F.greatest(F.lit(1), F.col("pos") + F.col("neg"))
    catalyst, dilution = clamp(F.col("pos") / total * 100, 0, 100), clamp(F.col("dil") / total * 100, 0, 100)
    liquidity = F.when(F.col("dollar_volume") > 0, clamp(100 - F.log10(F.col("dollar_volume") / 1e5) * 25, 0, 100)).otherwise(60.0)
    execution = clamp(30 + F.col("pos") * 8.0, 0, 100)
    financial = F.when(F.coalesce("runway_months", F.lit(0.0)) != 0, clamp(F.col("runway_months") * 4, 0, 100)).otherwise(45.0)
    attention = F.coalesce("technical", F.lit(50.0))
    overall = clamp(catalyst * 0.35 + execution * 0.2 + attention * 0.15 + financial * 0.1 - dilution * 0.2 - liquidity * 0.1 + 5.0, 0, 100)
    sure = clamp(35.0 + F.least(F.lit(30), F.col("items") * 3) - F.when(F.col("neg") > F.col("pos"), 15).otherwise(0), 0, 100)
    out = {"catalyst": catalyst, "dilution": dilution, "liquidity": liquidity, "execution": execution, "financial": financial, "attention": attention, "overall": overall, "confidence": sure}
    return j.select("ticker", "pos", "neg", *[round_half_up(c).alias(n) for n, c in out.items()], F.coalesce("catalysts", F.lit("")).alias("catalysts"), F.coalesce("risks", F.lit("")).alias("risks"))


def indicator_notes(rows: DataFrame) -> DataFrame:
    """rows of indicators with support and risks: short notes of what speaks for and against a price, in order."""
    c = F.col
    averages = [("20-day", "sma20"), ("50-day", "sma50"), ("200-day", "sma200")]
    side = lambda above: F.array_join(F.filter(F.array(*[F.when((c("close") > c(v)) if above else (c("close") <= c(v)), F.lit(n)) for n, v in averages]), lambda x: x.isNotNull()), ", ")
    pct = lambda x: F.format_string("%.1f%%", x)
    several = lambda s: F.when(s.contains(","), "s.").otherwise(".")
    up, down = side(True), side(False)
    support = [
        F.when(up != "", F.concat(F.lit("Trading above its "), up, F.lit(" average"), several(up))), F.when(c("momentum20") >= 0, F.concat(pct(c("momentum20")), F.lit(" over the last 20 sessions."))),
        F.when(c("rsi") <= 30, F.lit("RSI is in oversold territory.")).when(c("rsi") < 70, F.lit("RSI is neutral.")), F.when(c("macd") > c("macd_signal"), F.lit("MACD is above its signal line.")),
        F.when(c("from_high") >= -3, F.lit("Trading at or near its 52-week high.")), F.when(c("breakout"), F.lit("Price has broken above its recent range.")),
    ]
    risks = [
        F.when(down != "", F.concat(F.lit("Trading below its "), down, F.lit(" average"), several(down))), F.when(c("momentum20") < 0, F.concat(pct(c("momentum20")), F.lit(" over the last 20 sessions."))),
        F.when(c("rsi") >= 70, F.lit("RSI is in overbought territory.")), F.when(c("macd") <= c("macd_signal"), F.lit("MACD is below its signal line.")),
        F.when(c("from_high") < -3, F.concat(pct(c("from_high")), F.lit(" from its 52-week high."))), F.when(c("breakdown"), F.lit("Price has broken below its recent range.")),
    ]
    noted = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return rows.withColumns({"support": noted(support), "risks": noted(risks)})


def levels(bars: DataFrame, width: int = 5, most: int = 6, near: float = 0.02, away: float = 0.01) -> DataFrame:
    """(symbol, price, touches, kind): prices at which a series has turned, by clusters of its pivots.

    A pivot is a high or low that no bar within `width` on either side passes.
    Pivots go from low to high; one joins the last cluster if it lies within
    `near` of the last close above its mean. Clusters of two or more touches
    that are over `away` from the close count, the most touched first.
    """
    around = Window.partitionBy("symbol").orderBy("day").rowsBetween(-width, width)
    numbered = Window.partitionBy("symbol").orderBy("day")
    whole = Window.partitionBy("symbol")
    b = bars.withColumns({"_n": F.row_number().over(numbered), "_all": F.count("*").over(whole), "_top": F.max("high").over(around), "_low": F.min("low").over(around)})
    inside = b.filter((F.col("_n") > width) & (F.col("_n") <= F.col("_all") - width))
    pivots = inside.select("symbol", F.explode(F.array(F.when(F.col("high") >= F.col("_top"), F.col("high")), F.when(F.col("low") <= F.col("_low"), F.col("low")))).alias("p")).filter("p IS NOT NULL")
    last = bars.groupBy("symbol").agg(F.max_by("close", "day").alias("last"))
    lists = pivots.groupBy("symbol").agg(F.sort_array(F.collect_list("p")).alias("p")).join(last, "symbol")
    form = "array<struct<sum:double,count:int>>"

    def step(acc: Column, p: Column) -> Column:
        c = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (p - c["sum"] / c["count"] <= F.col("last") * near)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((c["sum"] + p).alias("sum"), (c["count"] + 1).alias("count"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.struct(p.alias("sum"), F.lit(1).alias("count")))))

    found = lists.select("symbol", "last", F.explode(F.aggregate("p", F.array().cast(form), step)).alias("c")).select("symbol", "last", (F.col("c.sum") / F.col("c.count")).alias("price"), F.col("c.count").alias("touches"))
    found = found.filter((F.col("touches") >= 2) & (F.abs(F.col("price") - F.col("last")) / F.col("last") > away))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("touches"), "price"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= most).select("symbol", "price", "touches", F.when(F.col("price") >= F.col("last"), "R").otherwise("S").alias("kind"))


def niches(items: DataFrame, phrases: DataFrame, limit: int = 6) -> DataFrame:
    """(label, count, hosts, members) of phrases (rank, phrase) that two or more items (id, host, text) hold, in order; items may be in several.

    The phrases are the few that a greedy choice has kept.
    """
    words = F.array_join(T.words(F.col("text")), " ")
    rows = items.select("id", "host", F.concat(F.lit(" "), words, F.lit(" ")).alias("_w")).join(F.broadcast(phrases.select("rank", "phrase")), F.expr("contains(_w, concat(' ', phrase, ' '))"))
    by_host = rows.groupBy("rank", "phrase", "host").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    hosts = F.transform(F.array_sort(F.collect_list(F.when(F.col("host").isNotNull(), F.struct((-F.col("n")).alias("n"), "host")))), lambda x: x["host"])
    found = by_host.groupBy("rank", "phrase").agg(F.sum("n").alias("count"), hosts.alias("hosts"), F.sort_array(F.flatten(F.collect_list("ids"))).alias("members")).filter(F.col("count") >= 2)
    return found.orderBy("rank").limit(limit).select(F.col("phrase").alias("label"), "count", "hosts", "members")


def as_list(value: Column) -> Column:
    """A field that should be a list of strings, from JSON text: a list stays, a string is cut at line ends and semicolons, an empty one is no entry."""
    text = F.trim(value)
    parts = F.filter(F.transform(F.split(text, r"\r?\n+|;\s*"), lambda p: F.trim(F.regexp_replace(p, r"^[\s*\-•]+", ""))), lambda p: p != "")
    string = F.when(text == "", F.array().cast("array<string>")).when(F.size(parts) > 1, parts).otherwise(F.array(text))
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(string)


def issues(raw: Column) -> Column:
    """What is wrong with an analysis as JSON text: 'field: problem' in order; none for a valid one."""
    whole = F.try_parse_json(raw).isNull()
    get = lambda f: F.get_json_object(raw, f"$.{f}")
    required = lambda f, x: F.when(x.isNull(), F.lit(f"{f}: required"))
    number = lambda f, x: required(f, x).when(x.try_cast("double").isNull(), F.lit(f"{f}: not a number")).when(~x.try_cast("double").between(0, 100), F.lit(f"{f}: not in 0-100"))
    listed = lambda f, x: required(f, x).when(~x.startswith("["), F.lit(f"{f}: not a list"))
    read = lambda f, test: T.let(get(f), lambda x: test(f, x))  # noqa: E731  # the text is parsed once a field
    checks = [read(f, test) for names, test in ((TEXTS, required), (SCORES, number), (LISTS, listed)) for f in names]
    return F.when(whole, F.array(F.lit("(root): invalid JSON"))).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))


def repaired(answers: DataFrame) -> DataFrame:
    """answers (id, first, second) with the valid one, after one round of repair, or why neither is: chosen, attempt, error."""
    one, two = issues(F.col("first")), issues(F.coalesce("second", F.lit("")))
    rows = answers.withColumn("_1", one).withColumn("_2", F.when(F.size("_1") > 0, two))  # the second is read only where the first fails
    ok1, ok2 = F.size("_1") == 0, F.size("_2") == 0
    return rows.select("id", F.when(ok1, F.col("first")).when(ok2, F.col("second")).alias("chosen"), F.when(ok1, 1).when(ok2, 2).alias("attempt"), F.when(~ok1 & ~ok2, F.array_join("_2", "; ")).alias("error"))


def model_for(requests: DataFrame, models: DataFrame, hints: dict[str, str]) -> DataFrame:
    """(request, id): the model each request means: an id that there is, the newest, or the newest that fits a hint, else a fixed place by age.

    models (id, created) are a vendor's short list.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col("created").alias("c"), F.col("id").alias("id"))), lambda a, b: F.when(a["c"] > b["c"], -1).when(a["c"] < b["c"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    listed = models.select("id", F.coalesce("created", F.lit("")).alias("created")).agg(F.transform(order, lambda x: x["id"]).alias("ids"))
    rows = requests.join(F.broadcast(listed))
    n = F.size("ids")
    place = {"deep": F.lit(0), "fast": n - 1, "balanced": F.floor(n / 2).cast("int")}
    fits = lambda alias: F.get(F.filter("ids", lambda i: i.rlike(hints[alias])), 0) if alias in hints else F.lit(None).cast("string")
    picked = reduce(lambda acc, a: F.when(F.col("request") == a, F.coalesce(fits(a), F.get("ids", place[a]))).otherwise(acc), place, F.when(F.col("request") == "latest", F.get("ids", 0)).when(F.array_contains("ids", F.col("request")), F.col("request")))
    return rows.select("request", picked.alias("id"))


def relaxed(criteria: dict, has_market: bool) -> dict:
    """Screening criteria without those that need market data, where there is none."""
    market = {"priceMin", "priceMax", "volumeMin", "dollarVolumeMin", "spreadMax", "rsiMin", "rsiMax", "relVolMin", "momentumMin"}
    return criteria if has_market else {k: v for k, v in criteria.items() if k not in market}
