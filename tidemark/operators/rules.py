"""Composite scores, risk classes and values out of company facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.math import clamp, round_half_up

#: Weights of the composite score.
WEIGHTS = {"catalyst": 0.2, "confirmation": 0.15, "execution": 0.15, "management": 0.1, "financial": 0.1, "valuation": 0.1, "price": 0.05, "attention": 0.05, "dilution": 0.2, "liquidity": 0.2, "contradiction": 0.25}


def composite(rows: DataFrame) -> DataFrame:
    """rows with overall and confidence from sub-scores of 0-100, sources, severity of contradictions, missing data and disagreement."""
    c = F.col
    confirmation = clamp(c("sources") / 3 * 100, 0, 100)
    positive = sum((F.coalesce(c(k), F.lit(0.0)) * WEIGHTS[k] for k in ("catalyst", "execution", "management", "financial", "valuation", "attention")), confirmation * WEIGHTS["confirmation"])
    positive = positive + F.coalesce("technical", "attention") * WEIGHTS["price"]
    penalty = c("dilution") * WEIGHTS["dilution"] + c("liquidity") * WEIGHTS["liquidity"] + c("severity") * WEIGHTS["contradiction"] * 100
    missing, disagreement = F.least(F.lit(15.0), c("missing") * 3.0), F.coalesce(c("disagreement"), F.lit(0.0)) * 20
    confidence = c("confidence") + F.least(F.lit(15.0), c("sources") * 5.0) - missing - disagreement - c("severity") * 15
    return rows.withColumns({"overall": round_half_up(clamp(positive - penalty - missing - disagreement, 0, 100)), "sure": round_half_up(clamp(confidence, 0, 100))})


def risk_class(rows: DataFrame, price: str = "price") -> DataFrame:
    """Class of a scored row by its confidence and last price; a missing price counts as high."""
    cheap = (F.coalesce(F.col(price), F.lit(99.0)) < 5) | (F.col("sure") < 60)
    return rows.withColumn("risk", F.when(cheap, "high-risk speculative").when(F.col("sure") < 75, "speculative").otherwise("conservative"))


def latest_value(facts: DataFrame, as_of: str) -> DataFrame:
    """(symbol, concept, val): the value whose period ended last by a day; of equal ends the later in the list."""
    rows = facts.filter((F.col("end") <= F.lit(as_of).cast("date")) & F.col("val").isNotNull())
    return rows.groupBy("symbol", "concept").agg(F.max_by("val", F.struct("end", "pos")).alias("val"))


def yearly_growth(facts: DataFrame, as_of: str, forms: str = "^10-K$") -> DataFrame:
    """(symbol, concept, growth): percent between the last two annual values of 300 days or more."""
    annual = facts.filter(F.col("form").rlike(forms) & (F.col("fp") == "FY") & (F.datediff("end", "start") >= 300) & (F.col("end") <= F.lit(as_of).cast("date")))
    last = F.slice(F.sort_array(F.collect_list(F.struct("end", "pos", "val")), False), 1, 2)
    two = annual.groupBy("symbol", "concept").agg(last.alias("l")).filter("size(l) = 2")
    now, prior = F.get("l", 0)["val"], F.get("l", 1)["val"]
    return two.select("symbol", "concept", F.when(prior != 0, F.floor((now - prior) / F.abs(prior) * 1000 + 0.5) / 10).alias("growth"))
