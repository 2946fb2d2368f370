"""Append-only ledgers, claims and merges: each as a new table made from the old one and what arrives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balances(ledger: DataFrame, since: str) -> DataFrame:
    """(user_id, balance, spent): all movements, and what was spent since an instant."""
    recent = (F.col("delta") < 0) & (F.col("created") >= F.lit(since).cast("timestamp"))
    return ledger.groupBy("user_id").agg(F.sum("delta").alias("balance"), (-F.coalesce(F.sum(F.when(recent, F.col("delta"))), F.lit(0))).alias("spent"))


def running_balance(ledger: DataFrame) -> DataFrame:
    """Each movement with its account's balance after it."""
    w = Window.partitionBy("user_id").orderBy("created", "id").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("balance", F.sum("delta").over(w))


def affordable(ledger: DataFrame) -> DataFrame:
    """Spends that the balance before them covers."""
    w = Window.partitionBy("user_id").orderBy("created", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("delta").over(w), F.lit(0))
    return ledger.withColumn("before", before).filter((F.col("delta") < 0) & (F.col("before") >= -F.col("delta")))


def throttle(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Each event with the number of its user's events in the window up to it, and whether that is within the limit."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double").cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("allowed", F.col("in_window") <= limit)


def append_new(table: DataFrame, arriving: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The table and those arriving rows whose key it doesn't hold, one a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = arriving.withColumn("_rank", rank).filter("_rank = 1").drop("_rank").join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh)


def merge(table: DataFrame, arriving: DataFrame, key: str, keep_old: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """Upsert by key: new values win; columns in keep_old stay as first written, those in fill stay where the new value is missing."""
    names = [c for c in table.columns if c != key]
    old, new = table.select(key, F.lit(True).alias("_had"), *[F.col(c).alias(f"_o_{c}") for c in names]), arriving.select(key, F.lit(True).alias("_came"), *[F.col(c).alias(f"_n_{c}") for c in names])
    both = old.join(new, key, "full_outer")

    def pick(c: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in keep_old:
            return F.when(F.col("_had"), o).otherwise(n)
        if c in fill:
            return F.coalesce(n, o)
        return F.when(F.col("_came"), n).otherwise(o)

    return both.select(key, *[pick(c).alias(c) for c in names])


def claim(candidates: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key nobody took: at most one each."""
    return candidates.dropDuplicates(keys).join(taken.select(*keys), keys, "left_anti")


def add_within(table: DataFrame, arriving: DataFrame, owner: str, item: str, cap: int, order: Column) -> DataFrame:
    """Rows that may be added: not there yet, in order, as far as the owner's cap has room."""
    fresh = arriving.dropDuplicates([owner, item]).join(table.select(owner, item), [owner, item], "left_anti")
    held = table.groupBy(owner).agg(F.count("*").alias("_held"))
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(order))
    placed = fresh.withColumn("_rank", rank).join(held, owner, "left")
    return placed.filter(F.col("_rank") <= cap - F.coalesce("_held", F.lit(0))).drop("_rank", "_held")
