"""Recursive series over symbols' bars as parallel scans of affine maps, all in Spark's own operators.

An exponential mean is y = r * y' + u: each bar is an affine map of the mean
before it, and such maps compose. A symbol's days are cut into blocks of
BLOCK_DAYS; the maps of a block are composed by a running sum of u / r^i, so
every block is a task's own work, however long or busy a symbol's history is.
The blocks' sums, a row each, are folded in order into the mean with which
each block begins, and a bar's mean is its block's own part and r^j times
that. A mean's first value is the plain mean of n bars: weights of the first
n bars that undo the decay up to there give just that, so the start needs no
case of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle_table

#: Days of a block, and so its bars at most: small enough that r^-j is far from overflow for any n of 2 or more.
BLOCK_DAYS = 128


@dataclass(frozen=True)
class Mean:
    """An exponential mean of `value` from the symbol's bar number `first` on: null before its n-th value."""

    value: Column
    n: int
    alpha: float
    first: int = 0


def numbered(bars: DataFrame, value: str = "close") -> DataFrame:
    """(symbol, day, x, block, j, k, previous): a bar's number in its block from 1 and in its symbol from 0, and the value before it.

    A symbol has one bar a day. Bars without a value, day or symbol are left out. The
    last value and the count of each block reach the next ones as a row a block.
    """
    block = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / BLOCK_DAYS)
    rows = settle_table(bars.filter(F.col(value).isNotNull() & F.col("symbol").isNotNull() & F.col("day").isNotNull()).select("symbol", "day", F.col(value).cast("double").alias("x"), block.alias("block")))
    order = Window.partitionBy("symbol").orderBy("block")
    sizes = rows.groupBy("symbol", "block").agg(F.count("*").alias("m"), F.max_by("x", "day").alias("last"))
    heads = sizes.select("symbol", "block", F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag("last").over(order).alias("before"))
    inside = Window.partitionBy("symbol", "block").orderBy("day")
    placed = rows.withColumns({"j": F.row_number().over(inside), "_lag": F.lag("x").over(inside)}).join(heads, ["symbol", "block"])
    return settle_table(placed.select("symbol", "day", "x", "block", "j", (F.col("base") + F.col("j") - 1).alias("k"), F.coalesce("_lag", "before").alias("previous")))


def with_means(rows: DataFrame, means: dict[str, Mean]) -> DataFrame:
    """rows, which are those of `numbered`, with a column for each mean."""
    inside = Window.partitionBy("symbol", "block").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda base, e: F.pow(F.lit(base), e)
    own = {}
    for name, m in means.items():
        r, k = 1 - m.alpha, F.col("k") - m.first
        if not r:
            own[f"_{name}"] = F.when(k >= 0, m.value)
            continue
        u = F.when(k < 0, 0.0).when(k < m.n, m.value / m.n * power(r, k - m.n + 1)).otherwise(m.value * m.alpha)
        own[f"_{name}"] = F.sum(u * power(r, -F.col("j"))).over(inside) * power(r, F.col("j"))
    rows = rows.withColumns(own)
    ends = rows.groupBy("symbol", "block").agg(F.count("*").alias("m"), *(F.max_by(c, "j").alias(c) for c in own))
    blocks = ends.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("block", "m", *own))).alias("blocks"))  # a row for BLOCK_DAYS days

    def carried(name: str, r: float) -> Column:
        grow = lambda held, b: F.concat(held, F.array(F.element_at(held, -1) * power(r, b["m"]) + b[f"_{name}"]))
        return F.aggregate("blocks", F.array(F.lit(0.0)), grow).alias(f"_{name}_in")

    folded = blocks.select("symbol", *(carried(name, 1 - m.alpha) for name, m in means.items()), F.posexplode("blocks").alias("_at", "_block"))
    heads = folded.select("symbol", F.col("_block.block").alias("block"), *(F.get(f"_{n}_in", F.col("_at")).alias(f"_{n}_in") for n in means))
    value = {n: F.when(F.col("k") - m.first >= m.n - 1, F.col(f"_{n}") + F.col(f"_{n}_in") * power(1 - m.alpha, F.col("j")) if m.alpha != 1 else F.col(f"_{n}")) for n, m in means.items()}
    return rows.join(heads, ["symbol", "block"]).withColumns(value).drop(*own, *(f"_{n}_in" for n in means))


def exponential(value: Column, n: int, first: int = 0) -> Mean:
    return Mean(value, n, 2 / (n + 1), first)


def wilder(value: Column, n: int, first: int = 0) -> Mean:
    return Mean(value, n, 1 / n, first)
