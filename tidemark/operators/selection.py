"""Exact order statistics of a whole column without sorting it or holding it in a task.

A rank is narrowed down by counting: each round takes two values of the
column that are likely to enclose the rank, from a mergeable sketch of the
range that is left, counts the rows below, between and above them exactly, and
keeps the part that holds the rank. A sketch that errs costs a round and no
result. Only a handful of numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle_table

#: Rows that one task sorts in the end, and the sketch's accuracy.
SMALL, ACCURACY = 65_536, 10_000


def at_rank(values: DataFrame, rank: int, small: int = SMALL, accuracy: int = ACCURACY) -> float:
    """The value number `rank` from 0, ascending, of the column x, which holds no nulls and more than `rank` rows; NaN comes last."""
    rest, size, x = values.select("x"), None, F.col("x")
    while True:
        size = rest.count() if size is None else size
        if size <= small:
            return rest.agg(F.sort_array(F.collect_list("x"))[rank]).first()[0]
        share, margin = (rank + 0.5) / size, 2 / accuracy
        at = F.percentile_approx("x", [max(0.0, share - margin), min(1.0, share + margin)], accuracy)
        lo, hi = rest.agg(at).first()[0]
        below, inside, least, most = rest.agg(F.count_if(x < lo), F.count_if((x >= lo) & (x <= hi)), F.min(F.when(x >= lo, x)), F.max(F.when(x <= hi, x))).first()
        if rank < below:
            rest, size = rest.filter(x < lo), below
        elif rank >= below + inside:
            rest, rank, size = rest.filter(x > hi), rank - below - inside, size - below - inside
        elif least == most:
            return least
        elif inside < size:
            rest, rank, size = rest.filter((x >= lo) & (x <= hi)), rank - below, inside
        else:  # a sketch that tells nothing, as where two values hold nearly all rows: part them at the lower one
            ties = rest.filter(x == lo).count()
            if rank < ties:
                return lo
            rest, rank, size = rest.filter(x > lo), rank - ties, size - ties


def median(rows: DataFrame, column: str, small: int = SMALL, accuracy: int = ACCURACY) -> float | None:
    """The middle value of a column, or the mean of the two in the middle; nulls don't count, and without a value it is null."""
    values = settle_table(rows.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL"))
    n = values.count()
    if not n:
        return None
    low = at_rank(values, (n - 1) // 2, small, accuracy)
    if n % 2:
        return low
    upto, above = values.agg(F.count_if(F.col("x") <= low), F.min(F.when(F.col("x") > low, F.col("x")))).first()
    return (low + (low if upto > n // 2 else above)) / 2
