"""Row frames over long histories: windows by blocks of rows, each with the rows before it that its frames reach.

A window by symbol is one task's work, however long the symbol's history is.
Here a symbol's rows are numbered in order without such a window, cut into
blocks of BLOCK_ROWS, and the last rows of a block are copied into the next
as its halo. A frame of at most `reach` rows then finds in its own block all
that it would find in the symbol, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import BLOCK_DAYS
from tidemark.session import settle_table

#: Rows of a block besides its halo.
BLOCK_ROWS = 1024

#: Columns of rows that are in blocks: the block, the row's number in its symbol from 0, and whether the row is the block's own or of its halo.
BLOCK, NUMBER, OWN = "_block", "_number", "_own"


def frame() -> Window:
    """The order of a symbol's rows in a block."""
    return Window.partitionBy("symbol", BLOCK).orderBy("day")


def back(reach: int) -> Window:
    """The last `reach` rows, the row itself included."""
    return frame().rowsBetween(1 - reach, 0)


def full(value: Column, n: int) -> Column:
    """A value over the last n rows, null before the symbol's n-th."""
    return F.when(F.col(NUMBER) >= n - 1, value)


def numbered(bars: DataFrame) -> DataFrame:
    """bars with NUMBER. Counts of (symbol, BLOCK_DAYS days) carry it on from one stretch to the next, a row a stretch.

    A symbol has one row a day; a row without a day comes first, rows without a symbol are one symbol.
    """
    rows = settle_table(bars.withColumn("_stretch", F.coalesce(F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / BLOCK_DAYS), F.lit(-(2**40)))))
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("symbol").alias("_of"), F.col("_stretch").alias("_at")).agg(F.count("*").alias("_n"))
    heads = counts.select("_of", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("symbol", "_stretch").orderBy("day"))
    placed = rows.withColumn("_j", inside).join(heads, F.col("symbol").eqNullSafe(F.col("_of")) & (F.col("_stretch") == F.col("_at")))
    return placed.withColumn(NUMBER, F.col("_base") + F.col("_j") - 1).drop("_stretch", "_of", "_at", "_j", "_base")


def in_blocks(bars: DataFrame, reach: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows in blocks of `rows`, and copies of those that frames of `reach` rows look back to from later blocks."""
    at, ahead = F.floor(F.col(NUMBER) / rows), F.floor((F.col(NUMBER) + reach - 1) / rows)
    copies = numbered(bars).withColumn(BLOCK, F.explode(F.sequence(at, ahead)))
    return copies.withColumn(OWN, F.col(BLOCK) == at)


def recent(bars: DataFrame, reach: int) -> DataFrame:
    """The last `reach` rows of each symbol as one block: enough for the frames of its last row.

    Ranks above `reach` are dropped before rows are shuffled, so a long history sends no more than that from a task.
    """
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))
    last = bars.withColumn("_rank", rank).filter(F.col("_rank") <= reach).drop("_rank").withColumns({BLOCK: F.lit(0), OWN: F.lit(True)})
    return last.withColumn(NUMBER, F.row_number().over(frame()) - 1)


def own(rows: DataFrame) -> DataFrame:
    """The rows once each, without the columns of blocks."""
    return rows.filter(OWN).drop(BLOCK, NUMBER, OWN)


def framed(reach: Callable[..., int] | int):
    """A function of rows in blocks made into one of plain bars. Rows that are in blocks already stay so: their reach must be enough for all.

    reach: rows that its frames look back, the row itself included, or a function of its further arguments that says it.
    """

    def wrap(fn):
        @wraps(fn)
        def run(bars: DataFrame, *args, **named) -> DataFrame:
            if BLOCK in bars.columns:
                return fn(bars, *args, **named)
            return own(fn(in_blocks(bars, reach(*args, **named) if callable(reach) else reach), *args, **named))

        return run

    return wrap
