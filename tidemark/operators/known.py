"""As-of joins of many instants a symbol with daily rows: the last row on or before a day, the first on or after it, or both.

A symbol's daily rows are laid out as one array for each block of BLOCK_DAYS
days, with a count for each of the days of how many of the rows lie before it;
a block has what the blocks before it ended with and what those after it begin
with. That is one row a block, of a bounded size, so instants meet it in an
equi-join on symbol and block and look their day up by its count. Instants are
never sorted, windowed or collected: however many a symbol has, the join may
split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import BLOCK_DAYS
from tidemark.session import settle_table


def with_around(instants: DataFrame, rows: DataFrame, at: str, before: dict[str, str], after: dict[str, str], *, key: str = "symbol", day: str = "day", daily: bool = False) -> DataFrame:
    """instants with columns (name in rows: name here) of the key's last row on or before the day `at`, and of its first on or after it.

    All instants stay, each as often as it came: with nulls where nothing is
    known, as for a null key or day. Of several rows of one key and day one is
    taken, the largest by its columns; `daily` says that there is but one, and
    spares a shuffle. `at` is a date or an instant, of which the date counts.
    Names of instants that begin with two underscores are ours.
    """
    names = {c: f"f{i}" for i, c in enumerate(dict.fromkeys([*before, *after]))}
    place = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    block = lambda p: F.floor(p / BLOCK_DAYS)
    facts = rows.filter(F.col(key).isNotNull() & F.col(day).isNotNull()).select(F.col(key).alias("__key"), place(F.col(day)).alias("__p"), *(F.col(c).alias(f) for c, f in names.items()))
    if not daily:
        facts = facts.groupBy("__key", "__p").agg(F.max(F.struct(*names.values())).alias("__f")).select("__key", "__p", "__f.*")
    facts = facts.select("__key", block(F.col("__p")).alias("__block"), F.struct("__p", *names.values()).alias("__f"))
    asked = settle_table(instants.withColumn("__p", place(F.col(at))).withColumn("__block", block(F.col("__p"))))
    # blocks that instants ask for and that hold no rows have only what lies around them
    places = asked.filter(F.col(key).isNotNull() & F.col("__block").isNotNull()).select(F.col(key).alias("__key"), "__block").distinct()
    # by key alone, as the neighbours below are: one shuffle of a key's days, of which there are no more than the calendar has
    every = facts.unionByName(places, allowMissingColumns=True).repartition("__key").groupBy("__key", "__block").agg(F.sort_array(F.collect_list("__f")).alias("__facts"), F.max(F.col("__f").isNull()).alias("__asked"))
    ends = every.withColumn("__head", F.get("__facts", F.lit(0))).withColumn("__tail", F.get("__facts", F.size("__facts") - 1))
    beside = lambda side, end: F.expr(f"{side}({end}) IGNORE NULLS OVER (PARTITION BY __key ORDER BY __block)")
    heads = ends.withColumn("__last", beside("lag", "__tail")).withColumn("__next", beside("lead", "__head")).filter("__asked")
    # the n-th bound less the one before: days of the block with n rows before them; one day more than the block has
    bounds = F.concat(F.array(F.lit(-1)), F.transform("__facts", lambda f: (f["__p"] - F.col("__block") * BLOCK_DAYS).cast("int")), F.array(F.lit(BLOCK_DAYS)))
    counts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__facts")), lambda n: F.array_repeat(n, F.get("__bounds", n + 1) - F.get("__bounds", n))))
    known = heads.withColumn("__bounds", bounds).select("__key", F.col("__block").alias("__of"), "__last", "__next", "__facts", counts.alias("__counts"))
    joined = asked.join(known, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__of")), "left")
    of_day = (F.col("__p") - F.col("__block") * BLOCK_DAYS).cast("int")
    upto, since = F.coalesce(F.get("__facts", F.get("__counts", of_day + 1) - 1), F.col("__last")), F.coalesce(F.get("__facts", F.get("__counts", of_day)), F.col("__next"))
    out = joined.withColumn("__upto", upto).withColumn("__since", since)
    return out.select(*instants.columns, *(F.col(f"__upto.{names[c]}").alias(n) for c, n in before.items()), *(F.col(f"__since.{names[c]}").alias(n) for c, n in after.items()))


def with_known(instants: DataFrame, rows: DataFrame, at: str, columns: dict[str, str], *, key: str = "symbol", day: str = "day", forward: bool = False) -> DataFrame:
    """As with_around, of one side: the last row on or before the day; with forward, the first on or after it."""
    return with_around(instants, rows, at, {} if forward else columns, columns if forward else {}, key=key, day=day)
