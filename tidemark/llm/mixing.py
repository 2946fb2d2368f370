"""Mixing sources to target weights by budgets that flow down a tree.

The tree's levels are columns (domain, language, source). A node shares its
budget among its children by their weights; a child can't take more than its
tokens times the epochs allowed, and what it can't take goes to its siblings
first. Since a node is never given more than all below it can take, only what
a whole family lacks reaches the family's own siblings. A leaf reads seeded
epochs, each its documents in another order, and takes the prefix of that
stream that its budget pays for, to the token: the document at the edge gives
the tokens that are left. What a token is, the caller says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a leaf's order is cut in (hexadecimal digits of the order's hash): only one of them is cut by the budget.
PART = 3
NONE = "?"
#: Leaves whose budgets are broadcast (some 100 bytes each); more are joined by a shuffle, which Spark splits where a leaf is hot.
MOST_LEAVES = 200_000
WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Words as a text's tokens: runs of signs other than ASCII space and controls 9-13; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """The weight of a node: by its value at its level; the entry '*' for others, else 1."""
    own = weights.get(level, {})
    other = F.lit(own.get("*", 1))
    return reduce(lambda c, kv: F.when(F.col(level) == kv[0], kv[1]).otherwise(c), [kv for kv in own.items() if kv[0] != "*"], other).cast("long")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], total: Column, epochs: int) -> DataFrame:
    """(levels, tokens, budget) from (levels, tokens): the leaves' budgets. One row a leaf all the way."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    given = leaves.agg(F.least(F.sum("cap"), total).alias("budget"))
    parents: list[str] = []
    for i, level in enumerate(levels):
        node = levels[: i + 1]
        nodes = leaves.groupBy(*node).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(level, weights))
        nodes = nodes.join(given, parents) if parents else nodes.crossJoin(given)  # given is one row there
        order = Window.partitionBy(*parents, F.lit(0)).orderBy(F.col("cap") / F.col("w"), level)
        sums = {"before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "after": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))}
        nodes = nodes.withColumns(sums)
        wide = {c: F.col(c).cast(WIDE) for c in ("cap", "w", "before", "after", "budget")}
        nodes = nodes.withColumn("full", wide["cap"] * wide["after"] + wide["before"] * wide["w"] <= wide["budget"] * wide["w"])
        family = Window.partitionBy(*parents, F.lit(0))
        nodes = nodes.withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))).withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(family))
        share = F.expr(f"(cast(w as {WIDE}) * cast(budget - taken as {WIDE})) div cast(open as {WIDE})")
        given = nodes.select(*node, F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share)).cast("long").alias("budget"))
        parents = node
    return leaves.drop("cap").join(given, levels)


def mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: float, epochs: int, seed: str, tokens: Column, doc_id: str = "doc_id", then: Column | None = None) -> DataFrame:
    """docs with tokens, leaf_budget, copies (how often each document is read whole) and part_tokens (how many of its tokens are read once more).

    The whole budget is floor(share * all tokens), or what the leaves can give
    if that is less; the leaves' copies and parts add up to it. Null levels
    are the node '?'. A document of no tokens is read as often as its place in
    the order says; a leaf without tokens is not read. Rows with equal ids
    stand next to each other in every order, by tokens and by `then` (what
    still ties is alike in all that the order uses); an empty table gives an
    empty table; columns named as a result are replaced.
    """
    then = F.lit("") if then is None else then
    node = [f"_l{i}" for i in range(len(levels))]
    keep = [c for c in docs.columns if c not in ("tokens", "leaf_budget", "copies", "part_tokens")]
    rows = docs.select(*keep, tokens.alias("tokens"), then.alias("_then")).withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for n, c in zip(node, levels, strict=True)})
    own = {n: weights.get(c, {}) for n, c in zip(node, levels, strict=True)}
    leaves = rows.groupBy(*node).agg(F.sum("tokens").alias("tokens"))
    # one row: the grand total
    whole = F.floor(F.sum("tokens") * share).cast("long")
    plan = budgets(leaves, node, own, whole, epochs).withColumnRenamed("tokens", "leaf_tokens").withColumnRenamed("budget", "leaf_budget")
    plan = plan.withColumn("epoch", F.expr("CASE WHEN leaf_tokens > 0 THEN leaf_budget div leaf_tokens ELSE 0 END")).withColumn("rest", F.expr("leaf_budget - epoch * leaf_tokens"))

    few = leaves.count() <= MOST_LEAVES
    side = F.broadcast if few else lambda df: df
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col(doc_id).cast("string")))
    rows = rows.join(side(plan), node).withColumn("_place", place).withColumn("_part", F.substring("_place", 1, PART))
    parts = rows.groupBy(*node, "_part", "rest").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy(*node).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** PART rows a leaf
    parts = parts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = parts.filter("_before < rest").groupBy(*node).agg(F.max(F.struct("_part", "_before")).alias("edge"))
    rows = rows.join(side(edge), node, "left")

    names = [*keep, "tokens", "leaf_budget"]
    inside = rows.filter(F.col("edge").isNull() | (F.col("_part") != F.col("edge._part")))
    inside = inside.select(*names, (F.col("epoch") + F.coalesce((F.col("_part") < F.col("edge._part")).cast("long"), F.lit(0))).alias("copies"), F.lit(0).cast("long").alias("part_tokens"))
    cut = rows.filter(F.col("_part") == F.col("edge._part"))
    ahead = Window.partitionBy(*node, "_part").orderBy("_place", "tokens", "_then").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_left", F.col("rest") - F.col("edge._before") - F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    fits = (F.col("_left") > 0) & (F.col("tokens") <= F.col("_left"))
    cut = cut.select(*names, (F.col("epoch") + fits.cast("long")).alias("copies"), F.when(~fits & (F.col("_left") > 0), F.col("_left")).otherwise(F.lit(0)).cast("long").alias("part_tokens"))
    return inside.unionByName(cut)
