"""Order-dependent folds: packing of sentences, rolling captions, greedy choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle, settle_table

#: Phrases that are gone through at first, and next, before all are.
FIRSTS = (4096, 65_536)


def pack_sentences(parts: Column, size: int = 600) -> Column:
    """Paragraphs: a sentence joins the last one while that is shorter than `size`."""
    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, s)))
        return F.when((F.size(acc) > 0) & (F.char_length(F.coalesce(last, F.lit(""))) < size), grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def strip_roll(cues: Column) -> Column:
    """Captions without the roll: a cue that begins with the last kept one replaces it; of any other the longest run of words that ends the last kept one is cut off its front, and what is left is added."""
    def step(acc: Column, s: Column) -> Column:
        last = F.coalesce(F.element_at(acc, -1), F.lit(""))
        kept = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        old, new = F.split(last, " "), F.split(s, " ")
        most = F.least(F.size(old), F.size(new))
        shared = F.filter(F.sequence(F.lit(0), most), lambda n: F.slice(old, F.size(old) - n + 1, n) == F.slice(new, F.lit(1), n))
        rest = F.trim(F.array_join(F.slice(new, F.array_max(shared) + 1, F.size(new)), " "))
        return F.when(F.size(acc) == 0, F.array(s)).when(s.startswith(last), F.concat(kept, F.array(s))).when(rest == "", acc).otherwise(F.concat(acc, F.array(rest)))

    return F.aggregate(F.filter(cues, lambda c: c != ""), F.array().cast("array<string>"), step)


def greedy_phrases(candidates: DataFrame, limit: int = 12) -> DataFrame:
    """(rank, phrase, n): the most frequent phrases, none of which holds or is held by one kept before it.

    Candidates (phrase, words, n), each phrase once, go in the order of
    count, words and letters. A phrase clashes with the runs of its words
    that are candidates too. In rounds, a phrase that comes before all that
    it still clashes with is kept and those are dropped, which keeps just
    what going through them one by one would. Rounds end when `limit` kept
    phrases come before all that are open.

    What is kept depends only on phrases that come before it, so the first
    FIRSTS of them are gone through alone; where they don't give `limit`
    phrases, the next number of them is, and in the end all are.
    """
    key = F.struct((-F.col("n")).alias("n"), (-F.col("words")).alias("words"), "phrase").alias("key")
    nodes = settle_table(candidates.filter("phrase IS NOT NULL").select("phrase", key))
    total, kept = nodes.count(), None
    for first in FIRSTS:
        if first < total and (kept is None or kept.count() < limit):
            kept = _kept(settle(nodes.orderBy("key").limit(first)), limit)
    if kept is None or kept.count() < limit:
        kept = _kept(nodes, limit)
    rank = F.row_number().over(Window.orderBy("key"))  # `limit` rows
    return kept.select(rank.alias("rank"), F.col("key.phrase").alias("phrase"), (-F.col("key.n")).alias("n"))


def _kept(nodes: DataFrame, limit: int) -> DataFrame:
    """The keys of the first `limit` phrases that greedy choice keeps of nodes (phrase, key)."""
    w = F.split("phrase", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.size(w) - i + 1), lambda n: F.array_join(F.slice(w, i, n), " "))))
    held = nodes.select(F.col("phrase").alias("a"), F.col("key").alias("a_key"), F.explode(F.array_distinct(runs)).alias("b")).filter("a <> b")
    held = held.join(nodes.select(F.col("phrase").alias("b"), F.col("key").alias("b_key")), "b")
    links = settle_table(held.select("a", "a_key", "b", "b_key").unionByName(held.select(F.col("b").alias("a"), F.col("b_key").alias("a_key"), F.col("a").alias("b"), F.col("a_key").alias("b_key"))))
    free = nodes.join(links.select(F.col("a").alias("phrase")), "phrase", "left_anti").select("key")
    kept = settle(free.orderBy("key").limit(limit))
    while not links.isEmpty():
        first = settle(links.groupBy("a", "a_key").agg(F.min("b_key").alias("least")).filter("a_key < least").select("a", F.col("a_key").alias("key")))
        gone = first.select("a").unionByName(links.join(first, "a", "left_semi").select(F.col("b").alias("a"))).distinct()
        left = links.join(gone, "a", "left_anti")
        # a phrase whose last clash was dropped is free now, and kept
        open_ = settle_table(left.join(gone.select(F.col("a").alias("b")), "b", "left_anti"))
        alone = left.select("a", F.col("a_key").alias("key")).distinct().join(open_, "a", "left_anti").select("key")
        kept = settle(kept.unionByName(first.select("key")).unionByName(alone).orderBy("key").limit(limit))
        links = open_
        ahead = links.agg(F.min("a_key").alias("next")).join(kept.agg(F.count("*").alias("k"), F.max("key").alias("last"))).filter(F.col("next").isNull() | ((F.col("k") == limit) & (F.col("last") < F.col("next"))))  # a row on each side
        if not ahead.isEmpty():
            break
    return kept
