"""How the sources of a language differ in their words: iceberg refinement of terms, then exact divergences.

A term is kept for a language if enough of its documents hold it. Most
different terms are rare, so the kept ones are found by prefixes: the
documents that hold each prefix of 4 bytes are counted, those under the
threshold are dropped, the others are extended to 8 bytes, 16 and so on,
until all that is left are complete terms. A term ends in a byte that no term
holds, which tells a complete one from a prefix. A document's terms are
sorted in its task, and each says up to which level its prefix is that of the
term before; so a level is a filter and one count per prefix, combined before
its shuffle, and what a dropped prefix would have cost is never sent.

The prefixes that a level keeps reach the next one as numbers of buckets:
they are broadcast, and there are at most BUCKETS of them whatever the input.
Two prefixes in one bucket cost a count that falls at the next threshold,
never a result; every number is exact.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.session import settle, settle_table

#: Rows that a task adds up at a time, and rows of a table with one row a language or group that are broadcast at most; more are joined by a shuffle.
BLOCK, MOST_SHARED = 1_500_000, 1_000_000
#: Runs of ASCII letters and of bytes beyond ASCII, in bytes of which A-Z are lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Ends a complete term; no term holds it.
END = "."
#: Numbers of buckets that a level's prefixes are broadcast as: 16 bytes each at most. Bytes of the first prefixes. The whole of all shares.
BUCKETS, FIRST, ONE = 1 << 22, 4, 1_000_000_000


def strings(values: list[bytes]) -> pa.StringArray:
    """The values, which are UTF-8, as one array."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int64)
    return pa.LargeStringArray.from_buffers(len(values), pa.py_buffer(ends), pa.py_buffer(b"".join(values))).cast(pa.string())


def shared_levels(terms: pa.Array, first: np.ndarray) -> np.ndarray:
    """At how many levels each term has the prefix of the one before; `first` marks those that have none before. Neighbours differ."""
    shared, same, length = np.zeros(len(terms), np.int32), ~first, FIRST
    raw = terms.cast(pa.binary())
    while same.any():
        own = pc.binary_slice(raw, 0, length)
        same = same & np.r_[False, pc.equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)]
        shared += same
        length *= 2
    return shared


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, shared, docs, n): how many documents of a group hold a term after one with which it shares so many levels, and how often.

    A document's terms are those of its whole text, in order. A task adds up
    some BLOCK of its rows at a time; all further sums are Spark's. A text
    without terms counts as one of the term ''. Nulls read as ''.
    """
    keys, names = ["lang", "source", "term", "shared"], ["lang", "source", "term", "shared", "docs", "n"]

    def work(batches):
        held, size = [], 0

        def summed():
            return pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "count"), ("n", "sum")]).rename_columns(names).to_batches()

        for piece in slices(batches):
            terms, counts, sizes = [], [], []
            for t in piece.column(2).to_pylist():
                found = Counter(TERM.findall(t.lower())) or {b"": 0}
                own = sorted(found)
                terms += own
                counts += map(found.__getitem__, own)
                sizes.append(len(own))
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            first = np.zeros(len(terms), bool)
            first[np.cumsum([0, *sizes[:-1]])] = True
            column = strings(terms)
            held.append(pa.table([piece.column(0).take(row), piece.column(1).take(row), column, pa.array(shared_levels(column, first)), pa.array(counts, pa.int64())], [*keys, "n"]))
            size += len(terms)
            if size > BLOCK:
                yield from summed()
                held, size = [], 0
        if held:
            yield from summed()

    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(read(lang), read(source), read(text).cast("binary")).mapInArrow(work, "lang string, source string, term string, shared int, docs long, n long")


def _bucket(*keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def _cut(term: Column, length: int) -> Column:
    """The first bytes of a term."""
    return F.substring(term.cast("binary"), 1, length)


def kept_terms(rows: DataFrame, least: int = 10) -> DataFrame:
    """(lang, term, docs) of the terms that at least `least` documents of a language hold; rows are those of term_counts."""
    found, before, level, length = [], None, 0, FIRST
    while True:
        new = rows.filter((F.col("term") != "") & (F.col("shared") <= level))
        if before is not None:
            new = new.filter(F.octet_length("term") >= length // 2).withColumn("bucket", _bucket("lang", _cut(F.col("term"), length // 2))).join(F.broadcast(before), "bucket", "left_semi")
        prefix = _cut(F.concat("term", F.lit(END)), length)
        kept = settle(new.groupBy("lang", prefix.alias("prefix")).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least))
        whole = F.substring("prefix", -1, 1) == F.lit(END).cast("binary")
        found.append(kept.filter(whole).select("lang", F.rtrim(F.col("prefix").cast("string"), F.lit(END)).alias("term"), "docs"))
        before = kept.filter(~whole).select(_bucket("lang", "prefix").alias("bucket")).distinct()
        if before.isEmpty():
            break
        level, length = level + 1, length * 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def counted(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences in each group's documents of the terms its language keeps; rows are those of term_counts."""
    near = kept.select(_bucket("lang", "term").alias("bucket")).distinct()
    each = rows.filter("term <> ''").withColumn("bucket", _bucket("lang", "term")).join(F.broadcast(near), "bucket", "left_semi")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"], "left_semi")


def _share(n: str, total: str, size: str) -> Column:
    """1 + floor(ONE * (n + 2) / (total + 2 * size)), exact for counts of any size; a language without terms has no shares."""
    return F.expr(f"1 + (CAST({ONE} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) DIV CAST({total} + 2 * {size} AS DECIMAL(20, 0))").cast("long")


def _differs(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) DIV (({p}) + ({q}))"


def _few(df: DataFrame) -> DataFrame:
    """A settled table, broadcast if it is small: no language's rows then meet in one task."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= MOST_SHARED else df


def audit(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how each (lang, source) group's shares of the kept terms differ.

    A share is 1 + floor(1e9 * (n + 2) / (N + 2 V)): n the term's occurrences
    in the group, N those of all kept terms, V their number in the language.
    Two shares differ by floor((p - q)^2 / (p + q)). Part `pair` sums that
    over all kept terms for every other source of the language; part `term`
    has the `top` terms that the group holds more of, by share, than the
    language. Ranks go by value from the highest, then by item in the order of its UTF-8.

    Nulls read as ''. Each row is a document, so repeated rows and rows of
    one id count each; a group without kept terms has part `pair` alone, and
    a language of one source no pairs. An empty table gives no rows. Columns
    other than the three are not read.

    Terms that two groups both lack differ alike, as do those that one of
    them lacks at one count of the other: these are counted, not listed. Only
    terms that both hold are joined, by (lang, term), once for two sources.
    """
    rows = settle_table(term_counts(docs, text, lang, source))
    kept = settle(kept_terms(rows, least))
    counts = settle(counted(rows, kept))

    sizes = _few(kept.groupBy("lang").agg(F.count("*").alias("size")))
    totals = _few(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"))
    groups = _few(groups.withColumn("p0", F.when(F.col("size") > 0, F.expr(f"1 + (CAST({ONE} AS DECIMAL(10, 0)) * 2) DIV CAST(total + 2 * size AS DECIMAL(20, 0))")).cast("long")))
    held = settle(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", _share("n", "total", "size").alias("p"), "p0"))

    # the two sources of a pair are named in both orders; a, b: the shares where neither holds a term
    pairs = groups.select("lang", "source", F.col("p0").alias("a"), "size").join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b")), "lang").filter("source <> item")
    alone = held.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    alone = alone.join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b")), "lang").filter("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.expr(f"sum(k * ({_differs('p', 'b')} - {_differs('p0', 'b')}))").alias("one"))
    left = held.select("lang", "term", "source", "p", F.col("p0").alias("a"))
    right = held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("b"))
    both = left.join(right, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(
        F.expr(f"sum({_differs('p', 'q')} - {_differs('p', 'b')} - {_differs('a', 'q')} + {_differs('a', 'b')})").alias("two")
    )
    swapped = lambda d, c: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), c)
    key = ["lang", "source", "item"]
    pairs = pairs.join(alone, key, "left").join(swapped(alone, F.col("one").alias("other")), key, "left").join(both.unionByName(swapped(both, F.col("two"))), key, "left")
    value = F.expr(f"coalesce(size * ({_differs('a', 'b')}), 0)") + sum((F.coalesce(c, F.lit(0)) for c in ("one", "other", "two")), F.lit(0))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(best))

    overall = counts.groupBy("lang", "term").agg(F.sum("n").alias("m"))
    sums = _few(totals.groupBy("lang").agg(F.sum("total").alias("overall")).join(sizes, "lang"))
    overall = overall.join(sums, "lang").select("lang", "term", _share("m", "overall", "size").alias("q"))
    terms = held.join(overall, ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_differs("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
