"""I-Match document fingerprints, with DataFrame functions only.

Terms whose inverse document frequency lies in a band form the lexicon. A
text's fingerprint hashes its sorted distinct lexicon terms, once whole and
once for each of several randomised sub-lexicons of different density, so
that texts which share much agree on some of them. The lexicon holds every
term of the band and is looked up in a string of bits that each task gets
with the plan, SLOTS slots a term and PROBES slots looked at; one in some
700 terms outside the band is let in by others' slots, alike in every text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of the lexicon for each of its terms, and slots held by a byte: seven, so that each byte is an ASCII sign.
SLOTS, BITS = 16, 7
#: Slots that a term sets and that all must be set to find it; none but the first is looked at for most terms outside.
PROBES = 5
SHIFT = 11
#: Sub-lexicons: the first of the hash bits that must be zero, and how many of them: 2^-bits of the lexicon each.
FIRSTS, DENSITIES = range(0, 56, 7), (4, 5, 6, 7, 8, 9, 10)
#: Documents of a run of ids that a task looks at together; STEPS * STEPS runs at most.
RUN, STEPS = 1000, 256


def terms(text: Column) -> Column:
    """Distinct hashes of a text's lower-case words of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", low: float = 0.15, high: float = 0.85) -> bytes:
    """A bit per slot, 1 where a term of the band falls: ln(N / df) / ln(N) in low..high.

    df counts all documents. The driver gets the band's hashes as Arrow
    batches, 8 bytes a term; the string has 16 / 7 bytes a term and stands in the plan once for each text.
    """
    n = docs.count()
    held = np.zeros(0, dtype=np.int64)
    if n > 1:
        df = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(F.lit(float(n)) / F.col("df")) / math.log(n)
        held = df.filter(idf.between(low, high)).select("term").toArrow()["term"].to_numpy()
    table = np.zeros(max(1, -(-SLOTS * len(held) // BITS)), dtype=np.uint8)
    with np.errstate(over="ignore"):
        for i in range(PROBES):
            slot = (held ^ (held >> np.int64(SHIFT * i)) if i else held) % (len(table) * BITS)
            np.bitwise_or.at(table, slot // BITS, np.left_shift(1, slot % BITS).astype(np.uint8))
    return table.tobytes()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def marks(text: Column, lex: bytes) -> Column:
    """The sorted hashes that stand for a text: lexicon terms, else all terms, else the text itself."""

    def probe(table: Column, h: Column) -> Column:
        slot = F.pmod(h, F.lit(len(lex) * BITS))
        byte = F.ascii(F.substr(table, F.floor(slot / BITS).cast("int") + 1, F.lit(1)).cast("string"))
        return F.getbit(byte, F.pmod(slot, F.lit(BITS)).cast("int")) == 1

    def held(table: Column, h: Column) -> Column:
        return reduce(lambda a, i: a & probe(table, h.bitwiseXOR(F.shiftright(h, SHIFT * i))), range(1, PROBES), probe(table, h))

    def chosen(every: Column) -> Column:
        found = bound(F.lit(lex), lambda table: F.filter(every, lambda h: held(table, h)))
        return bound(found, lambda inside: F.when(F.size(inside) > 0, inside).when(F.size(every) > 0, every).otherwise(F.array(F.xxhash64(text))))

    return F.sort_array(bound(terms(text), chosen))


def hashes(sorted_marks: Column) -> Column:
    """The whole fingerprint's hash, then one for each sub-lexicon; null where a sub-lexicon has none of the terms.

    Sub-lexicons of the same first bit lie in one another, so each denser one is cut down from the first.
    """

    def keep(hs: Column, first: Column, bits: int) -> Column:
        return F.filter(hs, lambda h: F.call_function("shiftright", h, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) == 0)

    def one(kept: Column) -> Column:
        return F.when(F.size(kept) > 0, F.xxhash64(kept))

    def family(first: Column) -> Column:
        return bound(keep(sorted_marks, first, DENSITIES[0]), lambda k: F.array(one(k), *[bound(keep(k, first, bits), one) for bits in DENSITIES[1:]]))

    return F.concat(F.array(F.xxhash64(sorted_marks)), F.flatten(F.transform(F.array(*map(F.lit, FIRSTS)), family)))


def digest(h: Column) -> Column:
    """The hashes as text: 8 hexadecimal digits of each, '-' for an empty sub-lexicon."""
    return F.array_join(F.transform(h, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0")), F.lit("-"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of hashes that agree among those that either text has."""
    pairs = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    same = F.filter(pairs, lambda p: p["x"] == p["y"])
    return F.size(same) / F.size(pairs)


def fingerprints(docs: DataFrame, lex: bytes, text: str = "text") -> DataFrame:
    """docs with the column `fingerprint`: equal texts have equal ones; null counts as empty."""
    held = docs.withColumn("_marks", marks(F.coalesce(F.col(text), F.lit("")), lex))
    return held.withColumn("fingerprint", digest(hashes(F.col("_marks")))).drop("_marks")


def quantiles(rows: DataFrame, order: str, parts: int) -> list[int]:
    """Distinct bounds that part the ids into `parts` of about equal size."""
    probs = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx(order, probs, 10_000)).first()[0] if probs else None
    return sorted(set(found or []))


def runs_of(rows: DataFrame, order: str) -> Column:
    """The run of an id: a number that grows with the id, for runs of about RUN rows wherever the ids lie; null ids are the last run.

    Bounds are quantiles, first of all ids and then of each part's: STEPS * STEPS numbers at most on the driver.
    """
    n = rows.count()
    coarse = quantiles(rows, order, min(STEPS, -(-n // RUN)))
    steps = min(STEPS, -(-n // (RUN * (len(coarse) + 1))))
    ids = F.col(order)

    def place(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b <= ids))

    def given(bounds: list) -> Column:
        return F.from_json(F.lit(json.dumps(bounds)), "array<bigint>" if not bounds or isinstance(bounds[0], int) else "array<array<bigint>>")

    part = place(given(coarse))
    if steps <= 1:
        run = part
    else:
        probs = [i / steps for i in range(1, steps)]
        found = {r["part"]: sorted(set(r["b"])) for r in rows.filter(ids.isNotNull()).groupBy(part.alias("part")).agg(F.percentile_approx(order, probs, 10_000).alias("b")).collect()}
        run = part * STEPS + place(F.get(given([found.get(i, []) for i in range(len(coarse) + 1)]), part))
    return F.when(ids.isNull(), STEPS * STEPS).otherwise(run).cast("long")


def with_next(rows: DataFrame, columns: list[str], order: str = "doc_id") -> DataFrame:
    """rows with next_<column> of the row that follows by `order`; the first follows the last.

    Ids are dealt in runs; each run also gets a copy of the row that begins
    the next one, so no task looks beyond its run. Null ids come last; equal
    ids follow each other by the first column named.
    """
    run = runs_of(rows, order)
    starts = rows.groupBy(run.alias("_run")).agg(F.min(order).alias("_start"))  # a row a run
    last = F.max("_run").over(Window.partitionBy(F.lit(0)))
    starts = starts.select("_start", F.coalesce(F.lag("_run").over(Window.partitionBy(F.lit(0)).orderBy("_run")), last).alias("_before"))
    dealt = rows.join(F.broadcast(starts), F.col(order).eqNullSafe(F.col("_start")), "left")
    dealt = dealt.withColumn("_copy", F.explode(F.when(F.col("_before").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    dealt = dealt.withColumn("_run", F.when(F.col("_copy"), F.col("_before")).otherwise(run))
    follows = Window.partitionBy("_run").orderBy("_copy", F.col(order).asc_nulls_last(), columns[0])
    out = dealt.select("*", *[F.lead(c).over(follows).alias(f"next_{c}") for c in columns])
    return out.filter(~F.col("_copy")).drop("_start", "_before", "_copy", "_run")


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by
    as many first ones of the next document by id (all, if it has fewer).
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty; a table of one row follows
    itself; repeated rows are rows of their own; an empty table gives an
    empty table.
    """
    lex = lexicon(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("marks", marks(F.col("text"), lex)).withColumn("h", hashes(F.col("marks"))).drop("marks")
    rows = with_next(rows, ["text", "h"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))).drop("next_text")
    rows = rows.withColumn("edited_marks", marks(F.col("edited"), lex)).withColumn("edited_h", hashes(F.col("edited_marks")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("h")).alias("fingerprint"), digest(F.col("edited_h")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("edited_h")).alias("near_edited"), likeness(F.col("h"), F.col("next_h")).alias("near_next"),
    )
