"""Fill-in-the-middle examples: each text cut at two lines and put in the order prefix, suffix, middle or suffix, prefix, middle.

The lines of a text are the nodes of an indexable skip list. Lane 0 links
every line to the next; each lane above keeps about a quarter of the nodes of
the one below. A link carries how many lines it passes (its unit width) and
how many code points (its code-point width), so a descent that adds up
widths while the units stay within a cut's rank ends at that rank and knows
its code point, after some steps a lane. Only the lines' lengths and the cuts
are in Python; texts are cut and joined by Spark.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: A node of a lane is in the lane above if so many bits of its hash are zero: one in four.
BITS = 2
#: Columns of the result; the first three come from the list of lines.
FIELDS = ("n", "prefix_chars", "middle_chars", "form", "output")


class SkipList:
    """Units of given code-point widths, found by rank; heights come from a hash of the node's number."""

    def __init__(self, widths: list[int]):
        self.n = len(widths)
        node = np.arange(self.n)
        self.lanes = [(np.ones(self.n, np.int64).tolist(), list(widths), node.tolist())]  # units, code points, place in the lane below
        if self.n <= 1 << BITS:
            return
        ends = np.concatenate([[0], np.cumsum(widths)])
        with np.errstate(over="ignore"):
            h = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)
        while len(node) > 1 << BITS:
            mask = np.uint64((1 << BITS * len(self.lanes)) - 1)
            down = np.flatnonzero(((h[node] & mask) == 0) | (node == 0))
            if len(down) == len(node):
                break
            node = node[down]
            after = np.append(node[1:], self.n)
            self.lanes.append(((after - node).tolist(), (ends[after] - ends[node]).tolist(), down.tolist()))

    def reach(self, rank: int) -> tuple[int, int]:
        """Code points before the unit of that rank (all of them at rank n), and the links passed."""
        units = chars = at = steps = 0
        for wide, points, down in reversed(self.lanes):
            while at < len(wide) and units + wide[at] <= rank:
                units += wide[at]
                chars += points[at]
                at += 1
                steps += 1
            if units == rank:
                break
            at = down[at]
        return chars, steps


def line_widths(text: str) -> list[int]:
    """Code points of each line with its line feed; the last one may have none."""
    widths = [len(line) + 1 for line in text.split("\n")]
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


@F.pandas_udf(StructType([StructField(name, LongType()) for name in FIELDS[:3]]))
def _cuts(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    out = []
    for t, a, b in zip(text, first, second, strict=True):
        lines = SkipList(line_widths(t))
        low, high = sorted((a % (lines.n + 1), b % (lines.n + 1)))
        start = lines.reach(low)[0]
        out.append((lines.n, start, lines.reach(high)[0] - start))
    return pd.DataFrame(out, columns=FIELDS[:3], dtype="int64")


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: str = "7:", marks: tuple[str, str, str] = MARKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n (lines), form, prefix_chars, middle_chars (code points, null if plain) and output, which replace columns of those names.

    The first four groups of eight hexadecimal digits of sha256(seed then the
    id in decimal) settle a row: two cut ranks modulo n + 1, then `rate` of a
    hundred texts are transformed, and `spm` of a hundred of those put the
    suffix first. Other texts, empty ones and those with a mark inside stay
    plain. A null text is empty, a null id an empty string; rows that share
    an id share hashes, repeated rows give the same result each. An empty
    table stays empty.
    """
    own = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    group = lambda i: F.conv(F.substring("_sha", 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.drop(*(c for c in FIELDS if c not in (doc_id, text))).withColumns({"_sha": own, "_read": F.coalesce(F.col(text).cast("string"), F.lit(""))})
    rows = rows.withColumn("_cut", _cuts("_read", group(0), group(1)))
    plain = (F.col("_read") == "") | (group(2) % 100 >= rate)
    for m in marks:
        plain = plain | F.contains("_read", F.lit(m))
    rows = rows.withColumn("form", F.when(plain, "plain").when(group(3) % 100 < spm, "spm").otherwise("psm"))
    start, length = F.col("_cut.prefix_chars").cast("int"), F.col("_cut.middle_chars").cast("int")
    prefix, middle = F.substring("_read", F.lit(1), start), F.substring("_read", start + 1, length)
    suffix = F.substring("_read", start + length + 1, F.lit(2**31 - 1))
    p, s, m = map(F.lit, marks)
    whole = F.when(F.col("form") == "plain", F.col("_read")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    only = lambda c: F.when(F.col("form") != "plain", F.col(c))
    found = {"n": F.col("_cut.n"), "prefix_chars": only("_cut.prefix_chars"), "middle_chars": only("_cut.middle_chars"), "output": whole}
    return rows.withColumns(found).drop("_sha", "_read", "_cut")


def restore(outputs: DataFrame, into: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """outputs with the original text, made from `output` and `form` alone.

    Marks end in '>' and begin with '<', and no transformed text holds one,
    so each stands in the output once.
    """
    parts = F.split("output", "|".join(re.escape(m) for m in marks), -1)
    at = lambda *order: F.concat(*(F.get("_parts", F.lit(i)) for i in order))
    text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))
    return outputs.withColumn("_parts", F.when(F.col("form") != "plain", parts)).withColumn(into, text).drop("_parts")
