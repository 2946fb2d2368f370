"""Harmonic packing of documents into sequences of fixed capacity.

A piece of length in (C/(j+1), C/j] is of class j, and j pieces of class j
always fit a bin of capacity C: a class fills its bins with that fixed count,
whatever the order, so every task fills its own without asking others. A
document's remainder after full bins may be cut at most `max_cuts` times,
each time by the largest slot C//j that it covers, which leaves little to
pad. The last class takes all pieces of up to C/K tokens, K to a bin.

What a task can't fill (less than j pieces of each class, however much it
has read) is numbered by prefix sums over the tasks' counts and fills bins of
the same kind; at the end fewer than j pieces of each class remain in all, at
most K * (K + 1) / 2, and are packed first-fit by decreasing length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import ByteBPE
from tidemark.llm.common import slices
from tidemark.session import settle_table

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int, task long, nth long"


def cuts(tokens: int, capacity: int, classes: int, max_cuts: int) -> list[int]:
    """Lengths of a document's pieces: full bins, then slots of the classes, then what is left."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    for _ in range(max_cuts):
        if rest <= capacity // classes:
            break
        slot = capacity // -(-capacity // rest)
        if slot == rest:
            break
        out.append(slot)
        rest -= slot
    return out + [rest] * (rest > 0)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, classes: int = 32, max_cuts: int = 2, end_id: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian unsigned 32-bit, if keep_ids).

    A document is its text's ids and then end_id, so a null or empty text is
    one token. Offsets in a sequence run on from 0 without gaps. Repeated
    rows are packed each; a null doc_id stays null; other columns are not
    read. An empty table gives no pieces. The pieces are computed once, in
    the shared folder: both the full and the open bins of a task come from
    the same attempt.
    """
    ids_field = ", ids binary" if keep_ids else ""

    def work(batches):
        bpe, task = ByteBPE(tokenizer_file), TaskContext.get().partitionId()
        open_bins: dict[int, list[tuple]] = {}
        rows: list[tuple] = []
        bins = 0

        def out(rows):
            cols = list(zip(*rows, strict=True)) if rows else [()] * (10 + keep_ids)
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class", "task", "nth"] + ["ids"] * keep_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for piece in slices(batches):
            for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.ids(t or ""), np.uint32(end_id)).astype("<u4")
                start, total = 0, len(ids)
                for n in cuts(total, capacity, classes, max_cuts):
                    data = ids[start : start + n].tobytes()
                    kind = min(capacity // n, classes)
                    part = (d, start, n, zlib.crc32(data), total)
                    held = open_bins.setdefault(kind, [])
                    held.append((part, data if keep_ids else None))
                    start += n
                    if len(held) == kind:
                        at = 0
                        for p, b in held:
                            rows.append((*p, (task << 36) | bins, at, kind, task, 0) + ((b,) if keep_ids else ()))
                            at += p[2]
                        bins += 1
                        held.clear()
            if len(rows) >= 4096 or keep_ids:
                yield out(rows)
                rows = []
        for kind, held in open_bins.items():
            rows += [(*p, None, None, kind, task, i) + ((b,) if keep_ids else ()) for i, (p, b) in enumerate(held)]
        yield out(rows)

    pieces = settle_table(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, PIECE + ids_field))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    full = pieces.filter(F.col("sequence_id").isNotNull()).select(names)
    loose = pieces.filter(F.col("sequence_id").isNull())

    counts = loose.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("class")).alias("in_class"))
    loose = loose.join(counts, ["class", "task"]).withColumn("nth", F.col("base") + F.col("nth"))
    loose = loose.withColumn("bin", F.floor(F.col("nth") / F.col("class"))).withColumn("filled", (F.col("bin") + 1) * F.col("class") <= F.col("in_class"))
    in_bin = Window.partitionBy("class", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    second = loose.filter("filled").withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    second = second.withColumn("sequence_id", F.lit(1 << 61) + F.col("class").cast("long") * F.lit(1 << 48) + F.col("bin"))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "class", "nth"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        room: list[int] = []
        for i, n in enumerate(pdf["length"]):
            b = next((b for b, r in enumerate(room) if r >= n), None)
            if b is None:
                room.append(capacity)
                b = len(room) - 1
            pdf.loc[i, "sequence_id"] = (1 << 62) + b
            pdf.loc[i, "offset"] = capacity - room[b]
            room[b] -= n
        return pdf[names]

    rest = loose.filter("NOT filled").select(*names, "class", "nth").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    fields = ", ".join(f"{n} binary" if n == "ids" else f"{n} long" for n in names)
    third = rest.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(last, fields)  # under `classes` pieces of each class
    return full.unionByName(second.select(names)).unionByName(third)
