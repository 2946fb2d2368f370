"""Bulk-synchronous best-fit packing of whole documents into sequences of fixed capacity.

A superstep takes the documents of one band of lengths, (C/2, C] first, and
every gap of an open sequence that could hold one of them. Both are
range-sorted by size and dealt out by rank, so that every share has its part
of each size, a hot length too, and no two shares want the same gap. Each
task sweeps its share from the longest document to the shortest: a document
goes to its successor, the smallest gap that is not smaller; of several that
want one gap the first by rank has it and the next looks on from there; a
gap is updated at once, and a document without a successor opens a sequence.
The updated gaps go into the next superstep. At the end sequences at most
half full, some a share and superstep, are swept once more as if they were
documents and run together.

What moves is numbers: a document is dealt in one superstep, a gap in those
whose documents it can still hold.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.word_bpe import word_bpe
from tidemark.session import settle_table

#: Rows of a share: as many shares as the session's shuffles have parts, as long as each has LEAST rows, and none over MOST.
LEAST, MOST = 512, 200_000
#: So many sequences that were run together at most are broadcast (24 bytes each); more are joined by a shuffle.
MOST_SHARED = 1_000_000
#: Bands below C / 2 ** LAST are one.
LAST = 6
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, pid long"
STATE = f"{PIECE}, sequence_id long, offset long, gap long"


class Gaps:
    """Open sequences by the size of their gap; a size's last comer is taken first."""

    def __init__(self):
        self.sizes: list[int] = []
        self.of: dict[int, list[int]] = {}

    def add(self, size: int, sequence: int) -> None:
        held = self.of.setdefault(size, [])
        if not held:
            insort(self.sizes, size)
        held.append(sequence)

    def successor(self, length: int) -> tuple[int, int] | None:
        """Take out a sequence of the smallest gap that holds `length`: (gap, sequence)."""
        i = bisect_left(self.sizes, length)
        if i == len(self.sizes):
            return None
        size = self.sizes[i]
        held = self.of[size]
        sequence = held.pop()
        if not held:
            del self.sizes[i]
        return size, sequence


def sweep(lengths: list[int], pids: list[int], gaps: list[tuple[int, int]], capacity: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Sequence and offset of each document, in the order given, and the gap of every sequence seen; gaps are (size, sequence)."""
    free, left = Gaps(), {}
    for size, sequence in gaps:
        free.add(size, sequence)
        left[sequence] = size
    into, at = [], []
    for length, pid in zip(lengths, pids, strict=True):
        size, sequence = free.successor(length) or (capacity, pid)  # a new sequence is named after its first document
        into.append(sequence)
        at.append(capacity - size)
        left[sequence] = size - length
        if size > length:
            free.add(size - length, sequence)
    return into, at, left


def _swept(capacity: int):
    def run(share: pa.Table) -> pa.Table:
        share = share.drop_columns(["share"])
        kind = share["length"].is_valid().to_numpy()
        docs = share.filter(pa.array(kind))
        docs = docs.sort_by([("length", "descending"), ("pid", "ascending")])
        gaps = share.filter(pa.array(~kind)).sort_by([("gap", "ascending"), ("sequence_id", "descending")])
        into, at, left = sweep(docs["length"].to_pylist(), docs["pid"].to_pylist(), list(zip(gaps["gap"].to_pylist(), gaps["sequence_id"].to_pylist(), strict=True)), capacity)
        names = docs.schema.names
        placed = docs.set_column(names.index("sequence_id"), "sequence_id", pa.array(into, pa.int64())).set_column(names.index("offset"), "offset", pa.array(at, pa.int64()))
        open_ = [(s, g) for s, g in left.items() if g]
        rest = pa.table({f.name: pa.nulls(len(open_), f.type) for f in docs.schema})
        rest = rest.set_column(names.index("sequence_id"), "sequence_id", pa.array([s for s, _ in open_], pa.int64())).set_column(names.index("gap"), "gap", pa.array([g for _, g in open_], pa.int64()))
        return pa.concat_tables([placed.cast(docs.schema), rest.cast(docs.schema)])

    return run


def superstep(docs: DataFrame, gaps: DataFrame, rows: int, capacity: int) -> DataFrame:
    """Rows of STATE: every document of docs with its sequence and offset, and (without a length) every sequence that still has a gap."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, min(parts, rows // LEAST), -(-rows // MOST))
    size = F.coalesce("length", "gap")
    order = [size.desc(), F.col("length").isNull(), F.coalesce("pid", "sequence_id")]
    ranked = docs.unionByName(gaps).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = ranked.withColumn("share", F.monotonically_increasing_id() % shares)
    return settle_table(dealt.groupBy("share").applyInArrow(_swept(capacity), STATE))


def tokenised(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, keep_ids: bool, doc_id: str, text: str) -> DataFrame:
    """Pieces of at most `capacity` ids, and a number `pid` for each that is the row's own however often the table is read; computed once."""
    names = [f.split()[0] for f in PIECE.split(", ")] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5] + [pa.binary()] * keep_ids

    def work(batches):
        bpe, number = word_bpe(tokenizer_file), TaskContext.get().partitionId() << 40
        end = np.uint32(end_id).astype("<u4").tobytes()
        for part in slices(batches):
            rows = []
            for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                data = bpe.data(t or "") + end
                for i, start in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[start : start + 4 * capacity]
                    rows.append((d, i, start // 4, len(own) // 4, zlib.crc32(own), len(data) // 4, number, *[own] * keep_ids))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return settle_table(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, PIECE + ", ids binary" * keep_ids))


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian unsigned 32-bit, if keep_ids).

    A document is its text's ids and then end_id, so a null or empty text is
    one token. One longer than `capacity` is cut into pieces of that length,
    the last one what is left; no other is cut. Offsets in a sequence run on
    from 0 without gaps. Repeated rows and rows that share an id are packed
    each; a null id stays null; other columns are not read. An empty table
    gives no pieces.
    """
    whole = tokenised(docs, tokenizer_file, capacity, end_id, keep_ids, doc_id, text)
    pieces = whole.drop("ids").withColumns({c: F.lit(None).cast("long") for c in ("sequence_id", "offset", "gap")})
    ends = [capacity >> i for i in range(1, LAST + 1)] + [0]
    bands = list(zip(ends[1:], ends[:-1], strict=True))
    counts = pieces.agg(*(F.count(F.when((F.col("length") > low) & (F.col("length") <= high), 1)) for low, high in bands)).first()

    alone = pieces.filter(F.col("length") > capacity // 2).withColumns({"sequence_id": F.col("pid"), "offset": F.lit(0).cast("long")})
    placed = [alone]
    gaps = alone.filter(F.col("length") < capacity).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in pieces.schema.fields[:7]), "sequence_id", F.lit(None).cast("long").alias("offset"), (capacity - F.col("length")).alias("gap"))
    for (low, high), n in zip(bands, counts, strict=True):
        if not n:
            continue
        wide = gaps.filter(F.col("gap") > low)
        step = superstep(pieces.filter((F.col("length") > low) & (F.col("length") <= high)), wide, n + wide.count(), capacity)
        placed.append(step.filter("length IS NOT NULL"))
        gaps = step.filter("length IS NULL").unionByName(gaps.filter(F.col("gap") <= low))

    half = gaps.filter(F.col("gap") >= capacity // 2).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in pieces.schema.fields[:3]), (capacity - F.col("gap")).alias("length"), F.lit(None).cast("long").alias("ids_crc32"), F.lit(None).cast("long").alias("doc_tokens"), F.col("sequence_id").alias("pid"), F.lit(None).cast("long").alias("sequence_id"), "offset", F.lit(None).cast("long").alias("gap"))
    n_half = half.count()
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    if n_half > 1:
        moved = superstep(half, gaps.filter("false"), n_half, capacity).filter("length IS NOT NULL").select(F.col("pid").alias("sequence_id"), F.col("sequence_id").alias("_into"), F.col("offset").alias("_base"))
        out = out.join(F.broadcast(moved) if n_half <= MOST_SHARED else moved, "sequence_id", "left")
        out = out.withColumns({"sequence_id": F.coalesce("_into", "sequence_id"), "offset": F.col("offset") + F.coalesce("_base", F.lit(0))})
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if keep_ids:
        return out.join(whole.select("pid", "ids"), "pid").select(*names, "ids")
    return out.select(names)
