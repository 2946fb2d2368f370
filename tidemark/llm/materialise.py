"""Training order on disk: fixed-length sequences at slots that a keyed permutation gives.

Texts are tokenised and run together, each task cutting its own stream into
sequences of `length` ids (its last one filled up with the end id). Prefix
sums over the tasks' counts number the sequences 0..N-1. A Feistel network
over the smallest even number of bits that holds N permutes that range; a
result of N or more is sent through again until it falls inside
(cycle-walking), so every sequence has one slot of 0..N-1 and either can be
computed from the other. Slots are dealt in ranges of `per_shard`; each shard
is one file of fixed stride, so slot s begins at byte
(s mod per_shard) * length * width of shard s div per_shard, and a reader
resumes at any slot by one seek.

What is settled and moved before the shards is coded: ids are numbered by
their frequency in a bounded sample, frequent ones take one byte, and the
bytes go through zstd.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import ByteBPE
from tidemark.llm.common import slices
from tidemark.session import settle_table

ROUNDS = 4
#: Tasks whose first numbers are broadcast (16 bytes each); more are joined by a shuffle.
MOST_TASKS = 1_000_000
#: Texts, about, whose ids are counted to number ids by frequency; only the size of the coded sequences depends on them.
SAMPLE = 2000
#: Ranks of one byte, and ranks of two: a first byte of ONE..254 and a second one. Others are 255 and four bytes.
ONE = 192
TWO = ONE + (255 - ONE) * 256


def round_keys(key: str) -> np.ndarray:
    raw = hashlib.sha256(f"feistel:{key}".encode()).digest()
    return np.frombuffer(raw, dtype="<u8")[:ROUNDS].copy()


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit finaliser of the multiply and shift kind."""
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: str, inverse: bool = False) -> np.ndarray:
    """Slots of the given numbers under the keyed permutation of 0..n-1, or the way back."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask, keys = np.uint64(half), np.uint64((1 << half) - 1), round_keys(key)
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for k in keys[::-1] if inverse else keys:
                if inverse:
                    left, right = right ^ (_mix(left, k) & mask), left
                else:
                    left, right = right, left ^ (_mix(right, k) & mask)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Coder:
    """Sequences of `length` ids as bytes and back, by the rank of each id."""

    def __init__(self, ranks: np.ndarray, length: int):
        self.rank, self.length = ranks, length
        self.id = np.empty(len(ranks), "<u4")
        self.id[ranks] = np.arange(len(ranks), dtype="<u4")
        self.zip, self.unzip = zstandard.ZstdCompressor(level=3, write_content_size=True).compress, zstandard.ZstdDecompressor().decompress

    def pack(self, ids: np.ndarray) -> bytes:
        r = self.rank[ids]
        first = np.where(r < ONE, r, np.where(r < TWO, ONE + ((r - ONE) >> 8), 255)).astype(np.uint8)
        second = ((r[(r >= ONE) & (r < TWO)] - ONE) & 255).astype(np.uint8)
        return self.zip(first.tobytes() + second.tobytes() + r[r >= TWO].astype("<u4").tobytes())

    def unpack(self, data: bytes, wide: str) -> bytes:
        raw = np.frombuffer(self.unzip(data), np.uint8)
        first = raw[: self.length].astype(np.int64)
        two, far = (first >= ONE) & (first < 255), first == 255
        n = self.length + int(two.sum())
        first[two] = ONE + ((first[two] - ONE) << 8) + raw[self.length : n]
        first[far] = np.frombuffer(raw[n:].tobytes(), "<u4")
        return self.id[first].astype(wide).tobytes()


def width_of(bpe: ByteBPE) -> str:
    return "<u4" if bpe.fast.max_token_value >= 1 << 16 else "<u2"


def id_ranks(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """The rank of each id of the vocabulary by its frequency in some SAMPLE texts, those of a range of hashes of the id; unseen ids follow in order."""

    def work(batches):
        bpe = ByteBPE(tokenizer_file)
        seen = np.zeros(bpe.fast.max_token_value + 1, np.int64)
        for piece in slices(batches):
            for t in piece.column(0).to_pylist():
                seen += np.bincount(bpe.ids(t or ""), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["id", "n"])

    some = docs.filter(F.pmod(F.xxhash64(doc_id), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    found = some.select(text).mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # the vocabulary at most
    seen = np.zeros(ByteBPE(tokenizer_file).fast.max_token_value + 1, np.int64)
    seen[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    ranks = np.empty(len(seen), np.int64)
    ranks[np.argsort(-seen, kind="stable")] = np.arange(len(seen))
    return ranks


def token_blocks(docs: DataFrame, tokenizer_file: str, ranks: np.ndarray, length: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(task, nth, first_doc, n_tokens, packed): the tasks' streams in sequences of `length` ids, coded by Coder(ranks, length)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # 8 bytes an id of the vocabulary

    def work(batches):
        bpe, task, pack = ByteBPE(tokenizer_file), TaskContext.get().partitionId(), Coder(shared.value, length).pack
        wide = width_of(bpe)
        held, first, nth = np.empty(0, wide), None, 0

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["task", "nth", "first_doc", "n_tokens", "packed"])

        for piece in slices(batches):
            rows = []
            for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                first = d if not len(held) else first
                held = np.concatenate([held, np.append(bpe.ids(t or ""), end_id).astype(wide)])
                whole = len(held) // length
                for i in range(whole):
                    rows.append((task, nth, first if i == 0 else d, length, pack(held[i * length : (i + 1) * length])))
                    nth += 1
                held, first = held[whole * length :], d if whole else first
            yield out(rows)
        if len(held):
            yield out([(task, nth, first, len(held), pack(np.append(held, np.full(length - len(held), end_id, wide))))])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(work, "task long, nth long, first_doc long, n_tokens long, packed binary")


def training_order(blocks: DataFrame, key: str, per_shard: int = 8192) -> DataFrame:
    """blocks with a global number, slot and shard; blocks must have been computed once (settle_table)."""
    counts = blocks.groupBy("task").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # one row a task: the number of tasks is the scan's, not the corpus's rows
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, key))

    if counts.count() <= MOST_TASKS:
        bases = F.broadcast(bases)
    numbered = blocks.join(bases, "task").withColumn("number", F.col("base") + F.col("nth"))
    return numbered.withColumn("slot", slot("number")).withColumn("shard", F.floor(F.col("slot") / per_shard)).drop("base")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(ordered: DataFrame, folder: str, ranks: np.ndarray, wide: str, length: int = 1024, per_shard: int = 8192) -> DataFrame:
    """Write the shards as raw files of fixed stride; one row per record: slot, shard, at, first_doc, n_tokens, crc32.

    `folder` must be shared by the executors (a path or URI that pyarrow
    opens). Ranges of shards go to tasks, each writes its shards one after
    the other, under another name until a shard is whole; a task that runs
    again replaces its files by the same bytes. All files are written before
    the result is returned, which reads a settled table: a limit or a second
    action writes nothing.
    """
    shared = ordered.sparkSession.sparkContext.broadcast(ranks)

    def work(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        mine, sink, at, unpack = f"{TaskContext.get().taskAttemptId()}", None, -1, Coder(shared.value, length).unpack

        def close():
            if sink is not None:
                sink.close()
                store.move(f"{root}/.{shard_name(at)}.{mine}", f"{root}/{shard_name(at)}")

        for piece in slices(batches):
            slots, shards, ids = (piece.column(i).to_pylist() for i in (0, 1, 4))
            ids = [unpack(x, wide) for x in ids]
            for shard, data in zip(shards, ids, strict=True):
                if shard != at:
                    close()
                    sink, at = store.open_output_stream(f"{root}/.{shard_name(shard)}.{mine}"), shard
                sink.write(data)
            starts = [(s % per_shard) * len(d) for s, d in zip(slots, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:2], pa.array(starts, pa.int64()), *piece.columns[2:4], pa.array([zlib.crc32(d) for d in ids], pa.int64())],
                ["slot", "shard", "at", "first_doc", "n_tokens", "crc32"],
            )
        close()

    tasks = max(1, int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = ordered.select("slot", "shard", "first_doc", "n_tokens", "packed").repartitionByRange(tasks, "shard").sortWithinPartitions("slot")
    return settle_table(dealt.mapInArrow(work, "slot long, shard long, at long, first_doc long, n_tokens long, crc32 long"))


def read_slots(spark: SparkSession, folder: str, start: int, stop: int, length: int = 1024, width: int = 2, per_shard: int = 8192) -> DataFrame:
    """(slot, ids) for the slots start..stop-1: each shard in the range is opened once and read on from one seek."""

    def work(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for shard in b.column(0).to_pylist():
                low, high = max(start, shard * per_shard), min(stop, (shard + 1) * per_shard)
                with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
                    f.seek((low % per_shard) * length * width)
                    for a in range(low, high, 1024):
                        n = min(1024, high - a)
                        data = f.read(n * length * width)
                        yield pa.RecordBatch.from_arrays([pa.array(range(a, a + n), pa.int64()), pa.array([data[i * length * width : (i + 1) * length * width] for i in range(n)], pa.binary())], ["slot", "ids"])

    shards = spark.range(start // per_shard, -(-stop // per_shard) if stop > start else start // per_shard)
    return shards.mapInArrow(work, "slot long, ids binary")


def materialise(docs: DataFrame, tokenizer_file: str, folder: str, key: str, length: int = 1024, per_shard: int = 8192, end_id: int = 0) -> DataFrame:
    """Tokenise, number, permute and write docs; one row per sequence.

    first_doc is the document that begins first in the sequence, or the one
    that goes on there if none begins earlier. Null and empty texts are one
    end id; repeated rows are written each; an empty table writes no file.
    """
    ranks = id_ranks(docs, tokenizer_file)
    blocks = settle_table(token_blocks(docs, tokenizer_file, ranks, length, end_id), "none")
    return write_shards(training_order(blocks, key, per_shard), folder, ranks, width_of(ByteBPE(tokenizer_file)), length, per_shard)
