"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each, mean and deviation are kept. For two
vectors, q.x over a segment of length l is at most l * (mean * mean +
deviation * deviation), which is the segment lower bound of the squared
distance |q - x|^2 turned round: both differ by (|q|^2 + |x|^2) / 2. Summed
over segments this bounds the whole inner product; finer segments bound it
closer. Each task scans its rows once against all queries of a block, drops
pairs whose bound is under the query's k-th best score so far, coarse to
fine, and computes exact integer products for the survivors. The first
bounds of all tasks are the k-th best scores in a sample of the candidates.

Queries are taken in blocks of bounded size, read in the order of their ids;
each block is one scan of the candidates with k rows a query and task out,
settled before the next block is read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

#: Bytes of scaled queries of a block that the driver and each task hold, and rows of the sample that gives the first bounds.
BLOCK_BYTES, SEEDS = 64 << 20, 4096
#: Share of pairs left from which on a level is computed for the pairs alone.
DENSE = 0.02
OUT = "query_id long, vec_id long, score long"


def segments(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 4, 8, 16, ... up to half the dimension."""
    return [s for s in (4, 8, 16, 32, 64) if s * 2 <= dim] or [1]


def features(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of (sqrt(l) * mean, sqrt(l) * deviation) per segment: their product bounds that of the rows."""
    out = []
    for part in np.array_split(x, n, axis=1):
        mean = part.mean(axis=1)
        root = np.sqrt(part.shape[1])
        out += [root * mean, root * part.std(axis=1)]
    return np.stack(out, axis=1)


def usable(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): vectors as scaled whole numbers, held as doubles, which are exact for them; null, empty or non-finite ones are left out."""
    scaled = lambda c: c.cast("double") * scale
    x = F.transform(F.col(vector), lambda c: F.when(F.abs(scaled(c)) < 2.0**53, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))  # larger doubles are whole
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(whole, F.lit(False)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"))


def matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of length dim, and these as a matrix."""
    lengths = np.asarray(column.value_lengths())
    at = np.flatnonzero(lengths == dim)
    flat = np.asarray(column.flatten())
    starts = np.concatenate([[0], np.cumsum(lengths)])[at]
    return at, flat[(starts[:, None] + np.arange(dim)).reshape(-1)].reshape(-1, dim)


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) < k
    return q[keep], ids[keep], score[keep]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; one that fits no long is an error."""
    dim = q.shape[1]
    size = dim * np.abs(q).max(axis=1, initial=0) * np.abs(x).max(axis=1, initial=0)
    if size.max(initial=0) < 1 << 53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    out = np.zeros(len(q), np.int64)
    fits = size < 1 << 62
    small = fits & (np.maximum(np.abs(q).max(axis=1), np.abs(x).max(axis=1)) < 1 << 62)
    out[small] = np.einsum("ij,ij->i", q[small].astype(np.int64), x[small].astype(np.int64))
    for i in np.flatnonzero(~small):
        out[i] = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[i].tolist(), strict=True))  # OverflowError beyond a long
    return out


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, block: int = 16_384, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each query with every other row.

    Components are floor(scale * x), of any size: products beyond 62 bits are
    summed as whole numbers of Python, and a score that fits no long fails
    the query. Ties go to the smaller id. Rows with a
    null id or an unusable vector take no part, nor do vectors of another
    length than the query's. A query given by several equal rows counts once;
    a repeated candidate row is a result each time; no row with the query's
    own id is a candidate. At most `block` queries, of BLOCK_BYTES in all, are
    on the driver at once.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector, scale)
    asked = usable(vectors.filter(is_query), vec_id, vector, scale).dropDuplicates(["vec_id"])
    n, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * (longest or 1))))
    seeds = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SEEDS))) == 0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    scans, last = [], None
    while True:
        page = (asked if last is None else asked.filter(F.col("vec_id") > last)).orderBy("vec_id").limit(block).toArrow()
        if not page.num_rows:
            break
        ids, v = page["vec_id"].to_numpy(), page["v"].combine_chunks()
        last = int(ids[-1])
        lengths = np.asarray(v.value_lengths())
        queries = {int(d): (ids[lengths == d], matrix(v, d)[1]) for d in np.unique(lengths)}
        unknown = {d: np.full(len(q[0]), -np.inf) for d, q in queries.items()}
        shared = spark.sparkContext.broadcast((queries, unknown))
        low = dict(first(seeds.mapInArrow(_scan(shared, k), OUT)).filter(F.col("rank") == k).select("query_id", "score").toArrow().to_pandas().itertuples(index=False))  # a number a query
        known = {d: np.array([low.get(int(i), -np.inf) for i in q[0]], float) for d, q in queries.items()}
        shared.destroy()
        shared = spark.sparkContext.broadcast((queries, known))
        scans.append(settle(first(rows.mapInArrow(_scan(shared, k), OUT))))  # k rows a query: the block's broadcast is done with
        shared.destroy()
        if page.num_rows < block:
            break
    if not scans:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, scans).select("query_id", "rank", "vec_id", "score")


def survivors(q: np.ndarray, x: np.ndarray, coarse: list, fine: list, floor: np.ndarray, bounds: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact product) of the pairs that no level rules out and whose product reaches the query's bound.

    `own` are the pairs of a query and a row of its id, which take no part.
    While more than DENSE of all pairs are left, a level is one product of
    matrices, which costs less than picking the pairs; then it is theirs alone.
    """
    left, pairs = np.ones((len(q), len(x)), bool), None
    left[own] = False
    for lq, lx in zip(coarse, fine, strict=True):
        if pairs is None:
            left &= lq @ lx.T >= floor[:, None]
            if left.mean() < DENSE:
                pairs = np.nonzero(left)
        else:
            qi, xi = pairs
            keep = np.concatenate([np.einsum("ij,ij->i", lq[qi[b : b + 500_000]], lx[xi[b : b + 500_000]]) >= floor[qi[b : b + 500_000]] for b in range(0, max(1, len(qi)), 500_000)])
            pairs = qi[keep], xi[keep]
    if pairs is None and q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 1 << 53:
        score = q @ x.T  # whole numbers under 2^53: exact
        score[own] = -np.inf
        if score.shape[1] > k:
            bounds = np.maximum(bounds, np.partition(score, -k, axis=1)[:, -k])
        qi, xi = np.nonzero(left & (score >= bounds[:, None]))
        return qi, xi, score[qi, xi].astype(np.int64)
    qi, xi = np.nonzero(left) if pairs is None else pairs
    score = np.concatenate([products(q[qi[b : b + 200_000]], x[xi[b : b + 200_000]]) for b in range(0, max(1, len(qi)), 200_000)])
    keep = score >= bounds[qi]
    return qi[keep], xi[keep], score[keep]


def _scan(shared, k: int):
    def run(batches):
        asked, known = shared.value
        state = {d: [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)] for d in asked}
        bounds = {d: b.copy() for d, b in known.items()}
        levels = {d: [features(q, s) for s in segments(d)] for d, (_, q) in asked.items()}
        for batch in batches:
            for dim, (query_ids, q) in asked.items():
                at, x_all = matrix(batch.column(1), dim)
                ids_all = np.asarray(batch.column(0))[at]
                step = max(1, 4_000_000 // max(1, len(query_ids)))
                for a in range(0, len(ids_all), step):
                    x, ids = x_all[a : a + step], ids_all[a : a + step]
                    fine = [features(x, s) for s in segments(dim)]
                    slack = 1 + 1e-9 * dim * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0))
                    floor = bounds[dim] - slack  # rounding of the bounds never drops a pair
                    place = np.minimum(np.searchsorted(query_ids, ids), len(query_ids) - 1)  # ids of queries ascend
                    mine = np.flatnonzero(query_ids[place] == ids)
                    qi, xi, score = survivors(q, x, levels[dim], fine, floor, bounds[dim], k, (place[mine], mine))
                    s = state[dim]
                    state[dim] = s = list(best(np.r_[s[0], qi], np.r_[s[1], ids[xi]], np.r_[s[2], score], k))
                    n = np.bincount(s[0], minlength=len(query_ids))
                    ends = np.cumsum(n) - 1
                    full = n >= k
                    bounds[dim][full] = np.maximum(bounds[dim][full], s[2][ends[full]])
        for dim, (query_ids, _) in asked.items():
            s = state[dim]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[s[0]]), pa.array(s[1]), pa.array(s[2])], ["query_id", "vec_id", "score"])

    return run
