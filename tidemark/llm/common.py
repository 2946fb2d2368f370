"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a batch that are turned into Python objects at a time.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A function for mapInArrow that applies fn to short pieces of each batch."""

    def run(batches):
        for piece in slices(batches):
            yield fn(piece)

    return run


def lowest(known: DataFrame, n: int) -> DataFrame:
    """(_id, label): of each label in known (doc_id, label), the n ids of the lowest hash; labels are few.

    A label of many ids is cut by a bound on the hash that some 2 n + 1000 of
    them pass, whatever the number of tasks, before its ids meet in one task.
    """
    place, room = F.xxhash64("doc_id"), 2 * n + 1000
    sizes = known.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n")).filter(F.col("n") > room).collect()  # a row a label
    bound = reduce(lambda c, r: F.when(F.col("label") == r["label"], int((room / r["n"] - 0.5) * 2**64)).otherwise(c), sizes, F.lit(2**63 - 1))
    near = known.filter(place <= bound).select(F.col("doc_id").alias("_id"), "label", place.alias("_place")).distinct()
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy("label").orderBy("_place", "_id")))
    return ranked.filter(F.col("_rank") <= n).select("_id", "label")


def labelled(docs: DataFrame, known: DataFrame, n: int, doc_id: str = "doc_id") -> DataFrame:
    """docs with `label`, for at most n ids of each label in known (doc_id, label): those of the lowest hash of the id.

    The ids are chosen before any text is read and then broadcast: n a label, whatever the size of docs.
    """
    ids = lowest(known.select("doc_id", "label").filter("doc_id IS NOT NULL AND label IS NOT NULL"), n)
    return docs.join(F.broadcast(ids), F.col(doc_id) == F.col("_id")).drop("_id")
