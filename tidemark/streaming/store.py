"""A table that a stream appends to in batches, each row once by its key, whatever is killed and run again.

A batch is a folder named by its number, and counts once Spark has marked its
write as whole; the folder of a batch that is run again is written anew. Rows
lie in buckets of neighbouring keys, so a batch is compared with the buckets
of its own keys and reads no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a bucket, and the most buckets that a batch names one by one; beyond that it reads all from its first to its last.
SPAN, NAMED = 65_536, 1_000


def _bucket(key: str, span: int) -> Column:
    return F.coalesce(F.floor(F.col(key) / span), F.lit(-(2**60)))


def whole_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are whole, ascending."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all whole batches, with their batch and bucket."""
    full = f"{schema}, batch long, bucket long"
    batches = whole_batches(spark, path)
    if not batches:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches))


def commit(batch: DataFrame, number: int, path: str, key: str, schema: str, span: int = SPAN) -> None:
    """A step of foreachBatch: the rows whose key no other batch holds, as batch `number`. A whole batch isn't written twice.

    Of rows that share a key in one batch one stays, the smallest by its
    columns; a null key is a key. Keys are whole numbers, batches of one table
    come one after the other.
    """
    spark = batch.sparkSession
    if number in whole_batches(spark, path):
        return
    names = [f.name for f in batch.schema]
    one = F.min(F.struct(*names)).alias("row")
    rows = batch.groupBy(F.col(key).alias("_key")).agg(one).select("row.*").withColumn("bucket", _bucket(key, span)).persist()
    try:
        named = [r[0] for r in rows.select("bucket").distinct().limit(NAMED + 1).collect()]
        held = read(spark, path, schema)
        if len(named) <= NAMED:
            held = held.filter(F.col("bucket").isin(named))
        else:
            first, last = rows.agg(F.min("bucket"), F.max("bucket")).first()
            held = held.filter(F.col("bucket").between(first, last))
        held = held.select(F.col("bucket").alias("_at"), F.col(key).alias("_held"))
        fresh = rows.join(held, (F.col("bucket") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_held")), "left_anti")
        fresh.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
    finally:
        rows.unpersist()
