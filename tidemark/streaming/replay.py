"""Incremental replay of events: an extension of our own, as the research rules know no streams.

Each works on a streaming or a plain DataFrame of (event_id, ts, user_id,
event_type, value).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.session import settle_table, shared_dir

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Files of events as they arrive, so many at a time."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def activity(events: DataFrame, window: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; what comes later than `late` is left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """Each event id once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def append_unseen(batch: DataFrame, path: str, key: str = "event_id") -> int:
    """A step of foreachBatch: append the rows whose key the table at `path` lacks; running it again adds nothing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001 the table begins with its first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def confirmed_within(claims: DataFrame, confirmations: DataFrame, key: str, before: str = "7 days", after: str = "180 days", late: str = "11 days") -> DataFrame:
    """Pairs of a claim (key, claimed, ...) and a confirmation (key, confirmed, ...) of the same key from `before` it to `after` it.

    On streams both sides are held only as long as the window and `late` rows
    ask for: the bounds on the two instants let Spark drop a claim once
    confirmations have passed its window, and a confirmation likewise. Other
    columns must have different names; nulls in key or instant meet nothing.
    """
    a = claims.withWatermark("claimed", late) if claims.isStreaming else claims
    b = confirmations.withWatermark("confirmed", late) if confirmations.isStreaming else confirmations
    b = b.withColumnRenamed(key, "_key")
    window = (F.col("confirmed") >= F.col("claimed") - F.expr(f"INTERVAL {before}")) & (F.col("confirmed") <= F.col("claimed") + F.expr(f"INTERVAL {after}"))
    return a.join(b, (F.col(key) == F.col("_key")) & window).drop("_key")


def arrivals(rows: DataFrame, at: Column, slices: int) -> Iterator[DataFrame]:
    """rows in so many parts of equal time by their arrival `at`, a timestamp; rows without one arrive last."""
    timed = settle_table(rows.withColumn("_at", F.unix_timestamp(at)))
    first, last = timed.agg(F.min("_at"), F.max("_at")).first()
    width = max(1, ((last or 0) - (first or 0)) // slices + 1)
    part = F.coalesce(F.floor((F.col("_at") - (first or 0)) / width), F.lit(slices - 1))
    for i in range(slices):
        yield timed.filter(part == i).drop("_at")


def replayed(spark: SparkSession, parts: Iterable[DataFrame], schema: str, start: Callable[[DataFrame, str], DataStreamWriter]) -> list[dict]:
    """Feeds parts one after the other to a stream that is stopped after each and resumed from its checkpoint; the last progress of each run.

    start: makes the writer of a query from the stream and the folder that is its own.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    progress = []
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        query = start(spark.readStream.schema(schema).parquet(f"{base}/in"), base).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        progress.append(query.lastProgress)
    return progress
