"""Queries that replay tables as streams, stopped and resumed between slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.views import table
from tidemark.streaming import replay, store

SLICES = 5
ORDERS = "id long, user_id long, status string, priority string, at timestamp"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def claims_of(orders: DataFrame) -> DataFrame:
    """Urgent orders claim something of their customer."""
    return orders.filter("priority = '1-URGENT'").select("user_id", F.col("id").alias("claim"), F.col("at").alias("claimed"))


def confirmations_of(orders: DataFrame) -> DataFrame:
    """Orders that are filled confirm it."""
    return orders.filter("status = 'F'").select("user_id", F.col("id").alias("confirmation"), F.col("at").alias("confirmed"))


def claim_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and what confirms them from 7 days before to 180 days after, by a join of two streams; orders arrive up to 10 days late."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("at"))
    arrives = F.col("at") + F.make_dt_interval(days=(F.col("id") % 11).cast("int"))
    out = []

    def start(stream: DataFrame, folder: str):
        out.append(f"{folder}/out")
        return replay.confirmed_within(claims_of(stream), confirmations_of(stream), "user_id").writeStream.format("parquet").option("path", out[-1])

    replay.replayed(spark, replay.arrivals(orders, arrives, SLICES), ORDERS, start)
    found = spark.read.schema("user_id long, claim long, claimed timestamp, confirmation long, confirmed timestamp").parquet(out[-1])
    return found.select("user_id", "claim", "confirmation", F.datediff("confirmed", "claimed").alias("days"))


CLAIM_WINDOWS = """SELECT c.o_custkey AS user_id, c.o_orderkey AS claim, e.o_orderkey AS confirmation, CAST(date_diff('day', CAST(c.o_orderdate AS DATE), CAST(e.o_orderdate AS DATE)) AS INTEGER) AS days
FROM orders c JOIN orders e ON c.o_custkey = e.o_custkey AND c.o_orderpriority = '1-URGENT' AND e.o_orderstatus = 'F' AND e.o_orderdate BETWEEN c.o_orderdate - INTERVAL 7 DAY AND c.o_orderdate + INTERVAL 180 DAY"""


def stored_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events mirrored into a stored table, where each slice brings some events of the slice before once more."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    out = []

    def pages():
        before = None
        for part in replay.arrivals(events, F.col("ts"), SLICES):
            yield part if before is None else part.unionByName(before.filter("event_id % 7 = 0"))
            before = part

    def start(stream: DataFrame, folder: str):
        out.append(f"{folder}/table")
        return stream.writeStream.foreachBatch(lambda batch, number: store.commit(batch, number, out[-1], "event_id", EVENTS))

    replay.replayed(spark, pages(), EVENTS, start)
    return store.read(spark, out[-1], EVENTS).groupBy("event_id", "user_id", "event_type").agg(F.count("*").alias("rows"))


STORED_MIRROR = "SELECT event_id, any_value(user_id) AS user_id, any_value(event_type) AS event_type, CAST(1 AS BIGINT) AS rows FROM events GROUP BY event_id"

QUERIES = {
    "strm03_dml12_13_stored_mirror": (stored_mirror, STORED_MIRROR),
    "strm08_05_claim_windows": (claim_windows, CLAIM_WINDOWS),
}
