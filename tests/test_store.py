"""The stored mirror under kills and repeats, and the join of two streams with late rows."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.plans import streams
from tidemark.streaming import replay, store

SCHEMA = "event_id long, value double"


def rows_of(df):
    return sorted((r["event_id"], r["value"]) for r in df.select("event_id", "value").collect())


def test_killed_and_run_again(spark, tmp_path):
    """Killed once amid a batch's files and once after them, before the stream noted the batch: the same rows, each once."""
    pages = [spark.range(i * 80, i * 80 + 100).select(F.col("id").alias("event_id"), (F.col("id") / 2).alias("value")).repartition(2) for i in range(3)]
    table, kills = f"{tmp_path}/table", {1: "amid", 2: "after"}

    def step(batch, number):
        kill = kills.pop(number, None)
        if kill == "amid":
            batch.limit(5).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table}/batch={number}/bucket=0")
            raise RuntimeError("killed")
        store.commit(batch, number, table, "event_id", SCHEMA, span=64)
        if kill == "after":
            raise RuntimeError("killed")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    for i, page in enumerate(pages):
        page.write.mode("append").parquet(f"{tmp_path}/in")
        if i in kills:
            with pytest.raises(StreamingQueryException):
                run()
        run()
    assert not kills and store.whole_batches(spark, table) == [0, 1, 2]
    assert rows_of(store.read(spark, table, SCHEMA)) == [(i, i / 2) for i in range(260)]


def test_a_batch_is_compared_with_its_own_buckets(spark, tmp_path, monkeypatch):
    table = f"{tmp_path}/table"
    store.commit(spark.range(1000).select(F.col("id").alias("event_id"), F.lit(0.0).alias("value")), 0, table, "event_id", SCHEMA, span=100)
    held = store.read(spark, table, SCHEMA).filter(F.col("bucket").isin([3]))
    assert len(held.inputFiles()) >= 1 and held.count() == 100
    scan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1].split("]")[0]
    late = spark.createDataFrame([(350, 9.0), (350, 8.0), (5_000, 1.0), (None, 2.0), (None, 3.0), (-5, 4.0)], SCHEMA)
    monkeypatch.setattr(store, "NAMED", 2)  # too many buckets to name: a range
    store.commit(late, 1, table, "event_id", SCHEMA, span=100)
    store.commit(late, 1, table, "event_id", SCHEMA, span=100)
    store.commit(late, 2, table, "event_id", SCHEMA, span=100)
    got = store.read(spark, table, SCHEMA).filter("batch > 0")
    assert sorted(map(str, rows_of(got.filter("event_id IS NOT NULL")))) == sorted(map(str, [(-5, 4.0), (5_000, 1.0)]))
    assert [r["value"] for r in got.filter("event_id IS NULL").collect()] == [2.0]
    store.commit(late.filter("false"), 3, table, "event_id", SCHEMA)
    assert store.read(spark, table, SCHEMA).count() == 1003 and store.whole_batches(spark, table) == [0, 1, 2, 3]


def test_claim_windows_with_late_rows_and_bounded_state(spark):
    """Five slices whose rows come up to 10 days late give the batch answer; what is held is a window's rows, not all."""
    start = dt.datetime(2001, 1, 1)
    rows = [(i, i % 5 if i % 3 else 0, "F" if i % 2 else "O", "1-URGENT" if i % 4 < 2 else "5-LOW", start + dt.timedelta(days=i)) for i in range(3000)]
    rows += [(9_000, None, "F", "1-URGENT", start), (9_001, 0, "F", "1-URGENT", None)]
    orders = spark.createDataFrame(rows, streams.ORDERS)
    want = {(r["claim"], r["confirmation"]) for r in replay.confirmed_within(streams.claims_of(orders), streams.confirmations_of(orders), "user_id").collect()}
    out = []

    def writer(stream, folder):
        out.append(f"{folder}/out")
        return replay.confirmed_within(streams.claims_of(stream), streams.confirmations_of(stream), "user_id").writeStream.format("parquet").option("path", out[-1])

    arrives = F.col("at") + F.make_dt_interval(days=(F.col("id") % 11).cast("int"))
    progress = replay.replayed(spark, replay.arrivals(orders, arrives, 5), streams.ORDERS, writer)
    got = [(r["claim"], r["confirmation"]) for r in spark.read.parquet(out[-1]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10_000
    assert all(p["stateOperators"][0]["numRowsTotal"] < 450 for p in progress), [p["stateOperators"][0]["numRowsTotal"] for p in progress]
