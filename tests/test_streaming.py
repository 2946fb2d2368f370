"""Replay of files as a stream gives what one read gives."""

from pyspark.sql import functions as F

from tidemark.streaming import replay


def test_activity_and_append(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = replay.read_events(spark, f"{tmp_path}/in", 2)
    q = replay.activity(stream, "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("activity").collect()}
    assert got == {(r["start"], r["event_type"], r["n"]) for r in replay.activity(events, "1 day").collect()}
    q = replay.once(stream, "60 days").writeStream.foreachBatch(lambda b, _: replay.append_unseen(b, f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == events.count() == out.select(F.countDistinct("event_id")).first()[0]
    assert replay.append_unseen(events, f"{tmp_path}/out") == 0
