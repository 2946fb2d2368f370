"""Openings in UTC of all days asked for, events' and the calendar's."""

from tidemark import registry
from tidemark.functions import dates as D
from tidemark.plans.records import END, START


def test_openings_of_every_trading_day_and_event(spark, tmp_path):
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-05 10:00:00' AS ts FROM range(3)").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["date03_wall_to_utc"](spark, str(tmp_path)).collect()
    days = {r["day"] for r in D.trading_days(spark, START, END).collect()}
    assert len(days) > 900 and {r["day"] for r in got if r["trading"]} == days
    assert sorted((r["event_id"], str(r["day"]), r["trading"]) for r in got if r["event_id"] is not None) == [(0, "2024-01-05", True), (1, "2024-01-06", False), (2, "2024-01-07", False)]
    assert {str(r["opens"]) for r in got if str(r["day"]) in ("2024-01-05", "2024-07-05")} == {"2024-01-05 09:00:00", "2024-07-05 08:00:00"}
