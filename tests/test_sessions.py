"""Trading days between two dates, and answers of models, on odd rows."""

import datetime as dt
import json

from tidemark.operators import analysis as N
from tidemark.operators import schedule as S
from tidemark.plans import desk

SMALL = "/root/testdata/sf0.001"


def test_sessions_against_counting(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    open_ = [day(n) for n in (0, 1, 2, 5, 9, 10, 30)]
    ends = [None, *(day(n) for n in (-400, -1, 0, 1, 3, 5, 8, 10, 29, 30, 31, 900))]
    rows = [(i * 100 + j, a, b) for i, a in enumerate(ends) for j, b in enumerate(ends)]
    out = S.trading_days_between(spark.createDataFrame(rows, "id long, a date, b date"), spark.createDataFrame([(d,) for d in open_], "day date"), "a", "b")
    assert out.columns == ["id", "a", "b", "sessions"]
    want = {i: sum(a <= d <= b for d in open_) if a and b else 0 for i, a, b in rows}
    assert {r["id"]: r["sessions"] for r in out.collect()} == want
    none = S.trading_days_between(spark.createDataFrame(rows, "id long, a date, b date"), spark.createDataFrame([], "day date"), "a", "b")
    assert {r["sessions"] for r in none.collect()} == {0}


def test_answers_are_dealt_out(spark):
    assert desk.answers(spark, SMALL).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_issues_by_field(spark):
    good = {f: "t" for f in N.TEXTS} | {f: 50 for f in N.SCORES} | {f: [] for f in N.LISTS}
    bad = good | {N.SCORES[0]: "x", N.SCORES[1]: 101, N.LISTS[0]: "no", N.TEXTS[0]: None}
    rows = spark.createDataFrame([(1, json.dumps(good), None), (2, "{", json.dumps(bad)), (3, None, json.dumps(good)), (4, "{}", "["), (5, json.dumps(bad), None)], "id long, first string, second string")
    got = {r["id"]: (r["attempt"], r["error"]) for r in N.repaired(rows).select("id", "attempt", "error").collect()}
    problems = f"{N.TEXTS[0]}: required; {N.SCORES[0]}: not a number; {N.SCORES[1]}: not in 0-100; {N.LISTS[0]}: not a list"
    assert got[1] == (1, None) and got[2] == (None, problems) and got[3] == (2, None)
    assert got[4] == (None, "(root): invalid JSON") and got[5] == (None, "(root): invalid JSON")
