"""As-of joins of many instants against a search in each symbol's sorted days."""

import bisect
import datetime as dt
import random

import pytest

from tidemark.operators.known import with_known

START = dt.date(1969, 1, 1)


def day(i):
    return START + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    prices = [("HOT", day(i), float(i)) for i in r.sample(range(3000), 900)]
    prices += [("RARE", day(100), 1.0), ("RARE", day(2500), None), ("NEVER ASKED", day(5), 5.0), (None, day(5), 6.0), ("HOT", None, 7.0)]
    asks = [("HOT", day(r.randrange(-200, 3400))) for _ in range(2000)] + [("RARE", day(i)) for i in range(0, 3000, 7)] + [("UNKNOWN", day(9)), (None, day(9)), ("HOT", None)]
    asks += asks[:5]
    return spark.createDataFrame(prices, "symbol string, day date, close double"), spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "close long, symbol string, asked date"), prices, asks


@pytest.mark.parametrize("forward", [False, True])
def test_known(tables, forward):
    rows, instants, prices, asks = tables
    by = {}
    for s, d, x in prices:
        if s is not None and d is not None:
            by.setdefault(s, []).append((d, x))
    want = {}
    for i, (s, d) in enumerate(asks):
        known = sorted(by.get(s, []), key=lambda f: f[0]) if d is not None else []
        at = [f[0] for f in known]
        j = (bisect.bisect_left(at, d) if forward else bisect.bisect_right(at, d) - 1) if known else -1
        want[i] = known[j] if 0 <= j < len(known) else (None, None)
    out = with_known(instants, rows, "asked", {"day": "known_day", "close": "price"}, forward=forward)
    assert out.columns == ["close", "symbol", "asked", "known_day", "price"]
    got = {r["close"]: (r["known_day"], r["price"]) for r in out.collect()}
    assert got == want and out.count() == len(asks)


def test_repeated_days_and_empty_tables(spark, tables):
    rows, instants, _, asks = tables
    twice = spark.createDataFrame([("A", day(1), 3.0), ("A", day(1), 9.0)], rows.schema)
    one = spark.createDataFrame([(1, "A", day(1))], instants.schema)
    assert with_known(one, twice, "asked", {"close": "price"}).first()["price"] == 9.0
    assert with_known(instants.filter("false"), rows, "asked", {"close": "price"}).collect() == []
    none = with_known(instants, rows.filter("false"), "asked", {"close": "price"})
    assert none.count() == len(asks) and none.filter("price IS NOT NULL").count() == 0
