"""As-of joins that look both ways at once, against a search in each symbol's sorted days."""

import bisect
import datetime as dt
import random

import pytest

from tidemark.operators import known
from tidemark.plans import technical

START = dt.date(1969, 1, 1)


def day(i):
    return START + dt.timedelta(days=i)


@pytest.mark.parametrize("daily", [False, True])
def test_both_sides(spark, daily):
    r = random.Random(5)
    prices = [("HOT", day(i), float(i)) for i in r.sample(range(3000), 900)] + [("HOT", day(6000), 1.5), ("RARE", day(100), 1.0), ("RARE", day(2500), None), ("NEVER ASKED", day(5), 5.0), (None, day(5), 6.0), ("HOT", None, 7.0)]
    asks = [("HOT", day(r.randrange(-200, 6400))) for _ in range(2000)] + [("RARE", day(i)) for i in range(0, 3000, 7)] + [("UNKNOWN", day(9)), (None, day(9)), ("HOT", None)]
    asks += asks[:5] + [("HOT", day(128 * k + e)) for k in range(-3, 30) for e in (-110, -109, -108, 17, 18, 19)]
    by = {}
    for s, d, x in prices:
        if s is not None and d is not None:
            by.setdefault(s, []).append((d, x))
    want = {}
    for i, (s, d) in enumerate(asks):
        held = sorted(by.get(s, []), key=lambda f: f[0]) if d is not None else []
        at = [f[0] for f in held]
        a, b = (bisect.bisect_right(at, d) - 1, bisect.bisect_left(at, d)) if held else (-1, 0)
        want[i] = (held[a] if a >= 0 else (None, None)) + ((held[b][1],) if b < len(held) else (None,))
    rows = spark.createDataFrame(prices if daily else [*prices, ("RARE", day(100), 0.5)], "symbol string, day date, close double")
    instants = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "close long, symbol string, asked date")
    out = known.with_around(instants, rows, "asked", {"day": "known_day", "close": "price"}, {"close": "next_price"}, daily=daily)
    assert out.columns == ["close", "symbol", "asked", "known_day", "price", "next_price"]
    assert {x["close"]: (x["known_day"], x["price"], x["next_price"]) for x in out.collect()} == want and out.count() == len(asks)


def test_orders_are_settled_and_looked_up_once(spark, monkeypatch):
    settled, keep = [], known.settle_table
    monkeypatch.setattr(known, "settle_table", lambda df: settled.append(df.columns) or keep(df))
    monkeypatch.setattr(technical, "settle_table", known.settle_table, raising=False)
    assert technical.priced_orders(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert len(settled) == 1
