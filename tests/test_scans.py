"""Means by blocks of affine maps against plain folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators import technical as T


def mean(x, n, alpha):
    out = [None] * len(x)
    if len(x) >= n:
        y = out[n - 1] = sum(x[:n]) / n
        for i in range(n, len(x)):
            y = out[i] = alpha * x[i] + (1 - alpha) * y
    return out


def histories():
    """A busy symbol, gaps longer than a block, one that is too short, one of falling prices only, one of equal ones."""
    r = random.Random(5)
    start = dt.date(1969, 6, 1)
    out = {"HOT": [(start + dt.timedelta(days=i), r.uniform(1, 500)) for i in range(1500)]}
    out["GAP"] = [(start + dt.timedelta(days=i * 45 + (i > 20) * 700), r.uniform(1, 5)) for i in range(60)]
    out["SHORT"] = [(start + dt.timedelta(days=i), 3.5 + i) for i in range(8)]
    out["DOWN"] = [(start + dt.timedelta(days=i), 1000.0 - i) for i in range(300)]
    out["FLAT"] = [(start + dt.timedelta(days=3 * i), 7.0) for i in range(200)]
    return out


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, d, x) for s, h in histories().items() for d, x in h]
    rows += [("HOT", None, 5.0), (None, dt.date(1970, 1, 1), 5.0), ("SHORT", dt.date(1980, 1, 1), None), ("NONE", dt.date(1980, 1, 1), None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, day date, close double").repartition(3)


def close(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1.0, abs(b)))


@pytest.mark.parametrize("n", [1, 2, 9, 21, 200])
def test_ema(bars, n):
    got = {(r["symbol"], r["day"]): r["ema"] for r in T.ema_series(bars, n).collect()}
    want = {(s, d): y for s, h in histories().items() for (d, _), y in zip(h, mean([x for _, x in h], n, 2 / (n + 1)), strict=True) if y is not None}
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)


def test_rsi_and_macd(bars):
    rsi = {(r["symbol"], r["day"]): r["rsi"] for r in T.rsi_series(bars).collect()}
    macd = {(r["symbol"], r["day"]): (r["macd"], r["signal"], r["histogram"]) for r in T.macd_series(bars).collect()}
    seen = 0
    for s, h in histories().items():
        x = [v for _, v in h]
        change = [b - a for a, b in zip(x, x[1:], strict=False)]
        gain, loss = mean([max(c, 0) for c in change], 14, 1 / 14), mean([max(-c, 0) for c in change], 14, 1 / 14)
        for (d, _), g, lo in zip(h[1:], gain, loss, strict=True):
            assert close(rsi.get((s, d)), None if g is None else 100.0 if lo == 0 else 100 - 100 / (1 + g / lo)), (s, d)
            seen += g is not None
        line = [None if a is None or b is None else a - b for a, b in zip(mean(x, 12, 2 / 13), mean(x, 26, 2 / 27), strict=True)]
        own = [v for v in line if v is not None]
        signal = [None] * (len(x) - len(own)) + mean(own, 9, 0.2)
        for (d, _), a, b in zip(h, line, signal, strict=True):
            got = macd[s, d]
            assert close(got[0], a) and close(got[1], b) and close(got[2], None if b is None else a - b), (s, d)
    assert seen == len(rsi) and len(macd) == sum(map(len, histories().values()))


def test_blocks_bound_tasks(bars):
    """No window or group holds more than a block's bars of a symbol, and no Python runs."""
    rows = scans.numbered(bars)
    assert rows.groupBy("symbol", "block").count().agg(F.max("count")).first()[0] <= scans.BLOCK_DAYS
    plan = T.ema_series(bars)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert T.macd_series(bars.filter("false")).collect() == [] and T.rsi_series(bars.filter("symbol = 'NONE'")).collect() == []
