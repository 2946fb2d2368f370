"""Frames over blocks with halos against frames over whole histories."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import halos
from tidemark.operators import technical as T

START = dt.date(1960, 1, 1)


def history(symbol, n, step=1):
    r = random.Random(n)
    return [(symbol, START + dt.timedelta(days=i * step), r.uniform(10, 20)) for i in range(n)]


@pytest.fixture(scope="module")
def bars(spark):
    rows = history("HOT", 5000) + history("GAPS", 300, 50) + history("SHORT", 5) + history("EVEN", halos.BLOCK_ROWS) + history(None, 30) + [("HOT", None, 15.0)]
    rows = [(s, d, x, x + 1, x - 1, x + 0.5, float(i % 7)) for i, (s, d, x) in enumerate(rows)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, volume double").repartition(4)


def folded(bars, value):
    """A plain fold of each symbol's rows in order: (symbol, day) to value(rows up to it)."""
    by = {}
    for r in bars.collect():
        by.setdefault(r["symbol"], []).append(r)
    out = {}
    for s, rows in by.items():
        rows.sort(key=lambda r: r["day"] or dt.date.min)
        for i, r in enumerate(rows):
            out[s, r["day"]] = value(rows[: i + 1])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == w or (w is not None and got[k] is not None and abs(got[k] - w) < 1e-9 * max(1, abs(w))), k


def column(df, name):
    rows = df.select("symbol", "day", name).collect()
    out = {(r["symbol"], r["day"]): r[name] for r in rows}
    assert len(out) == len(rows)
    return out


def test_frames(bars):
    mean = lambda x: sum(x) / len(x)
    same(column(T.with_sma(bars), "sma_200"), folded(bars, lambda rows: mean([r["close"] for r in rows[-200:]]) if len(rows) >= 200 else None))
    same(column(T.with_momentum(bars), "momentum_120"), folded(bars, lambda rows: (rows[-1]["close"] - rows[-121]["close"]) / rows[-121]["close"] * 100 if len(rows) > 120 else None))
    same(column(T.with_year_range(bars), "high_52w"), folded(bars, lambda rows: max(r["high"] for r in rows[-252:])))
    same(column(T.with_breakout(bars), "breakout"), folded(bars, lambda rows: len(rows) > 1 and rows[-1]["close"] > max(r["high"] for r in rows[-21:-1])))
    same(column(T.with_volume(bars), "avg_volume"), folded(bars, lambda rows: mean([r["volume"] for r in rows[-20:]]) if len(rows) >= 20 else None))
    same(column(T.with_gap(bars), "gap_percent"), folded(bars, lambda rows: (rows[-1]["open"] - rows[-2]["close"]) / rows[-2]["close"] * 100 if len(rows) > 1 else None))


def test_a_reach_beyond_one_block(bars):
    longest = halos.BLOCK_ROWS * 2 + 5
    same(column(T.with_year_range(bars, longest), "high_52w"), folded(bars, lambda rows: max(r["high"] for r in rows[-longest:])))


def test_blocks_bound_tasks(bars):
    """A symbol of 79 % of the rows lies in many groups, none of more than a block and its halo."""
    sizes = halos.in_blocks(bars, 252).groupBy("symbol", halos.BLOCK).count().collect()
    assert max(r["count"] for r in sizes) <= halos.BLOCK_ROWS + 251 and sum(r["symbol"] == "HOT" for r in sizes) >= 5
    assert T.with_sma(bars.filter("false")).collect() == []


def test_recent_is_enough_for_last_rows(bars):
    named = bars.filter("symbol IS NOT NULL")
    every = T.with_gap(T.with_breakout(T.with_volume(T.with_year_range(T.with_momentum(T.with_sma(named))))))
    short = halos.own(T.with_gap(T.with_breakout(T.with_volume(T.with_year_range(T.with_momentum(T.with_sma(halos.recent(named, T.YEAR))))))))
    order = sorted(every.columns)
    got, want = ({tuple(r) for r in T.latest(x).select(order).collect()} for x in (short, every))
    assert got == want and len(got) == 4
    assert "WindowGroupLimit" in halos.recent(named, T.YEAR)._jdf.queryExecution().executedPlan().toString()
    assert halos.recent(bars, T.YEAR).groupBy("symbol").count().agg(F.max("count")).first()[0] == T.YEAR
