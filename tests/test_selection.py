"""Exact medians and ranks against sorting."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(3)


SHAPES = {
    "even": [float(i) for i in range(1000)],
    "ties": [1.0] * 700 + [2.0] * 600 + [3.0],
    "two values": [1.0, 2.0] * 500,
    "one value": [7.5] * 501,
    "wide": [random.Random(1).choice([-1, 1]) * 10.0 ** random.Random(i).uniform(-300, 300) for i in range(999)],
    "one": [4.0],
    "two": [4.0, 9.0],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_median(spark, shape):
    values = SHAPES[shape]
    rows = frame(spark, values + [None, None])
    assert selection.median(rows, "x", small=8, accuracy=20) == statistics.median(values)


def test_ranks(spark):
    values = SHAPES["ties"] + SHAPES["wide"]
    rows = frame(spark, values).persist()
    for rank in (0, 1, 699, 1299, 1500, len(values) - 1):
        assert selection.at_rank(rows, rank, small=8, accuracy=20) == sorted(values)[rank]
    rows.unpersist()


def test_nothing_and_nan(spark):
    assert selection.median(frame(spark, []), "x") is None and selection.median(frame(spark, [None]), "x") is None
    nan = float("nan")
    assert selection.median(frame(spark, [nan, 1.0, 2.0] * 20), "x", small=8, accuracy=20) == 2.0
    got = selection.median(frame(spark, [nan] * 40 + [1.0]), "x", small=8, accuracy=20)
    assert got != got


def test_no_task_holds_the_column(spark):
    """Ten million rows, sorted 64 at a time: the sketch narrows the rank to that."""
    rows = spark.range(10_000_000).select((F.pmod(F.col("id") * 7_919, F.lit(10_000_000)) / 4).alias("x"))
    assert selection.median(rows, "x", small=64) == (4_999_999 / 4 + 5_000_000 / 4) / 2
