"""First sentences found in a text's head, against those of the whole text; cells of corroboration by characters."""

import random

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import evidence as E
from tidemark.plans import text as plans


def test_same_as_of_the_whole_text(spark):
    r = random.Random(4)
    signs = ["a", "B", "7", " ", "  ", "\n", ". ", "? ", "! A", ".", "“", "$", "word", "longer words here", " ", "😀"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(0, 60))) for _ in range(1500)] + [None, "", "x" * 50, "A short one. " * 9, "x" * 19 + ". B", "x" * 20 + ". B" + "y" * 40]
    df = spark.createDataFrame([(x,) for x in texts], "t string").repartition(4)
    for near in (1, 25, 40, 1000):
        assert df.filter(~T.first_sentence(F.col("t"), 20, near).eqNullSafe(F.get(T.sentences(F.col("t")), 0))).collect() == []


def test_cells_are_filled_by_characters(spark, monkeypatch):
    small = "/root/testdata/sf0.001"
    want = sorted(map(str, E.corroborations(plans.claims(spark, small), plans.docs(spark, small)).collect()))
    monkeypatch.setattr(E, "CELL_CHARS", 3000)
    assert want and sorted(map(str, E.corroborations(plans.claims(spark, small), plans.docs(spark, small)).collect())) == want
