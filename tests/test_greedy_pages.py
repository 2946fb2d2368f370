"""Greedy choice goes through no more phrases than it needs, and through all where it must."""

from tests.test_whole_job import greedy
from tidemark.operators import folds


def test_pages_keep_what_all_would(spark, monkeypatch):
    rows = [("hot", 1, 900)] + [(f"hot w{i:03}", 2, 800) for i in range(150)] + [(f"z{i}", 1, 5 - i) for i in range(4)]
    df = spark.createDataFrame(rows, "phrase string, words int, n long")
    sizes, whole = [], folds._kept
    monkeypatch.setattr(folds, "_kept", lambda nodes, limit: sizes.append(nodes.count()) or whole(nodes, limit))
    monkeypatch.setattr(folds, "FIRSTS", (2, 152))
    for limit, read in ((1, [2]), (2, [2, 152]), (3, [2, 152, 155]), (12, [2, 152, 155])):
        sizes.clear()
        assert [tuple(r) for r in folds.greedy_phrases(df, limit).collect()] == greedy(rows, limit)
        assert sizes == read
