"""The join against brute force, on texts that crowd entries, and on odd rows."""

import random

import pytest

from tidemark.llm.components import components
from tidemark.llm.jaccard_join import jaccard_components, schemes


def brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = [x for x in (t or "").encode().lower().split() if x]
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(3000))
    passage = [word() for _ in range(60)]
    rows = []
    for size, copies, edits in ((300, 40, 12), (300, 30, 20), (90, 40, 3), (40, 25, 1), (12, 25, 1), (600, 30, 40)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randrange(edits + 1)):
                k = r.randrange(len(t))
                kind = r.random()
                if kind < 0.5:
                    t[k] = word()
                elif kind < 0.75:
                    del t[k]
                else:
                    t.insert(k, word())
            rows.append(t)
    for _ in range(60):
        rows.append([word() for _ in range(r.randrange(5, 200))] + passage + [word() for _ in range(20)])
    for n in range(1, 12):
        rows += [["x"] * n, ["x", "y"] * n]
    texts = [" ".join(t) for t in rows]
    texts += [texts[3], texts[3].upper(), texts[3] + " \t\n", "", "  ", None]
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_brute_force(spark, width, num, den):
    rows = corpus(width)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, entry string").repartition(5)
    got = {tuple(r) for r in jaccard_components(df, width, num, den).collect()}
    assert got == brute(rows, width, num, den)


def test_odd_rows(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (4, None), (4, None), (9, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (4, 0, 4), (4, 0, 4), (9, 2, 3)], key=str)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_ids_over_the_whole_range(spark):
    """Crowded near copies with ids at both ends of a long."""
    rows = [((-1) ** i * (2**63 - 1 - i), t) for i, t in corpus(3)[:120]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard_components(df, 3, 90, 100).collect()} == brute(rows, 3, 90, 100)


def test_bands_hold_any_text():
    for num, den in ((90, 100), (80, 100), (1, 2)):
        assert len(schemes(num, den)) < 64 and schemes(num, den)[-1].high >= 1 << 31
        assert all(a.high + 1 == b.low for a, b in zip(schemes(num, den), schemes(num, den)[1:], strict=False))
