"""The inverted index against reading every text for every query."""

import random
import re

from tidemark.operators import search
from tidemark.operators.lookup import fulltext

WORDS = ["the", "then", "theta", "zebra", "über", "Übermut", "q3", "7", "x", "naïve", "日本", "日本語", "a1b", "guidance", "guide"]


def words(text):
    return {w.lower() for w in re.findall(r"[^\W_]+", text or "")}


def finds(query, text):
    asked = [w for w in words(query) if len(w) >= 2 or any(c.isdigit() for c in w)]
    return bool(asked) and all(any(w.startswith(a) for w in words(text)) for a in asked)


def test_queries_by_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(0, 9))) + r.choice([".", "!", "\n", ""]) for _ in range(120)] + [None, "", "the " * 4000 + "end", "w" * 20000]
    rows = [(i % 100, t, r.choice(["Ann", None, "Theo"])) for i, t in enumerate(texts)] + [(None, "zebra theta", None), (5, "zebra theta", "Ann"), (5, "zebra theta", "Ann")]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "k long, text string, speaker string, row_ long, words string").repartition(3)
    asked = [(i, " ".join(w[: r.randrange(1, 6)] for w in r.sample(WORDS, r.randrange(1, 4)))) for i in range(80)]
    asked += [(900, None), (901, ""), (902, "x"), (903, "the th t"), (904, "THE Über"), (905, "zzz the"), (906, "w" * 19999), (907, "zeb theta ann"), (907, "zeb theta ann"), (None, "theo")]
    index = search.write_index(df, ["k"], ["text", "speaker"], str(tmp_path / "index"))
    got = index.search(spark.createDataFrame(asked, "query_id long, query string"))
    want = [(q, k) for q, s in asked for k, t, who in rows if finds(s, " ".join(x for x in (t, who) if x is not None))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert all(str(tmp_path) not in f or "/rows/" in f or "/terms/" in f or "/postings/" in f for f in got.inputFiles())
    assert index.search(spark.createDataFrame([], "query_id long, query string")).collect() == []
    empty = search.write_index(df.filter("false"), ["k"], ["text"], str(tmp_path / "none"))
    assert empty.search(spark.createDataFrame(asked, "query_id long, query string")).collect() == []


def test_one_query_is_the_predicate(spark, tmp_path):
    df = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=6))) for i in range(200)], "k long, text string")
    index = search.write_index(df, ["k"], ["text"], str(tmp_path / "index"))
    for q in ("the zeb", "guid", "日", "7 q3"):
        one = index.search(spark.createDataFrame([(1, q)], "query_id long, query string")).select("k")
        assert sorted(one.collect()) == sorted(fulltext(df, ["k"], "text", q).collect())


def test_postings_skip_ranges(spark, tmp_path, monkeypatch):
    """The terms a few queries need are named in the scan; beyond that they are joined, with the same result."""
    df = spark.createDataFrame([(i, f"w{i} w{i // 2} hot") for i in range(300)], "k long, text string")
    index = search.write_index(df, ["k"], ["text"], str(tmp_path / "index"))
    asked = spark.createDataFrame([(i, f"w{i} hot") for i in range(100)], "query_id long, query string")
    named = index.search(asked)
    assert "In(term" in named._jdf.queryExecution().toString() or "term IN" in named._jdf.queryExecution().toString()
    few = sorted(named.collect())
    monkeypatch.setattr(search, "NAMED", 3)
    assert sorted(index.search(asked).collect()) == few and len(few) > 100


def test_held_only_if_nothing_is_found(spark):
    df = spark.createDataFrame([(1, "Alpha beta"), (2, "50% off. x"), (3, None), (4, "of f. x")], "k long, text string")
    run = lambda q: sorted(r[0] for r in search.found_or_held(df, ["k"], "text", q).collect())
    assert run("alp be") == [1] and run("f. x") == [2, 4] and run("OFF%.") == [2] and run("beta alp zz") == []


def test_long_beginnings_resolve(spark):
    """A query longer than any bound on prefixes still finds the name that it begins."""
    from tidemark.operators.directory import resolved

    name = "Zeta Very Long Holdings International Incorporated of the North"
    symbols = spark.createDataFrame([("ZVL", name, "NYSE", True), ("ZV", "Zeta Very", "NYSE", True)], "symbol string, name string, exchange string, tradable boolean")
    asked = spark.createDataFrame([(name[:n],) for n in (10, 24, 25, 40, 60)] + [("zv",), ("",), (None,)], "query string")
    got = {r["query"]: (r["symbol"], r["rank"]) for r in resolved(asked, symbols).collect()}
    assert all(got[name[:n].strip()] == ("ZVL", 80) for n in (25, 40, 60)) and got["zv"] == ("ZV", 100)


def test_each_key_once_a_query(spark, tmp_path):
    """With `once`, pairs of a query and a row are made distinct before any of them is shuffled: no exchange deals rows out by both."""
    rows = [(f"k{i % 3}", " ".join(random.Random(i).choices(WORDS, k=6))) for i in range(200)]
    index = search.write_index(spark.createDataFrame(rows, "k string, text string"), ["k"], ["text"], str(tmp_path / "index"))
    asked = [(1, "the zeb"), (2, "guid q3"), (2, "the zeb"), (3, "nothing the")]
    got = index.search(spark.createDataFrame(asked, "query_id long, query string"), once=True)
    assert sorted(map(tuple, got.collect())) == sorted({(q, k) for q, s in asked for k, t in rows if finds(s, t)})
    dealt = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in line and "row#" in line]
    assert not [line for line in dealt if "words#" in line or "_set#" in line]


def planned(spark, run):
    """The plan of run()'s result, as it is before any size is measured."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return run()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_table_of_queries_is_broadcast(spark, tmp_path, monkeypatch):
    """Queries, sets of words and terms grow with the input; but for small ones they are neither broadcast nor held by the driver."""
    df = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=6))) for i in range(200)], "k long, text string")
    index = search.write_index(df, ["k"], ["text"], str(tmp_path / "index"))
    asked = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=2))) for i in range(50)], "query_id long, query string")
    want = sorted(index.search(asked).collect())
    monkeypatch.setattr(search, "NEAR", 2)
    for once in (False, True):
        plan = planned(spark, lambda once=once: index.search(asked, once=once))
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted(index.search(asked).collect()) == want and len(want) > 100


def test_pairs_are_tried_by_bits(spark, tmp_path, monkeypatch):
    """Blocks, packs of queries, groups of words and handed batches of any size give the same rows, and no row of a plan is a pair that may fit."""
    rows = [(f"k{i % 7}" if i % 11 else None, " ".join(random.Random(i).choices(WORDS, k=i % 9))) for i in range(300)]
    asked = [(i % 90, " ".join(w[: 1 + i % 4] for w in random.Random(-i).choices(WORDS, k=1 + i % 4))) for i in range(200)] + [(7, "the zeb")] * 40
    df, queries = spark.createDataFrame(rows, "k string, text string").repartition(2), spark.createDataFrame(asked, "query_id long, query string")
    want = [(q, k) for q, s in asked for k, t in rows if finds(s, t)]
    for i, sizes in enumerate([{}, {"BLOCK": 4, "PACK": 16, "PACKS": 2}, {"BLOCK": 6, "LAID": 16, "HANDED": 5}]):
        for name, value in sizes.items():
            monkeypatch.setattr(search, name, value)
        index = search.write_index(df, ["k"], ["text"], str(tmp_path / f"index{i}"))
        got = index.search(queries)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        assert sorted(map(str, map(tuple, index.search(queries, once=True).collect()))) == sorted(map(str, set(want)))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "array_contains" not in plan
