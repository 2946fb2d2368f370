"""Queries and operators that must do the whole job, against brute force."""

import random

from tidemark import registry
from tidemark.functions import text as T
from tidemark.operators import folds
from tidemark.plans import feeds

SMALL = "/root/testdata/sf0.001"


def rolled(cues):
    out = []
    for c in cues:
        if not c:
            continue
        if out and c.startswith(out[-1]):
            out[-1] = c
            continue
        old, new = (out[-1].split(" ") if out else []), c.split(" ")
        n = next((n for n in range(min(len(old), len(new)), 0, -1) if old[-n:] == new[:n]), 0)
        if rest := " ".join(new[n:]).strip():
            out.append(rest)
    return out


def test_strip_roll(spark):
    r = random.Random(7)
    cases = [["a b c", "b c d"], ["can", "an"], ["a", "a", "a b", "b"], [], ["", "x"], ["x y", "", "y z"]]
    cases += [[" ".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(8)] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, cues array<string>")
    got = {x["id"]: x["kept"] for x in df.select("id", folds.strip_roll(df["cues"]).alias("kept")).collect()}
    assert got[0] == ["a b c", "d"] and got[1] == ["can", "an"]
    assert [got[i] for i in range(len(cases))] == [rolled(c) for c in cases]


def test_rolled_turns(spark):
    turns = {}
    for x in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        turns.setdefault(x["conv_id"], []).append((x["turn"], x["text"]))
    got = {x["document_id"]: x["kept"] for x in registry.queries()["win24_str37_rolled_turns"](spark, SMALL).collect()}
    assert got == {k: "|".join(rolled([t for _, t in sorted(v)])) for k, v in turns.items()}


def greedy(rows, limit):
    out = []
    for p, w, n in sorted(rows, key=lambda r: (-r[2], -r[1], r[0])):
        if len(out) < limit and not any(f" {p} " in f" {k} " or f" {k} " in f" {p} " for k, _ in out):
            out.append((p, n))
    return [(i + 1, p, n) for i, (p, n) in enumerate(out)]


def test_greedy_phrases_goes_on_after_a_page(spark):
    rows = [("hot", 1, 900)] + [(f"hot w{i:03}", 2, 800) for i in range(150)] + [(f"z{i}", 1, 5 - i) for i in range(4)]
    df = spark.createDataFrame(rows, "phrase string, words int, n long")
    for limit in (2, 3, 12):
        assert [tuple(r) for r in folds.greedy_phrases(df, limit).collect()] == greedy(rows, limit)
    assert folds.greedy_phrases(df.filter("false")).collect() == []


def test_greedy_phrases_counts_all_languages(spark):
    q = registry.queries()
    rows = [(r["phrase"], r["words"], r["n"]) for r in q["agg16_phrase_frequency"](spark, SMALL).collect()]
    assert sorted(tuple(r) for r in q["topk05_greedy_phrases"](spark, SMALL).collect()) == greedy(rows, 12)


def test_headline_key(spark):
    same = "x" * 70
    cases = [f"{same} one", f"{same} two", "Acme buys Bolt - Daily News", "Acme buys Bolt!", "a-b", "Q1 | Wire"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", T.headline_key(df["t"]).alias("k")).collect()}
    assert [got[i] for i in range(6)] == [f"{same} one", f"{same} two", "acme buys bolt", "acme buys bolt", "a b", "q1"]


def test_feeds_stay_small(spark, tmp_path):
    spark.range(12_000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    for make, sign in ((feeds.rss, "<item>"), (feeds.news_body, '"title"')):
        counts = [r["raw"].count(sign) for r in make(spark, str(tmp_path)).collect()]
        assert sum(counts) == 12_000 and len(counts) == 24 and max(counts) == 500
