"""Sentences that recur over a corpus: the joins that find them hold nothing of it whole."""

import random

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import evidence as E
from tidemark.operators import signals as G

LINE = "Investors should read this long notice with all due care before they act on it."


def corpus(spark):
    texts = [LINE + " The" + f" {c}{c}" * 12 + "." for c in "abcde"]
    return spark.createDataFrame([(i, f"T{i % 4}", t) for i, t in enumerate(texts)] + [(8, "T9", None), (9, "T9", "12345 67890 !!!!! ????? 12345 67890")], "id long, ticker string, text string")


def test_repeated_sentences(spark):
    rows = G.classified(corpus(spark), E.repeated_shingles(corpus(spark), 3))
    found = {(r["id"], r["pos"]) for r in rows.filter(F.array_contains("reasons", "corpus_repeated")).collect()}
    assert found == {(i, 0) for i in range(5)}
    assert rows.count() == G.classified(corpus(spark)).count()


def test_no_side_is_broadcast(spark, tmp_path):
    # read from a file, whose size is all that Spark knows before the run
    corpus(spark).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = G.classified(docs, E.repeated_shingles(docs, 3))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_counted_by_numbers_then_as_texts(spark, monkeypatch):
    """The same rows as a count of all shingles' texts, also if numbers clash all the time; ids repeat, texts and issuers are null."""
    r = random.Random(5)
    lines = [" ".join(r.choice(["alpha", "beta", "don't", "gamma 7", "Delta", "x"]) for _ in range(k)) for k in (4, 5, 7, 8, 9, 12, 30)]
    texts = [". ".join([x[0].upper() + x[1:] for x in r.choices(lines, k=r.randrange(0, 6))] + ["New " + " ".join(f"{chr(97 + i % 26)}{chr(97 + r.randrange(26))}" for _ in range(14))]) + "." for i in range(60)]
    rows = [(i % 50 if i % 13 else None, r.choice(["A", "B", "C", None]), t) for i, t in enumerate(texts)] + [(70, "A", None), (71, None, "12345 67890 !!!!! ????? 12345 67890"), (72, "B", "")]
    docs = spark.createDataFrame(rows, "id long, ticker string, text string").repartition(3)
    corpus = E.repeated_shingles(docs, 3).select("shingle", F.lit(1.0).alias("hit"))
    parts = docs.select("id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")).select("id", "pos", F.explode(T.shingles(F.col("s"))).alias("shingle"))
    want = parts.join(corpus, "shingle", "left").groupBy("id", "pos").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share")).filter("share >= 0.6").select("id", "pos")
    want = sorted(map(str, want.collect()))
    assert sorted(map(str, E.repeated_sentences(docs).collect())) == want and len(want) > 20
    monkeypatch.setattr(E, "KEPT", 3)
    assert sorted(map(str, E.repeated_sentences(docs).collect())) == want
    assert E.repeated_sentences(docs.filter("false")).collect() == []


def test_shingles_of_one_document_stay_in_it(spark, tmp_path):
    """Texts of shingles that no other issuer has are neither shuffled nor settled."""
    words = lambda i: " ".join("".join(random.Random(f"{i} {k}").choices("abcdefgh", k=6)) for k in range(400))
    docs = spark.createDataFrame([(i, f"T{i % 5}", words(i).capitalize() + ". " + LINE) for i in range(30)], "id long, ticker string, text string")
    found = E.repeated_sentences(docs)
    assert sorted((x["id"], x["pos"]) for x in found.collect()) == [(i, 1) for i in range(30)]
    settled = spark.read.parquet(*found.inputFiles())
    assert settled.filter("print IS NOT NULL").agg(F.sum(F.size("hits"))).first()[0] < 1000 and settled.agg(F.sum("n")).first()[0] > 10000
