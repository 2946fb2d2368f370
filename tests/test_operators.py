"""Operators on small tables with nulls, empty texts and ties, against plain Python."""

import csv
import io
import random

from pyspark.sql import functions as F

from tidemark.functions import records as X
from tidemark.functions import text as T
from tidemark.operators import accounts as A
from tidemark.operators import analysis as N
from tidemark.operators import directory as O
from tidemark.operators import evidence as E
from tidemark.operators import signals as G
from tidemark.operators import technical as C
from tidemark.sources import media as M
from tidemark.sources import pages as P


def one(spark, value, kind, *exprs):
    return spark.createDataFrame([(v,) for v in value], f"x {kind}").select(*exprs)


def test_words_are_stripped_runs(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab1-'& .é‘") for _ in range(r.randrange(0, 60))) for _ in range(200)] + ["", None, "--a--b--", "'tis", "12 3a"]
    import re

    def plain(t):
        parts = [w.strip("-'") for w in re.split(r"[^a-z0-9'&-]+", t.lower().replace("‘", "'").replace("’", "'"))]
        return [w for w in parts if 1 < len(w) < 40 and not w.isdigit()]

    got = [x[0] for x in one(spark, texts, "string", T.words(F.col("x"))).collect()]
    assert got == [None if t is None else plain(t) for t in texts]


def test_phrases_of_marked_tokens(spark):
    rows = [["the", "big", "dog"], [], ["of"], ["cats", "of", "rome"], ["a"] * 3, ["x", "x", "x"]]

    def plain(t):
        out = []
        for n in (1, 2, 3):
            out += [" ".join(t[i : i + n]) for i in range(len(t) - n + 1) if t[i] not in T.PHRASE_STOPWORDS + T.NOISE and t[i + n - 1] not in T.PHRASE_STOPWORDS + T.NOISE]
        return list(dict.fromkeys(out))

    got = [x[0] for x in one(spark, rows, "array<string>", T.phrases(F.col("x"))).collect()]
    assert got == [plain(t) for t in rows]


def test_signals_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "AB", "Acme Corp", None), (2, "AB", None, ""), (3, None, "Zed Group", "We saw record demand this year. We saw record demand this year.")], "id long, ticker string, company string, text string").withColumn("event_date", F.lit("2024-01-01").cast("date"))
    rows = G.classified(docs.drop("company"))
    assert {r["id"] for r in rows.collect()} == {3}
    assert len(G.signals(rows).collect()) == 1  # equal evidence counts once
    assert G.signals(rows.filter("false")).collect() == []


def test_subject_runs(spark):
    lines = ["Acme raised its outlook.", "It expects more orders soon.", "Nobody here is named at all.", "ZZTOP fell hard today.", "It fell again in the evening.", "Bolt Works said no.", "Shares of ACME rose."]
    rows = spark.createDataFrame([(1, i, "ACME", "Acme, Inc.", s) for i, s in enumerate(lines)], "id long, pos int, ticker string, company string, sentence string")
    known = spark.createDataFrame([("ZZTOP",), ("ACME",)], "symbol string")
    got = [r["attributed"] for r in G.attributed(rows, known).orderBy("pos").collect()]
    assert got == [True, True, False, False, False, False, True]


def test_csv_lines(spark):
    r = random.Random(3)
    rows = [["".join(r.choice('ab,"') for _ in range(r.randrange(0, 6))) for _ in range(r.randrange(1, 5))] for _ in range(200)]
    lines = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        lines.append(out.getvalue())
    got = [x[0] for x in one(spark, lines, "string", X.csv_fields(F.col("x"))).collect()]
    assert got == rows
    back = [x[0] for x in one(spark, ["a", "a,b", 'q"q', None], "string", X.csv_field(F.col("x"))).collect()]
    assert back == ["a", '"a,b"', '"q""q"', None]


def test_niches(spark):
    r = random.Random(4)
    items = [(i, r.choice(["h1", "h2", None]), " ".join(r.choice(["ai chips", "solar", "rome wall"]) for _ in range(r.randrange(0, 4)))) for i in range(40)] + [(99, "h", None)]
    phrases = [(1, "ai chips"), (2, "solar"), (3, "nowhere"), (4, "chips")]
    df = spark.createDataFrame(items, "id long, host string, text string")
    got = N.niches(df, spark.createDataFrame(phrases, "rank int, phrase string"), 3).collect()
    want = []
    for _, p in phrases:
        held = [(i, h) for i, h, t in items if f" {p} " in f" {t or ''} "]
        if len(held) >= 2:
            hosts = {}
            for _, h in held:
                if h:
                    hosts[h] = hosts.get(h, 0) + 1
            want.append((p, len(held), sorted(hosts, key=lambda h: (-hosts[h], h)), sorted(i for i, _ in held)))
    assert [tuple(x) for x in got] == want[:3]


def test_ledgers_take_a_step_once(spark):
    ledger = spark.createDataFrame([(1, 5, "monthly_grant", "2024-01")], "user_id long, delta long, reason string, idem string")
    users = spark.createDataFrame([(1,), (2,), (2,)], "user_id long")
    once = A.granted(ledger, users, "2024-01", 9)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, A.granted(once, users, "2024-01", 9).collect())) and once.count() == 2
    assert A.credited(ledger, ledger.filter("false")).collect() == ledger.collect()


def test_repeated_shingles_and_windows(spark):
    text = "one two three four five six seven eight nine ten."
    docs = spark.createDataFrame([(i, t, text if i < 4 else None) for i, t in enumerate(["a", "b", "c", "c", "d"])], "id long, ticker string, text string")
    got = {r["shingle"]: r["issuers"] for r in E.repeated_shingles(docs).collect()}
    assert got == {" ".join(text[:-1].split()[k : k + 8]): 3 for k in range(3)}
    a = spark.createDataFrame([("u", 1, "2024-01-01 00:59:59"), (None, 2, "2024-01-01 00:00:00")], "k string, a int, ts string").withColumn("ts", F.to_timestamp("ts"))
    b = spark.createDataFrame([("u", 7, "2024-01-01 01:59:59"), ("u", 8, "2024-01-01 02:00:00"), ("u", 9, "2024-01-01 00:59:59"), ("u", 5, None)], "k string, b int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["b"] for r in E.within_hours(a, b, "k", 1).collect()) == [7, 9]


def test_levels_and_series_of_short_histories(spark):
    bars = spark.createDataFrame([("A", i, 10.0 + i % 3, 9.0 + i % 3, 9.5 + i % 3) for i in range(8)], "symbol string, i int, high double, low double, close double").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")))
    assert N.levels(bars).collect() == [] and C.rsi_series(bars).collect() == []
    assert N.levels(bars.filter("false")).collect() == []


def test_captions_and_pages_without_content(spark):
    got = one(spark, ["WEBVTT\n\n", "", None, "00:01.000 --> 00:02.000\n", "00:01.000 --> 00:02.000\n<b>hi</b>\n\nlost"], "string", F.size(M.caption_cues(F.col("x")))).collect()
    assert [r[0] for r in got] == [0, 0, None, 0, 1] or [r[0] for r in got] == [0, 0, -1, 0, 1]
    assert [r[0] for r in one(spark, ["", "<p>x</p>", '<script type="application/ld+json">{bad</script>'], "string", P.article_text(F.col("x"))).collect()] == ["", "", ""]
    many = '{"articleBody":"' + 'a \\"b\\" \\n' * 3000 + '"}'
    body = one(spark, [f'<script type="application/ld+json">{many}</script>'], "string", P.article_text(F.col("x"))).first()[0]
    assert body.count('"') == 6000


def test_pairs_and_queries_of_nothing(spark):
    pairs = spark.createDataFrame([("BTC/USD", "BTC", "USD", "Bitcoin"), ("BTC/USDT", "BTC", "USDT", "Bitcoin")], "symbol string, base string, quote string, name string")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["btcusdt", "BTC", None, "", "eth", "b t c/usd", "btc,btc-usd,x,,btcusd"])], "k int, raw string")
    assert {r["k"]: r["pair"] for r in O.normal_pairs(rows, pairs, ["k"], "raw").collect()} == {0: "BTC/USDT", 1: "BTC/USD", 2: None, 3: None, 4: None, 5: "BTC/USD", 6: None}
    got = {r["k"]: (r["pairs"], r["rejected"], r["error"]) for r in O.baskets(rows, pairs, "k", "raw").collect()}
    assert got[6] == (["BTC/USD"], ["x"], None) and got[2] == ([], [], "missing symbols") and got[4][2] == "unsupported: eth"
    assert O.resolved(rows.select(F.col("raw").alias("query")), pairs.select("symbol", "name", F.lit("X").alias("exchange"), F.lit(True).alias("tradable")).filter("false")).filter("symbol IS NOT NULL").collect() == []
