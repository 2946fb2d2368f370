"""Sentences and what is built on them, on texts whose edges hold digits and blanks."""

import duckdb

from tidemark import registry
from tidemark.functions import text as T
from tidemark.operators import evidence
from tidemark.sources import media

Q, SQL = registry.queries(), registry.oracle_sql()
#: The sentence at place i begins with digits of i, and one of 21 signs is as long as one may be.
TEXTS = ["  0997 opens the text at place zero.  ", " ".join(f"{i}{i} is where this one of {i} begins at {i}!" for i in range(24)), "One sentence of no use here. 1234567890123456 12 5%. ", "", " ", None]
NAMES = ["str01_sentences", "str09_number_rules", "win27_pack_sentences", "join23_repeated_sentences", "str05_agg15_repeated_shingles"]


def test_edges_are_blanks_only(spark):
    df = spark.createDataFrame([(TEXTS[0],), (TEXTS[1],)], "t string")
    first, many = [r[0] for r in df.select(T.sentences(df["t"])).collect()]
    assert first == ["0997 opens the text at place zero."]
    assert many == [f"{i}{i} is where this one of {i} begins at {i}!" for i in range(24)]


def test_queries_equal_their_sql(spark, tmp_path):
    texts = TEXTS + [f"{i} 7 Shared words that three issuers all of them do repeat in full. 1{i} of them is not." for i in range(4)]
    rows = [(i, t, "en", f"src{i}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in NAMES:
        df = Q[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)), name


def test_caption_lines_keep_their_digits(spark):
    raw = "WEBVTT\n\n00:01.000 --> 00:02.000\n  1999 was the year 1  \n222 more of 2\n"
    df = spark.createDataFrame([(raw,)], "raw string")
    assert [c["text"] for c in df.select(media.caption_cues(df["raw"]).alias("c")).first()["c"]] == ["1999 was the year 1 222 more of 2"]


def test_shingles_keep_edge_digits(spark):
    rows = [("a", "x y z. 1 of ours was sold to a firm in a town."), ("b", "x y z. 1 of ours was sold to a firm in a town."), ("c", "x y z. 1 of ours was sold to a firm in a town.")]
    got = {r["shingle"] for r in evidence.repeated_shingles(spark.createDataFrame(rows, "ticker string, text string")).collect()}
    assert "# of ours was sold to a firm" in got
