"""Every op query on the smallest tables: against its SQL, the libraries, or labels held out; and the pipeline against brute force."""

import hashlib
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from tests.llm.test_jaccard_join import brute
from tidemark.llm import mixing, quality, queries, toxicity
from tidemark.llm.bpe import ByteBPE

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RUN = queries.queries()


def documents(spark, folder):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = RUN[name](spark, SMALL)
    sql = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(names).toPandas().itertuples(index=False, name=None))) == sorted(map(str, sql.fetch_df().itertuples(index=False, name=None)))


def auc(score, label):
    order = pd.Series(score).rank().to_numpy()  # ties share a rank
    n1 = label.sum()
    return (order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize(("name", "column", "folds", "out", "least"), [("op5_quality", "quality", 5, 0, 0.95), ("op8_toxicity", "toxic", 3, 1, 0.85)])
def test_held_out(spark, name, column, folds, out, least):
    got = RUN[name](spark, MIDDLE).toPandas()
    fold = np.array([zlib.crc32(str(i).encode()) % folds for i in got.doc_id])
    assert (got.held_out == (fold == out)).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= (0.3 if column == "quality" else 0.7))).all()
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert auc(both.score.to_numpy(), both[column].to_numpy()) >= least
    bad = both[both[column] == 1]
    if column == "toxic":
        assert bad.predicted.mean() >= 0.75 and both[both[column] == 0].predicted.mean() <= 0.02
    else:
        assert bad.predicted.mean() >= 0.9


def test_language_held_out(spark):
    got = RUN["op4_language_id"](spark, MIDDLE).toPandas()
    docs = documents(spark, MIDDLE)
    out = got[got.held_out]
    assert set(out.doc_id) == {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [p == docs[i]["lang"] for i, p in zip(out.doc_id, out.lang_pred, strict=True) if docs[i]["lang"] and p != "und"]
    assert np.mean(right) > 0.97


def test_packing_and_order(spark):
    bpe = ByteBPE(public_tokenizers.path(queries.BYTE_BPE))
    docs = documents(spark, SMALL)
    got = RUN["op2_packing"](spark, SMALL).toPandas()
    ids = {i: np.append(bpe.ids(r["text"] or ""), 0).astype("<u4") for i, r in docs.items()}
    assert set(got.doc_id) == set(ids)
    for i, own in got.sort_values("start").groupby("doc_id"):
        assert own.start.tolist() == np.r_[0, own.length.cumsum()[:-1]].tolist() and own.length.sum() == len(ids[i]) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[i][a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    order = RUN["op3_materialise"](spark, SMALL).toPandas()
    assert sorted(order.slot) == list(range(len(order))) and order.n_tokens.sum() == sum(map(len, ids.values()))


def test_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_BPE))
    docs = documents(spark, SMALL)
    for r in RUN["op9_token_counts"](spark, SMALL).collect():
        t = docs[r["doc_id"]]["text"] or ""
        n = len(sp.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_fingerprints(spark):
    docs = documents(spark, SMALL)
    order = sorted(docs)
    rows = {r["doc_id"]: r for r in RUN["op10_imatch"](spark, SMALL).collect()}
    parts = lambda f: [f[i : i + 8] for i in range(0, len(f) - 7, 8)] if "-" not in f else None
    for k, i in enumerate(order):
        t, nxt = docs[i]["text"] or "", docs[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + (nxt["text"] or "")[:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = parts(rows[i]["fingerprint"]), parts(rows[nxt["doc_id"]]["fingerprint"])
        if a and b:
            assert abs(rows[i]["near_next"] - np.mean([x == y for x, y in zip(a, b, strict=True)])) < 1e-9


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """The smallest tables with repeated ids and rows, null and empty columns and texts under clashing ids."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long_ = max(docs.collect(), key=lambda r: len(r["text"] or ""))["text"]
    odd = [(None, long_, "en", "src0", 1), (3, "", None, None, None), (3, "", None, None, None), (4, None, "en", "src1", 0), (5, long_ * 3, "de", "src2", 5)]
    odd += [(7, " ".join(f"w{i}x{j}" for j in range(40)), "en", "src3", 9) for i in range(3)] + [(7, " ".join(f"w0x{j}" for j in range(40)), "fr", "src4", 9)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def bag(rows):
    return sorted(map(str, map(tuple, rows)))


def test_pipeline_by_brute_force(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    rows = docs.collect()
    kept = corpus_pipeline.drop_toxic(spark, docs, odd_tables).collect()
    insults, w = toxicity.train(docs, corpus_pipeline._labels(spark, odd_tables, "toxic", 3, 1))
    lexicon = toxicity.Lexicon(insults)
    bad = lambda t: 1 / (1 + np.exp(-(np.array(toxicity.features(*toxicity.clause_scores(t, lexicon))) @ w))) >= 0.7
    assert bag(kept) == bag(r for r in rows if not bad(r["text"])) and len(kept) < len(rows)

    model = quality.train(docs, corpus_pipeline._labels(spark, odd_tables, "quality", 5, 0))
    poor = corpus_pipeline.drop_poor(spark, docs, odd_tables).collect()
    slots = quality.Slots()
    assert bag(poor) == bag(r for r in rows if 1 / (1 + np.exp(-quality.margin(*quality.features(r["text"], slots), *model)[0])) >= 0.3)

    ordered = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))
    groups = {}
    for n, size, c in brute([(n, r["text"]) for n, r in enumerate(ordered)], 5, 80, 100):
        groups.setdefault(c if size else -1 - n, []).append(n)
    left = corpus_pipeline.drop_near_copies(spark, docs, odd_tables).collect()
    assert len(left) == len(groups)
    firsts = [(ordered[min(g)]["doc_id"], frozenset(ordered[n]["text"] for n in g)) for g in groups.values()]
    for r in left:
        firsts.remove(next(f for f in firsts if f[0] == r["doc_id"] and r["text"] in f[1]))
    assert not firsts

    bpe = ByteBPE(public_tokenizers.path(queries.BYTE_BPE))
    total = sum(len(bpe.ids(r["text"] or "")) for r in rows)
    mixed = corpus_pipeline.mix_sources(spark, docs, odd_tables).collect()
    used = sum(len(bpe.ids(r["text"] or "")) for r in mixed)
    assert 0.6 * total < used <= 0.8 * total and not set(bag(mixed)) - set(bag(rows))


def test_pipeline_runs_whole(spark, odd_tables, tmp_path):
    out = corpus_pipeline.run(spark, odd_tables)
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{odd_tables}/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for name in ("op1_jaccard_join", "op2_packing", "op3_materialise", "op4_language_id", "op5_quality", "op7_mixing", "op8_toxicity", "op9_token_counts", "op10_imatch"):
        assert RUN[name](spark, str(tmp_path)).collect() == [], name


def test_mixing_of_equal_ids(spark):
    """Rows that share an id are placed by tokens and then by the tie column, whatever the number of tasks."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a " * (i % 4), str(i), "x") for i in range(40)], "doc_id long, text string, lang string, source string")
    runs = [bag(mixing.mix(df.repartition(n), ["source"], {}, 0.5, 1, "s", mixing.word_count(F.col("text")), then=F.col("lang")).select("lang", "copies", "part_tokens").collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
