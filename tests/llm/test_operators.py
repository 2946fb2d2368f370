"""Operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, imatch, langid, materialise, mixing, packing, quality, token_counts, topk_search, toxicity
from tidemark.llm.bpe import ByteBPE
from tidemark.llm.queries import BYTE_BPE, PIECE_BPE

BPE, PIECES = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)
ODD = ["", " ", "\n", "\n\n", "a  b", " a", "a ", "x\n y", "tab\tq", "▁ ▁x", "ﬁ①é é", "日本語 テスト", "<s> </s> <|endoftext|>x", "a" * 3000, "  \n  z \n", "😀 ok", "word " * 900]


def texts(seed=1, n=60):
    r = random.Random(seed)
    alphabet = "abc déß\n .,ñ中▁  A"
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 400))) for _ in range(n)] + [None]


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_tokens long, pretoken string").repartition(3)


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = texts()
    got = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, rows), PIECES, limit=50, table_size=20, cache_size=5).collect()}
    for i, t in enumerate(rows):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 50), t
    assert token_counts.count_tokens(frame(spark, ["a"]).filter("false"), PIECES).collect() == []


def test_bpe_is_the_library_s():
    from tokenizers import Tokenizer

    ours, theirs = ByteBPE(BPE), Tokenizer.from_file(BPE)
    for t in texts(5, 200)[:-1]:
        assert ours.ids(t).tolist() == theirs.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_round_trip(spark, capacity):
    from tokenizers import Tokenizer

    theirs, rows = Tokenizer.from_file(BPE), texts(2)
    got = packing.pack(frame(spark, rows), BPE, capacity=capacity, classes=16, keep_ids=True).toPandas()
    for i, t in enumerate(rows):
        own = got[got.doc_id == i].sort_values("start")
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in own.ids])
        assert ids.tolist() == [*theirs.encode(t or "", add_special_tokens=False).ids, 0]
        assert own.start.tolist() == np.r_[0, own.length.cumsum()[:-1]].tolist() and set(own.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(b) == c for b, c in zip(own.ids, own.ids_crc32, strict=True))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.r_[0, s.length.cumsum()[:-1]].tolist() and s.length.sum() <= capacity
    assert packing.pack(frame(spark, ["a"]).filter("false"), BPE).collect() == []


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4096, 5001):
        slots = materialise.permute(np.arange(n), n, "k")
        assert sorted(slots.tolist()) == list(range(n))
        assert materialise.permute(slots, n, "k", inverse=True).tolist() == list(range(n))
    assert materialise.permute(np.arange(1000), 1000, "k").tolist() != materialise.permute(np.arange(1000), 1000, "l").tolist()


def test_materialise_round_trip(spark, tmp_path):
    rows = texts(3)
    folder = f"file://{tmp_path}/shards"
    docs = frame(spark, rows)
    index = materialise.materialise(docs, BPE, folder, "k", length=32, per_shard=7).toPandas().sort_values("slot")
    n = len(index)
    assert index.slot.tolist() == list(range(n)) and (index["at"] == index.slot % 7 * 64).all()
    read = materialise.read_slots(spark, folder, 0, n, length=32, per_shard=7).toPandas().sort_values("slot")
    assert [zlib.crc32(b) for b in read.ids] == index.crc32.tolist()
    part = materialise.read_slots(spark, folder, 5, 9, length=32, per_shard=7).toPandas().sort_values("slot")
    assert part.ids.tolist() == read.ids.tolist()[5:9]
    df = materialise.materialise(docs, BPE, f"{folder}-2", "k", length=32, per_shard=7)
    stamps = {f: f.stat().st_mtime_ns for f in (tmp_path / "shards-2").iterdir()}
    assert len(df.limit(1).collect()) == 1 and df.count() == n and {f: f.stat().st_mtime_ns for f in (tmp_path / "shards-2").iterdir()} == stamps
    none = materialise.materialise(docs.filter("false"), BPE, f"{folder}-3", "k", length=32, per_shard=7)
    assert none.collect() == [] and not (tmp_path / "shards-3").exists()
    bpe = ByteBPE(BPE)
    assert sum(index.n_tokens) == sum(len(bpe.ids(t or "")) + 1 for t in rows)


def test_coder():
    rng = np.random.default_rng(1)
    coder = materialise.Coder(rng.permutation(60_000), 500)
    for high in (100, 20_000, 60_000):
        ids = rng.integers(0, high, 500)
        assert coder.unpack(coder.pack(ids), "<u2") == ids.astype("<u2").tobytes()


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 20)).astype(np.float32)
    v[50:80] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [float("nan")] * 20), (902, [1.0, None]), (903, []), (904, [float("inf")] * 20), (None, v[1].tolist()), (905, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in topk_search.top_k(df, F.col("vec_id") % 25 == 0, k=10, block=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    e = np.floor(v.astype(np.float64) * 1024).astype(np.int64)
    for q in range(0, 400, 25):
        s = e @ e[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:10]
        assert sorted(got[q]) == [(n + 1, i, s[i]) for n, i in enumerate(order)]
    assert set(got) == set(range(0, 400, 25))
    assert topk_search.top_k(df.filter("false"), F.lit(True)).collect() == []


@pytest.mark.parametrize("times", [2, 11, 50])
def test_topk_of_repeated_ids(spark, times):
    """A query's id in many rows takes no place among its results, whatever the number of parts and blocks."""
    r = np.random.RandomState(times)
    v = {i: r.randn(16).round(3).tolist() for i in range(60)}
    rows = [(i, v[i], "x") for i in v] + [(i, v[i], "y") for i in (0, 20, 21) for _ in range(times - 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    whole = [(i, np.floor(np.array(e) * 1024).astype(np.int64)) for i, e, _ in rows]
    want = []
    for q in (0, 20, 40):
        mine = next(x for i, x in whole if i == q)
        best = sorted(((-int(mine @ x), i) for i, x in whole if i != q))[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    for parts in (1, 3):
        got = topk_search.top_k(df.repartition(parts), F.col("vec_id") % 20 == 0, k=10, block=2).collect()
        assert sorted(map(tuple, got)) == want


def test_topk_of_large_and_tiny_components(spark):
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(90, 8)) * 10.0 ** rng.integers(-12, 7, (90, 1))).astype(np.float32)
    v[3, 0] = -1e-30
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    e = [[int(np.floor(float(c) * 1024)) for c in x] for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(e[a], e[b], strict=True))
    got = {}
    for r in topk_search.top_k(df, F.col("vec_id") % 10 == 0, k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 90, 10):
        order = sorted((i for i in range(90) if i != q), key=lambda i: (-dot(q, i), i))[:4]
        assert sorted(got[q]) == [(n + 1, i, dot(q, i)) for n, i in enumerate(order)]
    assert max(abs(r[2]) for x in got.values() for r in x) > 1 << 56
    far = spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|too big|Overflow"):
        topk_search.top_k(far, F.col("vec_id") == 0, k=1).collect()


def test_imatch(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    rows = [" ".join(r.choice(words) for _ in range(r.randrange(3, 300))) for _ in range(60)]
    rows += [rows[0], rows[0], "", None, "é", "###", "ABC def", rows[3].upper()]
    got = sorted(imatch.edit_report(frame(spark, rows)).collect(), key=lambda x: x["doc_id"])
    plain = [t or "" for t in rows]
    prints = {}
    for i, x in enumerate(got):
        t, nxt = plain[i], plain[(i + 1) % len(plain)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, x["fingerprint"]) == x["fingerprint"] and 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        assert (edited != t) or x["fingerprint"] == x["edited_fingerprint"]
    assert got[60]["near_next"] == 1.0 and np.mean([x["near_edited"] for x in got[:59]]) > 3 * np.mean([x["near_next"] for x in got[:59]])
    assert imatch.edit_report(frame(spark, ["a"]).filter("false")).collect() == []
    assert len(imatch.edit_report(frame(spark, ["one"])).collect()) == 1


def test_imatch_ids_over_the_whole_range(spark):
    ids = [-(2**62) - 5, 2**62 + 5, -(2**63), 2**63 - 1, *range(40)]
    df = spark.createDataFrame([(i, f"word{n} text {n}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["edited_sha256"] for r in imatch.edit_report(df).collect()}
    order = sorted(zip(ids, [f"word{n} text {n}" for n in range(len(ids))], strict=True))
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()


@pytest.mark.parametrize(("run", "steps"), [(3, 4), (1, 256), (1000, 256)])
def test_next_row_over_runs(spark, monkeypatch, run, steps):
    """Ids in two far clumps, repeated and null ones: each row is followed by the next one."""
    monkeypatch.setattr(imatch, "RUN", run)
    monkeypatch.setattr(imatch, "STEPS", steps)
    rows = [(i, str(i)) for i in [*range(50), *range(10**17, 10**17 + 30)]] + [(7, "7b"), (None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["text"]: r["next_text"] for r in imatch.with_next(df, ["text"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}


def test_imatch_lexicon_holds_the_whole_band(spark):
    shared = [f"w{i}" for i in range(40_000)]  # df 2 of 4: in the band
    rows = [" ".join(shared + ["one"]), " ".join(shared), " ".join(f"r{i}" for i in range(5000)), "two"]  # r0.. have df 1: out of it
    df = frame(spark, rows)
    lex = imatch.lexicon(df)
    inside = lambda words: F.size(imatch.marks(F.lit(" ".join(words)), lex))
    held, rare = spark.range(1).select(inside(shared), inside(["w0"] + [f"r{i}" for i in range(5000)])).first()
    assert held == 40_000 and rare < 40
    assert imatch.lexicon(df.filter("false")) == b"\0"


def labelled(n, seed, make):
    r = random.Random(seed)
    return [(i, *make(r)) for i in range(n)]


def test_language_mixture(spark):
    syllables = {"aa": "ka to mi re su no", "bb": "sch ung keit ver ein ach", "cc": "tion eau oux que ment ai"}

    def make(r):
        lang = r.choice(list(syllables))
        return lang, " ".join("".join(r.choice(syllables[lang].split()) for _ in range(3)) for _ in range(30))

    df = spark.createDataFrame(labelled(300, 1, make), "doc_id long, lang string, text string")
    names, p = langid.train(df.filter("doc_id < 200"))
    assert names == ["aa", "bb", "cc"]
    test = df.filter("doc_id >= 200").select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, "12 ,"), (902, "")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in langid.identify(test, names, p).collect()}
    truth = {r["doc_id"]: r["lang"] for r in df.collect()}
    assert all(got[i]["lang_pred"] == truth[i] for i in range(200, 300))
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    mixed = langid.infer(langid.trigrams(make(random.Random(3))[1] + " " + " ".join(["schungkeit", "verein", "achsch"] * 12)), p)
    assert (mixed > 0.2).sum() in (1, 2) and abs(mixed.sum() - 1) < 1e-6
    assert langid.identify(test, [], np.zeros((langid.SLOTS, 0), np.float32)).filter("lang_pred <> 'und'").count() == 0


def test_quality_machine(spark):
    def make(r):
        good = r.random() < 0.7
        words = [r.choice("abcdefgh") + r.choice(["ing", "er", "th"]) + str(r.randrange(99)) for _ in range(r.randrange(5, 80))]
        return int(good), " ".join(words) + "." if good else " ".join(w + r.choice(["$$$", "&&&", "!!"]) for w in words)

    df = spark.createDataFrame(labelled(500, 2, make), "doc_id long, label int, text string")
    model = quality.train(df.drop("label"), df.filter("doc_id < 350").select("doc_id", "label"))
    out = quality.score(df.select("doc_id", "text", F.lit(7).alias("score")), model).join(df.select("doc_id", "label"), "doc_id").filter("doc_id >= 350").toPandas()
    assert ((out.score >= 0.5) == (out.label == 1)).mean() > 0.97 and out.score.between(0, 1).all()
    odd = quality.score(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string"), quality.train(df.drop("label"), df.filter("false"))).collect()
    assert len(odd) == 3 and len({r["score"] for r in odd}) == 1
    x, at = np.array([0.5, 2.0, 1.0]), np.array([1, 5, 9])
    w0, w, v = 0.3, np.arange(10.0), np.random.default_rng(0).normal(size=(10, 3))
    pairs = sum((v[at[i]] @ v[at[j]]) * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert abs(quality.margin(at, x, w0, w, v)[0] - (w0 + w[at] @ x + pairs)) < 1e-9


def test_toxicity_grammar(spark):
    lexicon = toxicity.Lexicon({"idiot": 4.0, "vequ*": 3.0})
    score = lambda t: sum(toxicity.clause_scores(t, lexicon)[0])
    assert score("the idiot is here.") == 4.0 and score("Vequoir!") == 3.0 and score("fine.") == 0
    assert score("you idiot.") > score("an idiot.") > score("he was not an idiot.") > 0
    assert score("she said he was an idiot.") < score("he was an idiot.")
    assert score("I will kill you.") == score("you I will kill.") > 0 and score("I will kill time.") == 0
    assert score("the idiot, you.") == score("you, the idiot.") == 4.0 * 1.3
    assert 0 < score("she said I will kill you.") < score("I will kill you.") and 0 < score("I will never kill you.") < score("I will kill you.")
    assert score("kill. you") == 0 and score("du idiot") == score("tu idiot") == score("usted idiot") == 4.0 * 1.3
    for gap in ("\t", "\r", "\u00a0", "\u2003", "\x0b", " \r\n".strip("\n"), "  "):
        assert score(f"you{gap}idiot.") == score("you idiot."), repr(gap)
    assert score("you\nidiot.") == score("you\r\nidiot.") == 4.0  # a line is a clause
    assert score("idiot" * 5000) == 0.0 and toxicity.tokens("a\u00a0b\tc\n\nd") == ["a", "b", "c", "\n", "\n", "d"]
    assert score("you are kind. an idiot") == 4.0 and toxicity.clause_scores(None, lexicon) == ([], 0)

    def make(r):
        bad = r.random() < 0.3
        words = ["w" + str(r.randrange(500)) for _ in range(40)]
        if bad:
            for k in r.sample(range(40), 3):
                words[k] = "zorgu" + r.choice("abcdef")
        return int(bad), " ".join(words) + "."

    df = spark.createDataFrame(labelled(600, 5, make), "doc_id long, label int, text string")
    model = toxicity.train(df.drop("label"), df.filter("doc_id < 400"))
    out = toxicity.score(df.select("doc_id", "text"), model).join(df.select("doc_id", "label"), "doc_id").filter("doc_id >= 400").toPandas()
    assert (out.predicted == out.label).mean() > 0.97
    plain = toxicity.train(df.drop("label"), df.filter("false"))
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "you stupid idiot, you moron.")], "doc_id long, text string"), plain).collect()
    assert [r["predicted"] for r in sorted(odd)] == [0, 0, 1]


def test_mixing(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "b", None]), r.choice(["p", "q", "q", "q"]), "w\n" * r.randrange(0, 30) if i % 17 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, dom string, src string, text string")
    n = mixing.word_count(F.col("text"))
    got = mixing.mix(df, ["dom", "src"], {"dom": {"a": 3, "*": 1}}, share=0.9, epochs=3, seed="s", tokens=n).toPandas()
    assert len(got) == 400
    total = got.tokens.sum()
    read = (got.tokens * got.copies + got.part_tokens).sum()
    leaves = got.fillna("?").groupby(["dom", "src"])
    for _, leaf in leaves:
        budget = leaf.leaf_budget.iloc[0]
        assert budget <= 3 * leaf.tokens.sum() and (leaf.tokens * leaf.copies + leaf.part_tokens).sum() == budget
        assert (leaf.part_tokens > 0).sum() <= 1 and (leaf.part_tokens <= leaf.tokens).all()
        assert leaf.copies.max() - leaf.copies.min() <= 1
    assert abs(leaves.leaf_budget.first().sum() - int(total * 0.9)) <= 6 and read >= int(total * 0.9) - 6
    assert mixing.mix(df.filter("false"), ["dom", "src"], {}, 0.5, 1, "s", n).collect() == []
    all_ = mixing.mix(df, ["dom", "src"], {}, share=5.0, epochs=2, seed="s", tokens=n).toPandas()
    assert (all_[all_.tokens > 0].copies == 2).all()


def test_labelled_takes_the_lowest_hashes(spark):
    """The bound on the hash leaves the same ids as a sort of all of them; repeated ids count once."""
    known = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("label"))
    odd = spark.createDataFrame([(7, "many")] * 50 + [(None, "many"), (3, None)], "doc_id long, label string")
    got = common.labelled(known.select("doc_id"), known.unionByName(odd), 20).collect()
    for label in ("few", "many"):
        order = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()
        assert sorted(r["doc_id"] for r in got if r["label"] == label) == sorted(r["doc_id"] for r in order)
    assert common.labelled(known.select("doc_id"), known.filter("false"), 20).collect() == []
