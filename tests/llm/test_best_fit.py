"""Bulk-synchronous best fit: exact round trip by the library, whole sequences, and no more of them than best fit one by one."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import best_fit
from tidemark.llm.queries import WORD_BPE
from tidemark.llm.word_bpe import WordBPE

PATH = public_tokenizers.path(WORD_BPE)
ODD = ["", None, " ", "It's  we'll\tDON'T ‘s", "ÀÉ ñandú Łódź ß ſ ÇA", "²½ x² 2024", "日本語 テスト", "Σίσυφος ΟΔΟΣ", "<|endoftext|> a <|startoftext|>b", "éå", "İI ıi Ⱥ", "a" * 3000, "!!'s '", "\x1ca\x00b", "word " * 900]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s():
    ours, theirs, r = WordBPE(PATH), library(), random.Random(4)
    alphabet = "abc'dsßÀİŁǅŉ²½ \n\t\r.,!-_ªº\xad\xb7x9'tmȺ<>|"
    for t in ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)] + [f"a{chr(c)}b {chr(c)}" for c in range(0x250)]:
        assert np.frombuffer(ours.data(t or ""), "<u4").tolist() == theirs.encode(t or "", add_special_tokens=False).ids, t


def check(got, rows, capacity, end_id=1):
    theirs = library()
    pieces = {}
    for x in got.itertuples():
        pieces.setdefault(x.doc_id, []).append(x)
    want = []
    for i, t in rows:
        ids = np.array([*theirs.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes()), len(ids)) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, want)) == sorted(str((None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32, x.doc_tokens)) for x in got.itertuples())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.r_[0, s.length.cumsum()[:-1]].tolist() and s.length.sum() <= capacity


@pytest.mark.parametrize("capacity", [16, 300, 4096])
def test_round_trip(spark, capacity):
    r = random.Random(capacity)
    rows = [*enumerate(ODD), *((50 + i, " ".join(r.choice(["hot", "cold", "x'y", "größe"]) for _ in range(r.choice([1, 40, 41, r.randrange(1, 500)])))) for i in range(300)), (7, "twice"), (7, "twice"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, length long, pid string").repartition(3)  # two columns clash
    got = best_fit.pack(docs, PATH, capacity=capacity, keep_ids=True).toPandas()
    check(got, rows, capacity)
    assert all(zlib.crc32(b) == c for b, c in zip(got.ids, got.ids_crc32, strict=True))
    alone = best_fit.sweep(sorted(got.length.tolist(), reverse=True), list(range(len(got))), [], capacity)[2]
    assert got.sequence_id.nunique() <= 1.02 * len(alone) + 2
    assert best_fit.pack(docs.filter("false"), PATH).collect() == []


def test_hot_length(spark):
    """One length holds most rows, over many shares: pairs of 150 in 300 fill up."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        docs = spark.createDataFrame([(i, "hot " * (149 if i % 5 else 7)) for i in range(7000)], "doc_id long, text string")
        got = best_fit.pack(docs, PATH, capacity=300).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 7000 and got.groupby("sequence_id").length.sum().max() == 300
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 300) + 2


def test_sweep():
    into, at, left = best_fit.sweep([5, 5, 3, 2], [0, 1, 2, 3], [(6, 90), (5, 91), (2, 92)], 10)
    assert into == [91, 90, 2, 92] and at == [5, 4, 0, 8] and left == {90: 1, 91: 0, 92: 0, 2: 7}
