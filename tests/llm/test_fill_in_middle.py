"""Fill-in-the-middle against a plain reading of its rule, and the skip list against sums."""

import hashlib
import random
import re

import pytest

from tidemark.llm import fill_in_middle as fim

ODD = ["", "\n", "\n\n\n", "a", "a\n", "\na", "no feed at the end\nb", "x<P>y\nz", "<S>", "<M\n>", "<<P\n>", "ﬁ\n😀é\n日本\n", "w" * 50_000, "\r\n\r\n", "l\n" * 4000, "<\nS>\n<M", None]


def test_skip_list():
    r = random.Random(1)
    for n in [*range(30), 257, 5000]:
        widths = [r.randrange(1, 90) for _ in range(n)]
        units = fim.SkipList(widths)
        most = 0
        for k in range(n + 1) if n < 400 else [0, 1, n // 3, n - 1, n]:
            chars, steps = units.reach(k)
            assert chars == sum(widths[:k])
            most = max(most, steps)
        assert most <= 80  # some four links a lane, not n


def plainly(doc_id, text, rate, spm, seed):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    sha = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm", "seed"), [(100, 50, "7:"), (40, 100, "x")])
def test_rows(spark, rate, spm, seed):
    r = random.Random(2)
    rows = [*enumerate(ODD), *((100 + i, "".join(r.choice("ab\n<PSM>é") for _ in range(r.randrange(1, 300)))) for i in range(200)), (3, "a"), (3, "a"), (None, "p\nq\nr"), (None, None)]
    docs = spark.createDataFrame([(i, t, "kept", i) for i, t in rows], "doc_id long, text string, form string, output long").repartition(3)  # two columns clash
    made = fim.restore(fim.fill_in_middle(docs, rate=rate, spm=spm, seed=seed)).collect()
    assert sorted(map(str, ((x["doc_id"], x["text"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) for x in made))) == sorted(str((i, t, *plainly(i, t, rate, spm, seed))) for i, t in rows)
    assert all(x["restored"] == (x["text"] or "") for x in made)
    assert fim.fill_in_middle(docs.filter("false")).collect() == []


def test_other_marks(spark):
    docs = spark.createDataFrame([(i, "a b\nc|d\n" * i) for i in range(30)], "doc_id long, text string")
    made = fim.restore(fim.fill_in_middle(docs, marks=("[P.]", "[S.]", "[M.]")), marks=("[P.]", "[S.]", "[M.]")).collect()
    assert all(x["restored"] == x["text"] for x in made) and {x["form"] for x in made} == {"plain", "psm", "spm"}
