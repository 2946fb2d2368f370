"""Kept terms and divergences against a plain reading of the rule."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plainly(rows, least, top):
    words = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]) for text, lang, source in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for g, s, w in words:
        groups[g].add(s)
        docs[g].update(set(w))
        counts[g, s].update(w)
    out = []
    for g, sources in groups.items():
        kept = [t for t, n in docs[g].items() if n >= least]
        total = {s: sum(counts[g, s][t] for t in kept) for s in sources}
        share = lambda n, all_: 1 + 10**9 * (n + 2) // (all_ + 2 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(counts[g, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[g, s][t] for s in sources), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[g, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((g, s, part, item, v, i))
    return sorted(out)


def run(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("block", [50, 1_500_000])
def test_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    r = random.Random(6)
    stems = ["a", "ab", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "Abcdefghijklmnopq", "é", "éé", "Éé", "日本語", "日本", "x" * 200, "x" * 201, "über", "ÜBER", "z"]
    rows = [(" ".join(r.choice(stems[: r.randrange(1, len(stems) + 1)]) + r.choice(["", "", "q", "'s", "7"]) for _ in range(r.randrange(0, 25))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None])) for _ in range(400)]
    rows += [("HOT hot\thot\n" * 300, "en", "s1")] * 40 + [(None, "fr", "s1"), ("", "fr", "s2"), ("once", "it", "s9"), ("[\\]^_`{|}~\x7f\x00 09", "en", "s2")]
    df = spark.createDataFrame([(*x, "t", 5) for x in rows], "text string, lang string, source string, term string, n long").repartition(3)  # two columns clash
    for least, top in ((10, 10), (1, 3), (39, 2)):
        assert run(df, least=least, top=top) == plainly(rows, least, top)
    assert run(df.filter("false")) == []


def test_levels(spark):
    """Terms are kept by documents, not by how often they stand in one; a prefix that many terms share is refined to the end."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"common{x}{'y' * 60}a common{x}{'y' * 60}b " * 2, "en", "s") for x in letters] * 9
    rows += [(f"common{'g'}{'y' * 60}b", "en", "s"), ("many " * 50, "en", "s")]
    docs = divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert [tuple(r) for r in divergence.kept_terms(docs, 10).collect()] == [("en", "commong" + "y" * 60 + "b", 10)]
    assert divergence.kept_terms(docs, 9).count() == 52
