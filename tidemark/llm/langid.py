"""Languages of a text as a mixture, by expectation-maximisation over character n-grams.

Each language has a distribution of hashed letter trigrams. A text's trigrams
are seen as drawn from a mixture of the languages: expectation-maximisation
finds the proportions, and the set of languages is the one of the highest
likelihood less a penalty for each language beyond the first, which grows
with the logarithm of the text's length (the Bayesian information criterion).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import labelled, slices

SLOTS = 1 << 16
#: Bytes of a model that is broadcast: SLOTS x 4 a language, so some 4,000 languages.
LARGEST_MODEL = 1 << 30
#: Training rows of a language: those of the lowest hash of the id.
SAMPLE = 1500
UNKNOWN = "und"


@functools.lru_cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Slots of a text's lower-case letter trigrams; words are set apart by a space, other signs are left out."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    ok = letters()[c]
    if not ok.any():
        return np.empty(0, np.int64)
    c = np.where(ok, c, 32).astype(np.uint64)
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    c = np.r_[np.uint64(32), c, np.uint64(32)]
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(48)).astype(np.int64)[c[1:-1] != 32]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages and their distributions (slots x languages), from SAMPLE rows of each language in docs (doc_id, text, lang) at most."""
    sample = labelled(docs.select("doc_id", F.col(text).alias("text")), docs.select("doc_id", F.col(lang).alias("label")), SAMPLE).filter("text IS NOT NULL").select("label", "text")

    def work(batches):
        total: dict[str, np.ndarray] = {}
        for piece in slices(batches):
            for name, t in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                total.setdefault(name, np.zeros(SLOTS, np.int64))
                total[name] += np.bincount(trigrams(t), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], ["lang", "counts"])

    counts: dict[str, np.ndarray] = {}
    for r in sample.coalesce(4).mapInArrow(work, "lang string, counts binary").toLocalIterator():
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(r["counts"], "<i8")
    names = sorted(counts)
    if not names:
        return [], np.zeros((SLOTS, 0), np.float32)
    c = np.stack([counts[n] for n in names], axis=1) + 0.05
    return names, (c / c.sum(axis=0)).astype(np.float32)


def proportions(count: np.ndarray, p: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Mixture weights of the languages in p's columns and the log-likelihood at them."""
    w, n = np.full(p.shape[1], 1 / p.shape[1]), count.sum()
    for _ in range(rounds):
        mixed = p @ w
        new = w * (p.T @ (count / mixed)) / n
        if np.abs(new - w).max() < 1e-3:
            w = new
            break
        w = new
    return w, float(count @ np.log(p @ w))


def infer(slots: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Proportions of all languages, zero outside the selected set."""
    at, count = np.unique(slots, return_counts=True)
    q = p[at].astype(np.float64)
    weights, _ = proportions(count, q)
    order = np.argsort(-weights, kind="stable")
    out, best = np.zeros(p.shape[1]), -np.inf
    for k in range(1, p.shape[1] + 1):
        chosen = order[:k]
        if k > 1 and weights[chosen[-1]] < 0.01:
            break
        w, like = proportions(count, q[:, chosen])
        like -= (k - 1) * np.log(count.sum() + 1)
        if like <= best:
            break
        best, out = like, np.zeros(p.shape[1])
        out[chosen] = w
    return out


def identify(docs: DataFrame, languages: list[str], p: np.ndarray, text: str = "text") -> DataFrame:
    """docs without `text`, with lang_pred, score (its proportion) and mixture (language to proportion).

    `und`, score 0 and an empty mixture for texts that are null or have no
    letter, and for all if no language was learned. Ties go to the language
    whose name sorts first. Repeated rows get equal results; an empty table
    gives an empty table; columns named as a result are replaced.
    """
    if p.nbytes > LARGEST_MODEL:
        raise ValueError(f"a model of {len(languages)} languages is too large to be sent to every task")
    shared = docs.sparkSession.sparkContext.broadcast((languages, p))  # languages x SLOTS x 4 bytes
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score", "mixture")]

    def work(batches):
        names, model = shared.value
        for piece in slices(batches):
            pred, score, mix = [], [], []
            for t in piece.column(piece.num_columns - 1).to_pylist():
                s = trigrams(t) if names else ()
                w = infer(s, model) if len(s) else np.zeros(0)
                pred.append(names[int(w.argmax())] if len(w) else UNKNOWN)
                score.append(float(min(1.0, w.max())) if len(w) else 0.0)
                mix.append([(names[i], float(w[i])) for i in np.flatnonzero(w)])
            cols = [*piece.columns[:-1], pa.array(pred), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [*piece.schema.names[:-1], "lang_pred", "score", "mixture"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(work, (fields + ", " if fields else "") + "lang_pred string, score double, mixture map<string,double>")
