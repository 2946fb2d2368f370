"""A factorisation machine that scores the quality of texts.

Features are hashed words, hashed tails of words, ranges of structure
statistics of the whole text and the text's own size as metadata. Each has a
weight and a vector of low rank; the sum over all pairs of features of
<v_i, v_j> x_i x_j is half the difference between the square of the sum and
the sum of squares, so scoring is linear in a text's features.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import labelled, slices

WORDS, TAILS, STATS = 1 << 15, 1 << 10, 1 << 10
SIZE = WORDS + TAILS + STATS
RANK = 8
#: Labelled rows of each class that training reads at most: those of the lowest hash of the id.
SAMPLE = 6000
EPOCHS = 5
KEPT = 300_000

#: Kinds of bytes: lower case, upper case, digits, white space, sentence marks, other ASCII, beyond ASCII.
KIND = np.full(256, 5, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 6
KIND[[9, 10, 11, 12, 13, 32]] = 3
KIND[[ord(c) for c in ".,;:'\"()-"]] = 4
STEPS = np.array([0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


class Slots(dict):
    """A word's two slots: its own, and that of its tail of signs."""

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        bare = word.rstrip("$%&*#!|~^=+<>@_/\\")
        tail = word[len(bare) :] or (word[-1] if not word[-1].isalnum() else "" if not word.isupper() else "UP")
        out = xxhash.xxh32_intdigest(bare.lower()) % WORDS, WORDS + xxhash.xxh32_intdigest("tail:" + tail) % TAILS
        if len(self) < KEPT:
            self[word] = out
        return out


def features(text: str | None, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a whole text and their values."""
    text = text or ""
    raw = text.encode()
    words = text.split()
    n = max(1, len(words))
    kinds = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=7) / max(1, len(raw))
    lines = text.split("\n")
    stats = [*kinds, len(set(words)) / n, len(set(lines)) / len(lines), min(1.0, len(raw) / n / 20), min(1.0, n / len(lines) / 60)]
    stats.append(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n)
    at = [WORDS + TAILS + i * 20 + int(np.searchsorted(STEPS, x)) for i, x in enumerate(stats)]
    at.append(WORDS + TAILS + 20 * len(stats) + len(raw).bit_length())
    value = np.ones(len(at), np.float32)
    if words:
        pairs = np.array(list(map(slots.__getitem__, words)), np.int64)
        w, cw = np.unique(pairs[:, 0], return_counts=True)
        t, ct = np.unique(pairs[:, 1], return_counts=True)
        w_value = np.log1p(cw) / np.sqrt((np.log1p(cw) ** 2).sum())
        at, value = np.concatenate([at, w, t]), np.concatenate([value, w_value, np.sqrt(ct / n)]).astype(np.float32)
    return np.asarray(at, np.int64), value


def margin(at: np.ndarray, x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
    """The machine's output for one text, and the sum of the x-weighted vectors."""
    xv = v[at] * x[:, None]
    total = xv.sum(axis=0)
    return float(w0 + w[at] @ x + 0.5 * (total @ total - (xv * xv).sum())), total


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights by AdaGrad on the logistic loss, in a fixed order."""
    rng = np.random.default_rng(7)
    w, v = np.zeros(SIZE, np.float32), rng.normal(0, 0.01, (SIZE, RANK)).astype(np.float32)
    gw, gv, g0 = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
    share = np.clip(np.mean([y for y, _, _ in rows]), 0.01, 0.99) if rows else 0.5
    w0 = float(np.log(share / (1 - share)))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, at, x = rows[i]
            s, total = margin(at, x, w0, w, v)
            d = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y
            dw = d * x + 1e-5 * w[at]
            dv = d * x[:, None] * (total - v[at] * x[:, None]) + 1e-4 * v[at]
            g0 += d * d
            gw[at] += dw * dw
            gv[at] += dv * dv
            w0 -= 0.05 * d / np.sqrt(g0)
            w[at] -= 0.1 * dw / np.sqrt(gw[at])
            v[at] -= 0.02 * dv / np.sqrt(gv[at])
    return w0, w, v


def train(docs: DataFrame, known: DataFrame, text: str = "text") -> tuple[float, np.ndarray, np.ndarray]:
    """A machine from docs (doc_id, text) and labels known (doc_id, label): SAMPLE of each class at most, fitted by one task; equal texts count once, with the label that most of them have (1 if half); no labelled row gives even scores."""
    rows = labelled(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")), known.filter(F.col("label").isin(0, 1)), SAMPLE)
    sample = rows.groupBy("text").agg(F.round(F.avg("label")).cast("int").alias("label"))

    def work(batches):
        slots, found = Slots(), []
        for piece in slices(batches):
            found += [(y, *features(t, slots)) for y, t in zip(*(c.to_pylist() for c in piece.select(["label", "text"]).columns), strict=True)]
        w0, w, v = fit(found)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((w0, w.astype(np.float32), v.astype(np.float32)))], pa.binary())], ["model"])

    ordered = sample.select("label", "text").coalesce(1).sortWithinPartitions(F.xxhash64("text"))
    found = ordered.mapInArrow(work, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without `text`, with score (likelihood of label 1) and predicted (score >= threshold).

    A null text is scored as an empty one. Repeated rows get equal scores; an
    empty table gives an empty table; columns named as a result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x (RANK + 1) x 4 bytes
    keep = [c for c in docs.columns if c not in (text, "score", "predicted")]

    def work(batches):
        slots, parts = Slots(), shared.value
        for piece in slices(batches):
            s = [margin(*features(t, slots), *parts)[0] for t in piece.column(piece.num_columns - 1).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(s, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(p, pa.float64())], [*piece.schema.names[:-1], "score"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(work, (fields + ", " if fields else "") + "score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
