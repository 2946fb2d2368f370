"""Toxicity by a weighted finite-state grammar over clauses.

Four transducers rewrite a clause's symbols one after the other: a target
makes insults and threats of its clause personal, whether it stands before or
after them; reported speech marks what follows a verb of saying; negation
marks the next words; and the last one weighs what is left. Since a target
may follow, the first machine is a pair of transducers: one reads the clause
from its end and marks matches with a target behind them, and the other three
with the one that looks ahead of them are composed into one that reads on
from the start. Clauses that hold an insult or a threat get a score; a text's
score is a logistic function of its clauses' scores, calibrated on labelled
texts.

The insult lexicon is learned: words, and beginnings of words, that labelled
toxic texts hold far more often than others (a lower bound of the log odds),
besides a few that always count. Words of threat, targets, negation and
reported speech are given below.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.llm.common import labelled, slices

#: Labelled rows that training reads at most, of toxic and of other ones: those of the lowest hash of the id.
SAMPLE = 12_000
PREFIXES = (4, 5, 6)
#: A word, or a line feed.
WORD = re.compile(r"\n|\S+").findall
KEPT = 400_000
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Kinds after the backward reading: AIMED more than the kind for an insult or threat with a target behind it.
AIMED = 6

WORDS = {
    THREAT: """kill kills killed murder destroy hurt harm punish attack burn crush beat stab shoot strangle choke smash ruin slaughter
        töten umbringen schlagen erschlagen erwürgen verprügeln zerstören vernichten verbrennen ermorden erschießen
        tuer tuerai assassiner frapper battre détruire brûler étrangler écraser massacrer
        matar mataré asesinar golpear destruir quemar apuñalar estrangular aplastar""",
    TARGET: """you your yours yourself yourselves u ur ya they them their theirs he him his she her hers
        du dich dir dein deine deiner deinen ihr euch euer eure sie ihn ihm ihnen
        tu toi te ton ta tes vous votre vos eux lui leur
        tú ti te tus usted ustedes vosotros vuestro ellos ellas él ella""",
    NEGATION: """not no never none nor neither nobody nothing without cannot can't isn't aren't wasn't weren't don't doesn't didn't won't wouldn't shouldn't couldn't
        nicht kein keine keinen keiner nie niemals niemand nichts ohne weder
        ne pas jamais aucun aucune personne rien sans ni
        nunca jamás nadie nada ningún ninguna sin tampoco""",
    REPORT: """said says say saying quote quotes quoted wrote writes claimed claims reported reports told tells alleged stated called according
        sagte sagt sagten schrieb schreibt behauptete behauptet berichtete erzählte nannte laut
        dit disait écrit écrivait affirme affirmait raconte déclare selon
        dijo dice decía escribió escribe afirmó afirma contó declaró según""",
}
#: Insults that always count, and their weight.
BASE, BASE_WEIGHT = "idiot moron stupid trash scum loser pathetic worthless disgusting clown", 3.0
THREAT_WEIGHT = 3.0


@dataclass(frozen=True)
class Transducer:
    """From (state, symbol) to (state, symbol written, weight added); the first state starts."""

    start: object
    step: object
    states: tuple


def reported() -> Transducer:
    """Insults and threats after a verb of saying count as reported."""

    def step(state, symbol):
        kind, *flags = symbol
        if kind in (INSULT, THREAT) and state:
            return state, (kind, *flags, "reported"), 0.0
        return state or kind == REPORT, symbol, 0.0

    return Transducer(False, step, (False, True))


def negated(reach: int = 3) -> Transducer:
    """Insults and threats within `reach` words after a negation count as negated."""

    def step(state, symbol):
        kind, *flags = symbol
        if kind == NEGATION:
            return reach, symbol, 0.0
        if kind in (INSULT, THREAT) and state:
            return state - 1, (kind, *flags, "negated"), 0.0
        return max(0, state - 1), symbol, 0.0

    return Transducer(0, step, tuple(range(reach + 1)))


def targeted() -> Transducer:
    """Insults and threats after a target in the reading are aimed at it."""

    def step(state, symbol):
        kind, *flags = symbol
        if kind in (INSULT, THREAT) and state and "targeted" not in flags:
            return state, (kind, *flags, "targeted"), 0.0
        return state or kind == TARGET, symbol, 0.0

    return Transducer(False, step, (False, True))


def weighed() -> Transducer:
    """Weights of what is left: a share of the matched word's own weight. A threat needs a target."""
    factor = {"reported": 0.6, "negated": 0.4, "targeted": 1.3}

    def step(state, symbol):
        kind, *flags = symbol
        if kind == THREAT and "targeted" not in flags:
            return state, symbol, 0.0
        return state, symbol, math.prod(factor[f] for f in flags) if kind in (INSULT, THREAT) else 0.0

    return Transducer(0, step, (0,))


def compose(first: Transducer, then: Transducer) -> Transducer:
    """The machine that passes what `first` writes to `then`; weights add up."""

    def step(state, symbol):
        a, out, w = first.step(state[0], symbol)
        b, out, v = then.step(state[1], out)
        return (a, b), out, w + v

    return Transducer((first.start, then.start), step, tuple(itertools.product(first.states, then.states)))


@functools.lru_cache
def grammar() -> tuple[list[list[int]], list[list[float]], int]:
    """Tables of the composed forward machine: next state and weight by state and kind; the start's number.

    A kind of AIMED or more is one that the backward reading has marked.
    """
    machine = functools.reduce(compose, (targeted(), reported(), negated(), weighed()))
    number = {s: i for i, s in enumerate(machine.states)}
    symbols = [(k,) for k in range(AIMED)] + [(k, "targeted") for k in range(AIMED)]
    steps = [[machine.step(s, x) for x in symbols] for s in machine.states]
    return [[number[t[0]] for t in row] for row in steps], [[t[2] for t in row] for row in steps], number[machine.start]


def marked_backward(kinds: list[int]) -> list[int]:
    """A clause's kinds after `targeted` has read them from the end."""
    machine = targeted()
    state, out = machine.start, []
    for kind in reversed(kinds):
        state, symbol, _ = machine.step(state, (kind,))
        out.append(kind + AIMED * (len(symbol) > 1))
    return out[::-1]


def clause_score(clause: list[tuple[int, float, bool]]) -> float:
    """The score of one clause by the backward and then the forward machine."""
    step, gain, state = grammar()
    total = 0.0
    for kind, (_, weight, _) in zip(marked_backward([c[0] for c in clause]), clause, strict=True):
        total += gain[state][kind] * weight
        state = step[state][kind]
    return total


class Lexicon(dict):
    """What a white-space token is: (kind, weight, whether it ends a clause)."""

    def __init__(self, insults: dict[str, float]):
        self.insults = {w: BASE_WEIGHT for w in BASE.split()} | insults
        self.fixed = {w: k for k, ws in WORDS.items() for w in ws.split()}

    def __missing__(self, token: str) -> tuple[int, float, bool]:
        ends = token[:1] == "\n" or token[-1:] in ".!?;:…"
        word = bare(token)
        weight = max((self.insults.get(key, 0.0) for key in keys(word)), default=0.0)
        kind = INSULT if weight > 0 else self.fixed.get(word, OTHER)
        out = (kind, weight if weight > 0 else THREAT_WEIGHT if kind == THREAT else 0.0, ends)
        if len(self) < KEPT:
            self[token] = out
        return out


def bare(token: str) -> str:
    """A token in lower case without the signs around it."""
    token = token.lower()
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def keys(word: str) -> list[str]:
    """What a word is looked up by: itself, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)] if word else []


def tokens(text: str) -> list[str]:
    """Words of a text, parted by any white space; a line feed is a token of its own."""
    return WORD(text)


def clause_scores(text: str | None, lexicon: Lexicon) -> tuple[list[float], int]:
    """Scores of the clauses with a match, and the number of words."""
    found = list(map(lexicon.__getitem__, tokens(text))) if text else []
    if not any(f[1] for f in found):
        return [], len(found)
    out, begin, hit = [], 0, False
    for at, (_, weight, ends) in enumerate(found):
        hit = hit or weight > 0
        if ends or at == len(found) - 1:
            if hit:
                out.append(clause_score(found[begin : at + 1]))
            begin, hit = at + 1, False
    return out, len(found)


def features(scores: list[float], words: int) -> list[float]:
    """Of a text: its strongest clause, the sum, the number of matched clauses and the sum over its length."""
    total = sum(scores)
    return [1.0, max(scores, default=0.0) / 5, math.log1p(total), math.log1p(len(scores)), math.log1p(100 * total / max(words, 1))]


def learn_insults(sample: DataFrame) -> dict[str, float]:
    """Lower bounds of the log odds of words and beginnings, from (label, text): those over 1.4, which only words of several toxic texts of the bounded sample reach."""

    def work(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for piece in slices(batches):
            for y, t in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                seen[y].update({k for w in set(map(bare, tokens(t))) for k in keys(w)})
        rows = [(k, seen[1][k], seen[0][k]) for k in seen[0].keys() | seen[1].keys()]
        for at in range(0, len(rows), 50_000):
            cols = list(zip(*rows[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["key", "bad", "good"])

    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    a, b = n.get(1, 0), n.get(0, 0)
    found = sample.select("label", "text").mapInArrow(work, "key string, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (a + 1)) - F.log((F.col("good") + 0.5) / (b + 1))
    weight = odds - 1.3 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    top = found.withColumn("weight", weight).filter("weight > 1.4")
    return {r["key"]: min(r["weight"], 6.0) for r in top.coalesce(1).collect()}


#: Weights of the features before any label is seen; the ridge draws towards them.
PRIOR = (-4.0, 2.0, 2.0, 1.0, 0.5)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights by Newton's method with a light ridge around PRIOR, which they stay at without rows."""
    prior = np.array(PRIOR)
    w, ridge = prior.copy(), np.array([0.01] + [0.1] * (len(prior) - 1))

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * ridge @ (w - prior) ** 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6 or size <= 1e-6:
            break
    return w


def one_of_alike(rows: DataFrame) -> DataFrame:
    """(label, text): of texts of a label with the same least hash among all their three-word runs, the one of least hash.

    Near copies mostly share that hash, so a group of them counts once; what
    is left out depends on whole texts alone and is the same in every run.
    """

    def least(words):
        return F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 3))))

    alike = rows.select("label", "text", let(F.split(F.lower("text"), r"(?U)\s+"), least).alias("alike"))
    return alike.groupBy("label", "alike").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")


def train(docs: DataFrame, known: DataFrame, text: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """The insult lexicon and the weights of a text's features, from docs (doc_id, text) and labels known (doc_id, label).

    SAMPLE of each label at most, of near copies one. A text that has both
    labels counts for both. Without labels the base insults and PRIOR hold.
    """
    rows = labelled(docs.select("doc_id", F.col(text).alias("text")).filter("text IS NOT NULL"), known.filter(F.col("label").isin(0, 1)), SAMPLE)
    sample = one_of_alike(rows.select(F.col("label").cast("int").alias("label"), "text")).repartition(8, "text").persist()
    insults = learn_insults(sample)

    def work(batches):
        lexicon = Lexicon(insults)
        for piece in slices(batches):
            f = [features(*clause_scores(t, lexicon)) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(f, pa.list_(pa.float64()))], ["label", "f"])

    found = sample.mapInArrow(work, "label int, f array<double>").collect()  # the sample's rows at most
    sample.unpersist()
    return insults, logistic(np.array([r["f"] for r in found]).reshape(-1, len(PRIOR)), np.array([r["label"] for r in found], float))


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without `text`, with score, predicted (score >= threshold) and clauses, the number of matched ones.

    Null and empty texts match nothing and get the score of a text without a
    match. Repeated rows get equal scores; an empty table gives an empty
    table; columns named as a result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of a bounded sample
    keep = [c for c in docs.columns if c not in (text, "score", "predicted", "clauses")]

    def work(batches):
        insults, w = shared.value
        lexicon = Lexicon(insults)
        for piece in slices(batches):
            found = [clause_scores(t, lexicon) for t in piece.column(piece.num_columns - 1).to_pylist()]
            x = np.array([features(*f) for f in found]).reshape(-1, len(PRIOR))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(p, pa.float64()), pa.array([len(f[0]) for f in found], pa.int32())], [*piece.schema.names[:-1], "score", "clauses"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(work, (fields + ", " if fields else "") + "score double, clauses int").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
