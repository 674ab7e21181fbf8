"""Toxicity: a weighted finite-state grammar over clauses.

Words become symbols: insults and the like, threats, targets (whom it is said to), negations, words of
reported speech, others.  Each part of the grammar is a small transducer from symbols to symbols: the
negation transducer rewrites an insult or threat shortly after a negation, the reported-speech one what
follows a verb of saying in the same clause, the target one an insult near a person addressed, and the
scoring one maps what is left to patterns.  They are composed into a single machine, built once; every
clause runs through it, and what is matched is a clause with its context, not a word.

The lexicon of insults is learned: words and beginnings of words that labelled toxic documents have far
more often than clean ones.  The weights of the patterns are fitted on the same labelled sample.  The
closed classes of function words are fixed values below.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import training_labels

#: Labelled rows that are learned from, entries of the lexicon, at most.
MOST_LABELLED, MOST_ENTRIES = 20_000, 2_000
#: An entry needs so many different places (by the words on both sides, which near copies share) in toxic
#: texts, and half as many as it has toxic texts, and a share of the toxic texts so many times that of the clean ones.
LEAST_PLACES, LEAST_RATIO = 5, 25.0
#: Lengths of the beginnings of words that are tried.
STEMS = (4, 5, 6, 7, 8)

# Function words of the four languages, and words of threat.
TARGETS = frozenset("you your yours yourself u ur he she they them him her people everyone du dich dir ihr euch sie tu toi vous te usted ustedes vosotros ti".split())
NEGATIONS = frozenset("not no never nobody isn't aren't don't doesn't wasn't cannot can't nicht kein keine keinen niemals nie ne pas jamais aucun nunca jamás ningún".split())
REPORTED = frozenset("said says say called calls wrote writes quoted quotes according reported reports sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn töte töten umbringen tuer frapper matar golpear".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: What the composed machine writes: nothing, or a pattern with a weight.
PATTERNS = ("", "insult", "insult at target", "insult denied", "insult reported", "threat", "threat at target", "threat denied", "threat reported")
#: Weights before anything is learned, and the constant.
PRIOR = (0.0, 2.0, 3.0, 0.5, 1.0, 1.0, 3.5, 0.2, 0.5)
PRIOR_BIAS = -3.0
#: Labelled texts with a pattern from which on its weight is a learned one, and the least that a target adds.
LEAST_SEEN, AIMED = 20, 0.5

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Transducer:
    """Deterministic and letter to letter: ``arcs[state, symbol] = (state, symbol written)``; a symbol
    without an arc is passed on and the state kept."""

    arcs: dict
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, symbols) -> Transducer:
        """The composition: what this one writes is what ``other`` reads."""
        arcs, todo, start = {}, [(self.start, other.start)], (self.start, other.start)
        seen = {start}
        while todo:
            a, b = todo.pop()
            for x in symbols:
                a2, y = self.step(a, x)
                b2, z = other.step(b, y)
                arcs[(a, b), x] = (a2, b2), z
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(arcs, start)


def _scope(opens: int, mark: str, reach: int | None) -> Transducer:
    """After the symbol ``opens``, insults and threats within ``reach`` symbols (None: the clause) get
    the mark.  Symbols are numbers, or numbers with marks."""
    arcs = {}
    marked = [(x, *marks) for x in (INSULT, THREAT) for marks in ((), ("denied",), ("reported",), ("denied", "reported"))]
    plain = [OTHER, TARGET, NEGATION, REPORT]
    for left in range((reach or 1) + 1):
        after = left if reach is None else max(0, left - 1)
        for x in [*plain, *marked]:
            if x == opens:
                arcs[left, x] = (reach or 1), x
            elif left and x in marked:
                arcs[left, x] = after, (*x, mark)
            else:
                arcs[left, x] = after, x
    return Transducer(arcs)


def _aimed(reach: int = 4) -> Transducer:
    """Writes patterns.  An insult or threat with a target at most ``reach`` symbols before it is aimed at
    once; one that a target follows is written as such when the target comes."""
    arcs, names = {}, {INSULT: "insult", THREAT: "threat"}
    for seen in range(reach + 1):  # symbols left in which a target still counts
        for pending in (None, INSULT, THREAT):  # said, and still waiting for a target
            for wait in range(reach + 1) if pending is not None else (0,):
                state = seen, pending, wait
                lower = max(0, seen - 1)
                left = max(0, wait - 1)
                kept = (pending, left) if pending is not None and left else (None, 0)
                for x in (OTHER, NEGATION, REPORT):
                    arcs[state, x] = (lower, *kept), 0
                arcs[state, TARGET] = (reach, None, 0), PATTERNS.index(f"{names[pending]} at target") if pending is not None else 0
                for kind, name in names.items():
                    for marks in ((), ("denied",), ("reported",), ("denied", "reported"), ("reported", "denied")):
                        if marks:
                            out, then = PATTERNS.index(f"{name} {marks[-1]}"), (lower, *kept)
                        elif seen:
                            out, then = PATTERNS.index(f"{name} at target"), (lower, *kept)
                        else:
                            out, then = PATTERNS.index(name), (lower, kind, reach)
                        arcs[state, (kind, *marks)] = then, out
    return Transducer(arcs, (0, None, 0))


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """The composed machine: next state and pattern written, by state and symbol."""
    symbols = [OTHER, (INSULT,), (THREAT,), TARGET, NEGATION, REPORT]
    whole = _scope(NEGATION, "denied", 3).then(_scope(REPORT, "reported", None), symbols).then(_aimed(), symbols)
    states = {whole.start: 0}
    for (state, _), (to, _) in whole.arcs.items():
        for s in (state, to):
            states.setdefault(s, len(states))
    follow, write = np.zeros((len(states), len(symbols)), np.int64), np.zeros((len(states), len(symbols)), np.int64)
    for (state, x), (to, out) in whole.arcs.items():
        follow[states[state], symbols.index(x)], write[states[state], symbols.index(x)] = states[to], out
    return follow, write


class Words(dict):
    """Symbol of every word, worked out when first asked for."""

    def __init__(self, entries: frozenset[str]):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> int:
        if word in self.entries or any(word[:n] + "*" in self.entries for n in STEMS if len(word) >= n):
            out = INSULT
        else:
            out = THREAT if word in THREATS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTED else OTHER
        if len(self) < 500_000:
            self[word] = out
        return out


@dataclass
class Model:
    entries: frozenset[str]
    weights: tuple[float, ...] = PRIOR
    bias: float = PRIOR_BIAS

    def patterns(self, texts: list[str | None]) -> np.ndarray:
        """How many clauses of each text match each pattern (a clause counts once per pattern); what counts in
        the score is whether any does."""
        if not hasattr(self, "machine"):
            self.machine, self.words = tuple(x.tolist() for x in grammar()), Words(self.entries)
        (follow, write), symbol_of = self.machine, self.words
        out = np.zeros((len(texts), len(PATTERNS)))
        for row, text in enumerate(texts):
            lowered = (text or "").lower()
            if not any(symbol_of[w] in (INSULT, THREAT) for w in dict.fromkeys(_WORD.findall(lowered))):
                continue
            for clause in _CLAUSE.split(lowered):
                symbols = [symbol_of[w] for w in _WORD.findall(clause)]
                if INSULT in symbols or THREAT in symbols:
                    state, got = 0, set()
                    for x in symbols:
                        got.add(write[state][x])
                        state = follow[state][x]
                    out[row, list(got)] += 1
        out[:, 0] = 0
        return out

    def score(self, patterns: np.ndarray) -> np.ndarray:
        total = self.bias + np.minimum(patterns, 1) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _terms(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, place, 0, 0) of every word and beginning of a word of toxic texts, and (term, null, toxic,
    clean): in how many texts of a task it occurs."""
    counts = Counter(), Counter()
    names = ["term", "place", "toxic", "clean"]
    for pdf in batches:
        found = set()
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            words = _WORD.findall((text or "").lower())
            counts[int(label)].update(_terms(set(words)))
            if label:
                for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    place = zlib.crc32(f"{before} {after}".encode())
                    found.update((t, place) for t in _terms({w}))
        yield pd.DataFrame([(t, p, 0, 0) for t, p in found], columns=names)
    terms = counts[0].keys() | counts[1].keys()
    yield pd.DataFrame({"term": list(terms), "place": pd.array([None] * len(terms), "Int64"), "toxic": [counts[1][t] for t in terms], "clean": [counts[0][t] for t in terms]}, columns=names)


def lexicon(sample: DataFrame, most: int = MOST_ENTRIES) -> frozenset[str]:
    """Entries from labelled texts (text, label), each different text once.  A word is taken as it is; a
    beginning only where it gathers clearly more texts than any one word that begins so."""
    different = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sizes = {r[0]: r[1] for r in different.groupBy("label").count().toLocalIterator()}
    if not sizes.get(1) or not sizes.get(0):
        return frozenset()
    places = different.select("text", "label").mapInPandas(_places, "term string, place long, toxic long, clean long")
    once = places.groupBy("term", "place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    summed = once.groupBy("term").agg(F.count("place").alias("places"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / (sizes[1] + 1)) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    good = summed.where((F.col("places") >= LEAST_PLACES) & (2 * F.col("places") >= F.col("toxic")) & (ratio >= LEAST_RATIO))
    rows = good.orderBy(F.desc("toxic"), "term").limit(4 * most).collect()
    words = {r["term"]: r["toxic"] for r in rows if r["term"][-1] != "*"}
    taken = dict(words)
    for n in STEMS:  # short beginnings first; what they cover is left out
        for r in rows:
            term = r["term"]
            if term[-1] == "*" and len(term) == n + 1 and not any(term[:k] + "*" in taken for k in STEMS if k < n):
                below = [w for w in words if w.startswith(term[:-1])]
                if r["toxic"] >= 1.5 * max((words[w] for w in below), default=0):
                    taken[term] = r["toxic"]
                    for w in below:
                        taken.pop(w, None)
    return frozenset(sorted(taken, key=lambda t: (-taken[t], t))[:most])


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray, pull: float = 0.3, rounds: int = 30) -> tuple[tuple[float, ...], float]:
    """Logistic weights of the patterns by Newton's method, drawn towards PRIOR; row i counts n[i] times."""
    z = np.concatenate((np.minimum(x, 1), np.ones((len(x), 1))), axis=1)
    prior = np.array([*PRIOR, PRIOR_BIAS])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (n * (p - y)) + pull * (w - prior)
        w = w - np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + pull * np.eye(len(w)), slope)
    return ordered(w[:-1], w[-1], n @ z[:, :-1]), float(w[-1])


def ordered(weights: np.ndarray, bias: float, seen: np.ndarray) -> tuple[float, ...]:
    """Weights that keep the meaning of the patterns: one seen in fewer than ``LEAST_SEEN`` texts scores what
    it does before anything is learned, whatever the constant became; a target adds ``AIMED`` at least to an
    insult or threat, and denial and report add nothing to it."""
    w = np.where(seen < LEAST_SEEN, np.array(PRIOR) + PRIOR_BIAS - bias, weights)
    w[0] = 0.0
    for plain in (PATTERNS.index("insult"), PATTERNS.index("threat")):
        w[plain + 1] = max(w[plain + 1], w[plain] + AIMED)
        w[plain + 2 : plain + 4] = np.minimum(w[plain + 2 : plain + 4], w[plain])
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model for ``labels.toxic`` from ``docs`` (doc_id, text), learned on at most ``most`` labelled ids
    outside the held-out fold, which are broadcast.  Without labels of both kinds the lexicon is empty."""
    sample = docs.select("doc_id", "text").join(F.broadcast(training_labels(labels, "toxic", most)), "doc_id").select("text", "label")
    model = Model(lexicon(sample))

    @F.pandas_udf("array<double>")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(model.patterns(batch.tolist())), dtype=object)

    # texts with the same matches and label are one row, so few rows reach the driver
    rows = sample.select(matched("text").alias("x"), "label").groupBy("x", "label").count().orderBy("label", "x").collect()
    if len({r["label"] for r in rows}) < 2:
        return model
    x, y, n = (np.array([r[c] for r in rows], float) for c in ("x", "label", "count"))
    weights, bias = fit_weights(x, y, n)
    return Model(model.entries, weights, bias)


def score(text: str | Column, model: Model) -> Column:
    """Toxicity of a text column (0 to 1), null and empty texts included."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(model.patterns(batch.tolist())))

    return scored(text)
