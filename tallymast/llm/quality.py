"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics are computed where the documents are; only those of a bounded sample of labelled
rows reach the driver, which fits the trees with numpy.  A fitted model is a handful of flat arrays
(complete trees in heap order), so a batch of documents walks all trees at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import training_labels

#: Labelled rows a model is fitted on, at most.
MOST_LABELLED = 20_000

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "letters", "upper", "digits", "spaces", "punctuation", "symbols", "wide", "bars",
    "exclamations", "distinct_words", "top_word", "distinct_pairs", "shouted_words", "marked_words", "short_words", "lines_per_word", "repeated_lines",
    "closed_lines", "capital_starts", "longest_word", "byte_entropy",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?'\"()-"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = True
_MARKS = frozenset("#$%&*+/<=>@[\\]^_`{}~|!")


def statistics(text: str | None) -> list[float]:
    """The numbers named in STATISTICS for one whole text; all zero for an empty one."""
    text = text or ""
    words = text.split()
    if not words:
        return [math.log1p(len(text))] + [0.0] * (len(STATISTICS) - 1)
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = len(data), len(words)
    share = lambda mask: float(counts[mask].sum()) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    often = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    present = counts[counts > 0] / size
    return [
        math.log1p(len(text)), math.log1p(n), float(lengths.mean()), float(lengths.std()), share(_UPPER | _LOWER), share(_UPPER), share(_DIGIT), share(_SPACE),
        share(_STOP), share(_SYMBOL), float(counts[128:].sum()) / size, counts[124] / size, counts[33] / size, len(often) / n, max(often.values()) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(not _MARKS.isdisjoint(w[-3:]) for w in words) / n, float((lengths <= 2).mean()), len(lines) / n, 1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in ".!?:;\"'" for x in lines) / len(lines), sum(x[:1].isupper() for x in words) / n, float(lengths.max()),
        float(-(present * np.log2(present)).sum()),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth in heap order: ``feature`` and ``cut`` of the inner nodes
    (a row goes right if its value is above the cut), ``leaf`` values, and the score before any tree."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        total = np.full(len(x), self.base)
        if len(x) and len(self.leaf):
            tree = np.arange(len(self.leaf))[None, :]
            at = np.zeros((len(x), len(self.leaf)), np.int64)
            row = np.arange(len(x))[:, None]
            for _ in range(int(math.log2(self.leaf.shape[1]))):
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
            total = total + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Boosting on the logistic loss.  Values are binned once at their quantiles; a level of a tree
    is one histogram per feature over (node, bin).  No rows, or one label only, give the prior."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(p / (1 - p))
    none = Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), base)
    if len(y) < 2 * least or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    total, feature, cut, leaf = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feats, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            nodes = 2**level
            best = np.full(nodes, 1e-6)
            chosen, where = np.zeros(nodes, np.int64), np.full(nodes, bins)
            for f in range(x.shape[1]):
                key = at * bins + binned[:, f]
                sums = [np.bincount(key, w, nodes * bins).reshape(nodes, bins).cumsum(axis=1) for w in (grad, hess, None)]
                (g, h, c), (ga, ha, ca) = (s[:, :-1] for s in sums), (s[:, -1:] for s in sums)
                gain = g**2 / (h + ridge) + (ga - g) ** 2 / (ha - h + ridge) - ga**2 / (ha + ridge)
                gain[(c < least) | (ca - c < least)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(nodes), top] > best
                best = np.where(better, gain[np.arange(nodes), top], best)
                chosen, where = np.where(better, f, chosen), np.where(better, top, where)
            first = nodes - 1
            feats[first : first + nodes] = chosen
            cuts[first : first + nodes] = [edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(chosen, where, strict=True)]
            at = 2 * at + (binned[np.arange(len(y)), chosen[at]] > where[at])
        g, h = np.bincount(at, grad, 2**depth), np.bincount(at, hess, 2**depth)
        values = rate * g / (h + ridge)
        total = total + values[at]
        feature.append(feats)
        cut.append(cuts)
        leaf.append(values)
    return Trees(np.stack(feature), np.stack(cut), np.stack(leaf), base)


def statistics_of(text: str | Column) -> Column:
    """The statistics of a text column as an array column."""

    @F.pandas_udf("array<double>")
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([statistics(x) for x in batch], dtype=object)

    return stats(text)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, **options) -> Trees:
    """Trees for ``labels.quality`` from ``docs`` (doc_id, text), fitted on at most ``most`` labelled
    documents outside the held-out fold.  The labelled ids are broadcast: their number is bounded."""
    chosen = training_labels(labels, "quality", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "doc_id", statistics_of("text").alias("x")).orderBy("doc_id", "x").limit(4 * most).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, rows["label"].to_numpy(float), **options)


def score(text: str | Column, model: Trees) -> Column:
    """Probability that a text column is of good quality (0 to 1), null and empty texts included."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([statistics(t) for t in batch], float).reshape(len(batch), len(STATISTICS))
            yield pd.Series(model.score(x))

    return scored(text)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns."""
    return docs.where(score("text", fit(docs, labels, **options)) >= least)
