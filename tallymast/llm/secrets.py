"""Secret scan: exact patterns, and Markov models of random strings against ordinary identifiers.

Patterns find the base spans, which always stay.  The method scores every other token of 16 characters
or more (letters, digits and ``+/_=-``): the log-likelihood ratio of a first-order character chain
fitted on random strings against one fitted on ordinary words, per step.  Both chains are fitted here,
on labelled samples: values of base spans and digests of sampled texts are random strings, tokens
of sampled texts outside base spans are ordinary ones.  Spark expressions only.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import some_texts

KINDS = ("assign", "access", "hex", "random")
# (kind, pattern, group that must be long enough, its least length)
BASE = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run is taken whole, so this drops just the runs that are too short
)
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Shorter tokens are ordinary words too, to learn from.
WORD = r"[A-Za-z0-9+/_=-]{6,}"
#: Different texts the chains are fitted on, at most.
MOST_TEXTS = 2_000
#: Least mean log-likelihood ratio of a step for a span.
LEAST = 0.5

#: States of the chains: the characters of ASCII, of which tokens hold these.
STATES = 128
_CHARS = [i for i in range(STATES) if chr(i).isalnum() or chr(i) in "+/_=-."]
HITS = "array<struct<start: int, stop: int, hit: string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points, from the gaps between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(HITS).alias("out"))

    def add(acc: Column, e: Column) -> Column:
        a = acc["at"] + e["gap"]
        b = a + F.length(e["hit"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("stop"), e["hit"].alias("hit")))).alias("out"))

    found = F.aggregate(pairs, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(HITS))


def base_spans(text: Column) -> Column:
    """Base spans as (start, rank of the kind, stop, kind, value)."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        parts.append(_valued(matches(text, pattern), rank, kind, _group(pattern, group), least))
    return F.concat(*parts)


def _group(pattern: str, group: int):
    return lambda h: F.regexp_extract(h["hit"], pattern, group)


def _valued(found: Column, rank: int, kind: str, value, least: int) -> Column:
    valued = F.transform(found, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["stop"].alias("stop"), F.lit(kind).alias("kind"), value(h).alias("value")))
    return F.filter(valued, lambda h: F.length(h["value"]) >= least)


def _outside(tokens: Column, spans: Column) -> Column:
    """Tokens that touch no span."""
    return F.filter(tokens, lambda t: ~F.exists(spans, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))


def _steps(token: Column) -> Column:
    """Numbers of the pairs of neighbouring characters, which are ASCII here."""
    codes = F.transform(F.split(token, ""), F.ascii)
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * STATES + b)


def fit(docs: DataFrame, most: int = MOST_TEXTS) -> list[float] | None:
    """Log-likelihood ratio of every pair of classes, random against ordinary, from at most ``most`` texts
    with a base span and as many of all; None without either kind.  Tokens count once each, so copies
    weigh nothing; at most 2 x 4,624 sums reach the driver."""
    where = reduce(lambda a, b: a | b, [F.col("text").rlike(p) for _, p, _, _ in BASE])
    sample = some_texts(docs.where(where), most).unionByName(some_texts(docs, most)).distinct()
    known = sample.select(F.explode(F.transform(base_spans(F.col("text")), lambda s: s["value"])).alias("token"), F.lit(1).alias("random"))
    digest = F.sha2("text", 256)
    made = sample.select(F.explode(F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.substring(F.upper(F.base64(F.unhex(digest))), 1, 20))).alias("token"), F.lit(1).alias("random"))
    rest = reduce(lambda c, b: F.regexp_replace(c, b[1], " "), BASE, F.col("text"))
    words = sample.select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("token"), F.lit(0).alias("random"))
    pairs = known.unionByName(made).unionByName(words).distinct().select("random", F.explode(_steps(F.col("token"))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().toLocalIterator()}
    if {k for k, _ in counts} != {0, 1}:
        return None

    def chain(kind: int) -> dict[int, float]:
        rows = {a: [counts.get((kind, a * STATES + b), 0) + 0.1 for b in _CHARS] for a in _CHARS}
        return {a * STATES + b: math.log(x / sum(row)) for a, row in rows.items() for b, x in zip(_CHARS, row, strict=True)}

    random, ordinary = chain(1), chain(0)
    return [random.get(k, 0.0) - ordinary.get(k, 0.0) for k in range(STATES * STATES)]


def ratio(token: Column, weights: Column) -> Column:
    """Mean log-likelihood ratio of the steps of a token."""
    total = F.aggregate(_steps(token), F.lit(0.0), lambda acc, p: acc + F.get(weights, p))
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def random_tokens(tokens: Column, model: list[float], least: float) -> Column:
    """Tokens that the chains take for random strings.  The table of ratios is one literal, which numpy
    gives on the driver: an array expression of as many literals would be built anew for every step."""
    weights = F.lit(np.array(model, float))
    return F.filter(tokens, lambda t: ratio(t["hit"], weights) >= least)


def spans(text: str | Column, model: list[float] | None, least: float = LEAST) -> Column:
    """All spans of a text column, base and added, by start, then kind: (start, rank, stop, kind, value).
    A null text has none."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    base = base_spans(c)
    if model is None:
        return F.array_sort(base)
    tokens = random_tokens(_outside(matches(c, TOKEN), base), model, least)
    added = _valued(tokens, len(BASE), KINDS[-1], lambda t: t["hit"], 0)
    return F.array_sort(F.concat(base, added))


def scan(docs: DataFrame, model: list[float] | None = None, least: float = LEAST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of base spans by kind, the SHA-256 of the base spans
    written out as kind:start:stop, and all spans written out likewise."""
    found = docs.select("doc_id", spans("text", model, least).alias("found"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))

    def written(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:-1]]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
