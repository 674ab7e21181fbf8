"""Periodic runs: stretches of words that repeat with a period, such as boilerplate that a crawler or a
generator wrote over and over.

A run is a maximal stretch with smallest period q (words q apart are equal) of at least ``LEAST`` words and
at least ``TIMES`` periods.  Let a run start at s and be n words long.  Then suffixes s and s + q share
n - q words, no more, and no suffix between them shares as many with s (a shorter period would follow).
So the method: sort the suffixes of a document, unite classes of neighbouring suffixes by decreasing
length of their common prefix (Kruskal's order, union-find), keep the positions of a class in order, and
look at positions that become neighbours in a union at common prefix l: those p <= l apart seed the
stretch [i, i + p + l) with period p.  It is a run if it is long enough and the words before i and before
i + p differ.  A smaller set is merged into the larger one, so n words cost O(n log n) lookups.

Only common prefixes of ``shortest_prefix`` words or more can seed a run, so unions stop there, and a
document without any repeated stretch of that length is not sorted at all.  That test hashes stretches;
it can let a document through in vain, never hold one back.

Null and empty texts have no words and no runs; texts of any length are taken whole, and a task holds one
text or ``BATCH_WORDS`` words at a time.  Repeated rows give repeated results, rows with a null id are kept.
Ties between runs of one exponent go to the smallest start, then the smallest period.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 24, 3
#: Words of the texts that are sorted together.
BATCH_WORDS = 500_000
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
WORD = r"[^\x20\x09-\x0D]+"


def shortest_prefix(least: int = LEAST, times: int = TIMES) -> int:
    """The common prefix that every run's first two periods have at least: a run of period q and length
    n >= max(least, times * q) has n - q."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeats(words: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the documents in which a stretch of ``size`` words may occur twice."""
    if len(words) < size:
        return doc[:0]
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        base, back = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 2**64)
        power = np.full(len(words), base, np.uint64)
        unpower = np.full(len(words), back, np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * np.cumprod(power))))
        start = (sums[size:] - sums[:-size]) * np.cumprod(unpower)[: len(words) - size + 1]
        inside = doc[: len(start)] == doc[size - 1 :]  # stretches of one document
        key = start[inside] ^ (doc[: len(start)][inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    return np.unique(doc[: len(start)][inside][order[1:][same]])


def suffixes(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of documents laid end to end and the common prefix of each neighbouring two.  The
    document is the first key, so no prefix is common to two documents.  Ranks double in length."""
    total = len(words)
    _, rank = np.unique(doc * (int(words.max()) + 1) + words, return_inverse=True)
    ranks, size = [rank], 1
    last = np.append(np.nonzero(doc[1:] != doc[:-1])[0], total - 1)  # last position of each document
    ends = (last[np.searchsorted(last, np.arange(total))] + 1).astype(np.int64)
    while int(rank.max()) + 1 < total:
        ahead = np.arange(total) + size
        there = ahead < ends
        key = rank * (total + 1)
        key[there] += rank[ahead[there]] + 1
        _, rank = np.unique(key, return_inverse=True)
        ranks.append(rank)
        size *= 2
    order = np.argsort(rank)
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(total - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        padded = np.append(ranks[level], -1)
        same = padded[np.minimum(a, total)] == padded[np.minimum(b, total)]
        step = same.astype(np.int64) << level
        common, a, b = common + step, a + step, b + step
    return order, common


def seeds(order: np.ndarray, common: np.ndarray, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, l): positions that become neighbours in a class united at common prefix l >= ``shortest``."""
    edges = np.nonzero(common >= shortest)[0]
    edges = edges[np.argsort(-common[edges], kind="stable")]
    above: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def find(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for x, y, l in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist()):
        x, y = find(x), find(y)
        few, many = places.pop(x, None) or [x], places.pop(y, None) or [y]
        if len(few) > len(many):
            x, y, few, many = y, x, many, few
        above[x] = y
        for k, p in enumerate(few):
            at = bisect_left(many, p)
            if at and (k == 0 or few[k - 1] < many[at - 1]):
                yield many[at - 1], p, l
            if at < len(many) and (k + 1 == len(few) or few[k + 1] > many[at]):
                yield p, many[at], l
        if len(few) < 16:
            for p in few:
                insort(many, p)
        else:
            many = sorted(many + few)
        places[y] = many


def find_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every document, given as word numbers, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    shortest = shortest_prefix(least, times)
    long = [k for k, t in enumerate(texts) if len(t) >= least]
    if not long:
        return found
    joined = lambda ks: (np.concatenate([texts[k] for k in ks]).astype(np.int64), np.repeat(np.arange(len(ks)), [len(texts[k]) for k in ks]))
    hit = [long[k] for k in repeats(*joined(long), shortest).tolist()]
    if not hit:
        return found
    words, doc = joined(hit)
    starts = np.concatenate(([0], np.cumsum([len(texts[k]) for k in hit])))
    for i, j, l in seeds(*suffixes(words, doc), shortest):
        period, length = j - i, j - i + l
        if length >= least and length >= times * period:
            first = int(starts[doc[i]])
            if i == first or words[i - 1] != words[j - 1]:
                found[hit[doc[i]]].append((i - first, length, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when every run is cut to its first period."""
    stay = np.ones(n, bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def collapse_batch(texts: list[bytes | None], least: int, times: int) -> tuple[list, list]:
    """Runs and collapsed text of each text."""
    known: dict[bytes, int] = {}
    words = [(t or b"").split() for t in texts]  # bytes are split at the six ASCII white-space characters
    numbers = [np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws)) for ws in words]
    runs = find_runs(numbers, least, times)
    texts = [b" ".join(ws if not r else [ws[k] for k in np.nonzero(kept(len(ws), r))[0]]) for ws, r in zip(words, runs)]
    return [[dict(zip(("start", "length", "period"), r)) for r in one] for one in runs], texts


def periodic_runs(docs: DataFrame, text: str | Column = "text", least: int = LEAST, times: int = TIMES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs``, ``runs`` (start, length, period in words, by start and period) and
    ``collapsed``, the words that are left when each run is cut to its first period, joined by one space."""
    c = F.col(text) if isinstance(text, str) else text
    narrow = docs.select(F.struct(*keep).alias("own"), c.cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            column, low = batch.column(1), 0
            sizes = np.zeros(len(column) + 1, np.int64)
            sizes[1:] = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy())
            while low < len(column):
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + 6 * BATCH_WORDS, "right")) - 1)  # a word and its space: about six bytes
                runs, texts = collapse_batch(column.slice(low, high - low).to_pylist(), least, times)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(runs, kind), pa.array(texts, pa.binary())], ["own", "runs", "collapsed"])
                low = high

    out = narrow.mapInArrow(scan, f"own {narrow.schema['own'].dataType.simpleString()}, runs {RUN}, collapsed binary")
    return out.select("own.*", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the CRC-32 of its id, with a loop: its words from some place
    on repeat with a period.  The test input of the registered query; a null id has no loop."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    looped = lambda ws, g: F.transform(
        F.sequence(F.lit(0), F.size(ws) - 1),
        lambda i: F.get(ws, F.when(i < g % F.size(ws), i).otherwise(g % F.size(ws) + (i - g % F.size(ws)) % (1 + F.floor((F.size(ws) - g % F.size(ws)) / (3 + g % 8)))).cast("int")),
    )
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("ws"), F.floor(h / 10).alias("g"))
    return chosen.select("doc_id", F.when(F.size("ws") > 0, F.array_join(looped(F.col("ws"), F.col("g")), " ")).otherwise(F.col("text")).alias("text"))


def digest(runs: str = "runs", collapsed: str = "collapsed") -> list[Column]:
    """n_runs, the run of the greatest exponent (start, length, period, exponent_milli; null without runs),
    runs_sha256 and collapsed_sha256."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    top = F.aggregate(runs, none, lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return [
        F.size(runs).cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col(collapsed).cast("binary"), 256).alias("collapsed_sha256"),
    ]
