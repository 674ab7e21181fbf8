"""Similarity join of documents on their word n-grams, by vertical partitioning.

The global order of all n-grams (ascending document frequency, then hash) is cut into fragments.

1. Every batch of documents sends its n-grams to the fragments they belong to, packed as arrays.
2. A fragment counts in how many documents each n-gram occurs and returns those of two or more.
3. Back at its batch, a document of n n-grams can have a link only if 3/4 n of them are shared
   (for a least similarity of 3/4), and its partner must share one of its rarest ones: its prefix
   in the global order.  Equal sets become one node, so copies cost nothing from here on.
4. Candidate pairs get their overlap counted per fragment and summed per pair, which is exact.

Only components are asked for, so not all pairs of a dense group are needed: in the first round a
node is tried with one hub it shares most prefix n-grams with, links are contracted, and only n-grams
whose documents lie in different components stay.  The next rounds try those outside the main
component of an n-gram with a few nodes inside.  The last round tries every remaining pair of
nodes that share a prefix n-gram and lie in different components, so that no link can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymast.operators.graph import components

from .common import stored

#: Characters hashed at a time in a worker, and documents at a time (their index takes two bytes).
CHUNK_CHARS, CHUNK_DOCS = 1_500_000, 60_000
#: Characters of the corpus behind one fragment; fragments, at least and at most.
FRAGMENT_CHARS, FEWEST, MOST = 15_000_000, 64, 65_536
#: Nodes of its main component that a node outside is tried with, in the rounds between the first and
#: the exhaustive one.
HUBS = (8,)
#: 64-bit words of the bitmap of a set, a power of two.
WORDS = 16
#: Pieces into which the overlap of a pair is cut.
PIECES = 4

_SEED = np.random.RandomState(20240501)
_BYTE = _SEED.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _SEED.randint(1, 2**63 - 1, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def ngram_hashes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit hash) of the distinct n-grams of every text, sorted by both.

    Words are runs of anything but space and U+0009 to U+000D, with A-Z in lower case.  A text with
    fewer than ``width`` words has its whole sequence as its one n-gram, a text without words none.
    """
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    gap = _SPACE[data]
    edge = np.diff(np.concatenate(([True], gap)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)))
    word = _mix((total[end] - total[start]) * _powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(begins, start, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    # the words after a document's last n-gram start none, unless it has one n-gram only
    left = (first + count)[doc] - np.arange(len(word))
    begin = np.flatnonzero((left >= width) | ((left == count[doc]) & (count[doc] < width)))
    h = count[doc[begin]].clip(max=width).astype(np.uint64) * _PLACE[63]
    for k in range(width):
        at = begin + k
        inside = at < (first + count)[doc[begin]]
        h = h + np.where(inside, word[np.minimum(at, len(word) - 1)] * _PLACE[k], np.uint64(0))
    h, d = _mix(h), doc[begin]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for pdf in batches:
        for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _set_names(d: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set, from sums over its hashes."""
    one = np.zeros(len(n), np.uint64)
    two = np.zeros(len(n), np.uint64)
    np.add.at(one, d, _mix(h + _PLACE[60]))
    np.add.at(two, d, _mix(h * _PLACE[61] + _PLACE[62]))
    both = np.stack((_mix(one + n.astype(np.uint64)), _mix(two)), axis=1)
    return [row.tobytes() if k else None for row, k in zip(both, n, strict=True)]


def _sent(fragments: int, width: int):
    """Step 1: packed n-grams per (fragment, batch), and the documents of the batch."""
    cuts = (np.arange(1, fragments, dtype=object) * 2**64 // fragments).astype(np.uint64)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(_chunks(batches)):
            d, h = ngram_hashes(texts, width)
            n = np.bincount(d, minlength=len(ids))
            batch = task << 32 | k
            order = np.argsort(h, kind="stable")
            h, d16 = h[order], d[order].astype(np.uint16)
            at = np.concatenate(([0], np.searchsorted(h, cuts, "left"), [len(h)]))
            low = h & np.uint64(2**48 - 1)
            lo, hi = (low & np.uint64(2**32 - 1)).astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16)
            packed = [(f, lo[a:b].tobytes() + hi[a:b].tobytes() + d16[a:b].tobytes()) for f, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            names = _set_names(np.sort(d), h[np.argsort(d16, kind="stable")], n)
            known = np.array([0 if i is None or i != i else 1 for i in ids], np.uint8)
            rows = np.array([int(i) if ok else 0 for i, ok in zip(ids, known, strict=True)], np.int64).tobytes() + n.astype(np.int64).tobytes() + known.tobytes() + b"".join(x or bytes(16) for x in names)
            yield pd.DataFrame({"fragment": [f for f, _ in packed] + [batch % fragments], "batch": batch, "ngrams": [p for _, p in packed] + [None], "rows": [None] * len(packed) + [rows]})

    return send


def _unpack(ngrams: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(ngrams) // 8
    low = np.frombuffer(ngrams, np.uint32, k).astype(np.uint64) | np.frombuffer(ngrams, np.uint16, k, 4 * k).astype(np.uint64) << np.uint64(32)
    return low, np.frombuffer(ngrams, np.uint16, k, 6 * k)


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2: the n-grams of one fragment that two documents or more have, back to their batches."""
    own = pdf["rows"].notna().to_numpy()
    out = [pd.DataFrame({"fragment": -1, "batch": pdf["batch"][own], "ngrams": None, "rows": pdf["rows"][own]})]
    if not own.all():
        sent = pdf[~own]
        low, index = zip(*map(_unpack, sent["ngrams"]), strict=True)
        size = np.array([len(x) for x in low])
        low, index = np.concatenate(low), np.concatenate(index)
        order = np.argsort(low, kind="stable")
        ranked = low[order]
        runs = np.concatenate(([0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, [len(ranked)]))
        often = np.empty(len(low), np.int64)
        often[order] = np.repeat(np.diff(runs), np.diff(runs))
        level = np.minimum(255, np.floor(4 * np.log2(often))).astype(np.uint8)
        ends = np.cumsum(size)
        packed = []
        for a, b in zip(ends - size, ends, strict=True):
            keep = a + np.flatnonzero(often[a:b] > 1)
            packed.append(low[keep].tobytes() + index[keep].tobytes() + level[keep].tobytes())
        out.append(pd.DataFrame({"fragment": sent["fragment"].to_numpy(), "batch": sent["batch"].to_numpy(), "ngrams": packed, "rows": None}))
        out[1] = out[1][[len(p) > 0 for p in packed]]
    return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]


def _gathered(least: Fraction):
    """Step 3: documents of one batch; ``shared`` is null for one that can have no link."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        head = next(x for x in pdf["rows"] if x is not None)
        k = len(head) // 33
        ids, n, known = np.frombuffer(head, np.int64, k), np.frombuffer(head, np.int64, k, 8 * k), np.frombuffer(head, np.uint8, k, 16 * k)
        names = [head[17 * k + 16 * i : 17 * k + 16 * i + 16] if n[i] else None for i in range(k)]
        tokens, index, level = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
        for f, p in zip(pdf["fragment"], pdf["ngrams"], strict=True):
            if p is not None:
                m = len(p) // 11
                tokens.append((np.frombuffer(p, np.uint64, m) | np.uint64(f) << np.uint64(48)).view(np.int64))
                index.append(np.frombuffer(p, np.uint16, m, 8 * m))
                level.append(np.frombuffer(p, np.uint8, m, 10 * m))
        tokens, index, level = np.concatenate(tokens), np.concatenate(index), np.concatenate(level)
        many = np.bincount(index, minlength=k)
        can = (many > 0) & (many * least.denominator >= n * least.numerator)
        keep = can[index]
        tokens, index, level = tokens[keep], index[keep], level[keep]
        order = np.lexsort((tokens, level, index))
        pieces = np.split(tokens[order], np.cumsum(np.bincount(index, minlength=k))[:-1])
        bits = np.zeros((k, WORDS), np.uint64)
        np.bitwise_or.at(bits, (index, tokens >> 6 & WORDS - 1), np.uint64(1) << (tokens & 63).astype(np.uint64))
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), known == 0), "n_shingles": n, "node": names, "shared": [p if ok else None for p, ok in zip(pieces, can, strict=True)], "bits": [b if ok else None for b, ok in zip(bits.view(np.int64), can, strict=True)]})

    return gather


def shared_ngrams(docs: DataFrame, width: int = 5, least: Fraction = Fraction(3, 4)) -> DataFrame:
    """(doc_id, n_shingles, node, shared, bits) of every row: set size, name of the set (null if empty),
    its n-grams that other documents have too, in global order, where these suffice for a link, and a
    bitmap of them."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    fragments = int(min(MOST, max(FEWEST, chars // FRAGMENT_CHARS)))
    packed = "fragment int, batch long, ngrams binary, rows binary"
    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_sent(fragments, width), packed)
    back = sent.groupBy("fragment").applyInPandas(_shared, packed)
    return back.groupBy("batch").applyInPandas(_gathered(least), "doc_id long, n_shingles long, node binary, shared array<long>, bits array<long>")


def _enough(overlap, a, b, least: Fraction):
    """overlap / (a + b - overlap) >= least"""
    return (least.denominator + least.numerator) * overlap >= least.numerator * (a + b)


def linked(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Those of the (a, b) ``pairs`` of nodes whose sets are similar enough: the overlap of each piece
    of the global order is counted on its own, then summed."""
    piece = lambda k: F.struct(F.lit(k).alias("piece"), F.filter("shared", lambda t: F.pmod(F.shiftright(t, 48), F.lit(PIECES)) == k).alias("part"))
    parts = sets.select("node", "n", F.explode(F.array(*map(piece, range(PIECES)))).alias("p")).select("node", "n", "p.piece", "p.part")
    left = pairs.join(parts.toDF("a", "n_a", "piece", "part_a"), "a")
    both = left.join(parts.toDF("b", "n_b", "piece", "part_b"), ["b", "piece"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("overlap"))
    whole = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return whole.where(_enough(F.col("overlap"), F.col("n_a"), F.col("n_b"), least)).select("a", "b")


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def link_components(sets: DataFrame, least: Fraction = Fraction(3, 4)) -> DataFrame:
    """(node, component) of the nodes with a link, from ``sets`` (node, n, shared, bits)."""
    prefix = F.col("n") - F.ceil(F.col("n") * least.numerator / least.denominator) + 1 - (F.col("n") - F.size("shared"))
    postings = sets.select("node", "n", F.size("shared").alias("s"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))).alias("k", "ngram"))
    own = (F.col("n") - F.col("s")).cast("int")  # n-grams no other document has, which come first in the order
    postings = postings.select("ngram", "node", "n", (own + F.col("k")).cast("int").alias("pos"), own.alias("own"), F.col("node").alias("component"))
    several = lambda p: p.groupBy("ngram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("ngram")
    postings = stored(postings.join(several(postings), "ngram", "left_semi"), "postings")
    edges = None
    for turn, hubs_tried in enumerate((1, *HUBS, None)):
        if hubs_tried == 1:
            # the node with the smallest share of n-grams of its own is the likeliest centre of a group
            hubs = postings.groupBy("ngram").agg(F.min(F.struct(F.col("own") / F.col("n"), "node", "n")).alias("hub"))
            met = postings.join(hubs, "ngram").where((F.col("node") != F.col("hub.node")) & _enough(F.least("n", "hub.n"), F.col("n"), F.col("hub.n"), least))
            best = met.groupBy("node", F.col("hub.node").alias("other")).count().groupBy("node").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
            pairs = best.select(*_ordered("node", "other")).distinct()
        else:
            counts = postings.groupBy("ngram", "component").count()
            main = counts.groupBy("ngram").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("all"))
            held = postings.join(main, "ngram").join(sets.select("node", "bits", F.size("shared").alias("s")), "node")
            rest, others = held.where("component <> main"), held
            if hubs_tried:
                many = F.col("all") > 2 * hubs_tried  # smaller groups are left to the last turn, which tries all their pairs
                first = F.row_number().over(Window.partitionBy("ngram").orderBy(F.xxhash64("node", F.lit(turn)), "node"))
                rest, others = rest.where(many), held.where(many & (F.col("component") == F.col("main"))).withColumn("first", first).where(F.col("first") <= hubs_tried)
            pair = rest.alias("x").join(others.alias("y"), "ngram").where("x.component <> y.component")
            low, tail = F.least("x.pos", "y.pos"), F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
            # every bit that differs is an n-gram of one set only
            differ = sum((F.bit_count(F.col("x.bits")[k].bitwiseXOR(F.col("y.bits")[k])) for k in range(1, WORDS)), F.bit_count(F.col("x.bits")[0].bitwiseXOR(F.col("y.bits")[0])))
            for most in (F.least("x.n", "y.n"), low + tail, (F.col("x.s") + F.col("y.s") - differ) / 2):
                pair = pair.where(_enough(most, F.col("x.n"), F.col("y.n"), least))
            pairs = pair.select(*_ordered("x.node", "y.node")).distinct()
        found = stored(linked(pairs, sets, least), "links")
        if turn and found.isEmpty():
            continue
        edges = found if edges is None else edges.unionByName(found)
        grouped = stored(components(edges), "components")
        if hubs_tried:
            moved = postings.drop("component").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
            postings = stored(moved.join(several(moved), "ngram", "left_semi").select("ngram", "node", "n", "pos", "own", "component"), "postings")
    return grouped


def near_duplicates(docs: DataFrame, width: int = 5, least: Fraction = Fraction(3, 4)) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents are linked if the Jaccard similarity of their sets of distinct word n-grams is
    ``least`` or more; a component is what links reach, named by its smallest doc_id.  A document
    without words has an empty set and no links.  Equal texts, repeated rows included, are linked;
    null ids are never the smallest, unless there is no other.
    """
    least = Fraction(least)
    rows = stored(shared_ngrams(docs, width, least), "ngrams")
    sets = stored(rows.where("shared is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("shared").alias("shared"), F.first("bits").alias("bits")), "sets")
    grouped = link_components(sets, least)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    named = nodes.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of_node = named.join(names, "component").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, least: Fraction = Fraction(3, 4)) -> DataFrame:
    """The rows of ``docs`` that name their component (its smallest doc_id), with all their columns, and
    one row only where an id is repeated.  A row without an id can name nothing and stays as it is."""
    found = near_duplicates(docs.where("doc_id is not null"), width, least)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))
