"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

Texts and benchmark items are compared as sequences of words (A-Z in lower case, ASCII punctuation
and space dropped; in scripts without spaces every character is a word).  An item leaks into a document if some stretch of the document is within
``edits`` x (words of the item) word insertions, deletions and replacements of it.

The walk of Chakraborty, Goldenberg and Koucky turns a sequence into one of three times its length:
at step j it writes the current word and moves on if a random bit of (j, word) says so.  Sequences
at small edit distance then differ in few places, so a sample of places is an LSH for the edit
distance.  Every window of a document that could be a leak is walked for several seeds, sampled
for several tables and looked up among the items; what collides is verified exactly by a
bit-parallel edit distance.

The walks of a long window drift apart, so a long item is looked up by pieces of at most PIECE
words: if the whole is within the bound, so is at least one piece.  A piece that collides places the
whole item, which is verified there.

A window is skipped without a walk only if too few of its adjacent word pairs occur in any item: a
word edit breaks at most two pairs, so no stretch within the bound is skipped.  Every start is
asked for its pairs, then the nearest start on the stride is walked.  The items are
handled in blocks of bounded size, so what a task holds does not grow with the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items and characters of one block, at most on average.
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 4_000_000
#: Length classes of windows: each this much longer than the one before.
STEP = 1.25
#: Windows of n words begin at every (n // STRIDE)-th word: the walk takes a shift like few edits.
STRIDE = 16
#: Random walks, samples of each, and places per sample: 36 tables of 3 places.  Measured recall in
#: ``tests/llm/test_decontaminate.py``: above 0.95 at the full bound of 20 % edited words.
WALKS, SAMPLES, PLACES = 6, 6, 3
#: Longer items are looked up by equal pieces of at most so many words.
PIECE = 40
#: Items of fewer words are searched as they are: one edit would be more than the bound.
LEAST_WORDS = 5
CHUNK_CHARS = 1_500_000

LEAK = "array<struct<item_id: bigint, edits: int, words: int, start_word: int>>"

_TABLE = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han and Yi.
_UNSPACED = re.compile("[\u0e01-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3031-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")


def words_of(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def coins(words: int, seed: int, steps: int) -> np.ndarray:
    """Random bits of every word id up to ``words``, one per step, 64 to an integer."""
    word, block = np.arange(words + 1, dtype=np.uint64)[None, :], np.arange(-(-steps // 64), dtype=np.uint64)[:, None]
    return _mix(word * np.uint64(0x9E3779B97F4A7C15) + block * np.uint64(1_000_003) + np.uint64(seed * 7_919 + 1))


def walk(rows: np.ndarray, bits: np.ndarray, steps: int) -> np.ndarray:
    """CGK embedding of every row of word ids, a step to a row of the result; beyond its end a
    sequence reads 0."""
    width = rows.shape[1]
    padded = np.concatenate((rows, np.zeros((len(rows), 1), rows.dtype)), axis=1)
    flat, at = padded.ravel(), np.arange(len(rows)) * (width + 1)
    end, out = at + width, np.empty((steps, len(rows)), rows.dtype)
    for j in range(steps):
        out[j] = word = flat[at]
        at = np.minimum(at + (bits[j >> 6][word] >> np.uint64(j & 63) & np.uint64(1)).astype(np.int64), end)
    return out


def sequences(words: np.ndarray) -> np.ndarray:
    """A hash of every column of word ids."""
    h = np.zeros(words.shape[1], np.uint64)
    for row in words:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) + np.uint64(1))
    return h


def edit_ends(item: list[int], stretch: list[int]) -> tuple[int, int]:
    """Least edit distance between the item and any part of the stretch, and where that part ends
    (the first such end), with all columns of the table held in the bits of one integer."""
    n = len(item)
    eq: dict[int, int] = {}
    for i, w in enumerate(item):
        eq[w] = eq.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, (n, 0)
    for j, w in enumerate(stretch):
        e = eq.get(w, 0) if w else 0
        x = e | minus
        d = ((((e & plus) + plus) ^ plus) | e) & full
        up, down = minus | (~(d | plus) & full), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (~(x | up) & full), up & x
        if score < best[0]:
            best = score, j + 1
    return best


@dataclass
class Items:
    """An index of one block of items: word ids, pairs, and per length class the LSH tables."""

    ids: list[int]
    edits: float
    words: dict[bytes, int] = field(default_factory=dict)
    rows: list[list[int]] = field(default_factory=list)

    def build(self, texts: list[str]) -> Items:
        pairs = set()
        for text in texts:
            row = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            self.rows.append(row)
            pairs.update(a << 32 | b for a, b in zip(row, row[1:], strict=False))
        self.pairs = np.array(sorted(pairs), np.int64)
        self.sets = [frozenset(r) for r in self.rows]
        self.most = [int(self.edits * len(r)) for r in self.rows]
        # items too short for an edit, by their words: hashes and items
        self.short = []
        for n in range(1, LEAST_WORDS):
            own = np.array([i for i, r in enumerate(self.rows) if len(r) == n], np.int64)
            if len(own):
                keys = sequences(np.array([self.rows[i] for i in own], np.int64).T)
                order = np.argsort(keys, kind="stable")
                self.short.append((n, keys[order], own[order]))
        # pieces: item, word of the item where it begins, words
        cuts = [(i, len(r), -(-len(r) // PIECE)) for i, r in enumerate(self.rows) if len(r) >= LEAST_WORDS]
        pieces = [(i, n * k // many, n * (k + 1) // many - n * k // many) for i, n, many in cuts for k in range(many)]
        self.piece_item, self.piece_at = (np.array([p[c] for p in pieces], np.int64) for c in (0, 1))
        lengths = sorted({m for _, _, m in pieces})
        classes, self.classes = [], []
        for n in lengths:
            if not classes or n > classes[-1] * STEP:
                classes.append(n)
        for n in classes:
            own = [p for p, (_, _, m) in enumerate(pieces) if n <= m <= n * STEP]
            need = max(1, n - 1 - 2 * max(int(self.edits * pieces[p][2]) for p in own))
            keys = self.keys(np.array([self.rows[pieces[p][0]][pieces[p][1] :][:n] for p in own], np.int64))
            piece = np.repeat(np.array(own), keys.shape[1])
            order = np.argsort(keys.ravel(), kind="stable")
            self.classes.append((n, need, keys.ravel()[order], piece[order]))
        return self

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """LSH keys of every row, one per table."""
        width, out = rows.shape[1], []
        draw, steps = np.random.RandomState(width), 2 * width - width // 4
        for seed in range(WALKS):
            far = walk(rows, coins(len(self.words), seed, steps), steps)
            for s in range(SAMPLES):
                h = np.full(len(rows), seed * SAMPLES + s + 1, np.uint64)
                for p in draw.randint(0, steps, PLACES):
                    h = (h ^ far[p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append(h)
        return np.stack(out, axis=1)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For every text its leaks: (item_id, edits, words of the item, word where the part that
        matches best ends, counted back by the item's words), best part per item."""
        found: list[list] = [[] for _ in texts]
        rows = [words_of(t) for t in texts]
        count = np.array([len(r) for r in rows], np.int64)
        ids = np.fromiter(map(self.words.get, chain.from_iterable(rows), repeat(0)), np.int64, int(count.sum()))
        doc = np.repeat(np.arange(len(rows)), count)
        first = np.cumsum(count) - count
        for n, keys, items in self.short:
            starts = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])
            probe = sequences(np.stack([ids[starts + j] for j in range(n)]))
            lo, many = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
            many -= lo
            start = np.repeat(starts, many)
            item = items[np.repeat(lo + many - np.cumsum(many), many) + np.arange(len(start))]
            # the first place of an item in a text
            both, at = np.unique(doc[start] * len(self.rows) + item, return_index=True)
            for k, i, p in zip((both // len(self.rows)).tolist(), (both % len(self.rows)).tolist(), start[at].tolist(), strict=True):
                if ids[p : p + n].tolist() == self.rows[i]:
                    found[k].append((self.ids[i], 0, n, p - int(first[k])))
        if not self.classes:
            return [sorted(x) for x in found]
        near = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (doc[:-1] == doc[1:]))
        key = ids[near] << 32 | ids[near + 1]
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        hit = near[self.pairs[at] == key] if len(self.pairs) else near[:0]
        per_doc = np.bincount(doc[hit], minlength=len(rows))
        live = np.flatnonzero(per_doc >= min(need for _, need, _, _ in self.classes))
        if not len(live):
            return [sorted(x) for x in found]
        widest = max(n + n // STRIDE for n, _, _, _ in self.classes)
        # the documents that are left, each followed by a widest window of nothing
        size = count[live] + widest
        begin = np.cumsum(size) - size
        flat, mark = np.zeros(size.sum(), np.int64), np.zeros(size.sum() + 1, np.int64)
        pair = np.zeros(len(ids), bool)
        pair[hit] = True
        for b, d in zip(begin, live, strict=True):
            flat[b : b + count[d]] = ids[first[d] : first[d] + count[d]]
            mark[b + 1 : b + 1 + count[d]] = pair[first[d] : first[d] + count[d]]
        sums = np.cumsum(mark)
        met = [np.zeros(0, np.int64)]  # (document, piece, start) in one number
        for n, need, keys, pieces in self.classes:
            starts = np.flatnonzero(sums[n - 1 : -1] - sums[: len(sums) - n] >= need)
            step = max(1, n // STRIDE)
            if step > 1:  # only the exact window is sure to have the pairs: its nearest start is walked
                base = begin[np.searchsorted(begin, starts, "right") - 1]
                starts = np.unique(base + (starts - base + step // 2) // step * step)
            if len(starts):
                probe = self.keys(np.lib.stride_tricks.sliding_window_view(flat, n)[starts]).ravel()
                lo, many = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
                many -= lo
                start = np.repeat(np.repeat(starts, len(probe) // len(starts)), many)
                piece = pieces[np.repeat(lo + many - np.cumsum(many), many) + np.arange(len(start))]
                met.append(((np.searchsorted(begin, start, "right") - 1) * len(self.piece_item) + piece) * len(flat) + start)
        # where the whole items may lie: (document, item) and a stretch, those that meet made one
        both, start = np.divmod(np.unique(np.concatenate(met)), len(flat))
        k, piece = np.divmod(both, len(self.piece_item))
        item = self.piece_item[piece]
        words, spare = np.array([len(r) for r in self.rows], np.int64)[item], np.array(self.most, np.int64)[item] + PIECE // 2
        a, z = start - self.piece_at[piece] - spare, start - self.piece_at[piece] + words + spare
        order = np.lexsort((a, item, k))
        k, item, a, z = k[order], item[order], a[order], z[order]
        both = k * len(self.rows) + item
        cuts = np.flatnonzero((np.diff(both, prepend=-1) != 0) | (a > np.concatenate((a[:1], z[:-1]))))
        a, z = np.maximum(a[cuts], begin[k[cuts]]), np.minimum(np.append(z[cuts[1:] - 1], z[-1:]), (begin + count[live])[k[cuts]])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k, i, a, z in zip(k[cuts].tolist(), item[cuts].tolist(), a.tolist(), z.tolist(), strict=True):
            row, spare, stretch = self.rows[i], self.most[i], flat[a:z].tolist()
            if len(self.sets[i].difference(stretch)) > spare:  # each missing word is an edit
                continue
            edits, end = edit_ends(row, stretch)
            if edits <= spare and ((k, i) not in best or edits < best[k, i][0]):
                best[k, i] = edits, max(0, int(a - begin[k]) + end - len(row))
        for (k, i), (edits, at) in best.items():
            found[live[k]].append((self.ids[i], edits, len(self.rows[i]), at))
        return [sorted(x) for x in found]


def index_blocks(benchmark: DataFrame, edits: float = 0.2) -> Iterator[Items]:
    """The items in blocks of bounded size, each read from ``benchmark`` (item_id, text) by itself."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        got = sorted((-1 if r[0] is None else r[0], r[1]) for r in own.toLocalIterator())
        yield Items([r[0] for r in got], edits).build([r[1] for r in got])


def _search(text: str | Column, items: Items) -> Column:
    @F.pandas_udf(LEAK)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out, start, size = [x or "" for x in batch], [], 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= CHUNK_CHARS or k == len(texts) - 1:
                    out += items.search(texts[start : k + 1])
                    start, size = k + 1, 0
            yield pd.Series([[dict(zip(("item_id", "edits", "words", "start_word"), leak, strict=True)) for leak in one] for one in out], dtype=object)

    return leaks(text)


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2) -> DataFrame:
    """One row per document and item that leaks into it: doc_id, item_id, edits (of the best part),
    words (of the item), start_word (about where the part begins).

    Null and empty texts have no leaks and repeated rows the same ones; of an item of fewer than
    LEAST_WORDS words only copies leak, an item without words never does; a null item_id reads -1.
    """
    parts = [docs.select("doc_id", F.explode(_search("text", block)).alias("leak")).select("doc_id", "leak.*") for block in index_blocks(benchmark, edits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    for block in index_blocks(benchmark, edits):
        docs = docs.where(F.size(_search("text", block)) == 0)
    return docs
