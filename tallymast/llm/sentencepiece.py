"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut where two neighbouring characters lie together in no piece, as no piece and
no merge crosses such a place, and every stretch that a worker does not remember goes into one indexed text
(words come back, so most are remembered: some 300,000 are, see ``REMEMBERED``).  Its suffix array is built by
prefix doubling, up to the length of the longest piece; all pieces are binary-searched in it at
once, which gives the range of suffixes each occurs at.  The occurrences are the edges of a graph
over positions: sorted by position, they are relaxed from left to right, one position of all
stretches at a time.

The vocabulary files are of the BPE kind, where the best path is not a sum of scores but the path on
which merging would end.  Relaxing uses that such a path is made of compatible neighbours: an edge
may follow the path chosen at its start if merging the two pieces alone leaves them as they are.  At
most one edge into every position qualifies, so the relaxed path is the encoding.  A vocabulary of
the unigram kind is relaxed by the sum of scores instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where public tokenizers lie, unless a caller names another file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, BYTE, UNIGRAM, BPE = 1, 2, 6, 1, 2
#: Stretches a worker remembers, about: so many met last, and as many met before that.
REMEMBERED = 200_000
#: Bytes of texts that are cut and matched together; a longer text is taken alone.
CHARS = 4_000_000

_PREPARED: dict[int, dict] = {}


def _as_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which compare like them."""
    return np.ascontiguousarray(rows).view(f"S{2 * rows.shape[1]}").ravel()


def _runs(sizes: np.ndarray, most: int) -> Iterator[int]:
    """How many entries at a time have a sum of about ``most``, at least one."""
    total, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield end - at
        at = end


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: 0, 5: 4}[key & 7] or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """What encoding needs of a model file; small enough to travel with a task (some hundred kB)."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int = BPE
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        with open(path, "rb") as f:
            data = f.read()
        out = cls([], [], [])
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append(piece[1].decode())
                out.scores.append(float(np.frombuffer(piece.get(2, bytes(4)), np.float32)[0]))
                out.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                out.model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                out.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models without a character map and space removal are supported")
        return out

    def prepared(self) -> Pieces:
        """Lookup tables, made once per worker and shared by its tasks."""
        if not hasattr(self, "ids"):
            key = hash((tuple(self.pieces), tuple(self.scores), self.model, self.dummy_prefix))
            if key not in _PREPARED:
                _PREPARED[key] = self._tables()
            self.__dict__.update(_PREPARED[key], key=key)
        return self

    def _tables(self) -> dict:
        named = list(zip(self.pieces, self.kinds, strict=True))
        ids = {p: i for i, (p, k) in enumerate(named) if k == NORMAL}
        list_ids = list(ids.values())
        inner = sorted({c for p in ids if len(p) > 1 for c in p})
        place = np.zeros(0x110000, np.int16)  # characters of longer pieces, numbered from 1
        place[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        joined = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in ids:
            codes = place[[ord(c) for c in p]]
            joined[codes[:-1], codes[1:]] = True
        # when merging makes a piece: single characters are there from the start
        by_score = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: (-self.scores[i], i))
        born = {self.pieces[i]: k + 1 for k, i in enumerate(by_score)} | {p: 0 for p in ids if len(p) == 1}
        longer = [k for k, p in enumerate(ids) if len(p) > 1]
        lower = np.zeros((len(longer), max((len(p) for p in ids), default=1)), ">u2")
        upper = np.full_like(lower, 0xFFFF)
        single = np.zeros(0x110000, np.int32)
        for k, p in enumerate(ids):
            if len(p) == 1:
                single[ord(p)] = k + 1
        for row, k in enumerate(longer):
            p = place[[ord(c) for c in self.pieces[list_ids[k]]]]
            lower[row, : len(p)] = upper[row, : len(p)] = p
        surfaces = [p.replace(SPACE, " ") if k == NORMAL else " ⁇ " if k == UNKNOWN else "" for p, k in named]
        for i, (p, k) in enumerate(named):
            if k == BYTE:
                surfaces[i] = chr(int(p[3:5], 16)) if int(p[3:5], 16) < 128 else None
        plain = [bytes([int(p[3:5], 16)]) if k == BYTE else (t or "").encode() for (p, k), t in zip(named, surfaces, strict=True)]
        return {
            "surface_bytes": np.frombuffer(b"".join(plain), np.uint8), "surface_starts": np.concatenate(([0], np.cumsum([len(b) for b in plain]))),
            "longer": np.array(longer, np.int64) + 1, "lower": lower, "upper": upper, "single": single, "surfaces": surfaces, "ids": ids, "byte_ids": {int(p[3:5], 16): i for i, (p, k) in enumerate(named) if k == BYTE}, "unknown": next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0),
            "all": list(ids), "length": np.array([0, *map(len, ids)], np.int64), "number_to_id": np.array([-1, *ids.values()], np.int64), "place": place, "joined": joined, "born": born, "halves": {}, "known": {}, "older": {}, "pair_keys": np.zeros(0, np.int64), "pair_fit": np.zeros(0, bool),
        }

    def stretches(self, text: str) -> list[str]:
        """The text cut where its neighbours are together in no piece."""
        codes = self.place[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = [0, *(np.flatnonzero(~self.joined[codes[:-1], codes[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merges(self, text: str, least: int = 1) -> list[str]:
        """What merging leaves of a short text: always the neighbours whose joint piece scores best, from
        the left, until ``least`` parts are left or nothing merges."""
        parts = list(text)
        while len(parts) > least:
            best = min(((b, k) for k in range(len(parts) - 1) if (b := self.born.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def split(self, piece: str) -> list[str]:
        """The two parts whose merge makes a piece; a piece that merging cannot make has more."""
        got = self.halves.get(piece)
        if got is None:
            got = self.halves[piece] = self.merges(piece, 2)
        return got

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves ``a`` and ``b``, side by side, as they are.

        Time runs backwards: whichever of the two was made last is split, and what then touches the
        seam must not merge across it before the time of that split (on equal time the left goes
        first, so ``b`` loses to a merge across and ``a`` wins)."""
        born, limit = self.born, float("inf")
        for p in (a, b):
            if len(p) > 1 and len(self.split(p)) != 2:
                return self.merges(a + b) == [a, b]
        while True:
            across = born.get(a + b)
            if across is not None and across < limit:
                return False
            if born[a] > born[b]:
                limit, a = born[a], self.split(a)[1]
            elif born[b]:
                limit, b = born[b] + 0.5, self.split(b)[0]
            else:
                return True

    def fitting(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which pairs of pieces are compatible; what is new is worked out and kept."""
        n, pieces = len(self.length), self.all
        keys = before * n + piece
        asked = np.unique(keys)
        at = np.minimum(np.searchsorted(self.pair_keys, asked), max(0, len(self.pair_keys) - 1))
        fresh = asked[self.pair_keys[at] != asked] if len(self.pair_keys) else asked
        if len(fresh):
            fit = np.array([self.compatible(pieces[k // n - 1], pieces[k % n - 1]) for k in fresh.tolist()], bool)
            both = np.concatenate((self.pair_keys, fresh))
            order = np.argsort(both, kind="stable")
            self.pair_keys, self.pair_fit = both[order], np.concatenate((self.pair_fit, fit))[order]
            _PREPARED[self.key].update(pair_keys=self.pair_keys, pair_fit=self.pair_fit)
        return self.pair_fit[np.searchsorted(self.pair_keys, keys)]

    # -- suffix array ------------------------------------------------------------------------------

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array over character numbers, sorted to the length of the longest piece, and the
        first and one past the last place in it of every piece of two characters or more."""
        width = self.lower.shape[1]
        rank = codes.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        for h in range((width - 1).bit_length()):
            after = np.full(len(rank), -1, np.int64)
            after[: max(0, len(rank) - (1 << h))] = rank[1 << h :]
            both = rank * (int(rank.max(initial=0)) + 2) + after + 1
            order = np.argsort(both)
            both = both[order]
            new = np.empty(len(rank), np.int64)
            new[order] = np.cumsum(np.concatenate(([True], both[1:] != both[:-1]))[: len(rank)])
            rank = new
        padded = np.concatenate((codes, np.zeros(width, codes.dtype))).astype(">u2")
        suffixes = _as_bytes(np.lib.stride_tricks.sliding_window_view(padded, width)[order])
        return order, np.searchsorted(suffixes, _as_bytes(self.lower), "left"), np.searchsorted(suffixes, _as_bytes(self.upper), "right")

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, number of the piece from 1) of every occurrence of a piece."""
        order, lo, hi = self.ranges(self.place[codes])
        count = hi - lo
        number = np.repeat(self.longer, count)
        start = order[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(number))]
        single = self.single[codes]
        one = np.flatnonzero(single)
        return np.concatenate((start + self.length[number], one + 1)), np.concatenate((number, single[one]))

    # -- relaxing ----------------------------------------------------------------------------------

    def learn(self, stretches: list[str]) -> None:
        """Encode stretches not seen before, all from one index, where U+10FFFF stands between them."""
        codes = np.frombuffer("\U0010ffff".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        end, piece = self.edges(codes)
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        first = np.cumsum(size + 1) - size - 1
        # characters that no piece stands for get an edge of their own, number 0
        bare = np.ones(len(codes) + 1, bool)
        bare[end[self.length[piece] == 1]] = bare[0] = bare[first] = False
        end, piece = np.concatenate((end, np.flatnonzero(bare))), np.concatenate((piece, np.zeros(bare.sum(), np.int64)))
        place = end - first[np.searchsorted(first, end - 1, "right") - 1]
        order = np.lexsort((piece, place))
        end, piece = end[order], piece[order]
        start = end - np.where(piece > 0, self.length[piece], 1)
        bounds = np.searchsorted(place[order], np.arange(1, int(size.max()) + 2))
        # the piece that ends the path to a position: -1 without a path, -2 where a stretch begins
        last, total = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1)
        last[first] = -2
        worth = np.array([-100.0, *(self.scores[i] for i in self.number_to_id[1:])])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            before = last[start[a:b]]
            ok = before != -1
            if self.model == BPE:
                ask = np.flatnonzero((before > 0) & (piece[a:b] > 0))
                ok[ask] = self.fitting(before[ask], piece[a:b][ask]) if len(ask) else True
            e, p, value = end[a:b][ok], piece[a:b][ok], total[start[a:b][ok]] + worth[piece[a:b][ok]]
            if self.model != BPE:  # the best path into every position
                best = np.lexsort((p, -value, e))
                best = best[np.diff(e[best], prepend=-1) != 0]
                e, p, value = e[best], p[best], value[best]
            last[e], total[e] = p, value
        # walk back, all stretches at once
        at, own, steps = first + size, np.arange(len(size)), []
        while len(own):
            p = last[at]
            steps.append((own, np.where(p > 0, self.number_to_id[p], -1 - codes[at - 1].astype(np.int64))))
            at = at - np.where(p > 0, self.length[p], 1)
            more = at > first[own]
            at, own = at[more], own[more]
        owners, found = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        order = np.argsort(owners, kind="stable")
        found, cuts = found[order].astype(np.int32), np.cumsum(np.bincount(owners, minlength=len(size)))
        spelled = np.minimum.reduceat(found, cuts - np.diff(cuts, prepend=0)) < 0
        data, known, low = found.tobytes(), self.known, 0  # bytes take a quarter of what a list takes
        for s, high in zip(stretches, (4 * cuts).tolist(), strict=True):
            known[s] = data[low:high]
            low = high
        for k in np.flatnonzero(spelled).tolist():
            ids = [i for x in np.frombuffer(known[stretches[k]], np.int32).tolist() for i in ((x,) if x >= 0 else self.spelled(chr(-1 - x)))]
            known[stretches[k]] = np.array(ids, np.int32).tobytes()

    def spelled(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; empty for a null or empty one."""
        self.prepared()
        cut = [self.stretches((SPACE if self.dummy_prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        known, older = self.known, self.older
        if len(known) > REMEMBERED:
            # what was not met since is forgotten, so frequent stretches stay
            older.clear()
            older.update(known)
            known.clear()
        new = []
        for s in {s for own in cut for s in own if s not in known}:
            ids = older.get(s)
            if ids is None:
                new.append(s)
            else:
                known[s] = ids
        if new:
            self.learn(new)
        return [np.frombuffer(b"".join([known[s] for s in own]), np.int32) for own in cut]

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Ids of a column of texts, about ``CHARS`` bytes of text at a time."""
        found, at = [], 0
        for size in _runs(pc.binary_length(texts).fill_null(0).to_numpy(), CHARS):
            found += self.encode(texts.slice(at, size).to_pylist())
            at += size
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))

    def decode_column(self, column: pa.Array) -> pa.Array:
        """Texts of a column of ids: the bytes of all pieces are gathered at once."""
        self.prepared()
        sizes, values = pc.list_value_length(column).fill_null(0).to_numpy(), column.flatten().to_numpy()
        starts, lengths = self.surface_starts, np.diff(self.surface_starts)
        out, at, row = [], 0, 0
        for rows in _runs(sizes, CHARS // 4):
            own = sizes[row : row + rows]
            ids = values[at : at + int(own.sum())]
            size = lengths[ids]
            data = self.surface_bytes[np.repeat(starts[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].tobytes()
            ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(own)].tolist() if len(ids) else [0] * rows
            for a, b in zip([0, *ends], ends):
                text = data[a:b].decode("utf-8", "replace")
                out.append(text[1:] if self.dummy_prefix and text[:1] == " " else text)
            at, row = at + len(ids), row + rows
        return pa.array(out, pa.string(), mask=np.asarray(column.is_null()))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids.  Control pieces read as nothing; bytes that are no UTF-8 as U+FFFD."""
        surfaces = self.prepared().surfaces
        parts = [surfaces[i] for i in ids]
        if None in parts:  # bytes of characters outside ASCII, which make sense together only
            held, whole = bytearray(), []
            for i, part in zip([*ids, -1], [*parts, ""], strict=True):
                if part is None:
                    held.append(int(self.pieces[i][3:5], 16))
                    continue
                if held:
                    whole.append(held.decode("utf-8", "replace"))
                    held.clear()
                whole.append(part)
            parts = whole
        text = "".join(parts)
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def encoded(text: str | Column, pieces: Pieces) -> Column:
    """Token ids of a text column (array of int)."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pieces.prepared().encode_column(batch)

    return ids(text)


def decoded(ids: str | Column, pieces: Pieces) -> Column:
    """Text of a column of token ids; null for null."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pieces.prepared().decode_column(batch)

    return text(ids)


def tokenize(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens`` of ``text``; a null or empty text has none.  The
    model file is read by the driver alone."""
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens")]
    return docs.select(*kept, encoded("text", Pieces.load(model)).alias("token_ids")).withColumn("n_tokens", F.size("token_ids"))
