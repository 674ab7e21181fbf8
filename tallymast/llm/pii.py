"""Personal data: exact patterns, and a character-level bidirectional LSTM with a CRF on top.

The patterns find the base spans, which always stay.  The network is trained in numpy on spans the
patterns label in a bounded sample, and adds spans of the same kinds where they fail.  It reads
windows around digits and at-signs only, as every kind holds one of these; overlapping windows give
each character a weighted mean of their label scores, and one Viterbi pass over the whole region
with the CRF's transitions settles what the windows disagree on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import some_texts

KINDS = ("email", "ip", "card", "phone")
#: Documents a model is trained on, at most, and windows of each kind and of none from them.
MOST_DOCS, MOST_WINDOWS = 4_000, 300
WINDOW, STRIDE, MARGIN = 64, 48, 16
#: Windows the network reads at a time in a worker.
BATCH = 512

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins, which keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_CENTRE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def checked(text: str) -> Iterator[tuple[int, str, int, bool]]:
    """(start, kind, end, whether its check holds) of the matches of all patterns with a check."""
    for m in _IP.finditer(text):
        yield m.start(), "ip", m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        yield m.start(), "card", m.end(), 14 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield m.start(), "phone", m.end(), 10 <= len(_DIGITS.findall(m.group())) <= 15


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base spans, by start, then kind as listed."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(a, KINDS.index(k), b) for a, k, b, holds in checked(text) if holds]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


_CLASSES = "\n\t .,:;-_+@%()/\\\"'=#*&$|!?<>[]{}"


def _class_table() -> np.ndarray:
    """Class of a code point: 0 other, 1 digit, 2 lower, 3 upper, 4 other letters, then single marks."""
    table = np.zeros(0x10000, np.int16)
    table[0xC0:] = 4
    table[48:58], table[97:123], table[65:91] = 1, 2, 3
    for k, c in enumerate(_CLASSES):
        table[ord(c)] = 5 + k
    return table


_TABLE = _class_table()
N_CLASSES = 5 + len(_CLASSES) + 1
PAD = N_CLASSES - 1
LABELS = 1 + 2 * len(KINDS)  # none, then begin and inside of every kind


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, 0xFFFF)]


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches the network reads: MARGIN characters around every digit and at-sign, merged."""
    out: list[tuple[int, int]] = []
    for m in _CENTRE.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Weights: for each direction an input row per class, recurrent matrix; output, transitions."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> Tagger:
        draw = np.random.RandomState(seed)
        w = {}
        for way in "fb":
            w[f"{way}x"] = draw.normal(0, 0.3, (N_CLASSES, 4 * hidden))
            w[f"{way}x"][:, hidden : 2 * hidden] += 1  # forget gates open
            w[f"{way}h"] = draw.normal(0, hidden**-0.5, (hidden, 4 * hidden))
        w["o"], w["ob"], w["t"] = draw.normal(0, 0.3, (2 * hidden, LABELS)), np.zeros(LABELS), np.zeros((LABELS, LABELS))
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, row, unit) over class ids ``x`` (time, row)."""
        wx, wh = self.weights[f"{way}x"], self.weights[f"{way}h"]
        n = wh.shape[0]
        h, c = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = wx[x[t]] + h @ wh
            i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            before = c
            c = f * before + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores (row, time, label) of windows ``x`` (row, time)."""
        both = np.concatenate((self._run(x.T, "f"), self._run(x.T, "b")), axis=2)
        return (both @ self.weights["o"] + self.weights["ob"]).transpose(1, 0, 2)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """CRF negative log-likelihood of label paths ``y``, and its gradient, through time."""
        x, y, trans = x.T, y.T, self.weights["t"]
        steps, rows = x.shape
        kept = {"f": [], "b": []}
        hid = {way: self._run(x, way, kept[way]) for way in "fb"}
        both = np.concatenate((hid["f"], hid["b"]), axis=2)
        e = both @ self.weights["o"] + self.weights["ob"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        for t in range(1, steps):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        dt = sum(np.exp(alpha[t][:, :, None] + trans + (e[t + 1] + beta[t + 1])[:, None, :] - z[:, None, None]).sum(axis=0) for t in range(steps - 1))
        every, gold = np.arange(rows), 0.0
        for t in range(steps):
            gold += e[t][every, y[t]].sum() + (trans[y[t - 1], y[t]].sum() if t else 0)
            de[t][every, y[t]] -= 1
        np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1)
        grads = {"t": dt, "o": np.einsum("trh,trl->hl", both, de), "ob": de.sum(axis=(0, 1))}
        n = hid["f"].shape[2]
        for way, part in (("f", slice(0, n)), ("b", slice(n, None))):
            wh, up = self.weights[f"{way}h"], de @ self.weights["o"][part].T
            dx, dwh = np.zeros_like(self.weights[f"{way}x"]), np.zeros_like(wh)
            dh, dc = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
            for t, h, before, i, f, o, g, tc in reversed(kept[way]):
                dh = dh + up[t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)), axis=1)
                np.add.at(dx, x[t], dz)
                dwh += h.T @ dz
                dh, dc = dz @ wh.T, dc * f
            grads[f"{way}x"], grads[f"{way}h"] = dx, dwh
        return (z.sum() - gold) / rows, {k: v / rows for k, v in grads.items()}

    def region_labels(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Best label path of every region, from overlapping windows."""
        starts = [list(range(0, max(1, len(p) - WINDOW + STRIDE), STRIDE)) for p in parts]
        x = np.full((sum(map(len, starts)), WINDOW), PAD, np.int16)
        k = 0
        for p, own in zip(parts, starts, strict=True):
            for s in own:
                piece = p[s : s + WINDOW]
                x[k, : len(piece)] = piece
                k += 1
        scores = np.concatenate([self.emissions(x[i : i + BATCH]) for i in range(0, len(x), BATCH)])
        trust = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)[:, None] + 1  # little at a window's edge
        out, k = [], 0
        for p, own in zip(parts, starts, strict=True):
            total, weight = np.zeros((len(p), LABELS), np.float32), np.zeros((len(p), 1), np.float32)
            for s in own:
                m = min(WINDOW, len(p) - s)
                total[s : s + m] += scores[k, :m] * trust[:m]
                weight[s : s + m] += trust[:m]
                k += 1
            out.append(self.viterbi(total / weight))
        return out

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        trans = self.weights["t"]
        if not (e[:, 1:].max(axis=1) > e[:, 0] - 4 * np.abs(trans).max()).any():
            return np.zeros(len(e), np.int64)  # no label but the first can pay for the two transitions it changes
        back, score = np.zeros(e.shape, np.int64), e[0]
        for t in range(1, len(e)):
            step = score[:, None] + trans
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + e[t]
        path = np.zeros(len(e), np.int64)
        path[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def added(self, texts: list[str], base: list[list[tuple[int, str, int]]]) -> list[list[tuple[int, str, int]]]:
        """Spans the network finds in each text that touch no base span and nothing that the check of their own
        kind refuses: a number that fails its check digit is no card, whatever it looks like."""
        found: list[list] = [[] for _ in texts]
        where, parts = [], []
        for k, text in enumerate(texts):
            held = regions(text)
            if held:
                coded = classes(text)
                where += [(k, a) for a, _ in held]
                parts += [coded[a:b] for a, b in held]
        if not parts:
            return found
        for (k, a), path in zip(where, self.region_labels(parts), strict=True):
            i = 0
            while i < len(path):
                if path[i] % 2 == 1:  # odd labels begin a span
                    kind, j = (path[i] - 1) // 2, i + 1
                    while j < len(path) and path[j] == path[i] + 1:
                        j += 1
                    span = a + i, KINDS[kind], a + j
                    known = base[k] + [(s, own, e) for s, own, e, holds in checked(texts[k]) if own == span[1] and not holds]
                    if j - i >= 6 and _CENTRE.search(texts[k], *span[::2]) and not any(s < span[2] and span[0] < e for s, _, e in known):
                        found[k].append(span)
                    i = j
                else:
                    i += 1
        return found


def windows_of(text: str, draw: np.random.RandomState) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """(kind, classes, labels) of a window around every span of a whole text, and around two digits or
    at-signs outside all spans, each at a random place of its window."""
    spans = base_spans(text)
    starts, stops = np.array([a for a, _, _ in spans], np.int64), np.maximum.accumulate(np.array([b for _, _, b in spans] or [0], np.int64))
    inside = lambda p: (k := int(np.searchsorted(starts, p, "right"))) > 0 and p < stops[k - 1]
    other = [(m.start(), None, m.end()) for m in _CENTRE.finditer(text) if not inside(m.start())]
    centres = [*spans, *(other[i] for i in draw.permutation(len(other))[:2])]
    if not centres:
        return
    coded, gold = classes(text), np.zeros(len(text), np.int64)
    for a, k, b in spans:
        label = 1 + 2 * KINDS.index(k)
        gold[a], gold[a + 1 : b] = label, label + 1
    for a, k, b in centres:
        s = max(0, min(a, a - draw.randint(0, max(1, WINDOW - (b - a)))))
        row, lab = np.full(WINDOW, PAD, np.int16), np.zeros(WINDOW, np.int64)
        piece = coded[s : s + WINDOW]
        row[: len(piece)], lab[: len(piece)] = piece, gold[s : s + WINDOW]
        yield k, row, lab


def labelled_windows(texts: list[str], most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their labels of ``texts``, at most ``most`` of each kind and of none."""
    draw, count, x, y = np.random.RandomState(seed), dict.fromkeys((*KINDS, None), 0), [], []
    for text in texts:
        for kind, row, lab in windows_of(text, draw):
            if count[kind] < most:
                count[kind] += 1
                x.append(row)
                y.append(lab)
    return np.array(x, np.int16).reshape(-1, WINDOW), np.array(y, np.int64).reshape(-1, WINDOW)


def train(texts: list[str], hidden: int = 12, updates: int = 500, rows: int = 64, rate: float = 0.02, most: int = MOST_WINDOWS, seed: int = 11) -> Tagger | None:
    """A tagger from spans that the patterns label in ``texts``; None without any span."""
    return train_windows(*labelled_windows(texts, most, seed), hidden, updates, rows, rate, seed)


def train_windows(x: np.ndarray, y: np.ndarray, hidden: int = 12, updates: int = 500, rows: int = 64, rate: float = 0.02, seed: int = 11) -> Tagger | None:
    """A tagger from labelled windows (Adam); None without any span."""
    if not y.any():
        return None
    tagger, draw = Tagger.fresh(hidden, seed), np.random.RandomState(seed)
    first = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    second, step = {k: np.zeros_like(v) for k, v in tagger.weights.items()}, 0
    while step < updates:
        order = draw.permutation(len(x))
        for i in range(0, len(x), rows):
            own, step = order[i : i + rows], step + 1
            _, grads = tagger.gradient(x[own], y[own])
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grads.values()))) / 5)
            for k, g in grads.items():
                g = g / norm
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                pace = rate * max(0.02, 1 - step / updates)
                tagger.weights[k] = (tagger.weights[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def fit(docs: DataFrame, most: int = MOST_DOCS, windows: int = MOST_WINDOWS, seed: int = 11, **options) -> Tagger | None:
    """A tagger trained on whole texts, at most ``most`` with a digit or at-sign, those of the smallest hash,
    and on at most ``windows`` windows of each kind and of none from them.  Tasks cut the windows; the driver
    gets those alone."""
    chosen = some_texts(docs.where(F.col("text").rlike("[0-9@]")), most)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, text in zip(batch["h"], batch["text"]):
                found = list(windows_of(text, np.random.RandomState((h ^ seed) % 2**32)))
                yield pd.DataFrame({"h": h, "n": range(len(found)), "kind": [k or "" for k, _, _ in found], "x": [x.tobytes() for _, x, _ in found], "y": [y.tobytes() for _, _, y in found]})

    place = Window.partitionBy("kind").orderBy(F.xxhash64("h", "n"), "h", "n")
    rows = chosen.mapInPandas(cut, "h long, n long, kind string, x binary, y binary").withColumn("place", F.row_number().over(place))
    kept = sorted(rows.where(F.col("place") <= windows).select("h", "n", "x", "y").collect())
    x = np.frombuffer(b"".join(r["x"] for r in kept), np.int16).reshape(-1, WINDOW)
    y = np.frombuffer(b"".join(r["y"] for r in kept), np.int64).reshape(-1, WINDOW)
    return train_windows(x, y, seed=seed, **options)


_SPANS = "array<struct<kind: string, start: int, stop: int, base: boolean>>"


def spans(text: str | Column, tagger: Tagger | None) -> Column:
    """All spans of a text column: kind, start, stop (code points, stop exclusive), base."""

    @F.pandas_udf(_SPANS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            base = [base_spans(t) for t in texts]
            more = tagger.added(texts, base) if tagger else [[] for _ in texts]
            yield pd.Series([[{"kind": k, "start": a, "stop": b, "base": own} for a, k, b, own in sorted([(*s, True) for s in x] + [(*s, False) for s in y], key=lambda s: (s[0], KINDS.index(s[1]), s[2]))] for x, y in zip(base, more, strict=True)], dtype=object)

    return found(text)


def redact(text: str | Column, tagger: Tagger | None) -> Column:
    """The text with every span replaced by its kind in square brackets, for example ``[email]``;
    spans that overlap are replaced as one, by the kind of the first.  A null text stays null."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            base = [base_spans(t) for t in texts]
            more = tagger.added(texts, base) if tagger else [[] for _ in texts]
            out = []
            for given, text, a, b in zip(batch, texts, base, more, strict=True):
                parts, last = [], 0
                for start, kind, stop in sorted(a + b, key=lambda s: (s[0], KINDS.index(s[1]), s[2])):
                    if start >= last:
                        parts += [text[last:start], f"[{kind}]"]
                    last = max(last, stop)
                out.append(None if given is None else "".join(parts) + text[last:])
            yield pd.Series(out, dtype=object)

    return cleaned(text)


def redacted(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced and ``n_chars`` counted anew if it is there;
    other columns stay as they are."""
    tagger = fit(docs, **options)
    out = docs.withColumn("text", redact("text", tagger))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(spans_column: str | Column) -> list[Column]:
    """Counts of base spans by kind, the SHA-256 of the base spans written out, and all spans."""
    c = F.col(spans_column) if isinstance(spans_column, str) else spans_column
    base = F.filter(c, lambda s: s["base"])
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(c).alias("spans")]
