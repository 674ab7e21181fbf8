"""Whitening of embeddings: principal components scaled to unit variance.

The covariance is gathered in two passes over all vectors: exact sums per dimension, then products of
centred entries.  A task adds up its own part with numpy and sends one row per entry, which Spark sums; the
driver receives d sums and the d * (d + 1) / 2 entries of the symmetric matrix and nothing that grows with
the number of vectors (at d = 2,000 some 50 MB).  There the leading eigenvectors are found: Householder
reflections to tridiagonal form, bisection on Sturm counts for the largest eigenvalues, and inverse
iteration, orthogonalised within clusters of close eigenvalues, carried back by the reflections.  Mean and
components are broadcast, d * 10 numbers, and every vector is projected by them.

Entries c become whole numbers floor(1024 * c) + 100000 (those beyond +-2**53 are held there), so sums and
squared distances from the mean are exact.  Rows whose vector is null, holds a null, NaN or infinity, or is
not as long as most vectors (ties: the longer) are left out; repeated rows count as often as they are there,
and a null id is kept.  No rows give no rows.  A component without variance (fewer distinct vectors than
components) has null ``whitened``, and ``explained`` 0 or, where nothing varies, null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, MOST = 1024, 100_000, 2**53
COMPONENTS = 8
#: Rows of a block of products.
BLOCK = 4_096
#: Eigenvalues closer than this, in norms of the matrix, are a cluster.
CLOSE = 1e-3
EPS = float(np.finfo(float).eps)


# -- eigenvectors -------------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors (unit vectors, or empty ones) of a symmetric matrix."""
    a, reflectors = np.array(matrix, float), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = float(np.sqrt(v @ v))
        v[0] += size if v[0] >= 0 else -size
        length = float(np.sqrt(v @ v))
        if length == 0 or not a[k + 2 :, k].any():
            reflectors.append(v[:0])
            continue
        v /= length
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        below = a[k + 1 :, k]
        below -= 2 * (v @ below) * v
        a[k, k + 1 :] = below
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def above(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are greater than each of ``x``."""
    tiny = np.finfo(float).tiny / EPS
    squares = np.concatenate(([0.0], off * off))
    q, count = np.ones_like(x), np.zeros(x.shape, int)
    for d, e in zip(diagonal.tolist(), squares.tolist()):
        q = d - x - e / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q > 0
    return count


def largest(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues by bisection, all at once."""
    around = np.concatenate(([0.0], np.abs(off))) + np.concatenate((np.abs(off), [0.0]))
    low, high = np.full(k, (diagonal - around).min()), np.full(k, (diagonal + around).max())
    margin = EPS * len(diagonal) * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high, wanted = low - margin, high + margin, np.arange(1, k + 1)
    for _ in range(1100):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= EPS * np.maximum(np.abs(low), np.abs(high)))):
            break
        enough = above(diagonal, off, middle) >= wanted
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    return low + (high - low) / 2


def solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row exchanges; pivots below ``least`` are set to it."""
    n = len(diagonal)
    main, up, up2 = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    steps = []
    for k in range(n - 1):
        under, nxt, nxt_up = float(off[k]), main[k + 1], up[k + 1]
        swap = abs(under) > abs(main[k])
        if swap:
            main[k], under = under, main[k]
            up[k], nxt, up2[k], nxt_up = nxt, up[k], nxt_up, 0.0
        if abs(main[k]) < least:
            main[k] = least
        factor = under / main[k]
        main[k + 1], up[k + 1] = nxt - factor * up[k], nxt_up - factor * up2[k]
        steps.append((swap, factor))
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for k, (swap, factor) in enumerate(steps):
            if swap:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= factor * x[k]
        for k in range(n - 1, -1, -1):
            x[k] = (x[k] - (up[k] * x[k + 1] if k + 1 < n else 0.0) - (up2[k] * x[k + 2] if k + 2 < n else 0.0)) / main[k]
        return np.array(x)

    return solve


def leading_eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as rows (the largest entry of each
    is positive)."""
    n = len(matrix)
    k = min(k, n)
    norm = float(np.abs(matrix).max())
    if norm == 0:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, reflectors = tridiagonal(matrix / norm)
    values = largest(diagonal, off, k)
    size = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0))
    random = np.random.default_rng(0)
    vectors, cluster, shift = np.zeros((k, n)), 0, 0.0
    for m, value in enumerate(values.tolist()):
        if m and values[m - 1] - value > CLOSE * size:
            cluster = m
        # equal eigenvalues are solved at slightly different shifts
        shift = min(value, shift - 10 * EPS * size) if m > cluster else value
        solve = solver(diagonal, off, shift, EPS * size)
        x = random.standard_normal(n)
        for _ in range(6):
            x = solve(x / np.abs(x).max())
            for _ in range(2):
                x -= vectors[cluster:m].T @ (vectors[cluster:m] @ x)
            x /= np.sqrt(x @ x)
        vectors[m] = x
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        if len(v):
            vectors[:, at + 1 :] -= 2 * np.outer(vectors[:, at + 1 :] @ v, v)
    vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    signs = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])
    return values * norm, vectors * signs[:, None]


# -- passes over the vectors --------------------------------------------------------------------------


def blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole numbers of their vectors) of the usable rows of a batch, in blocks."""
    column = batch.column(batch.num_columns - 1)
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.nonzero(lengths == dim)[0]
    for at in range(0, len(rows), BLOCK):
        part = rows[at : at + BLOCK]
        flat = column.take(pa.array(part)).flatten()
        c = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(part), dim)
        good = np.isfinite(c).all(axis=1)
        x = np.clip(np.floor(c[good] * SCALE) + SHIFT, -MOST, MOST).astype(np.int64)
        yield part[good], x


@dataclass
class Whitening:
    """A fitted transformation.  ``sums`` are exact; ``values`` are the leading eigenvalues."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    whole: np.ndarray = field(init=False)
    part: np.ndarray = field(init=False)

    def __post_init__(self):
        self.whole = np.array([s // max(self.n, 1) for s in self.sums], np.int64)
        self.part = np.array([s % max(self.n, 1) / max(self.n, 1) for s in self.sums], float)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole numbers first, so nothing is rounded away."""
        return (x - self.whole) - self.part

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates, NaN for components without variance."""
        floor = EPS * len(self.sums) * max(self.trace, np.finfo(float).tiny)
        scale = np.where(self.values > floor, 1 / np.sqrt(np.maximum(self.values, np.finfo(float).tiny)), np.nan)
        return self.centred(x) @ (self.components.T * scale)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 over the dimensions, exact; null beyond 64 bits."""
        rest = np.array([s % max(self.n, 1) for s in self.sums], float)
        rough = self.n * np.abs((x - self.whole).astype(float)) + rest
        small = (rough * rough).sum(axis=1) < 2.0**62
        out: list[int | None] = [None] * len(x)
        exact = (x[small] - self.whole) * self.n - rest.astype(np.int64)
        for row, value in zip(np.nonzero(small)[0].tolist(), (exact * exact).sum(axis=1).tolist()):
            out[row] = value
        for row in np.nonzero(~small)[0].tolist():
            value = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[row], self.sums))
            out[row] = value if value < 2**63 else None
        return out


def products(df: DataFrame, column: str, dim: int, points: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], float]:
    """Sums over all vectors of the products of each two coordinates of ``points``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in blocks(batch, dim):
                y = points(x)
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    sums = df.select(column).mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in sums.collect()}


def square(entries: dict[tuple[int, int], float], size: int, n: int) -> np.ndarray:
    out = np.zeros((size, size))
    for (i, j), v in entries.items():
        out[i, j] = out[j, i] = v / n
    return out


def dimension(df: DataFrame, column: str) -> int:
    """The length most vectors have, the longer one of two as frequent; 0 without vectors."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else 0


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The transformation for all vectors of ``df``, or None if there are none."""
    dim = dimension(df, column)
    if not dim:
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            for _, x in blocks(batch, dim):
                n += len(x)
                high, low = (x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)
                total = [t + (h << 26) + l for t, h, l in zip(total, high.tolist(), low.tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total])], ["d", "n", "s"])

    parts = df.select(column).mapInArrow(part, "d int, n bigint, s string")
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not rows:
        return None
    n, sums = rows[0]["n"], [int(r["s"]) for r in sorted(rows, key=lambda r: r["d"])]
    centre = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((0, dim)))
    covariance = square(products(df, column, dim, centre.centred), dim, n)
    values, vectors = leading_eigen(covariance, components)
    return Whitening(n, sums, float(np.trace(covariance)), np.maximum(values, 0.0), vectors)


def identity_error(df: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over all vectors and
    the components that have variance; null if none has.  Their mean is 0 by construction."""
    found = products(df, column, len(model.sums), model.project)
    errors = [abs(v / model.n - (i == j)) for (i, j), v in found.items() if not np.isnan(v)]
    return max(errors, default=None)


OUT = "component int, n bigint, deviation bigint, whitened double, explained double"


def whiten(df: DataFrame, id: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: ``id``, component (from 1), n, deviation, whitened, explained,
    identity_error."""
    schema = f"`{id}` {df.schema[id].dataType.simpleString()}, {OUT}"
    model = fit(df, column, components)
    if model is None:
        return df.sparkSession.createDataFrame([], f"{schema}, identity_error double")
    error = identity_error(df, model, column)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        k = len(own.values)
        share = own.values / own.trace if own.trace > 0 else np.full(k, np.nan)
        number = lambda a: pa.array(a, mask=np.isnan(a))
        for batch in batches:
            for picked, x in blocks(batch, len(own.sums)):
                times = np.repeat(np.arange(len(picked)), k)
                columns = [
                    batch.column(0).take(pa.array(picked)).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(picked))),
                    pa.array(np.full(len(times), own.n, np.int64)), pa.array(own.deviation(x), pa.int64()).take(pa.array(times)),
                    number(own.project(x).ravel()), number(np.tile(share, len(picked))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id, "component", "n", "deviation", "whitened", "explained"])

    return df.select(id, column).mapInArrow(rows, schema).withColumn("identity_error", F.lit(error).cast("double"))
