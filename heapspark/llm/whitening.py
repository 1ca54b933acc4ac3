"""Whitening of vectors: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

The centred rows of the fit list are reduced to one triangular factor, block after block and then along a tree, so
the covariance is never formed and small variances keep their digits.  The factor, which has as many rows as the
vectors have entries, is bidiagonalised on the driver; dqds gives its singular values to high relative accuracy,
and twisted factorisations give the directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, materialize

#: Entries become floor(SCALE * c) + SHIFT; those of more than LIMIT in size count as LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**52
#: Bytes of triangular factors that one task, or the driver, takes together.
TOGETHER = 64 << 20
#: Rows of a block.
BLOCK = 4096
#: Directions whose singular value is below so many epsilons, times the number of entries, of the greatest have no variance.
NOISE = 64
#: Squared singular values so close, relatively, are told apart together.
NEAR = 1e-6

_EPS = float(np.finfo(float).eps)
_TINY = 1e-290


# --- small dense work: on the driver, bounded by the length of a vector


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with a = U B V' and B upper bidiagonal, by Householder reflections from both sides."""
    a = np.array(a, float)
    d = a.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        """(u, s): I - s u u' takes x to its first axis."""
        u = x.copy()
        size = np.abs(x).max(initial=0.0)
        if len(x) < 2 or size == 0:
            return u, 0.0
        u /= size
        u[0] += np.copysign(np.sqrt(u @ u), u[0])
        return u, 2.0 / (u @ u)

    for k in range(d):
        u, s = reflector(a[k:, k])
        a[k:, k:] -= s * np.outer(u, u @ a[k:, k:])
        if k < d - 2:
            u, s = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= s * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= s * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _qd(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd transform with a shift: (q, e, d); None where the shift exceeds the least eigenvalue."""
    d = q[0] - shift
    qs, es, ds = [], [], [d]
    for k, off in enumerate(e):
        if not d >= 0:
            return None
        new = d + off
        t = q[k + 1] / new if new else 1.0
        qs.append(new)
        es.append(off * t)
        d = d * t - shift
        ds.append(d)
    if not d >= 0:
        return None
    return [*qs, d], es, ds


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling.

    Each round bounds the least eigenvalue from both sides by a transform without shift (1 / d are the diagonal of
    the inverse, so it lies between 1 / sum(1 / d) and the least d), then shifts in between, or by the lower bound
    where that went too far.
    """
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if not len(diagonal) or scale == 0:
        return np.zeros(len(diagonal))
    # An exact zero becomes one that no digit of the others sees.
    todo = [([max((float(x) / scale) ** 2, 1e-200) for x in diagonal], [(float(x) / scale) ** 2 for x in above], 0.0)]
    out, small = [], (4 * _EPS) ** 2
    while todo:
        q, e, gone = todo.pop()
        for _ in range(400 * len(q)):
            if len(q) == 1:
                break
            cut = next((k for k in reversed(range(len(e))) if e[k] <= small * max(gone, min(q[k], q[k + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], gone))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # the least at the end
                q, e = q[::-1], e[::-1]
            q, e, _ = _qd(q, e, 0.0)
            d = _qd(q, e, 0.0)[2]
            low, high = (1 - 8 * len(q) * _EPS) / sum(1 / max(x, _TINY) for x in d), min(d)
            for shift in (low,) if high <= 1.5 * low else (float(np.sqrt(low) * np.sqrt(high)), low):
                if (step := _qd(q, e, shift)) is not None:
                    q, e, gone = step[0], step[1], gone + shift
                    break
        else:
            raise ArithmeticError("dqds does not settle")
        out.append(gone + q[0])
    return np.sort(np.array(out))[::-1] * scale**2


def _twisted(diag: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(L, U, D, k): the twisted factorisation of L D L' - value I whose twist k leaves the least remainder."""
    n = len(diag)
    lower, upper = np.zeros(n), np.zeros(n)
    top, bottom, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    off = lambda x: x if abs(x) > _TINY else -_TINY
    s[0] = -value
    for k in range(n - 1):
        top[k] = off(s[k] + diag[k])
        lower[k] = diag[k] * low[k] / top[k]
        s[k + 1] = lower[k] * low[k] * s[k] - value
    p[n - 1] = diag[n - 1] - value
    for k in range(n - 2, -1, -1):
        p[k + 1] = off(p[k + 1])
        bottom[k + 1] = off(diag[k] * low[k] ** 2 + p[k + 1])
        t = diag[k] / bottom[k + 1]
        upper[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    rest = s + p + value
    rest[~np.isfinite(rest)] = np.inf
    k = int(np.argmin(np.abs(rest)))
    return lower, upper, np.concatenate([top[:k], [off(rest[k])], bottom[k + 1 :]]), k


def _solve(factors: tuple[np.ndarray, np.ndarray, np.ndarray, int], b: np.ndarray) -> np.ndarray:
    """Solutions for the columns of b."""
    lower, upper, d, k = factors
    n, y = len(b), b.copy()
    for i in range(1, k):
        y[i] -= lower[i - 1] * y[i - 1]
    for i in range(n - 2, k, -1):
        y[i] -= upper[i] * y[i + 1]
    y[k] -= (lower[k - 1] * y[k - 1] if k else 0.0) + (upper[k] * y[k + 1] if k < n - 1 else 0.0)
    return _up(lower, upper, k, y / d[:, None])


def _up(lower: np.ndarray, upper: np.ndarray, k: int, x: np.ndarray) -> np.ndarray:
    for i in range(k - 1, -1, -1):
        x[i] -= lower[i] * x[i + 1]
    for i in range(k, len(x) - 1):
        x[i + 1] -= upper[i] * x[i]
    return x


def directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, near: float = NEAR) -> np.ndarray:
    """Unit right singular vectors, as columns, of an upper bidiagonal matrix for its greatest squared singular values.

    A value that differs from the others by more than `near`, relatively, has the vector of the twisted
    factorisation with the least remainder.  Closer values share one factorisation, a little above them: inverse
    iteration with it finds the space of their vectors, and the matrix within that space tells them apart.
    """
    scale = float(max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))) or 1.0
    a = np.where(np.abs(diagonal) > 1e-100 * scale, diagonal / scale, 1e-100)
    b = np.append(above / scale, 0.0)
    diag, low, n = a**2, b / a, len(a)
    values = values / scale**2
    out = np.zeros((n, len(values)))
    ends = [*(np.flatnonzero(values[:-1] - values[1:] > near * values[:-1]) + 1).tolist(), len(values)]
    first = 0
    for end in ends:
        if end == first + 1:
            factors = _twisted(diag, low, float(values[first]))
            x = np.zeros(n)
            x[factors[3]] = 1.0
            out[:, first] = _up(*factors[:2], factors[3], x)
        else:
            factors = _twisted(diag, low, float(values[first] * (1 + near / 4)))
            x = np.linalg.qr(np.random.default_rng(first).standard_normal((n, end - first)))[0]
            for _ in range(50):
                x = np.linalg.qr(_solve(factors, x))[0]
                bx = a[:, None] * x + b[:, None] * np.vstack([x[1:], np.zeros((1, end - first))])
                own, turn = np.linalg.eigh(bx.T @ bx)
                x, bx = x @ turn[:, ::-1], bx @ turn[:, ::-1]
                back = a[:, None] * bx + np.vstack([np.zeros((1, end - first)), (b[:, None] * bx)[:-1]])
                if np.abs(back - x * own[::-1]).max() <= 4 * n * _EPS * values[first]:
                    break
            out[:, first:end] = x
        out[:, first:end] /= np.sqrt((out[:, first:end] ** 2).sum(axis=0))
        first = end
    q, r = np.linalg.qr(out)  # they are orthogonal but for the last digits
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


# --- over all vectors


@dataclass(frozen=True)
class Whitening:
    """n, per-entry sums of the fit list, unit directions as columns, their variances (falling), all variances' sum, identity_error."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def usable(vectors: Column) -> Column:
    return F.coalesce(F.forall(vectors, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False)) & (F.size(vectors) > 0)


def grid(vectors: Column) -> Column:
    """Each entry c as the whole number floor(SCALE * c) + SHIFT."""
    return F.transform(vectors, lambda c: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c.cast("double") * SCALE))).cast("long") + SHIFT)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.column("x").slice(a, BLOCK)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit numbers where they suffice, Python's own elsewhere."""
    if n * int(np.abs(x).max(initial=0)) < 2**61 and max(map(abs, sums), default=0) < 2**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(float)


def _merged(parts: list[np.ndarray], d: int) -> np.ndarray:
    r = np.linalg.qr(np.concatenate(parts), mode="r")
    return np.concatenate([r, np.zeros((d - len(r), d))])


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for x in _blocks(batches, d):
            safe = len(x) * int(np.abs(x).max(initial=0)) < 2**61
            n, total = n + len(x), [a + int(b) for a, b in zip(total, (x if safe else x.astype(object)).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * d, pa.int64())], names=["at", "total", "n"])

    rows = fit.mapInArrow(work, "at int, total decimal(38,0), n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    return int(rows[0].n), [int(r.total) for r in rows]  # d rows


def _triangle(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor of the centred rows: one for each task, then merged along a tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for x in _blocks(batches, d):
            r = _merged([_centred(x, n, sums)] if r is None else [r, _centred(x, n, sums)], d)
        rows = [] if r is None else [r.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["part", "r"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        r = _merged([np.asarray(x).reshape(d, d) for x in frame.sort_values("part")["r"]], d)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // fan], "r": [r.ravel().tolist()]})

    fan = int(np.clip(TOGETHER // (8 * d * d), 2, 64))
    parts = materialize(fit.mapInArrow(work, "part long, r array<double>"), "triangles")
    while parts.count() > fan:
        parts = materialize(parts.groupBy(F.floor(F.col("part") / fan).alias("to")).applyInPandas(merge, "part long, r array<double>"), "triangles", instead_of=parts)
    r = _merged([np.asarray(x.r).reshape(d, d) for x in parts.orderBy("part").collect()], d)  # at most fan rows
    discard(parts)
    return r


def _identity_error(fit: DataFrame, d: int, n: int, sums: list[int], scaled: np.ndarray) -> float:
    k = scaled.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for x in _blocks(batches, d):
            y = _centred(x, n, sums) @ scaled
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) * k), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["at", "total"])

    rows = fit.mapInArrow(work, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()  # (k + 1) k rows
    total = np.array([r.total for r in rows]).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Learn the whitening of a column `x` of equally long whole-number vectors, each different one once; None without rows.

    vectors is read four times (sums, factor, error); give a written table.
    """
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d
    n, sums = _sums(vectors, d)
    r = _triangle(vectors, d, n, sums)
    diagonal, above, v = bidiagonal(r)
    values = dqds(diagonal, above)
    rank = int((np.sqrt(values) > NOISE * d * _EPS * np.sqrt(values[0])).sum())
    k = m = min(components, rank)
    while 0 < m < rank and values[m - 1] - values[m] <= NEAR * values[m - 1]:  # close values are told apart together
        m += 1
    axes = (v @ directions(diagonal, above, values[:m]) if k else np.zeros((d, 0)))[:, :k]
    values = values[:k] / n
    error = _identity_error(vectors, d, n, sums, axes / np.sqrt(values)) if len(values) else 0.0
    return Whitening(n, sums, axes, values, float((r**2).sum()) / n, error)


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of (vec_id, x), a row for each component.

    deviation is null where it exceeds a long.
    """
    d, k = model.axes.shape
    scaled = model.axes / np.sqrt(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(iter([batch.select(["x"])]), d):
                m = len(x)
                apart = _scaled(x, model.n, model.sums)
                if apart.dtype == object or d * float(np.abs(apart).max(initial=0)) ** 2 >= 2**62:
                    far = [sum(int(c) ** 2 for c in row) for row in apart]
                else:
                    far = (apart * apart).sum(axis=1).tolist()
                y = (apart / model.n).astype(float) @ scaled
                each = lambda values: np.tile(values, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").slice(at, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(each(np.arange(1, k + 1)).astype(np.int32)), pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array([f if f < 2**63 else None for f in far], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(y.ravel()), pa.array(each(model.values / model.trace)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
                at += m

    return rows.mapInArrow(work, _OUT)


def whiten(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """Whitened vectors of (vec_id, embedding), as rows of `apply`.

    Vectors that are null or empty, or hold null or non-finite entries, are dropped, and so are those of another
    length than most different ones have (ties: the longer).  Entries beyond 2^46 in size count as that.
    Components without variance, as in constant or few vectors, give no rows; an empty table, or a single different
    vector, none at all.  Null or repeated vec_ids stay, a row set each.
    """
    good = embeddings.where(usable(F.col("embedding"))).select("vec_id", grid(F.col("embedding")).alias("x"))
    different = materialize(good.select("x").distinct(), "fit-list")
    most = different.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    model = fit(different.where(F.size("x") == most.d), components) if most else None
    discard(different)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], _OUT)
    return apply(good.where(F.size("x") == most.d), model)
