"""Whitening of embeddings: partitions keep an eigendecomposition up to date row by row, spectra are combined, Rayleigh-Ritz refines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import written
from marketframe.llm.vectors import int_vectors

#: Partial results that one task combines; levels of this width go on until one is left.
FAN = 16
EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_i^2 / (d_i - mu)) for rising, distinct ``d``, all ``z`` non-zero, rho > 0.

    Returns (mu, gaps) with gaps[i, k] = d_i - mu_k.  Each root is sought as its distance from the nearer pole, so that the gaps keep
    their relative precision.  A step takes the two sums to the left and right of the root as simple poles that agree in value and slope;
    one that leaves the bracket is halved instead.
    """
    m, w = len(d), rho * z * z
    width = np.append(np.diff(d), w.sum())
    left = np.arange(m)[:, None] <= np.arange(m)[None, :]
    apart = d[:, None] - d[None, :]
    middle = 1 + (w[:, None] / (apart - width / 2)).sum(0)
    nearer = middle >= 0  # the root lies in the left half: measure from d_k
    nearer[-1] = True
    origin = np.where(nearer, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    delta = apart[:, origin]
    p = np.where(nearer, 0.0, -width)
    q = np.where(nearer, width, 0.0)
    lo = np.where(nearer, 0.0, -width / 2)
    hi = np.where(nearer, width / 2, 0.0)
    hi[-1] = width[-1]
    tau = (lo + hi) / 2
    for _ in range(rounds):
        gap = delta - tau
        term = w[:, None] / gap
        slope = term / gap
        psi, phi = np.where(left, term, 0.0), np.where(left, 0.0, term)
        a, b = psi.sum(0), phi.sum(0)
        f = 1 + a + b
        lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
        da, db = np.where(left, slope, 0.0).sum(0), np.where(left, 0.0, slope).sum(0)
        s, t = da * (p - tau) ** 2, db * (q - tau) ** 2
        c = 1 + a - da * (p - tau) + b - db * (q - tau)
        t[-1], c[-1] = 0.0, 1 + a[-1] - da[-1] * (p[-1] - tau[-1])
        with np.errstate(all="ignore"):
            beta, gamma = c * (p + q) + s + t, c * p * q + s * q + t * p
            root = 0.5 * (beta + np.copysign(np.sqrt(np.maximum(0, beta * beta - 4 * c * gamma)), beta))
            one, two = root / c, gamma / root
            one[-1] = two[-1] = p[-1] + s[-1] / c[-1]
        inside = lambda x: (x > lo) & (x < hi)
        following = np.where(inside(one), one, np.where(inside(two), two, (lo + hi) / 2))
        done = (np.abs(f) <= 4 * EPS * (1 + np.abs(a) + np.abs(b))) | (np.abs(following - tau) <= 2 * EPS * np.abs(tau))
        if done.all():
            break
        tau = np.where(done, tau, following)
    return d[origin] + tau, delta - tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of Q diag(values) Q' + rho v v', rho >= 0.

    Deflation: an eigenpair that v has no part in stays; within a run of eigenvalues equal to rounding one reflection moves all of v's
    part to a single vector.  The rest are roots of the secular equation; their vectors are those of the matrix that has exactly these
    roots, so they stay orthogonal however close the roots are.
    """
    z = vectors.T @ v
    size = np.sqrt(z @ z)
    if not size or rho <= 0:
        return values, vectors
    rho, z = rho * size * size, z / size
    tol = 8 * EPS * max(np.abs(values).max(), rho)
    close = np.diff(values) <= tol
    if close.any():
        vectors = vectors.copy()
        k = 0
        while k < len(values):
            end = k + 1
            while end < len(values) and close[end - 1] and values[end] - values[k] <= tol:
                end += 1
            norm = np.sqrt(z[k:end] @ z[k:end])
            if end - k > 1 and norm > 0:
                h = z[k:end].copy()
                h[-1] += np.copysign(norm, h[-1])
                vectors[:, k:end] -= np.outer(vectors[:, k:end] @ h, h) * (2 / (h @ h))
                z[end - 1] = -np.copysign(norm, z[end - 1])
                z[k : end - 1] = 0
            k = end
    live = np.flatnonzero(rho * np.abs(z) > tol)
    if not len(live):
        return values, vectors
    d, own = values[live], z[live]
    roots, gaps = secular_roots(d, own, rho)
    m = len(d)
    shape = np.arange(m)[:, None] > np.arange(m - 1)[None, :]
    apart = d[None, :] - d[:, None]
    ratio = -gaps[:, :-1] / np.where(shape, apart[:, :-1], apart[:, 1:])
    exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1) * -gaps[:, -1] / rho)), own)
    turn = exact[:, None] / gaps
    turn /= np.sqrt((turn * turn).sum(0))
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[live], new_vectors[:, live] = roots, vectors[:, live] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


class Spectrum:
    """Count, mean, and eigendecomposition of the scatter about it, of the rows seen so far."""

    def __init__(self, size: int) -> None:
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(size), np.zeros(size), np.eye(size)

    def add(self, row: np.ndarray) -> None:
        away = row - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """Add what another one has seen: the step between the means, then its eigenpairs, one rank-one update each."""
        if not other.n:
            return
        n, away = self.n + other.n, other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / n)
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self.n, self.mean = n, self.mean + away * (other.n / n)

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, size: int) -> Spectrum:
        out, x = cls(size), np.frombuffer(raw)
        out.n, out.mean, out.values, out.vectors = int(x[0]), x[1 : 1 + size], x[1 + size : 1 + 2 * size], x[1 + 2 * size :].reshape(size, size)
        return out


def merged_spectra(raws: list[bytes], size: int) -> bytes:
    first = Spectrum.unpacked(raws[0], size)
    for raw in raws[1:]:
        first.merge(Spectrum.unpacked(raw, size))
    return first.packed()


def summed(raws: list[bytes], size: int) -> bytes:
    return np.sum([np.frombuffer(r) for r in raws], axis=0).tobytes()


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, their vectors as a matrix) for each vector size in a batch."""
    sizes = b.column("size").to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, np.frombuffer(b"".join(b.column("vec").take(pa.array(at)).to_pylist()), np.int64).reshape(len(at), size)


def combined(rows: DataFrame, of_task: Callable[[Iterator[tuple[int, np.ndarray]]], dict[int, bytes]], merge: Callable[[list[bytes], int], bytes], name: str) -> dict[int, bytes]:
    """One result for each vector size: ``of_task`` makes one for each partition and size, ``FAN`` at a time become one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = of_task((size, x) for b in batches for size, _, x in _matrices(b))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"size": pa.array(list(found), pa.int32()), "part": pa.array([part] * len(found), pa.int32()), "raw": pa.array(list(found.values()), pa.binary())})

    def together(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"size": [key[0]], "part": [key[1]], "raw": [merge(list(group.sort_values("part")["raw"]), int(key[0]))]})

    kinds = "size int, part int, raw binary"
    level = written(rows.select("size", "vec").mapInArrow(partial, kinds), name)
    while level.agg(F.max("part")).first()[0]:
        level = written(level.groupBy("size", F.floor(F.col("part") / FAN).cast("int").alias("to")).applyInPandas(together, kinds), name)
    return {r.size: bytes(r.raw) for r in level.collect()}


class Centre:
    """Exact count and sums of one vector size; rows less their mean."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.near = np.array([s // n for s in sums], np.int64)
        self.rest = [s - n * (s // n) for s in sums]  # what the whole mean leaves, in n-ths

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S)^2) of each row, exact; None where it is no long."""
        y = x - self.near
        bound = int(np.abs(y).max(initial=0)) * self.n + self.n
        if bound * bound * x.shape[1] < 1 << 63:
            gap = self.n * y - np.array(self.rest, np.int64)
            return (gap * gap).sum(1).tolist()
        out = []
        for row in y.tolist():
            total = sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest, strict=True))
            out.append(total if total < 1 << 63 else None)
        return out


def centres(rows: DataFrame) -> dict[int, Centre]:
    """Of each vector size; one row for each size and dimension reaches the driver.  Sums stay exact: high and low parts apart."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, at, x in _matrices(b):
                high = x >> 26
                yield pa.RecordBatch.from_pydict({"size": pa.array([size] * size, pa.int32()), "dim": pa.array(range(size), pa.int32()), "n": pa.array([len(at)] * size, pa.int64()), "high": high.sum(0), "low": (x - (high << 26)).sum(0)})

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    exact = total("high") * F.lit(1 << 26).cast("decimal(9,0)") + total("low")
    found = rows.select("size", "vec").mapInArrow(sums, "size int, dim int, n long, high long, low long").groupBy("size", "dim").agg(F.sum("n").alias("n"), exact.alias("s"))
    at: dict[int, dict[int, int]] = {}
    counts: dict[int, int] = {}
    for r in found.collect():
        counts[r["size"]] = r.n
        at.setdefault(r["size"], {})[r.dim] = int(r.s)
    return {size: Centre(counts[size], [sums[k] for k in range(size)]) for size, sums in at.items()}


def spectra(rows: DataFrame, centre: dict[int, Centre]) -> dict[int, Spectrum]:
    """The eigendecomposition of each vector size, by rank-one updates within partitions and then of partitions."""

    def updated(parts: Iterator[tuple[int, np.ndarray]]) -> dict[int, bytes]:
        found: dict[int, Spectrum] = {}
        for size, x in parts:
            own = found.setdefault(size, Spectrum(size))
            for row in (x - centre[size].near).astype(np.float64):
                own.add(row)
        return {size: s.packed() for size, s in found.items()}

    return {size: Spectrum.unpacked(raw, size) for size, raw in combined(rows, updated, merged_spectra, "spectra").items()}


def _products(rows: DataFrame, map_of: dict[int, Callable[[np.ndarray], np.ndarray]], name: str) -> dict[int, np.ndarray]:
    """Sum of y y' over all rows, y = what ``map_of`` its size makes of a matrix of rows."""

    def partial(parts: Iterator[tuple[int, np.ndarray]]) -> dict[int, bytes]:
        found: dict[int, np.ndarray] = {}
        for size, x in parts:
            y = map_of[size](x)
            found[size] = found.get(size, 0) + y.T @ y
        return {size: m.tobytes() for size, m in found.items()}

    square = lambda raw: np.frombuffer(raw).reshape(2 * (round((len(raw) // 8) ** 0.5),))
    return {size: square(raw) for size, raw in combined(rows, partial, summed, name).items()}


class Whitening:
    """Components of one vector size, their eigenvalues (falling), shares of the trace, and how far whitened rows are from white."""

    def __init__(self, centre: Centre, basis: np.ndarray, scatter: np.ndarray, components: int) -> None:
        values, turn = np.linalg.eigh(scatter / centre.n)
        trace = np.trace(scatter) / centre.n
        top = np.argsort(values)[::-1][:components]
        self.centre, self.vectors, self.values = centre, basis @ turn[:, top], values[top]
        self.used = self.values > max(len(values) * EPS * values.max(initial=0) * 16, 0)
        self.explained = [float(e / trace) if u else 0.0 for e, u in zip(self.values, self.used, strict=True)] if trace > 0 else [None] * len(top)
        self.error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``x`` on the components that vary; the others are NaN."""
        out = self.centre.centred(x) @ self.vectors
        return np.where(self.used, out / np.sqrt(np.where(self.used, self.values, 1)), np.nan)


def fit(rows: DataFrame, components: int) -> dict[int, Whitening]:
    """``rows``: size and vec.  Updates, combination, then Rayleigh-Ritz: the covariance within the basis found is summed over all rows and
    diagonalised, so what the updates left of the off-diagonal is removed.  A last pass measures the whitened covariance."""
    centre = centres(rows)
    basis = {size: s.vectors for size, s in spectra(rows, centre).items()}
    turned = {size: (lambda x, size=size: centre[size].centred(x) @ basis[size]) for size in centre}
    model = {size: Whitening(centre[size], basis[size], scatter, components) for size, scatter in _products(rows, turned, "ritz").items()}
    white = {size: (lambda x, m=m: m.whitened(x)[:, m.used]) for size, m in model.items()}
    for size, found in _products(rows, white, "white").items():
        model[size].error = float(np.abs(found / centre[size].n - np.eye(len(found))).max(initial=0))
    return model


def whiten(vectors: DataFrame, components: int = 8, *, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector and component, numbered from 1.

    Components become whole numbers floor(scale * c) + offset first; all fitting is over all rows.  Rows with a null vector, a null or
    non-finite component, or one of 2^52 / scale or more (no exact whole number) are left out.  Each vector size is fitted by itself, with
    its own n; a size below ``components`` has as many as it has dimensions; empty vectors have none.  A component along which nothing
    varies (all rows alike, fewer rows than dimensions) has a null ``whitened`` and 0 as its share; the share is null if nothing varies at
    all.  A deviation that is no long is null.  Null and repeated ids are rows like others.  An empty table gives no rows.  What reaches
    the driver for a size is its sums and d x d matrices, whatever its rows.
    """
    rows = written(int_vectors(vectors, {"id": F.col(id_col).cast("long")}, F.col(vector_col), scale=scale, limit=2.0**52, kind="<i8", offset=offset).where("size > 0"), "whole")
    model = fit(rows, components)
    kinds = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                for size, at, x in _matrices(b):
                    m = model[size]
                    w, r = m.whitened(x), len(m.values)
                    each = pa.array(np.repeat(np.arange(len(at)), r))
                    columns = [b.column("id").take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * r, m.centre.n)), pa.array(m.centre.deviations(x), pa.int64()).take(each), pa.array(w.ravel(), from_pandas=True), pa.array(m.explained * len(at), pa.float64()), pa.array(np.full(len(at) * r, m.error))]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return rows.mapInArrow(projected, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
