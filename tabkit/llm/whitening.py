"""Whitening of vectors along their strongest components, found by contour integration.

Vectors become integers floor(scale * component). The fit list is each distinct integer vector once; its counts and sums
are exact, its covariance is summed over centred vectors in doubles, task by task and then by Spark. The driver holds
one covariance matrix (dimensions squared).

The components come from FEAST: the eigenvalue interval is enclosed by a circle, and a quadrature of solves with the
complex shifted covariance, (zI - V) Y = Q, projects a block of vectors onto the eigenvectors of the interval;
Rayleigh-Ritz extracts them, and this is repeated on the result until the residuals vanish. Intervals are chosen by
inertia: the signs of the pivots of V - sI count the eigenvalues above s. The same count says how many must have been
found; if some are missing, the block grows.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; repeated rows stay, and are
fitted once; vectors of different lengths are fitted apart; components whose eigenvalue is not above 1e-12 of the trace
cannot be whitened and are left out, so a single distinct vector, an empty vector or an empty table gives no rows;
components of equal eigenvalues come in any order and direction within their space; a null id is kept; other columns
are ignored. A deviation beyond 64-bit integers stops the query with an error that says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.topk import as_integers, matrix, usable
from tabkit.session import written


def eigenvalues_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed `shift`: the positive pivots of v - shift * I (Sylvester)."""
    a = v - shift * np.eye(len(v))
    tiny = np.finfo(float).eps * max(np.abs(v).max(), 1e-300)
    above = 0
    for k in range(len(a)):
        pivot = a[k, k] if abs(a[k, k]) > tiny else tiny  # a shift on an eigenvalue of a leading part, moved off it
        above += pivot > 0
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :]) / pivot
    return int(above)


def interval_below(v: np.ndarray, top: float, done: int, wanted: int, most: int) -> tuple[float, int]:
    """A lower end that leaves at least `wanted` and, unless eigenvalues coincide, at most `most` below `top`."""
    low, high = -1e-9 * top, top
    while high - low > 1e-13 * top:
        middle = (low + high) / 2
        inside = eigenvalues_above(v, middle) - done
        if wanted <= inside <= most:
            return middle, inside
        low, high = (middle, high) if inside > most else (low, middle)
    return low, eigenvalues_above(v, low) - done


def feast(v: np.ndarray, low: float, high: float, inside: int, nodes: int = 8, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The `inside` eigenpairs of v with eigenvalues in (low, high), largest first."""
    d = len(v)
    size = min(d, inside + max(4, inside // 2))
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi / 2 * (1 - at))  # the upper half; the lower one is its mirror image
    solvers = [np.linalg.inv((centre + radius * t) * np.eye(d) - v) for t in turn]
    filter_ = sum((w * radius * t / 2 * s for w, t, s in zip(weight, turn, solvers))).real
    while True:
        block = np.random.default_rng([7, d, size]).normal(size=(d, size))
        for _ in range(rounds):
            block, _ = np.linalg.qr(filter_ @ block)
            values, turned = np.linalg.eigh(block.T @ v @ block)
            block = block @ turned
            mine = np.flatnonzero((values > low) & (values < high))
            rest = np.linalg.norm(v @ block[:, mine] - block[:, mine] * values[mine], axis=0)
            if done := len(mine) == inside and rest.max(initial=0) <= 1e-13 * max(abs(high), abs(low)) * np.sqrt(d):
                break
        if done or size == d:  # a block of all dimensions holds every eigenvector
            order = mine[::-1]
            return values[order], block[:, order]
        size = min(d, 2 * size)  # the inertia says that some are missing, or they lie too close to others


def top_components(v: np.ndarray, k: int, per_interval: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Up to k largest eigenvalues of a covariance, and their unit eigenvectors in columns."""
    v = (v + v.T) / 2
    trace = float(np.trace(v))
    least = 1e-12 * trace
    k = min(k, eigenvalues_above(v, least)) if trace > 0 else 0
    top, values, vectors = float(np.abs(v).sum(1).max(initial=0)) * (1 + 1e-9), [], []
    while (found := sum(map(len, values))) < k:
        wanted = min(per_interval, k - found)
        low, inside = interval_below(v, top, found, wanted, wanted + per_interval)
        e, u = feast(v, low, top, inside)
        values.append(e)
        vectors.append(u)
        top = low
    if not values:
        return np.empty(0), np.empty((len(v), 0))
    basis, _ = np.linalg.qr(np.concatenate(vectors, 1))  # eigenvectors of neighbouring intervals are made orthogonal
    e, turned = np.linalg.eigh(basis.T @ v @ basis)
    return e[::-1][:k], (basis @ turned)[:, ::-1][:, :k]


def _summed(rows: DataFrame, fn, kind: str) -> dict[tuple[int, int], list]:
    """Sums over all rows: fn gives (length, place, value...) rows per task; the sums of each place reach the driver."""
    found = rows.mapInArrow(fn, f"size int, place int, a {kind}, n long")
    total = F.sum(F.col("a").cast("decimal(38,0)")) if kind == "long" else F.sum("a")
    return {(r["size"], r["place"]): (r["a"], r["n"]) for r in found.groupBy("size", "place").agg(total.alias("a"), F.sum("n").alias("n")).collect()}


def _batch(size: int, values: np.ndarray, n: int, kind) -> pa.RecordBatch:
    m = len(values)
    columns = [pa.array(np.full(m, size, "i4")), pa.array(np.arange(m, dtype="i4")), pa.array(values, kind), pa.array(np.full(m, n, "i8"))]
    return pa.RecordBatch.from_arrays(columns, names=["size", "place", "a", "n"])


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Exact count and sums per dimension of the vectors of each length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrix(batch, "x"):
                if float(np.abs(x).max(initial=0)) * len(x) >= 2**63:
                    raise ValueError("sums of these vectors exceed 64-bit integers")
                if x.shape[1]:
                    yield _batch(x.shape[1], x.sum(0), len(x), pa.int64())

    found = _summed(rows, add, "long")
    return {d: (found[d, 0][1], [int(found[d, i][0]) for i in range(d)]) for d in {d for d, _ in found}}


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n in doubles, from the exact whole numbers n * x - S."""
    if float(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0) < 2**62:
        return (n * x - np.array(total, "i8")) / n
    return np.array([[(n * a - s) / n for a, s in zip(row, total)] for row in x.tolist()], "f8").reshape(x.shape)


def products(rows: DataFrame, fit: dict[int, tuple[int, list[int]]], onto: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Summed products of the centred vectors of each length (first projected by `onto`), divided by their number."""
    sent = rows.sparkSession.sparkContext.broadcast((fit, onto))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, onto = sent.value
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in matrix(batch, "x"):
                d = x.shape[1]
                if d in fit and (onto is None or d in onto):
                    c = centred(x, *fit[d])
                    c = c if onto is None else c @ onto[d]
                    held[d] = held.get(d, 0) + c.T @ c
        for d, m in held.items():
            yield _batch(d, m.ravel(), 0, pa.float64())

    found = _summed(rows, multiply, "double")
    side = {d: (d if onto is None else onto[d].shape[1]) for d in {d for d, _ in found}}
    return {d: np.array([found[d, i][0] for i in range(m * m)]).reshape(m, m) / fit[d][0] for d, m in side.items()}


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exactly."""
    gap = (float(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0)) ** 2 * max(x.shape[1], 1)
    if gap < 2**63:
        return ((n * x - np.array(total, "i8")) ** 2).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, total)) for row in x.tolist()]
    if max(exact, default=0) >= 2**63:
        raise ValueError("a deviation exceeds 64-bit integers")
    return exact


def whiten(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", scale: float = 256.0, components: int = 4) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each usable row and component."""
    values = as_integers(F.col(vector), scale)
    rows = written(vectors.where(usable(F.col(vector))).select(F.col(id_).cast("long").alias("id"), values.alias("x")), "integers")
    distinct = written(rows.select("x").distinct(), "distinct-vectors")
    fit = sums(distinct)
    found = {d: (*top_components(v, components), float(np.trace(v))) for d, v in products(distinct, fit).items()}
    found = {d: (e, u, trace) for d, (e, u, trace) in found.items() if len(e)}
    onto = {d: u / np.sqrt(e) for d, (e, u, _) in found.items()}
    error = {d: float(np.abs(c - np.eye(len(c))).max()) for d, c in products(distinct, fit, onto).items()}
    sent = vectors.sparkSession.sparkContext.broadcast((fit, found, onto, error))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, found, onto, error = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                for at, x in matrix(part, "x"):
                    d = x.shape[1]
                    if d not in found:
                        continue
                    e, _, trace = found[d]
                    k, far = len(e), pa.array(deviations(x, *fit[d]), pa.int64())
                    each = pa.array(np.repeat(np.arange(len(at)), k))
                    columns = [
                        part.column("id").take(pa.array(at)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(at))),
                        pa.array(np.full(len(at) * k, fit[d][0], "i8")),
                        far.take(each),
                        pa.array((centred(x, *fit[d]) @ onto[d]).ravel()),
                        pa.array(np.tile(e / trace, len(at))),
                        pa.array(np.full(len(at) * k, error[d])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=WHITENED.replace(",", "").split()[::2])

    return rows.mapInArrow(project, WHITENED).withColumnRenamed("id", id_)


WHITENED = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
