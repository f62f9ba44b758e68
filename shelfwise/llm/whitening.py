"""Operator 11: whitening directions of embeddings by blockwise QR and a bidiagonal qd solver.

Entries become whole numbers (``floor(scale * c)``), so that sums and deviations
are exact. The fit list is each distinct vector once. Its rows, centred before
anything is multiplied, go through QR block by block: a task keeps one
triangular factor, and tasks' factors are merged sixteen at a time until one is
left. It has the dimension's size, whatever the number of rows, and only it and
the sums come to the driver. There

* Householder reflections make it bidiagonal, and the right ones are kept;
* dqds, which never subtracts but in its shift, finds the singular values of
  the bidiagonal matrix to high relative accuracy;
* a twisted factorisation for each wanted value, joined where its pivot is
  least, gives the singular vector; vectors of (nearly) equal values are made
  orthogonal, by inverse iteration beside those already found.

A second pass over the rows projects them; the covariance of the whitened fit
list is measured and its distance from the identity returned.

Defined results: rows without a vector, or with a null or non-finite entry, are
dropped; of vectors of several lengths those of the most frequent length stay
(ties: the longest); values beyond a long are cut to it; a deviation beyond a
long is null; a component without variance has null ``whitened`` and explains 0
(null if nothing varies); there are at most as many components as dimensions;
null ids stay null, repeated rows are returned as often as they occur; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stored

#: Factors that are merged at a time, rows of a block.
MERGE, BLOCK = 16, 4096
EPS, LEAST = np.finfo(float).eps, 1e-290
LONG = 1 << 63


# --- rows ---------------------------------------------------------------------------------------------------------


def whole_numbers(values: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * c)`` as int64, cut to its range."""
    with np.errstate(over="ignore"):
        x = np.floor(values * scale)
    inside = np.clip(x, -float(LONG), np.nextafter(float(LONG), 0)).astype(np.int64)
    return np.where(x >= float(LONG), np.int64(LONG - 1), inside)


def encode_rows(x: np.ndarray) -> list[bytes]:
    """A row of whole numbers as bytes: two for each number if all of the row fit, else eight."""
    small = (np.abs(x.astype(np.float64)) < 32768).all(axis=1)
    narrow, wide = np.ascontiguousarray(x.astype("<i2")), np.ascontiguousarray(x.astype("<i8"))
    return [(narrow[k] if ok else wide[k]).tobytes() for k, ok in enumerate(small.tolist())]


def decode_rows(rows: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), dtype="<i2").reshape(len(rows), dim).astype(np.int64)
    return np.array([np.frombuffer(r, dtype="<i2" if len(r) == 2 * dim else "<i8") for r in rows], dtype=np.int64)


def quantised(df: DataFrame, scale: float, vec_id: str, vector: str) -> DataFrame:
    """vec_id, dim, x of the rows whose vector is whole and finite."""
    ship_package(df.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("vec_id"), batch.column("vector")
            starts = lists.offsets.to_numpy()
            values, known = lists.values.to_numpy(zero_copy_only=False), lists.values.is_valid().to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~(known & np.isfinite(values)))])
            keep = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[starts[1:]] == bad[starts[:-1]])
            dims, out = np.diff(starts), [b""] * len(keep)
            for dim in np.unique(dims[keep]).tolist():
                rows = np.nonzero(keep & (dims == dim))[0]
                if dim:
                    cells = values[starts[rows][:, None] + np.arange(dim)[None, :]].astype(np.float64)
                    for k, x in zip(rows.tolist(), encode_rows(whole_numbers(cells, scale))):
                        out[k] = x
            at = np.nonzero(keep)[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(dims[at], pa.int32()),
                                              pa.array([out[k] for k in at.tolist()], pa.binary())], ["vec_id", "dim", "x"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInArrow(encode, "vec_id long, dim int, x binary")


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and float(np.abs(x.astype(np.float64)).max()) * len(x) >= 2.0 ** 62:
        return [int(s) for s in x.astype(object).sum(axis=0)]
    return [int(s) for s in x.sum(axis=0)]


def distances(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: int64 where that holds it, Python's numbers else."""
    largest = float(np.abs(x.astype(np.float64)).max(initial=0.0)) * n + max(map(abs, sums), default=0)
    if largest < 2.0 ** 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(exact: np.ndarray) -> list[int | None]:
    """Sum of the squares of each row, null beyond a long."""
    if exact.dtype != object and float(np.abs(exact.astype(np.float64)).max(initial=0.0)) ** 2 * exact.shape[1] < 2.0 ** 62:
        return (exact * exact).sum(axis=1).tolist()
    found = (exact.astype(object) ** 2).sum(axis=1)
    return [int(s) if s < LONG else None for s in found]


# --- the solver ---------------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right transformation P of ``r``: r P is, up to a rotation from the left, bidiagonal."""
    m = np.array(r, dtype=float)
    d = m.shape[1]
    right = np.eye(d)
    for k in range(d):
        w, beta, _ = reflector(m[k:, k])
        m[k:, k:] -= np.outer(beta * w, w @ m[k:, k:])
        if k + 2 < d:
            w, beta, _ = reflector(m[k, k + 1:])
            m[k:, k + 1:] -= np.outer(m[k:, k + 1:] @ w, beta * w)
            right[:, k + 1:] -= np.outer(right[:, k + 1:] @ w, beta * w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """w, beta: I - beta w w' maps x to a multiple of the first unit vector."""
    w, size = x.copy(), float(np.linalg.norm(x))
    if size == 0:
        return w, 0.0, 0.0
    w[0] += math.copysign(size, w[0])
    return w, 2.0 / float(w @ w), size


def qd_sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, int]:
    """One differential qd transformation: new q and e, the last pivot, and how many pivots were fine."""
    n, d = len(q), q[0] - shift
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for k in range(n - 1):
        if d < 0:
            return q, e, d, k
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] > LEAST else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift if new_q[k] > LEAST else q[k + 1] - shift
    new_q[n - 1] = d
    return new_q, new_e, d, n if d >= 0 else n - 1


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values of the bidiagonal matrix with squared entries ``q`` and ``e``."""
    out: list[float] = []
    blocks = [(list(q), list(e), 0.0)]
    sweeps = 0
    while blocks:
        q, e, base = blocks.pop()
        while q:
            n = len(q)
            if n == 1:
                out.append(q[0] + base)
                break
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (base + min(q[k], q[k + 1])) or e[k] < LEAST), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[-1] > 1.5 * q[0]:                                       # large values first: they converge at the end
                q, e = q[::-1], e[::-1]
            # the smaller value of the last two rows, as a first guess; a guess that is too large shows where
            a, b, c = q[-2] + (e[-2] if n > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
            half = (a + c) / 2
            big = half + math.sqrt(((a - c) / 2) ** 2 + b)
            shift = max(0.0, (a * c - b) / big) if big > LEAST else 0.0
            for attempt in range(8):
                new_q, new_e, last, fine = qd_sweep(q, e, shift if attempt < 7 else 0.0)
                if fine == n:
                    base += shift if attempt < 7 else 0.0
                    q, e = new_q, new_e
                    break
                # only the last pivot failed: it says by how much; else the guess was far off
                shift = max(0.0, (shift + last) * (1 - 4 * EPS)) if fine == n - 1 else shift / 4
            sweeps += 1
            if sweeps > 200 * (len(out) + n) + 10_000:
                raise ArithmeticError("the qd iteration does not converge")
    return out


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The vector of B'B for an eigenvalue: stationary qd from above and progressive qd from below, joined at the least pivot."""
    n = len(a)
    d, low = a * a, b / a[:-1] if n > 1 else np.zeros(0)

    def safe(x: float) -> float:
        return x if abs(x) > LEAST else math.copysign(LEAST, x)

    s, down = np.zeros(n), np.zeros(max(0, n - 1))
    s[0] = -value
    for k in range(n - 1):
        down[k] = d[k] * low[k] / safe(s[k] + d[k])
        s[k + 1] = down[k] * low[k] * s[k] - value
    p, up = np.zeros(n), np.zeros(max(0, n - 1))
    p[n - 1] = d[n - 1] - value
    for k in range(n - 2, -1, -1):
        t = d[k] / safe(d[k] * low[k] ** 2 + p[k + 1])
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    at = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -up[k] * z[k]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) else np.zeros(n)


def beside(a: np.ndarray, b: np.ndarray, value: float, found: list[np.ndarray]) -> np.ndarray:
    """A vector for an eigenvalue that ``found`` already has one for: inverse iteration, kept orthogonal to these."""
    n = len(a)
    main = a * a + np.concatenate([[0.0], b * b]) - value
    side, floor = a[:-1] * b, EPS * EPS * float(np.max(a * a)) + LEAST
    z = np.random.default_rng(n).standard_normal(n)
    for _ in range(6):
        z = orthogonal(z, found)
        pivot, x = main.copy(), z.copy()
        for k in range(n - 1):
            pivot[k] = pivot[k] if abs(pivot[k]) > floor else math.copysign(floor, pivot[k])
            pivot[k + 1] -= side[k] / pivot[k] * side[k]
            x[k + 1] -= side[k] / pivot[k] * x[k]
        pivot[n - 1] = pivot[n - 1] if abs(pivot[n - 1]) > floor else math.copysign(floor, pivot[n - 1])
        x[n - 1] /= pivot[n - 1]
        for k in range(n - 2, -1, -1):
            x[k] = (x[k] - side[k] * x[k + 1]) / pivot[k]
        z = x / np.abs(x).max()
    return orthogonal(z, found)


def orthogonal(z: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    z = z / np.linalg.norm(z)
    for _ in range(2):
        for v in found:
            z = z - (v @ z) * v
        z = z / np.linalg.norm(z)
    return z


def leading_directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest squared singular values of ``r`` in falling order, and their right vectors as columns.

    Values that vanish beside the largest (or all) are 0 and have no vector.
    """
    d = r.shape[1]
    k = min(k, d)
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0:
        return np.zeros(k), np.zeros((d, k))
    a, b, right = bidiagonal(r / scale)
    # entries too small to matter become just that: no pivot is zero
    floor = EPS / 64 * max(float(np.abs(a).max()), float(np.abs(b).max(initial=0.0)))
    a = np.where(np.abs(a) < floor, floor, a)
    values = sorted(dqds((a * a).tolist(), (b * b).tolist()), reverse=True)[:k]
    found: list[np.ndarray] = []
    for value in values:
        if value <= (d * EPS) ** 2 * values[0] * 16:
            break
        z = twisted(a, b, value)
        rest = z - sum(((v @ z) * v for v in found), np.zeros(d))
        found.append(orthogonal(z, found) if np.linalg.norm(rest) > 0.5 else beside(a, b, value, found))
    vectors = np.zeros((d, k))
    for j, z in enumerate(found):
        v = right @ z
        vectors[:, j] = v * math.copysign(1.0, v[int(np.argmax(np.abs(v)))])
    kept = np.array([v if j < len(found) else 0.0 for j, v in enumerate(values)])
    return kept * scale * scale, vectors


# --- the operator -------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """Directions and variances of whole-number vectors, with the exact sums of the ``n`` vectors of the fit list."""

    dim: int
    n: int
    sums: list[int]
    directions: np.ndarray      # dim x components
    variances: np.ndarray
    total: float                # the covariance's trace
    identity_error: float | None = None

    def transform(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers; null (nan) for a component without variance."""
        with np.errstate(divide="ignore"):
            weights = np.where(self.variances > 0, 1 / np.sqrt(self.variances), np.nan)
        centred = distances(x, self.n, self.sums).astype(np.float64) / self.n
        return (centred @ self.directions) * weights


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangular_factor(fit_rows: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: one factor a task, merged until one is left."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, dim))
        for batch in batches:
            rows = batch.column("x").to_pylist()
            for k in range(0, len(rows), BLOCK):
                centred = distances(decode_rows(rows[k:k + BLOCK], dim), n, sums).astype(np.float64) / n
                r = triangle(np.vstack([r, centred]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("part").to_numpy())
        rows = [np.frombuffer(group.column("r")[int(k)].as_py()).reshape(-1, dim) for k in order]
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // MERGE], pa.int32()), "r": pa.array([triangle(np.vstack(rows)).tobytes()], pa.binary())})

    factors = stored(fit_rows.select("x").mapInArrow(factor, "part int, r binary"), "factors")
    while factors.agg(F.count(F.lit(1))).first()[0] > 1:
        factors = stored(factors.groupBy(F.expr(f"part div {MERGE}")).applyInArrow(merge, "part int, r binary"), "factors")
    found = factors.first()
    r = np.zeros((dim, dim))
    if found is not None:
        rows = np.frombuffer(bytes(found.r)).reshape(-1, dim)
        r[:len(rows)] = rows
    return r


def fit_sums(fit_rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors, and their exact sums by dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            rows = batch.column("x").to_pylist()
            for k in range(0, len(rows), BLOCK):
                part = exact_sums(decode_rows(rows[k:k + BLOCK], dim))
                total = [a + b for a, b in zip(total, part)]
            n += len(rows)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, dim), pa.int32()),
                                          "total": pa.array([Decimal(t) for t in [n, *total]], pa.decimal128(38, 0))})

    each = fit_rows.select("x").mapInArrow(sums, "at int, total decimal(38,0)")
    found = {r["at"]: int(r["total"]) for r in each.groupBy("at").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    return found.get(-1, 0), [found.get(k, 0) for k in range(dim)]


def identity_error(fit_rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured over its rows."""
    kinds = [j for j, v in enumerate(model.variances) if v > 0]
    if not kinds:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(kinds)
        total = np.zeros((k, k + 1))
        for batch in batches:
            rows = batch.column("x").to_pylist()
            for i in range(0, len(rows), BLOCK):
                z = model.transform(decode_rows(rows[i:i + BLOCK], model.dim))[:, kinds]
                total += z.T @ np.hstack([z, np.ones((len(z), 1))])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(np.arange(k), k + 1), pa.int32()), "j": pa.array(np.tile(np.arange(k + 1), k), pa.int32()),
                                          "value": pa.array(total.ravel(), pa.float64())})

    each = fit_rows.select("x").mapInArrow(moments, "i int, j int, value double")
    found = {(r["i"], r["j"]): r["value"] / model.n for r in each.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    k = len(kinds)
    return max(abs(found[i, j] - found[i, k] * found[j, k] - (i == j)) for i in range(k) for j in range(k))


def fit_whitening(rows: DataFrame, components: int) -> Whitening | None:
    """The whitening of ``quantised`` rows (written down by the caller); None if there are none."""
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if dims is None or not dims["dim"]:
        return None
    dim = dims["dim"]
    fit_rows = stored(rows.where(F.col("dim") == dim).select("x").distinct(), "fit-rows")
    n, sums = fit_sums(fit_rows, dim)
    r = triangular_factor(fit_rows, dim, n, sums)
    squares, directions = leading_directions(r, components)
    model = Whitening(dim, n, sums, directions, squares / n, float((r * r).sum()) / n)
    model.identity_error = identity_error(fit_rows, model)
    return model


def whiten(df: DataFrame, components: int = 4, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stored(quantised(df, scale, vec_id, vector), "vectors")
    model = fit_whitening(rows, components)
    if model is None:
        return spark.createDataFrame([], schema)
    explained = [float(v) / model.total if model.total else None for v in model.variances]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = decode_rows(batch.column("x").to_pylist(), model.dim)
            z = model.transform(x)
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, model.n), pa.int64()),
                pa.array(deviations(distances(x, model.n, model.sums)), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(z.ravel(), pa.float64(), from_pandas=True), pa.array(explained * m, pa.float64()),
                pa.array([model.identity_error] * (m * k), pa.float64())], schema_names)

    schema_names = [part.split()[0] for part in schema.split(", ")]
    return rows.where(F.col("dim") == model.dim).select("vec_id", "x").mapInArrow(project, schema)
