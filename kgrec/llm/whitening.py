"""Whitening of embeddings along their leading principal components (operator 11).

``fit``     the distinct integer vectors are counted and summed, then their centred outer products; the covariance (one
            d x d matrix, whatever the number of rows) is split on the driver.
``split``   QDWH spectral divide and conquer: the polar factor U of (A - shift I), found by inverse-free QDWH steps, gives
            the projector (U + I) / 2 onto the eigenvalues above the shift; orthonormal bases of its range and of the
            rest cut A into two smaller blocks, and so on down to single components.
``whiten``  adds every row's projections over the root of the eigenvalues; the model of d numbers a component is broadcast.
``identity_error``  measures the covariance of what ``whiten`` gives over the fit list.

An entry c, as a double, is the integer floor(256 c); sums, counts and deviations are exact integers.  The outer products of a
task are summed in the task, and by Spark for each (matrix row, 16 columns), so no task or driver holds more than a few
matrices.  Only the distinct vectors are shuffled; a vector that a third of the rows repeat leaves a task once.

Defined results: rows whose vector is null, or holds null or non-finite entries, are left out; so are empty vectors.
Vectors of different lengths raise ``ValueError``; entries beyond the 64-bit range stand at its ends.  Equal vectors count once in the fit and
each have their rows in the result; rows of a null id stay.  A component without variance (its eigenvalue is rounding) has
a null ``whitened`` and takes no part in ``identity_error``, which is null where no component is left; ``explained`` is
null where the trace is zero.  A ``deviation`` beyond the 64-bit range is null; ``deviation_digits`` always has it.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgrec.llm.common import written

SCALE = 256
COMPONENTS = 4
COLUMNS = 16           # matrix columns that one partial sum carries
EPS = float(np.finfo(float).eps)
LARGEST = (1 << 63) - 1


# --- spectral divide and conquer ----------------------------------------------------------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps (QR form, no inverse)."""
    n = len(a)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    low, eye = EPS, np.eye(n)  # any smaller start only costs steps
    for _ in range(60):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2)) if low < 1 else 0.0
        a_ = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)))
        b = (a_ - 1) ** 2 / 4
        c = a_ + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        before, x = x, b / c * x + (a_ - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        x = (x + x.T) / 2
        low = min(1.0, low * (a_ + b * l2) / (1 + c * l2))
        if 1 - low < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(EPS) * np.sqrt(n):
            break
    return x


def halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None where all eigenvalues are one up to rounding."""
    n = len(a)
    eye, mean = np.eye(n), np.trace(a) / n
    if np.linalg.norm(a - mean * eye) <= 4 * EPS * n * scale:
        return None
    best = None
    for shift in (float(np.median(np.diag(a))), mean, *(mean + f * (np.diag(a).max() - mean) for f in (0.5, -0.5, 0.25, -0.25, 0.1, -0.1))):
        b = a - shift * eye
        if np.linalg.norm(b) == 0:
            continue
        projector = (polar(b) + eye) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        # A basis of the range: QR of the projector's longest columns, once more for full orthogonality.
        order = np.argsort(-np.diag(projector), kind="stable")
        q = np.linalg.qr(np.hstack([projector[:, order[:rank]], (eye - projector)[:, order[rank:]]]))[0]
        upper = np.linalg.qr(projector @ q[:, :rank])[0]
        lower = np.linalg.qr(q[:, rank:] - upper @ (upper.T @ q[:, rank:]))[0]
        lower = np.linalg.qr(lower - upper @ (upper.T @ lower))[0]
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = left, upper, lower
        if left <= 32 * EPS * n * scale:
            break
    if best is None:
        raise ArithmeticError("no shift splits the matrix")
    return best[1], best[2]


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = float(np.linalg.norm(a))
    values, vectors = [], []
    open_blocks = [(a, np.eye(len(a)))] if len(a) else []
    while open_blocks:
        block, basis = open_blocks.pop()
        parts = halves(block, scale) if len(block) > 1 else None
        if parts is None:
            values += np.diag(block).tolist()
            vectors += list(basis.T)
            continue
        for part in parts:
            inner = part.T @ block @ part
            open_blocks.append(((inner + inner.T) / 2, basis @ part))
    if not values:
        return np.zeros(0), np.zeros((0, 0))
    v = np.linalg.qr(np.array(vectors).T)[0]  # the products of bases, orthonormal to the last bit
    e = np.einsum("ij,ik,kj->j", v, a, v)     # Rayleigh quotients
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


# --- Spark --------------------------------------------------------------------------------------------------

@dataclass
class Model:
    n: int                 # fit vectors
    sums: np.ndarray       # their sums, exact (object integers)
    values: np.ndarray     # eigenvalues of the components kept, falling
    vectors: np.ndarray    # their unit eigenvectors, one a column
    trace: float
    error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums])

    @property
    def varies(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > max(len(self.sums), 1) * 8 * EPS * max(self.trace, 0.0)


def integer_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are whole (not null, not empty, all entries finite numbers), and these as rows of integers."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = lists.flatten().cast(pa.float64())
    values = entries.to_numpy(zero_copy_only=False)  # a null becomes NaN
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    whole = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    if not whole.any():
        return whole, np.zeros((0, 0), np.int64)
    if len(np.unique(sizes[whole])) > 1:
        raise ValueError("vectors of different lengths")
    flat = np.floor(SCALE * values[np.repeat(whole, sizes)])
    ints = np.where(flat >= 2.0 ** 63, LARGEST, np.clip(flat, -2.0 ** 63, np.nextafter(2.0 ** 63, 0)).astype(np.int64))
    return whole, ints.reshape(whole.sum(), -1)


def integers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, x)`` of the usable rows: x holds little-endian 64-bit integers."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, ints = integer_rows(batch.column(1))
            width = 8 * ints.shape[1]
            raw = ints.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(whole)), pa.array([raw[k * width:(k + 1) * width] for k in range(len(ints))], pa.binary())],
                ["key", "x"])

    source = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("x"))
    return source.mapInArrow(convert, f"key {source.schema['key'].dataType.simpleString()}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    if len({len(p) for p in parts}) > 1:
        raise ValueError("vectors of different lengths")
    return np.frombuffer(b"".join(parts), "<i8").reshape(len(parts), -1)


def _summed(fit: DataFrame, of_batch, kind: str) -> dict[tuple[int, int], list]:
    """Matrices of the batches summed in each task, then by Spark for each (row, first column)."""
    arrow = pa.int64() if kind == "bigint" else pa.float64()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = of_batch(_matrix(batch.column(0)))
                if total is not None and total.shape != m.shape:
                    raise ValueError("vectors of different lengths")
                total = m if total is None else total + m
        if total is None:
            return
        for at in range(0, total.shape[1], COLUMNS):
            part = total[:, at:at + COLUMNS]
            part = np.pad(part, ((0, 0), (0, COLUMNS - part.shape[1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(part)), pa.int32()), pa.array(np.full(len(part), at), pa.int32()), *(pa.array(c, arrow) for c in part.T)],
                ["row", "col", *(f"c{k}" for k in range(COLUMNS))])

    cells = ", ".join(f"c{k} {kind}" for k in range(COLUMNS))
    sums = fit.select("x").mapInArrow(partial, f"row int, col int, {cells}").groupBy("row", "col").agg(
        *(F.sum(f"c{k}").alias(f"c{k}") for k in range(COLUMNS)))
    return {(r["row"], r["col"]): [r[f"c{k}"] for k in range(COLUMNS)] for r in sums.collect()}  # d * d numbers at most


def fit_list(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each distinct integer vector once, written so that every pass over it reads the same rows."""
    return written(integers(rows.select(F.lit(0).alias("key"), F.col(f"`{vector}`").alias("v")), "key", "v").select("x").distinct(), "fit-list")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The leading components of a fit list; None where it is empty."""
    def moments(x: np.ndarray) -> np.ndarray:
        """Row 0: the sums' low 31 bits, row 1: the rest, so that neither can overflow; row 2: the count."""
        return np.vstack([(x & 0x7FFFFFFF).sum(axis=0), (x >> 31).sum(axis=0), np.full(x.shape[1], len(x))])

    cells = _summed(distinct, moments, "bigint")
    if not cells:
        return None
    low, high, count = ([v for at in sorted(c for r, c in cells if r == k) for v in cells[k, at]] for k in range(3))
    d = sum(1 for c in count if c)
    n = count[0]
    if any(c != n for c in count[:d]):
        raise ValueError("vectors of different lengths")
    sums = np.array([lo + (hi << 31) for lo, hi in zip(low[:d], high[:d], strict=True)], object)
    mean = np.array([float(s) / n for s in sums])

    def outer(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    cells = _summed(distinct, outer, "double")
    v = np.array([[x for at in range(0, d, COLUMNS) for x in cells[r, at]][:d] for r in range(d)]) / n
    v = (v + v.T) / 2
    values, vectors = split(v)
    k = min(components, d)
    model = Model(n, sums, values[:k], vectors[:, :k], float(np.trace(v)))
    model.error = identity_error(distinct, model)
    return model


def _projected(x: np.ndarray, model: Model) -> np.ndarray:
    """Whitened rows; NaN for components without variance."""
    root = np.sqrt(np.where(model.varies, model.values, np.nan))
    return (x - model.mean) @ model.vectors / root


def identity_error(distinct: DataFrame, model: Model) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    names = [f"w{k}" for k in np.flatnonzero(model.varies)]
    if not names:
        return None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = _projected(_matrix(batch.column(0)), model)[:, model.varies]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], names)

    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    whitened = distinct.mapInArrow(project, ", ".join(f"{c} double" for c in names))
    row = whitened.agg(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()
    return max(abs(row[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def deviations(x: np.ndarray, model: Model) -> list[int]:
    """The exact sums over dimensions of (n x - S)^2."""
    most = max(model.n * int(np.abs(x.astype(float)).max(initial=0)) + max(abs(s) for s in model.sums), 1)
    if most < 1 << 31 and most * most * x.shape[1] < 1 << 62:
        delta = model.n * x - model.sums.astype(np.int64)
        return np.einsum("ij,ij->i", delta, delta).tolist()
    delta = x.astype(object) * model.n - model.sums
    return [sum(v * v for v in row) for row in delta]


SCHEMA = ("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, "
          "deviation_digits string")


def whiten(rows: DataFrame, model: Model | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row and component: ``key`` and the columns of ``SCHEMA``."""
    kind = rows.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, {SCHEMA}"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # d numbers a component

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        explained = m.values / m.trace if m.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1))
                dev = np.repeat(np.array(deviations(x, m), object), k)
                rows_ = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                     pa.array(np.full(rows_, m.n), pa.int64()), pa.array([v if v <= LARGEST else None for v in dev], pa.int64()),
                     pa.array(_projected(x, m).ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(explained, len(x)), pa.float64(), from_pandas=True),
                     pa.array([m.error] * rows_, pa.float64()), pa.array(map(str, dev), pa.string())],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])

    return integers(rows, key, vector).mapInArrow(project, schema)
