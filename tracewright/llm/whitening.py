"""Embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Vectors are first made whole numbers, ``x = floor(SCALE * c) + OFFSET``, so that sums over any number of rows are exact.

1. One pass sums each dimension exactly, a second adds up the covariance of centred vectors, per task and then per row of
   the matrix. What reaches the driver is one matrix, whose size depends on the vectors' length alone (``MAX_DIMENSION``).
2. The covariance is split: with a shift inside its spectrum the polar factor U of (V - shift I) has the eigenvalues 1 and
   -1, so (U + I) / 2 is the projector on the subspace of eigenvalues above the shift. A basis of that subspace and one
   of its complement make the matrix block diagonal; both blocks are split likewise until they are numbers, or multiples
   of the identity to working precision. The polar factor comes from the dynamically weighted Halley iteration
   (Nakatsukasa, Bai, Gygi 2010; Nakatsukasa, Higham 2013): QR decompositions while the matrix is badly conditioned,
   Cholesky decompositions behind that.
3. The first ``most`` components go to the tasks, which project centred vectors on them and divide by the root of their
   eigenvalues. A pass before that measures the covariance of what comes out: ``identity_error``.

Defined results: rows whose vector is null or empty, holds a null or non-finite entry, or an entry too large for a long
take no part; nor do rows whose vector has another length than most (the longest of equally frequent ones), since no
covariance is defined for them. A component without variance, to working precision, has a null ``whitened`` and takes no
part in ``identity_error`` (which is null where there is no other), and ``explained`` is 0. ``deviation`` is null where
it doesn't fit in a long. Rows that repeat count as often as they occur, a null vec_id stays null, other columns are
ignored, equal eigenvalues give any orthonormal basis of their subspace, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import batches

SCALE, OFFSET = 64, 1_000_000
#: The driver holds a few matrices of the vectors' length squared.
MAX_DIMENSION = 4096
COMPONENTS = 32
#: Entries whose scaled size reaches this don't fit in a long with what is added to them.
_LARGEST = float(1 << 61)
_EPS = np.finfo(float).eps
#: Shifts tried in turn, in standard deviations of the eigenvalues from their mean.
_SHIFTS = (0.0, 0.07, -0.07, 0.19, -0.19, 0.41, -0.41, 0.83, -0.83, 0.013, -0.013)
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by QDWH; a direction that the matrix maps to nothing has no sign and is left near 0."""
    eye = np.eye(len(a))
    x = a / np.linalg.norm(a)  # singular values are now at most 1
    low = _EPS  # a bound from below for those that count
    for _ in range(60):
        low2 = low * low
        d = np.cbrt(4 * (1 - low2) / (low2 * low2))
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low2) / (low2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            after = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[: len(a)] @ q[len(a) :].T)
        else:
            root = np.linalg.cholesky(eye + wc * (x.T @ x))
            half = np.linalg.solve(root, x.T)
            after = wb / wc * x + (wa - wb / wc) * np.linalg.solve(root.T, half).T
        after = (after + after.T) / 2
        low = min(1.0, low * (wa + wb * low2) / (1 + wc * low2))
        step = np.linalg.norm(after - x)
        x = after
        if abs(1 - low) < 10 * _EPS and step < np.cbrt(5 * _EPS):
            break
    return x


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvalues above a shift, the others the rest; None where all eigenvalues are equal to working precision of ``scale``."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * n * _EPS * scale:
        return None
    rng = np.random.default_rng(n)
    best: tuple[float, np.ndarray, int] | None = None
    for shift in _SHIFTS:
        projector = (polar(a - (mean + shift * spread) * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = rng.standard_normal((n, n))
        for _ in range(2):  # the projector has but eigenvalues 0 and 1, so one step is enough and another cleans rounding
            basis[:, :k] = projector @ basis[:, :k]
            basis, _ = np.linalg.qr(basis)
        coupled = np.linalg.norm(basis[:, :k].T @ a @ basis[:, k:])
        if best is None or coupled < best[0]:
            best = coupled, basis, k
        if coupled <= 10 * n * _EPS * np.linalg.norm(a):
            break  # else an eigenvalue lies on the shift: another one separates better
    return None if best is None else best[1:]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns; of each the entry of largest size is positive."""
    scale = np.linalg.norm(a)
    vectors = np.empty_like(a)
    open_blocks = [(0, np.eye(len(a)))]
    while open_blocks:  # a block is a subspace, given by its basis and by where its columns go
        at, basis = open_blocks.pop()
        n = basis.shape[1]
        block = basis.T @ a @ basis
        found = split((block + block.T) / 2, scale) if n > 1 else None
        if found is None:
            vectors[:, at : at + n] = basis
        else:
            turned, k = found
            # turned bases are made orthonormal again, so that deep splits don't add up rounding
            own = np.linalg.qr(basis @ turned)[0]
            open_blocks += [(at, own[:, :k]), (at + k, own[:, k:])]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))])
    return values[order], vectors * np.where(signs == 0, 1, signs)


@dataclass
class Whitening:
    """What tasks need: the number of vectors, their exact sums, components in columns, their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def __post_init__(self) -> None:
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    @property
    def usable(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > 16 * len(self.sums) * _EPS * self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, correctly rounded but for the last bit."""
        return (x - self.base).astype(float) - self.rest / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        roots = np.sqrt(np.where(self.usable, self.values, 1.0))
        return np.where(self.usable, self.centred(x) @ self.components / roots, np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - S) ** 2; None where it is no long."""
        away = x - self.base
        near = ((self.n * away.astype(float) - self.rest) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            whole = self.n * away - self.rest
            exact = (whole * whole).sum(axis=1).tolist()  # right where the sum is a long, since its parts only add up
        for i in np.flatnonzero(near > 0.999 * 2.0**63).tolist():
            true = sum((self.n * int(d) - int(r)) ** 2 for d, r in zip(away[i], self.rest)) if near[i] < 1.001 * 2.0**63 else 1 << 63
            exact[i] = true if true < 1 << 63 else None
        return exact


def vectors_of(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vector of the rows that take part, and the vectors' length (0 where there are none)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= _LARGEST))
    rows = rows.filter(F.col("vector").isNotNull() & ~odd & (F.size("vector") > 0))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    if length > MAX_DIMENSION:
        raise ValueError(f"vectors of {length} entries; the driver holds matrices of at most {MAX_DIMENSION} squared")
    return rows.filter(F.size("vector") == length), length


def whole_numbers(column: pa.ListArray, length: int) -> np.ndarray:
    """x of a batch's vectors, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    return np.floor(flat * SCALE).astype(np.int64) + OFFSET


def sums_of(rows: DataFrame, length: int) -> tuple[int, list[int]]:
    """The number of vectors and each dimension's exact sum, added up in halves of 31 bits and the rest."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for batch in parts:
            x = whole_numbers(batch.column(0), length)
            n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & ((1 << 31) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    whole = "decimal(38,0)"
    found = batches(rows.select("vector"), add, "i int, n long, high long, low long").groupBy("i").agg(F.sum(F.col("n")).alias("n"), F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low")).collect()
    by = {r["i"]: r for r in found}
    return by[0]["n"], [(int(by[i]["high"]) << 31) + int(by[i]["low"]) for i in range(length)]


def covariance(rows: DataFrame, width: int, of) -> np.ndarray:
    """The sum of products of what ``of`` makes of a batch (a row of ``width`` numbers for each vector): per task, then per row of the matrix."""

    def multiply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        seen = False
        for batch in parts:
            y = of(batch)
            total += y.T @ y
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "products"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in parts:
            for i, products in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[i] = held.get(i, 0) + products.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "products"])

    shape = "i int, products array<double>"
    found = batches(batches(rows.select("vector"), multiply, shape).repartition("i"), merge, shape).collect()  # one matrix
    out = np.zeros((width, width))
    for r in found:
        out[r["i"]] = r["products"]
    return out


def fit(rows: DataFrame, length: int, most: int = COMPONENTS) -> Whitening:
    """The whitening of vectors (column vector, each of ``length`` entries), with the largest error of what it gives."""
    n, sums = sums_of(rows, length)
    centre = Whitening(n, sums, np.zeros((length, 0)), np.zeros(0), 0.0)
    v = covariance(rows, length, lambda batch: centre.centred(whole_numbers(batch.column(0), length))) / n
    v = (v + v.T) / 2
    values, vectors = eigen(v)
    k = min(most, length)
    found = Whitening(n, sums, np.ascontiguousarray(vectors[:, :k]), values[:k], float(np.trace(v)))
    good = np.flatnonzero(found.usable)
    if len(good):
        # whitened vectors have the mean 0 to rounding, which is taken off all the same: a first column of ones gives their sums
        def whitened(batch: pa.RecordBatch) -> np.ndarray:
            y = found.project(whole_numbers(batch.column(0), length))[:, good]
            return np.hstack([np.ones((len(y), 1)), y])

        products = covariance(rows, len(good) + 1, whitened) / n
        mean = products[0, 1:]
        found.identity_error = float(np.abs(products[1:, 1:] - np.outer(mean, mean) - np.eye(len(good))).max())
    return found


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows, length = vectors_of(embeddings)
    if not length:
        return embeddings.sparkSession.createDataFrame([], WHITENED)
    model = fit(rows, length, most)
    k = len(model.values)
    explained = np.where(model.usable, model.values / model.trace if model.trace > 0 else 0.0, 0.0)

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = whole_numbers(batch.column(1), length)
            n = len(x)
            each = np.repeat(np.arange(n), k)
            y = model.project(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n, np.int64)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(y, mask=np.isnan(y)),
                    pa.array(np.tile(explained, n)),
                    pa.array([model.identity_error] * (n * k), pa.float64()),
                ],
                [c.split()[0] for c in WHITENED.split(", ")],
            )

    return batches(rows, project, WHITENED)

