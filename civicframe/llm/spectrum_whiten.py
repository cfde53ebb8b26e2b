"""Whitening of embeddings by spectrum slicing.

Entries become whole numbers, so Spark sums counts, entries and centred products exactly: one row of sums for each pair of
dimensions leaves a task, and only d x d sums reach the driver.  There the covariance V is cut into intervals: the LDL'
factorisation of V - s I has as many positive pivots as V has eigenvalues above s (Sylvester), so counts at the ends of an
interval tell which eigenvalues it holds.  Bisection isolates each leading one, Rayleigh quotient iteration converges
cubically inside its interval, and counts just below and above the result certify its number.  A last pass
projects every vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, small_batches
from .vectors import integers, lengths

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Scaled entries from here on fit no long.
LIMIT = 2.0**62
#: Rows whose products are added in one multiplication; with entries below ``EXACT`` in size it is exact in doubles.
ROWS, EXACT = 1024, 1 << 21


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are larger than ``shift``: positive pivots of LDL' with 1x1 and 2x2 pivots."""
    m = matrix - shift * np.eye(len(matrix))
    found, threshold = 0, (1 + 17**0.5) / 8
    while len(m):
        size = np.abs(np.diag(m))
        k = int(size.argmax())
        off = np.abs(np.tril(m, -1))
        r, c = divmod(int(off.argmax()), len(m))
        if size[k] == 0 and off[r, c] == 0:
            return found
        if size[k] >= threshold * off[r, c]:
            found += bool(m[k, k] > 0)
            rest = np.delete(np.arange(len(m)), k)
            m = m[np.ix_(rest, rest)] - np.outer(m[rest, k], m[rest, k]) / m[k, k]
        else:  # the block is indefinite: one eigenvalue on either side
            found += 1
            rest = np.delete(np.arange(len(m)), [r, c])
            side = m[np.ix_(rest, [r, c])]
            m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_([r, c], [r, c])], side.T)
            m = (m + m.T) / 2
    return found


class Slicer:
    """Eigenvalues of a symmetric positive semidefinite matrix from the top, each in an interval certified by counts."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.n = matrix, len(matrix)
        self.top = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
        #: Distance below which eigenvalues cannot be told apart in doubles.
        self.fine = 4 * self.n * np.finfo(float).eps * self.top
        self.counts = {-self.fine - self.top * 1e-3: self.n, self.top * (1 + 1e-3): 0}

    def count(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = above(self.matrix, shift)
        return self.counts[shift]

    def interval(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that holds eigenvalue ``k`` (from 1)."""
        return max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k)

    def isolate(self, k: int) -> tuple[float, float]:
        """An interval with no other eigenvalue than the k-th, or with those that equal it."""
        while True:
            low, high = self.interval(k)
            if high - low <= self.fine or self.count(low) == k and self.count(high) == k - 1:
                return low, high
            self.count((low + high) / 2)

    def _solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0.0, 1.0, 3.0):
            try:
                y = np.linalg.solve(self.matrix - (shift + nudge * self.fine / 8) * np.eye(self.n), x)
            except np.linalg.LinAlgError:
                continue
            if np.all(np.isfinite(y)) and y.any():
                return y
        return x

    def vector(self, k: int, earlier: np.ndarray) -> tuple[float, np.ndarray]:
        """The k-th eigenvalue and a unit vector orthogonal to the ``earlier`` ones."""

        def clean(x: np.ndarray) -> np.ndarray:
            for _ in range(2):
                x = x - earlier.T @ (earlier @ x)
                x = x / np.linalg.norm(x)
            return x

        x = clean(np.random.default_rng(k).standard_normal(self.n))
        low, high = self.isolate(k)
        value = (low + high) / 2
        for step in range(200):
            y = clean(self._solve(value if step >= 2 else (low + high) / 2, x))
            quotient = float(y @ self.matrix @ y)
            gap = float(np.linalg.norm(self.matrix @ y - quotient * y))
            x = y
            if gap <= self.fine:
                wide = gap + self.fine
                if self.count(quotient + wide) < k <= self.count(quotient - wide):
                    return quotient, x
            if step >= 2 and not low < quotient < high or step % 8 == 7:
                # Towards another eigenvalue: halve the interval and begin again from its middle.
                self.count((low + high) / 2)
                low, high = self.isolate(k)
                value = (low + high) / 2
            else:
                value = quotient
        raise ArithmeticError(f"eigenvalue {k} not certified")


def leading(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues in falling order and their unit vectors as rows; a vector's largest entry is positive."""
    values, vectors = np.zeros(0), np.zeros((0, len(matrix)))
    slicer = Slicer(matrix)
    for k in range(1, min(components, len(matrix)) + 1):
        value, x = (0.0, np.eye(len(matrix))[k - 1]) if slicer.top == 0 else slicer.vector(k, vectors)
        values, vectors = np.append(values, value), np.vstack([vectors, x * np.sign(x[np.abs(x).argmax()])])
    return values, vectors


@dataclass
class Whitening:
    """What the fit list says: counts and sums are exact."""

    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    #: Eigenvalues beyond the rounding of the covariance; the others have no whitened value.
    usable: np.ndarray
    identity_error: float | None = None

    @property
    def centre(self) -> list[int]:
        """The whole numbers next to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def centred(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the usable vectors, and their scaled entries less ``centre``; beyond 64 bits as Python's whole numbers."""
        kept, y = _whole(column, self.width)
        if max(np.abs(y).max(initial=0), *map(abs, self.centre)) < 1 << 61:
            return kept, y - np.array(self.centre)
        return kept, y.astype(object) - np.array(self.centre, object)

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened values of rows less ``centre``."""
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, self.centre)])
        scale = np.sqrt(np.where(self.usable, self.values, 1.0))
        return (z - rest) @ self.vectors.T / scale


def _listed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return small_batches(vectors).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def _summed(rows: DataFrame, task, kind: str) -> dict[tuple[int, int], object]:
    """Sums of the cells (i, j, v) that tasks leave, one row a cell."""
    cells = rows.select("vec").mapInArrow(freed(task), f"i int, j int, v {'string' if kind != 'double' else kind}")
    total = cells.groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in total.collect()}


def _cells(found: dict[tuple[int, int], object], kind: pa.DataType) -> pa.RecordBatch:
    i, j = ([k[a] for k in found] for a in (0, 1))
    v = [str(x) for x in found.values()] if kind == pa.string() else [*found.values()]
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, kind)], ["i", "j", "v"])


def exact_products(z: np.ndarray) -> np.ndarray:
    """z' z in Python's whole numbers."""
    total = np.zeros((z.shape[1],) * 2, object)
    for low in range(0, len(z), ROWS):
        part = z[low : low + ROWS]
        if np.abs(part).max(initial=0) < EXACT:
            wide = part.astype(np.float64)
            total += (wide.T @ wide).astype(np.int64).astype(object)
        else:
            total += part.T.astype(object) @ part.astype(object)
    return total


def _whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    return integers(column, SCALE, width, LIMIT)


def fit(vectors: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id", vec_col: str = "embedding") -> Whitening | None:
    """Covariance, leading components and the check of the whitened covariance, over all usable vectors; None if there are none."""
    rows = _listed(vectors, id_col, vec_col)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            width = int(lengths(batch.column(0)).max(initial=0))
            kept, y = _whole(batch.column(0), width)
            total = y.sum(axis=0).tolist() if np.abs(y).max(initial=0) < 1 << 40 else y.astype(object).sum(axis=0).tolist()
            for key, v in [((-1, 0), len(kept)), *(((0, j), s) for j, s in enumerate(total) if len(kept))]:
                found[key] = found.get(key, 0) + int(v)
        yield _cells(found, pa.string())

    sums = _summed(rows, entries, "decimal(38,0)")
    n = int(sums.pop((-1, 0), 0) or 0)
    width = 1 + max((j for _, j in sums), default=-1)
    if not n or not width:
        return None
    model = Whitening(width, n, [int(sums[0, j]) for j in range(width)], np.zeros(0), np.zeros((0, width)), 0.0, np.zeros(0, bool))
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            total += exact_products(model.centred(batch.column(0))[1])
        yield _cells({(i, j): total[i, j] for i in range(width) for j in range(i, width)}, pa.string())

    found = _summed(rows, products, "decimal(38,0)")
    rest = [s - n * m for s, m in zip(model.sums, model.centre)]
    cov = np.zeros((width, width))
    for (i, j), p in found.items():
        cov[i, j] = cov[j, i] = (n * int(p) - rest[i] * rest[j]) / n**2
    model.values, model.vectors = leading(cov, components)
    model.trace = float(np.trace(cov))
    model.usable = model.values > 64 * width * np.finfo(float).eps * model.trace
    k = len(model.values)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.project(model.centred(batch.column(0))[1].astype(float))
            total, first = total + w.T @ w, first + w.sum(axis=0)
        cells = {(i, j): total[i, j] for i in range(k) for j in range(i, k)} | {(-1, i): first[i] for i in range(k)}
        yield _cells(cells, pa.float64())

    found = _summed(rows, whitened, "double")
    off = [
        abs(v / n - found[-1, i] / n * (found[-1, j] / n) - (i == j))
        for (i, j), v in found.items() if i >= 0 and model.usable[i] and model.usable[j]
    ]
    model.identity_error = max(off, default=None)
    return model


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(vectors: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component (from 1, by falling eigenvalue): id, component, n, deviation, whitened, explained, identity_error.

    A vector is usable unless it is null or holds an entry that is null, not finite, or too large for a long once scaled.  Shorter vectors
    count as filled with zeros.  Vectors of d dimensions have d components at most.  Where an eigenvalue is zero up to the rounding of the covariance,
    whitened is null, and ``identity_error`` leaves that component out (null if there is no other); ``explained`` is null if all
    vectors are equal.  ``deviation`` is null where it does not fit a long.  Rows with null or repeated ids are rows like others.  Other
    columns are not read.  An empty table gives an empty result.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {SCHEMA}"
    model = fit(vectors, components, id_col=id_col, vec_col=vec_col)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, k = model.n, len(model.values)
    rest = [s - n * m for s, m in zip(model.sums, model.centre)]
    explained = [v / model.trace if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, z = model.centred(batch.column("vec"))
            largest = int(np.abs(z).max(initial=0))
            if model.width * (n * (largest + 1)) ** 2 < 1 << 63:
                deviation = ((n * z.astype(np.int64) - np.array(rest)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [int(d) if d < 1 << 63 else None for d in ((n * z.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)]
            white = model.project(z.astype(float))
            place = np.repeat(np.arange(len(kept)), k)
            columns = [
                batch.column("id").take(pa.array(kept[place])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(kept))),
                pa.array(np.full(len(place), n)), pa.array(deviation, pa.int64()).take(pa.array(place)),
                pa.array(white.ravel(), mask=np.tile(~model.usable, len(kept))),
                pa.array(explained, pa.float64()).take(pa.array(np.tile(np.arange(k), len(kept)))),
                pa.array([model.identity_error] * len(place), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *(c.split()[0] for c in SCHEMA.split(", "))])

    return _listed(vectors, id_col, vec_col).mapInArrow(freed(run), schema)
