"""Vectors of an Arrow batch as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(column: pa.Array) -> np.ndarray:
    """The number of entries of each vector; -1 for a null."""
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def integers(column: pa.Array, scale: int, width: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and floor(scale * entry) of theirs as a matrix of ``width`` columns.

    A vector is not usable if it is null, or if an entry is null, not finite, or ``limit`` or more in size once scaled.  Shorter
    vectors are filled with zeros; none may be longer than ``width``.
    """
    size = lengths(column)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.floor(scale * flat)
    size0 = np.maximum(size, 0)
    row = np.repeat(np.arange(len(size)), size0)
    good = size >= 0
    with np.errstate(invalid="ignore"):
        good[row[~(np.abs(scaled) < limit)]] = False
    out = np.zeros((len(size), width), np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size0) - size0, size0)
    use = good[row]
    out[row[use], place[use]] = scaled[use].astype(np.int64)
    usable = np.flatnonzero(good)
    return usable, out[usable]
