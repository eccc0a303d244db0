"""Conversions between Arrow list columns and NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .vectors import NORM_FLOOR


def flat_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def to_matrix(column) -> np.ndarray:
    """List column of equal lengths and finite values to a float64 matrix."""
    column = flat_array(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        return values.reshape(0, 0).astype(np.float64)
    width, rest = divmod(len(values), len(column))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if rest or (sizes != width).any():
        raise ValueError("embedding widths differ within the library")
    if not np.isfinite(values).all():
        raise ValueError("vectors must be finite")
    return values.reshape(len(column), width).astype(np.float64)


def to_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(width)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.maximum(lengths, NORM_FLOOR)[:, None]
