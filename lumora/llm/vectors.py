"""Vectors of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows in double precision; all are of one length."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)
