"""Arrow list columns as numpy vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows(column: pa.Array) -> list[np.ndarray | None]:
    """Float64 vectors; None for null, empty, or any null or non-finite component."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    missing = column.is_null().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for i in range(len(column)):
        v = None if missing[i] else flat[offsets[i] : offsets[i + 1]]
        out.append(v if v is not None and len(v) and np.isfinite(v).all() else None)
    return out


def padded(v: np.ndarray, dim: int) -> np.ndarray:
    return v if len(v) == dim else np.concatenate([v, np.zeros(dim - len(v))])
