"""Vectors of a table as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Neither null nor holding null or non-finite components."""
    x = F.col(column)
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows as doubles; shorter vectors end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    wide = int(size.max()) if len(size) else 0
    if len(values) == len(size) * wide:
        return values.reshape(len(size), wide)
    out = np.zeros((len(size), wide))
    out[np.arange(wide)[None, :] < size[:, None]] = values
    return out


def unpacked(ids: bytes, data: bytes, n: int, dim: int, kind: str = "<f8") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).reshape(n, dim)
