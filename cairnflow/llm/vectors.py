"""Vectors as exact integers: floor(scale * x) of every component, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components from here on aren't longs.
TOO_LARGE = 2.0**63


def of_floats(vectors: DataFrame, id_col: str, vector_col: str, id_type: str | None = None) -> DataFrame:
    """(id, v) alone, v of floats or doubles; other element types become doubles."""
    v, element = vectors[vector_col], vectors.schema[vector_col].dataType.elementType.typeName()
    own = vectors[id_col].cast(id_type) if id_type else vectors[id_col]
    return vectors.select(own.alias("id"), (v if element in ("float", "double") else v.cast("array<double>")).alias("v"))


def whole(v: Column, scale: float) -> Column:
    """Whether no component is null or not finite, and every scaled one is a long: the vectors that :func:`scaled` gives."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < TOO_LARGE)), F.lit(False))


def scaled(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, int64 matrix) for each length among the whole vectors of a list column; empty vectors have no columns."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(size[known]).tolist():
        rows = np.flatnonzero(known & (size == d))
        x = values[offsets[rows][:, None] + np.arange(d)]
        ok = (np.abs(x) < TOO_LARGE).all(axis=1)  # not so for NaN
        if ok.any():
            yield rows[ok], np.floor(x[ok]).astype(np.int64)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0
