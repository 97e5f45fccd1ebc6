"""Vector columns: norm, normalise, cosine. Plain Spark expressions, computed in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8
INFERENCE_FLOOR = 1e-6
RANK_DIGITS = 9


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, floor: float = NORM_FLOOR) -> Column:
    def scaled(u: Column) -> Column:
        norm = F.greatest(l2_norm(u), F.lit(floor))
        return F.transform(u, lambda x: x / norm)

    # Inside transform the vector is a bound variable: it is computed once, however it was made.
    return F.transform(F.array(as_doubles(v)), scaled)[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine with floored norms; vectors of different or zero length score 0."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    floor = F.lit(NORM_FLOOR)
    scale = F.greatest(l2_norm(a), floor) * F.greatest(l2_norm(b), floor)
    return F.when(same, dot(a, b) / scale).otherwise(F.lit(0.0))


def matrix(column: pa.Array) -> np.ndarray | list[np.ndarray]:
    """Arrow list column as a double matrix; a list of rows when the lengths differ."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n and column.null_count == 0 and (lengths == lengths[0]).all():
        return flat.reshape(n, lengths[0])
    return [np.asarray(v if v is not None else [], dtype=np.float64) for v in column.to_pylist()]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.maximum(norms, NORM_FLOOR)[:, None]


def cosine_block(left, right) -> np.ndarray:
    """All cosines between two blocks of vectors, one matrix product per common length."""
    if isinstance(left, np.ndarray) and isinstance(right, np.ndarray):
        if left.shape[1] != right.shape[1]:
            return np.zeros((len(left), len(right)))
        return unit_rows(left) @ unit_rows(right).T
    scores = np.zeros((len(left), len(right)))
    left_len = np.array([len(v) for v in left])
    right_len = np.array([len(v) for v in right])
    for size in np.intersect1d(left_len, right_len):
        i, j = np.flatnonzero(left_len == size), np.flatnonzero(right_len == size)
        if size:
            scores[np.ix_(i, j)] = unit_rows(np.vstack([left[x] for x in i])) @ unit_rows(
                np.vstack([right[x] for x in j])
            ).T
    return scores
