"""Vector columns: unit length, fusion and softmax.

Vectors are ``array<float>``. Arithmetic runs on whole Arrow batches in double
precision; array lambdas would cost tens of times more per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

NORM_FLOOR = 1e-12


def matrix(lists: pa.Array) -> np.ndarray:
    """Non-null vectors of a batch as a float64 matrix; all must have one length."""
    valid = lists.drop_null()
    if not len(valid):
        return np.empty((0, 0))
    lengths = np.unique(np.diff(np.asarray(valid.offsets)))
    if len(lengths) != 1:
        raise ValueError(f"vectors differ in length: {lengths.min()} to {lengths.max()}")
    flat = valid.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(valid), -1)


def lists_of(rows: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows back as lists, with nulls where ``valid`` is false."""
    width = rows.shape[1] if rows.ndim == 2 else 0
    sizes = np.where(valid, width, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(rows.ravel(), type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~valid))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.maximum(norms, NORM_FLOOR)[:, None]


def l2_normalize(vector: Column) -> Column:
    """Divide by the norm, floored at 1e-12."""

    @arrow_udf(T.ArrayType(T.FloatType()))
    def normalize(lists: pa.Array) -> pa.Array:
        return lists_of(unit_rows(matrix(lists)), np.asarray(lists.is_valid()), pa.float32())

    return normalize(vector)


def fuse(vectors: list[Column], fusion_type: str | None) -> Column:
    """One vector from several: ``concat`` or ``sum``, then unit length.

    A single vector passes through as it is. Any null gives null.
    """
    if len(vectors) == 1:
        return vectors[0]
    if fusion_type == "concat":
        return l2_normalize(F.concat(*vectors))
    if fusion_type == "sum":
        return _fused_sum(*vectors)
    raise ValueError(
        f"fusion_type must be 'concat' or 'sum' for several embeddings, got {fusion_type!r}"
    )


def _fused_sum(*vectors: Column) -> Column:
    complete = F.lit(True)
    for v in vectors:
        complete = complete & v.isNotNull()
    sides = [F.when(complete, v) for v in vectors]

    @arrow_udf(T.ArrayType(T.FloatType()))
    def total(lists: pa.Array, more: pa.Array) -> pa.Array:
        left, right = matrix(lists), matrix(more)
        if left.shape != right.shape:
            raise ValueError(f"cannot sum vectors of lengths {left.shape[1]} and {right.shape[1]}")
        return lists_of(left + right, np.asarray(lists.is_valid()), pa.float32())

    summed = sides[0]
    for side in sides[1:]:
        summed = total(summed, side)
    return l2_normalize(summed)


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision; null when either side is null."""
    both = left.isNotNull() & right.isNotNull()

    @arrow_udf(T.DoubleType())
    def product(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = matrix(a), matrix(b)
        values = np.zeros(len(a))
        valid = np.asarray(a.is_valid())
        if len(x):
            values[valid] = np.einsum("ij,ij->i", x, y)
        return pa.array(values, mask=~valid)

    return product(F.when(both, left), F.when(both, right))


def softmax(scores: np.ndarray) -> np.ndarray:
    """Row-wise softmax shifted by the row maximum."""
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)
