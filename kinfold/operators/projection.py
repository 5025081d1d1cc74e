"""Projection head: a linear map, batch normalisation with fixed statistics, unit length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from kinfold.functions.vectors import lists_of, matrix, unit_rows

# Batch normalisation and dropout of the head.
BN_EPS = 1e-5
BN_MOMENTUM = 0.1
DROPOUT = 0.5
# Rows projected at a time, however many an Arrow batch has.
_TILE = 1024

HEAD_SCHEMA = T.StructType(
    [
        T.StructField("weight", T.ArrayType(T.ArrayType(T.DoubleType()))),
        *[
            T.StructField(name, T.ArrayType(T.DoubleType()))
            for name in ("bias", "bn_gamma", "bn_beta", "bn_mean", "bn_var")
        ],
    ]
)


@dataclass
class ProjectionHead:
    """Weights of a head; their size is set by its two dimensions, not by the data."""

    weight: np.ndarray
    bias: np.ndarray
    bn_gamma: np.ndarray
    bn_beta: np.ndarray
    bn_mean: np.ndarray
    bn_var: np.ndarray

    @classmethod
    def initial(cls, input_dim: int, projection_dim: int = 512, seed: int = 42) -> ProjectionHead:
        rng = np.random.default_rng(seed)
        bound = 1 / np.sqrt(input_dim)
        return cls(
            rng.uniform(-bound, bound, (projection_dim, input_dim)),
            rng.uniform(-bound, bound, projection_dim),
            np.ones(projection_dim),
            np.zeros(projection_dim),
            np.zeros(projection_dim),
            np.ones(projection_dim),
        )

    def linear(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight.T + self.bias

    def project(self, x: np.ndarray) -> np.ndarray:
        """Evaluation mode: running statistics, no dropout, unit rows."""
        z = (self.linear(x) - self.bn_mean) / np.sqrt(self.bn_var + BN_EPS)
        return unit_rows(z * self.bn_gamma + self.bn_beta)

    def to_table(self, spark: SparkSession) -> DataFrame:
        row = tuple(getattr(self, f.name).tolist() for f in HEAD_SCHEMA.fields)
        return spark.createDataFrame([row], HEAD_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame) -> ProjectionHead:
        rows = table.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("a head table has exactly one row")
        return cls(*[np.array(rows[0][f.name], dtype=np.float64) for f in HEAD_SCHEMA.fields])


def apply_head(rows: DataFrame, head: ProjectionHead, *, vec_col: str = "embedding") -> DataFrame:
    """Replace each vector by its projection; the weights travel with the batch function."""

    @arrow_udf(T.ArrayType(T.FloatType()))
    def project(lists: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, max(1, len(lists)), _TILE):
            part = lists.slice(at, _TILE)
            vectors = matrix(part)
            projected = head.project(vectors) if len(vectors) else vectors
            parts.append(lists_of(projected, np.asarray(part.is_valid()), pa.float32()))
        return pa.concat_arrays(parts)

    return rows.withColumn(vec_col, project(F.col(vec_col)))
