"""Embedding tables keyed by id: joining modalities, fusing, selecting a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import fuse


def combine_modalities(
    tables: Sequence[DataFrame],
    fusion_type: str | None = None,
    *,
    id_col: str = "posting_id",
    vec_col: str = "embedding",
    strict: bool = True,
) -> DataFrame:
    """One ``id, embedding`` table from one table per modality.

    All must hold the same ids: with ``strict`` an id missing from one of them
    stops the job, otherwise such ids are left out. The check rides on the join
    itself and costs no extra pass.
    """
    if len(tables) > 1 and fusion_type not in ("concat", "sum"):
        raise ValueError(
            f"fusion_type must be 'concat' or 'sum' for several embeddings, got {fusion_type!r}"
        )
    joined = tables[0].select(id_col, F.col(vec_col).alias("_v0"))
    for i, table in enumerate(tables[1:], start=1):
        side = table.select(id_col, F.col(vec_col).alias(f"_v{i}"))
        joined = joined.join(side, id_col, "full_outer" if strict else "inner")
    vectors = [F.col(f"_v{i}") for i in range(len(tables))]
    if strict and len(tables) > 1:
        vectors = [
            F.when(
                v.isNull(),
                F.raise_error(F.concat(F.lit("id missing from a modality: "), F.col(id_col))),
            ).otherwise(v)
            for v in vectors
        ]
    return joined.select(id_col, fuse(vectors, fusion_type).alias(vec_col))


def attach_embeddings(
    rows: DataFrame,
    embeddings: DataFrame,
    *,
    id_col: str = "posting_id",
    vec_col: str = "embedding",
    strict: bool = True,
) -> DataFrame:
    """Rows with their vector; a row without one stops the job, or is left out if not strict."""
    side = embeddings.select(id_col, vec_col)
    if not strict:
        return rows.join(side, id_col)
    missing = F.raise_error(F.concat(F.lit("no embedding for "), F.col(id_col).cast("string")))
    return rows.join(side, id_col, "left").withColumn(
        vec_col, F.when(F.col(vec_col).isNull(), missing).otherwise(F.col(vec_col))
    )


def select_split(assignments: DataFrame, split: str) -> DataFrame:
    return assignments.where(F.col("split") == split)
