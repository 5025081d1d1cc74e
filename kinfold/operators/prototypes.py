"""Soft classification of vectors by their similarity to prototype vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from kinfold.functions.vectors import l2_normalize, lists_of, matrix, softmax
from kinfold.session import materialize

BROADCAST_BYTES = 64 << 20
_BLOCK_BYTES = 16 << 20


def class_prototypes(
    df: DataFrame, *, label_col: str = "label", vec_col: str = "embedding"
) -> DataFrame:
    """Unit-length mean vector per label: ``class_id, embedding``.

    Components are summed map-side, so a label of any size moves one row per task
    and component; the list put back together has one entry per dimension.
    """
    components = df.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).alias("class_id"), F.posexplode(vec_col).alias("pos", "x")
    )
    sums = components.groupBy("class_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x"))).getField("x")
    return (
        sums.groupBy("class_id")
        .agg(ordered.alias("embedding"))
        .withColumn("embedding", l2_normalize(F.col("embedding")))
    )


def classify_by_prototypes(
    rows: DataFrame,
    prototypes: DataFrame,
    *,
    scale: float = 1.0,
    vec_col: str = "embedding",
    class_col: str = "class_id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``probs``: softmax of ``scale`` times the similarity to each class, in class order.

    Prototypes whose measured size is below ``broadcast_bytes`` go to every task
    as one matrix and nothing shuffles. Larger sets meet the rows block by block;
    rows are told apart by a number of their own, so repeated and null ids are fine.
    """
    n, dim = prototypes.agg(F.count("*"), F.max(F.size(vec_col))).first()
    if not n:
        raise ValueError("no prototypes")
    if n * dim * 8 > broadcast_bytes:
        return _classify_in_blocks(rows, prototypes, n, dim, scale, vec_col, class_col)
    held = prototypes.select(class_col, vec_col).orderBy(class_col).toPandas()
    wanted = np.stack(held[vec_col].to_numpy()).astype(np.float64).T

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def probs(lists: pa.Array) -> pa.Array:
        vectors = matrix(lists)
        valid = np.asarray(lists.is_valid())
        scores = softmax(scale * (vectors @ wanted)) if len(vectors) else np.empty((0, 0))
        return lists_of(scores, valid, pa.float64())

    return rows.withColumn("probs", probs(F.col(vec_col)))


def pick_class(probs: str, position: int = 1) -> Column:
    """Probability of the class at a 0-based position."""
    return F.get(F.col(probs), F.lit(position))


def _classify_in_blocks(rows, prototypes, n, dim, scale, vec_col, class_col) -> DataFrame:
    columns = rows.columns
    # written first, so that the numbers stay the same however often they are read
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    per_block = max(1, _BLOCK_BYTES // (8 * dim))
    n_classes = -(-n // per_block)
    n_rows = max(1, -(-rows.count() // per_block))
    kind = "bigint"
    label = dict(prototypes.dtypes)[class_col]
    asked = rows.where(F.col(vec_col).isNotNull()).select(
        F.col("_row").alias("_id"),
        F.lit(None).cast(label).alias("_class"),
        F.col(vec_col).alias("_vec"),
        F.pmod(F.xxhash64("_row"), F.lit(n_rows)).alias("_rb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)).cast("array<bigint>")).alias("_cb"),
    )
    offered = prototypes.select(
        F.lit(None).cast(kind).alias("_id"),
        F.col(class_col).alias("_class"),
        F.col(vec_col).alias("_vec"),
        F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)).cast("array<bigint>")).alias("_rb"),
        F.pmod(F.xxhash64(class_col), F.lit(n_classes)).alias("_cb"),
    )

    def score(table: pa.Table) -> pa.Table:
        of_row = np.asarray(table["_class"].is_null())
        ids = table["_id"].filter(pa.array(of_row)).combine_chunks()
        classes = table["_class"].filter(pa.array(~of_row)).combine_chunks()
        vectors = table["_vec"].combine_chunks()
        if not len(ids) or not len(classes):
            sims, sizes = np.empty(0), np.zeros(len(ids), dtype=np.int32)
        else:
            left, right = matrix(vectors.filter(pa.array(of_row))), matrix(vectors.filter(pa.array(~of_row)))
            sims, sizes = (left @ right.T).ravel(), np.full(len(ids), len(classes), dtype=np.int32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        listed = classes.take(pa.array(np.tile(np.arange(len(classes)), len(ids))))
        return pa.table(
            {
                "_id": ids,
                "_classes": pa.ListArray.from_arrays(offsets, listed),
                "_sims": pa.ListArray.from_arrays(offsets, pa.array(sims)),
            }
        )

    parts = (
        asked.unionByName(offered)
        .groupBy("_rb", "_cb")
        .applyInArrow(score, f"_id {kind}, _classes array<{label}>, _sims array<double>")
    )
    # A row's answer holds one number per class by definition; only that is gathered.
    pairs = F.flatten(F.collect_list(F.arrays_zip("_classes", "_sims")))
    whole = parts.groupBy("_id").agg(F.sort_array(pairs).getField("_sims").alias("_sims"))

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def normalise(lists: pa.Array) -> pa.Array:
        return lists_of(softmax(scale * matrix(lists)), np.asarray(lists.is_valid()), pa.float64())

    answers = whole.select(F.col("_id").alias("_row"), normalise("_sims").alias("probs"))
    return rows.join(answers, "_row", "left").select(*columns, "probs")
