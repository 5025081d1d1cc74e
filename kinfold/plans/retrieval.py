"""Jobs: retrieve, evaluate, search the threshold grid."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import metrics as mx
from kinfold.operators.embeddings import attach_embeddings, combine_modalities, select_split
from kinfold.operators.neighbors import knn_self_join
from kinfold.operators.projection import ProjectionHead, apply_head
from kinfold.session import materialize


def split_vectors(
    assignments: DataFrame,
    embeddings: Sequence[DataFrame],
    *,
    fusion_type: str | None = None,
    split: str = "test",
    head: ProjectionHead | None = None,
    id_col: str = "posting_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Rows of one split with their fused, optionally projected, vector.

    Several modalities are cut down to the split before they are fused, so only its
    rows are shuffled, and must agree on its ids.
    """
    base = select_split(assignments, split)
    if len(embeddings) > 1:
        ids = base.select(id_col).distinct()
        embeddings = [e.join(ids, id_col, "left_semi") for e in embeddings]
    fused = combine_modalities(embeddings, fusion_type, id_col=id_col, vec_col=vec_col)
    rows = attach_embeddings(
        base.drop(vec_col) if vec_col in base.columns else base, fused, id_col=id_col, vec_col=vec_col
    )
    return rows if head is None else apply_head(rows, head, vec_col=vec_col)


def neighbors_of(
    rows: DataFrame,
    *,
    k: int = 50,
    threshold: float | None = 0.5,
    id_col: str = "posting_id",
    group_col: str = "label_group",
    vec_col: str = "embedding",
) -> DataFrame:
    """Long-form neighbours with both groups, ready for the metrics."""
    return knn_self_join(
        rows, k=k, threshold=threshold, id_col=id_col, vec_col=vec_col, carry=[group_col]
    )


def retrieval_lists(
    rows: DataFrame,
    neighbors: DataFrame,
    *,
    id_col: str = "posting_id",
    columns: Sequence[str] = ("posting_id", "image", "title", "label_group", "stratum"),
) -> DataFrame:
    """One row per query with ``retrieved_products``, a JSON list of ids, best first.

    A query nothing was retrieved for keeps an empty list. A list has at most k ids.
    """
    ranked = F.sort_array(F.collect_list(F.struct("rank", F.col("neighbor_id").cast("string").alias("n"))))
    lists = neighbors.groupBy(F.col("query_id").alias(id_col)).agg(ranked.getField("n").alias("_ids"))
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    return (
        rows.select(*columns)
        .join(lists, id_col, "left")
        .select(*columns, F.to_json(ids).alias("retrieved_products"))
    )


def retrieve(
    assignments: DataFrame,
    embeddings: Sequence[DataFrame],
    *,
    fusion_type: str | None = None,
    split: str = "test",
    k: int = 50,
    threshold: float = 0.5,
    head: ProjectionHead | None = None,
    id_col: str = "posting_id",
    group_col: str = "label_group",
) -> DataFrame:
    """Nearest neighbours of a split as retrieval lists."""
    rows = split_vectors(
        assignments, embeddings, fusion_type=fusion_type, split=split, head=head, id_col=id_col
    )
    # sized and searched from one written table
    found = neighbors_of(materialize(rows), k=k, threshold=threshold, id_col=id_col, group_col=group_col)
    return retrieval_lists(
        select_split(assignments, split),
        found,
        id_col=id_col,
        columns=(id_col, "image", "title", group_col, "stratum"),
    )


class Evaluation(NamedTuple):
    rows: DataFrame
    overall: DataFrame
    by_stratum: DataFrame


def evaluate(results: DataFrame, recall_ks: Sequence[int] = mx.RECALL_KS, **columns) -> Evaluation:
    """Score retrieval lists: per row, overall means, means by stratum.

    The scored rows are written once for both summaries. ``results`` is read
    several times too, so it should be a table and not a search still to be run.
    """
    rows = materialize(mx.compute_per_row_metrics(results, recall_ks, **columns))
    columns.pop("retrieved_col", None)
    return Evaluation(
        rows, mx.summarize_metrics(rows, **columns), mx.summarize_by_stratum(rows, **columns)
    )


class GridSearch(NamedTuple):
    rows: DataFrame
    summary: DataFrame
    best: DataFrame


def grid_search(
    rows: DataFrame,
    *,
    thresholds: Sequence[float] = mx.THRESHOLDS,
    recall_ks: Sequence[int] = mx.RECALL_KS,
    k: int = 50,
    id_col: str = "posting_id",
    group_col: str = "label_group",
) -> GridSearch:
    """Metrics of every threshold from one search at the lowest.

    The summary, a row per threshold, is computed here and the best row read from
    it; ``rows`` of the result stays lazy and would search again.
    """
    found = neighbors_of(rows, k=k, threshold=min(thresholds), id_col=id_col, group_col=group_col)
    grid = mx.metrics_by_threshold(
        rows, found, thresholds, recall_ks, id_col=id_col, group_col=group_col
    )
    summary = materialize(mx.summarize_grid(grid, id_col=id_col, group_col=group_col))
    return GridSearch(grid, summary, mx.best_threshold(summary))
