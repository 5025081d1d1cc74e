"""Job: compare modalities and fusions, frozen and projected, on val and test."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.vectors import fuse
from kinfold.operators import metrics as mx
from kinfold.operators.embeddings import attach_embeddings, select_split
from kinfold.operators.neighbors import knn_self_join
from kinfold.operators.projection import ProjectionHead, apply_head
from kinfold.operators.training import Fit, fit_heads
from kinfold.session import materialize

# Variant name, the modalities it needs and how they are fused.
VARIANTS = (
    ("images", ("images",), None),
    ("titles", ("titles",), None),
    ("multimodal_concat", ("images", "titles"), "concat"),
    ("multimodal_sum", ("images", "titles"), "sum"),
)
GRID_K = 51
BY = ["variant", "head"]


def present_variants(modalities: Mapping[str, DataFrame]) -> list[tuple[str, tuple[str, ...], str | None]]:
    """The variants whose modalities are all there; a notice for each of the others."""
    found = []
    for name, needed, fusion in VARIANTS:
        if any(m not in modalities for m in needed):
            warnings.warn(f"variant {name} skipped: missing {needed}", stacklevel=3)
            continue
        found.append((name, needed, fusion))
    if not found:
        raise ValueError("no variant has its inputs")
    return found


def variant_vectors(
    assignments: DataFrame,
    modalities: Mapping[str, DataFrame],
    *,
    split: str,
    id_col: str = "posting_id",
    group_col: str = "label_group",
) -> DataFrame:
    """Rows of one split with the vector of every variant in a column of its name, written once.

    Each modality is joined once, whatever the number of variants that use it.
    """
    found = present_variants(modalities)
    rows = select_split(assignments, split).select(id_col, group_col, "stratum")
    used = sorted({m for _, needed, _ in found for m in needed})
    for m in used:
        side = modalities[m].select(id_col, F.col("embedding").alias(f"_{m}"))
        rows = attach_embeddings(rows, side, id_col=id_col, vec_col=f"_{m}")
    fused = [fuse([F.col(f"_{m}") for m in needed], fusion).alias(name) for name, needed, fusion in found]
    return materialize(rows.select(id_col, group_col, "stratum", *fused))


def fit_variants(
    assignments: DataFrame,
    modalities: Mapping[str, DataFrame],
    *,
    id_col: str = "posting_id",
    group_col: str = "label_group",
    **options,
) -> dict[str, Fit]:
    """A head for every variant, all fitted in one loop on train and judged on val."""
    shared = {"id_col": id_col, "group_col": group_col}
    found = present_variants(modalities)
    train, val = (variant_vectors(assignments, modalities, split=s, **shared) for s in ("train", "val"))
    return fit_heads(
        train,
        val,
        {name: name for name, _, _ in found},
        fusion_types={name: fusion for name, _, fusion in found},
        id_col=id_col,
        label_col=group_col,
        **options,
    )


def run_variants(
    assignments: DataFrame,
    modalities: Mapping[str, DataFrame],
    *,
    heads: Mapping[str, ProjectionHead] | None = None,
    thresholds: Sequence[float] = mx.THRESHOLDS,
    recall_ks: Sequence[int] = mx.RECALL_KS,
    k: int = GRID_K,
    id_col: str = "posting_id",
    group_col: str = "label_group",
) -> DataFrame:
    """Grid on val, then test at the best threshold, for every variant with inputs.

    Columns: ``variant, head, split, threshold`` and the mean metrics. A variant is
    projected too when ``heads`` has its name. All variants, frozen and projected,
    are one search and one aggregate a split.
    """
    shared = {"id_col": id_col, "group_col": group_col}
    sets = []
    for name, _, _ in present_variants(modalities):
        sets.append((name, "frozen", None))
        if heads is not None and name in heads:
            sets.append((name, "projected", heads[name]))
        elif heads is not None:
            warnings.warn(f"variant {name} has no head", stacklevel=2)

    def searched(split: str, floor: DataFrame | float) -> tuple[DataFrame, DataFrame]:
        wide = variant_vectors(assignments, modalities, split=split, **shared)
        rows = None
        for name, kind, head in sets:
            part = wide.select(id_col, group_col, "stratum", F.col(name).alias("embedding"))
            if head is not None:
                part = apply_head(part, head)
            part = part.withColumns({"variant": F.lit(name), "head": F.lit(kind)})
            rows = part if rows is None else rows.unionByName(part)
        rows = materialize(rows)
        if isinstance(floor, DataFrame):  # a row a set
            least = floor.agg(F.min("threshold")).first()[0]
        else:
            least = floor
        found = knn_self_join(rows, k=k, threshold=least, id_col=id_col, carry=[group_col], within=BY)
        return rows, found

    rows, found = searched("val", min(thresholds))
    grid = mx.metrics_by_threshold(rows, found, thresholds, recall_ks, by=BY, **shared)
    summary = materialize(mx.summarize_grid(grid, by=BY, **shared))
    # the lowest threshold among those with the best mean F1, up to rounding of the sums
    place = F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc(F.round("avg_f1", 12)), "threshold"))
    best = materialize(summary.withColumn("_place", place).where("_place = 1").select(*BY, "threshold"))
    rows, found = searched("test", best)
    kept = found.join(F.broadcast(best), BY).where(F.col("sim") >= F.col("threshold")).drop("threshold")
    scored = mx.metrics_from_neighbors(rows, kept, recall_ks, by=BY, **shared)
    at_best = scored.join(F.broadcast(best), BY)
    final = mx.summarize_grid(at_best, by=BY, **shared)
    columns = ["variant", "head", "split", *[c for c in summary.columns if c not in BY]]
    quoted = [F.col(f"`{c}`") for c in columns]
    return (
        summary.withColumn("split", F.lit("val")).select(*quoted)
        .unionByName(final.withColumn("split", F.lit("test")).select(*quoted))
    )
