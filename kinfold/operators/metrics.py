"""Retrieval metrics: per query, overall, by stratum and by threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.joins import hot_key_lookup

RECALL_KS = (5, 10, 50)
# The thresholds a grid search tries.
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _scored(precision: Column, recall: Column) -> Column:
    return F.when(
        precision + recall > 0, 2 * precision * recall / (precision + recall)
    ).otherwise(F.lit(0.0))


def _check_ks(recall_ks: Sequence[int]) -> None:
    if any(k < 1 for k in recall_ks):
        raise ValueError("recall_ks must be 1 or more")


def _with_group_size(rows: DataFrame, id_col: str, group_col: str, by: Sequence[str] = ()) -> DataFrame:
    group = F.col(group_col)
    if by:  # sets side by side: a group counts inside its set
        group = F.when(group.isNotNull(), F.struct(*by, group_col))
    keyed = rows.withColumn("_set", group)
    sizes = (
        keyed.where("_set is not null")
        .groupBy("_set")
        .agg(F.count("*").alias("_size"))
        .withColumn("_weight", F.col("_size"))
    )
    return hot_key_lookup(keyed, sizes, "_set", weight="_weight", spread_by=id_col).drop("_set")


def _metric_columns(recall_ks: Sequence[int]) -> list[Column]:
    """Metrics from ``_got``, ``_hits``, ``_hits<k>`` and ``_size``."""
    got, hits, size = (F.coalesce(c, F.lit(0)) for c in ("_got", "_hits", "_size"))
    precision, recall = _ratio(hits, got), _ratio(hits, size)
    return [
        precision.alias("precision"),
        recall.alias("recall"),
        _scored(precision, recall).alias("f1"),
        *[
            _ratio(F.coalesce(F.col(f"_hits{k}"), F.lit(0)), size).alias(f"recall-{k}")
            for k in recall_ks
        ],
    ]


def _hit_counts(keep: Column, recall_ks: Sequence[int], suffix: str = "") -> list[Column]:
    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    hit = keep & F.col("hit")
    return [
        count(keep).alias(f"_got{suffix}"),
        count(hit).alias(f"_hits{suffix}"),
        *[count(hit & (F.col("rank") <= k)).alias(f"_hits{k}{suffix}") for k in recall_ks],
    ]


def compute_per_row_metrics(
    results: DataFrame,
    recall_ks: Sequence[int] = RECALL_KS,
    *,
    retrieved_col: str = "retrieved_products",
    id_col: str = "posting_id",
    group_col: str = "label_group",
    stratum_col: str = "stratum",
) -> DataFrame:
    """Precision, recall, F1 and recall-k of each row's retrieved id list.

    The list may be a JSON string or an array. A retrieved id counts as a match
    when it is a row of the same input with the query's group; unknown ids stay
    in the denominator. Ids much retrieved are looked up without moving by id.
    """
    _check_ks(recall_ks)
    listed = F.col(retrieved_col)
    if dict(results.dtypes)[retrieved_col] == "string":
        listed = F.from_json(listed, "array<string>")
    spread = results.select(
        F.col(id_col).alias("query_id"),
        F.col(group_col).alias("_group"),
        F.posexplode(listed).alias("_pos", "_retrieved"),
    ).select("query_id", "_group", (F.col("_pos") + 1).alias("rank"), F.col("_retrieved").cast("string"))
    in_degree = spread.groupBy("_retrieved").agg(F.count("*").alias("_weight"))
    groups = results.select(
        F.col(id_col).cast("string").alias("_retrieved"), F.col(group_col).alias("_found")
    )
    # an id that occurs twice has one group, the largest
    groups = groups.groupBy("_retrieved").agg(F.max("_found").alias("_found"))
    lookup = groups.join(in_degree, "_retrieved")
    looked = hot_key_lookup(spread, lookup, "_retrieved", weight="_weight", spread_by="query_id")
    hits = looked.withColumn("hit", F.coalesce(F.col("_found") == F.col("_group"), F.lit(False)))
    base = results.select(id_col, group_col, stratum_col)
    return _join_counts(base, hits, recall_ks, id_col, group_col)


def metrics_from_neighbors(
    products: DataFrame,
    neighbors: DataFrame,
    recall_ks: Sequence[int] = RECALL_KS,
    *,
    id_col: str = "posting_id",
    group_col: str = "label_group",
    stratum_col: str = "stratum",
    by: Sequence[str] = (),
) -> DataFrame:
    """The same metrics from long-form neighbours that carry both groups.

    No lookup by retrieved id is needed: the neighbour search brought the group.
    ``by`` names columns, of both inputs, that part them into sets scored side by side.
    """
    _check_ks(recall_ks)
    base = products.select(*by, id_col, group_col, stratum_col)
    return _join_counts(base, with_hits(neighbors, group_col), recall_ks, id_col, group_col, by)


def with_hits(neighbors: DataFrame, group_col: str) -> DataFrame:
    same = F.col(f"query_{group_col}") == F.col(f"neighbor_{group_col}")
    return neighbors.withColumn("hit", F.coalesce(same, F.lit(False)))


def _join_counts(base, hits, recall_ks, id_col, group_col, by=()) -> DataFrame:
    counts = hits.groupBy(*by, "query_id").agg(*_hit_counts(F.lit(True), recall_ks))
    counts = counts.withColumnRenamed("query_id", id_col)
    joined = _with_group_size(base, id_col, group_col, by).join(counts, [*by, id_col], "left")
    return joined.select(*base.columns, *_metric_columns(recall_ks))


def running_matches(neighbors: DataFrame, group_col: str = "label_group") -> DataFrame:
    """Matches so far along each query's list: ``query_id, rank, matches``."""
    so_far = (
        Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    return with_hits(neighbors, group_col).select(
        "query_id", "rank", F.sum(F.col("hit").cast("long")).over(so_far).alias("matches")
    )


def metric_columns(df: DataFrame, skip: Sequence[str]) -> list[str]:
    """Every column but the id, group and stratum."""
    return [c for c in df.columns if c not in skip]


def summarize_metrics(
    metrics: DataFrame,
    *,
    id_col: str = "posting_id",
    group_col: str = "label_group",
    stratum_col: str = "stratum",
) -> DataFrame:
    """One row with the mean of every metric."""
    columns = metric_columns(metrics, (id_col, group_col, stratum_col))
    return metrics.agg(*[F.avg(f"`{c}`").alias(c) for c in columns])


def summarize_by_stratum(
    metrics: DataFrame,
    *,
    id_col: str = "posting_id",
    group_col: str = "label_group",
    stratum_col: str = "stratum",
) -> DataFrame:
    """The mean of every metric per stratum; rows without one are left out."""
    columns = metric_columns(metrics, (id_col, group_col, stratum_col))
    return (
        metrics.where(F.col(stratum_col).isNotNull())
        .groupBy(stratum_col)
        .agg(*[F.avg(f"`{c}`").alias(c) for c in columns])
    )


def metrics_by_threshold(
    products: DataFrame,
    neighbors: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    recall_ks: Sequence[int] = RECALL_KS,
    *,
    id_col: str = "posting_id",
    group_col: str = "label_group",
    stratum_col: str = "stratum",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per-row metrics at every threshold, from one neighbour search at the lowest.

    A higher threshold keeps a prefix of a query's list, so conditional counts in
    one aggregate serve all thresholds; neighbours are neither searched again nor
    multiplied by the grid. ``by`` parts both inputs into sets scored side by side.
    """
    _check_ks(recall_ks)
    counts = []
    for i, t in enumerate(thresholds):
        counts += _hit_counts(F.col("sim") >= float(t), recall_ks, f"_t{i}")
    per_query = with_hits(neighbors, group_col).groupBy(*by, "query_id").agg(*counts)
    base = products.select(*by, id_col, group_col, stratum_col)
    joined = _with_group_size(base, id_col, group_col, by).join(
        per_query.withColumnRenamed("query_id", id_col), [*by, id_col], "left"
    )
    names = ["_got", "_hits", *[f"_hits{k}" for k in recall_ks]]
    grid = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_t{i}").alias(n) for n in names]
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return joined.select(*base.columns, "_size", F.inline(grid)).select(
        "threshold", *base.columns, *_metric_columns(recall_ks)
    )


def summarize_grid(
    grid: DataFrame,
    *,
    id_col: str = "posting_id",
    group_col: str = "label_group",
    stratum_col: str = "stratum",
    by: Sequence[str] = (),
) -> DataFrame:
    """``threshold`` and the mean of every metric as ``avg_<metric>``, by threshold (and ``by``)."""
    columns = metric_columns(grid, (*by, "threshold", id_col, group_col, stratum_col))
    return (
        grid.groupBy(*by, "threshold")
        .agg(*[F.avg(f"`{c}`").alias(f"avg_{c}") for c in columns])
        .orderBy(*by, "threshold")
    )


def best_threshold(summary: DataFrame) -> DataFrame:
    """The row with the highest mean F1; the lowest threshold among equals."""
    return summary.orderBy(F.desc("avg_f1"), "threshold").limit(1)
