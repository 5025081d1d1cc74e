"""Group profiles, describe tables, box-plot numbers and frequency counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.quantiles import exact_quantiles, melt

_QUARTILES = (0.25, 0.5, 0.75)


def group_profile(
    df: DataFrame,
    *,
    id_col: str = "posting_id",
    group_col: str = "label_group",
    score_cols: Sequence[str] = ("multiples_score", "indonesian_score"),
) -> DataFrame:
    """Per group: ``product_count`` and, for each score, ``<s>_mean`` and ``<s>_std``.

    The deviation is the sample one, null for a group of one. Rows without a
    group are left out.
    """
    scores = []
    for s in score_cols:
        scores += [F.avg(s).alias(f"{s}_mean"), F.stddev_samp(s).alias(f"{s}_std")]
    return (
        df.where(F.col(group_col).isNotNull())
        .groupBy(group_col)
        .agg(F.count(id_col).alias("product_count"), *scores)
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Eight rows ``statistic`` by ``columns``: count, mean, std, min, quartiles, max."""
    moments = (
        melt(df, columns)
        .groupBy("column")
        .agg(
            F.count("*").cast("double").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    names = ("count", "mean", "std", "min", "max")
    pairs = F.array(
        *[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in names]
    )
    quartiles = exact_quantiles(df, columns, _QUARTILES).select(
        "column",
        F.concat((F.col("prob") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
        "value",
    )
    cells = moments.select("column", F.inline(pairs)).unionByName(quartiles)
    return cells.groupBy("statistic").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    )


def boxplot_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The numbers a box plot draws, one row per column.

    Whiskers end at the furthest values within 1.5 interquartile ranges of the
    box; values beyond are outliers.
    """
    inside = F.col("value").between(F.col("fence_low"), F.col("fence_high"))
    return (
        _fenced(df, columns)
        .groupBy("column")
        .agg(
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.least(F.min(F.when(inside, F.col("value"))), F.first("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(inside, F.col("value"))), F.first("q3")).alias("whisker_high"),
            F.sum((~inside).cast("long")).alias("outliers"),
        )
    )


def boxplot_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every value outside the fences with its number of rows: ``column, value, rows``."""
    outside = ~F.col("value").between(F.col("fence_low"), F.col("fence_high"))
    return (
        _fenced(df, columns).where(outside).groupBy("column", "value").agg(F.count("*").alias("rows"))
    )


def _fenced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long values beside their column's quartiles; one broadcast row per column."""
    quartiles = exact_quantiles(df, columns, _QUARTILES)
    box = quartiles.groupBy("column").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
            for p, name in zip(_QUARTILES, ("q1", "median", "q3"))
        ]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = box.withColumn("fence_low", F.col("q1") - reach).withColumn(
        "fence_high", F.col("q3") + reach
    )
    return melt(df, columns).join(F.broadcast(fences), "column")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``column, count`` of the non-null values, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
    )
