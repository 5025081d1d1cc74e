"""Variance strata and the stratified train / val / test split of groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators.joins import HOT_ROWS, hot_key_lookup
from kinfold.operators.quantiles import quantile_row
from kinfold.operators.ranking import hash_order, rank_by_hash, rank_by_order
from kinfold.session import materialize

# Quotas of up to so many strata are worked out on the driver and broadcast.
FEW_STRATA = 1_000


def assign_stratum(
    groups: DataFrame,
    vision_std_col: str = "multiples_score_std",
    language_std_col: str = "indonesian_score_std",
    product_count_col: str = "product_count",
) -> DataFrame:
    """``higher_variance`` where any of the three columns is strictly above its third quartile."""
    columns = [vision_std_col, language_std_col, product_count_col]
    cuts = quantile_row(groups, columns, [0.75]).select(F.struct(*columns).alias("q")).scalar()
    marked = groups.withColumn("_q", cuts)
    above = F.lit(False)
    for c in columns:
        over = ~F.isnan(F.col(c).cast("double")) & (F.col(c) > F.col("_q").getField(c).getField("q0"))
        above = above | F.coalesce(over, F.lit(False))
    return marked.withColumn(
        "stratum", F.when(above, "higher_variance").otherwise("lower_variance")
    ).drop("_q")


def largest_remainder(counts: dict[str, int], total: int) -> dict[str, int]:
    """Share ``total`` over the strata by size; leftovers go to the largest remainders."""
    whole = sum(counts.values())
    exact = {s: n / whole * total for s, n in counts.items()}
    quota = {s: math.floor(x) for s, x in exact.items()}
    by_remainder = sorted(counts, key=lambda s: (-(exact[s] - quota[s]), s is None, s or ""))
    for s in by_remainder[: total - sum(quota.values())]:
        quota[s] += 1
    return quota


def split_quotas(counts: dict[str, int], train_ratio: float) -> dict[str, tuple[int, int]]:
    """Per stratum the number of train and of val groups; the rest is test."""
    n = sum(counts.values())
    held = math.ceil((1.0 - train_ratio) * n)
    test = math.ceil(held * 0.5)
    few = [s for s, c in counts.items() if c < 2]
    if few:
        raise ValueError(f"strata with fewer than two groups: {sorted(map(str, few))}")
    if min(n - held, held - test, test) < len(counts):
        raise ValueError(f"{n} groups are too few to put every stratum in every split")
    train = largest_remainder(counts, n - held)
    left = {s: counts[s] - train[s] for s in counts}
    if min(left.values()) < 2:
        raise ValueError("a stratum keeps fewer than two groups outside train")
    val = largest_remainder(left, held - test)
    return {s: (train[s], val[s]) for s in counts}


def share_out(sizes: DataFrame, count: str, total: int, whole: int, name: str, stratum: str) -> DataFrame:
    """Add ``name``: the share of ``total`` of each stratum by its ``count``; leftovers go to the largest remainders.

    Equal remainders go by stratum, null last. Strata are ranked by a range sort, so
    their number does not matter.
    """
    exact = F.col(count) / F.lit(float(whole)) * F.lit(float(total))
    parts = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    order = [F.desc(F.col("_exact") - F.col("_floor")), F.asc_nulls_last(stratum)]
    ranked = rank_by_order(parts, *order, name="_at")
    spare = total - (ranked.agg(F.sum("_floor")).first()[0] or 0)
    return ranked.withColumn(name, (F.col("_floor") + (F.col("_at") <= spare).cast("long")).cast("long")).drop(
        "_exact", "_floor", "_at"
    )


def quota_table(counts: DataFrame, train_ratio: float, *, stratum: str = "stratum") -> DataFrame:
    """``stratum, count, train, val``: how many groups of each stratum go to train and to val; the rest is test.

    ``counts`` has a stratum (null is one) and the ``count`` of its groups in each row.
    """
    counts = materialize(counts.select(stratum, "count"))
    n, strata, least = counts.agg(F.sum("count"), F.count("*"), F.min("count")).first()
    if 0 < strata <= FEW_STRATA:  # the same rule, without the jobs of a sort
        sizes = {r[stratum]: r["count"] for r in counts.collect()}
        quotas = split_quotas(sizes, train_ratio)
        longs = [T.StructField(name, T.LongType()) for name in ("count", "train", "val")]
        schema = T.StructType([counts.schema[stratum], *longs])
        return counts.sparkSession.createDataFrame([(s, sizes[s], *quotas[s]) for s in sizes], schema)
    if not n:
        return counts.withColumns({"train": F.lit(0).cast("long"), "val": F.lit(0).cast("long")})
    held = math.ceil((1.0 - train_ratio) * n)
    test = math.ceil(held * 0.5)
    if least < 2:
        few = [str(r[0]) for r in counts.where("count < 2").orderBy(stratum).select(stratum).limit(10).collect()]
        raise ValueError(f"strata with fewer than two groups: {few}")
    if min(n - held, held - test, test) < strata:
        raise ValueError(f"{n} groups are too few to put every stratum in every split")
    train = share_out(counts, "count", n - held, n, "train", stratum)
    left = materialize(train.withColumn("_left", F.col("count") - F.col("train")))
    if left.agg(F.min("_left")).first()[0] < 2:
        raise ValueError("a stratum keeps fewer than two groups outside train")
    return share_out(left, "_left", held - test, held, "val", stratum).drop("_left")


def stratified_group_split(
    groups: DataFrame,
    *,
    group_col: str = "label_group",
    stratify_col: str = "stratum",
    split_ratios: Sequence[float] = (0.7, 0.15, 0.15),
    random_seed: int = 42,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``split``. Only the first ratio counts; the rest is halved into val and test.

    Groups are drawn in md5 order of seed and group. Ranks come from bucket
    offsets, so a stratum (null is one) is never sorted in one task, and the quotas
    are a table of any number of strata that meets the groups without moving a large
    stratum to one task. The group table is written once, since it is read three times.
    """
    groups = materialize(groups)
    quotas = quota_table(groups.groupBy(stratify_col).count(), split_ratios[0], stratum=stratify_col)
    keyed = groups.withColumn("_order", hash_order(random_seed, group_col))
    ranked = rank_by_hash(keyed, "_order", within=[stratify_col], name="_rank")
    if quotas.limit(FEW_STRATA + 1).count() <= FEW_STRATA:
        few = F.broadcast(quotas.select(F.col(stratify_col).alias("_stratum"), "train", "val"))
        joined = ranked.join(few, F.col(stratify_col).eqNullSafe(F.col("_stratum")))
        return _labelled(joined, groups.columns)
    # a struct is a key also where the stratum is null
    ranked = ranked.withColumn("_key", F.struct(F.col(stratify_col).alias("stratum")))
    lookup = quotas.select(F.struct(F.col(stratify_col).alias("stratum")).alias("_key"), "train", "val", F.col("count").alias("_weight"))
    joined = hot_key_lookup(ranked, lookup, "_key", weight="_weight", spread_by=group_col, hot_rows=hot_rows)
    return _labelled(joined, groups.columns)


def _labelled(ranked: DataFrame, columns: Sequence[str]) -> DataFrame:
    split = (
        F.when(F.col("_rank") <= F.col("train"), "train")
        .when(F.col("_rank") <= F.col("train") + F.col("val"), "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).select(*columns, "split")


def assign_rows(
    products: DataFrame,
    groups: DataFrame,
    *,
    group_col: str = "label_group",
    id_col: str = "posting_id",
    count_col: str = "product_count",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give each product its group's ``split`` and ``stratum``; null where the group is unknown."""
    lookup = groups.select(group_col, "split", "stratum", F.col(count_col).alias("_weight"))
    return hot_key_lookup(products, lookup, group_col, weight="_weight", spread_by=id_col, hot_rows=hot_rows)
