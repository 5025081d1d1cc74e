"""Global ranks without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import materialize


def hash_order(seed: int | str, *columns: str) -> Column:
    """A reproducible shuffle key: md5 over the seed and the columns, as hex text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def rank_by_hash(
    df: DataFrame, order: str, *, within: Sequence[str] = (), name: str = "rank", digits: int = 4
) -> DataFrame:
    """1-based rank of each row by the md5 text in ``order``, inside ``within``.

    The first hex digits cut the rows into even buckets. Their counts, at most
    16^digits per group, give each bucket's offset; only the rank inside a bucket
    needs a window, so no task sees a whole group however large it is.
    """
    keys = [*within, "_bucket"]
    bucketed = df.withColumn("_bucket", F.substring(order, 1, digits))
    counts = bucketed.groupBy(*keys).agg(F.count("*").alias("_n"))
    return _offset_rank(bucketed, counts, list(within), [F.col(order)], name)


def rank_by_value(
    df: DataFrame, column: str, *, name: str = "rank", buckets: int = 1024
) -> DataFrame:
    """1-based rank of each row by a numeric column without repeats, ascending.

    Approximate quantiles cut the range into even buckets (exactness does not
    depend on them); bucket counts give offsets, a window ranks inside a bucket.
    """
    as_double = df.withColumn("_value", F.col(column).cast("double"))
    cuts = as_double.approxQuantile("_value", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]  # no cuts where there are no rows
    bucketed = Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket").transform(as_double)
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    return _offset_rank(bucketed, counts, [], [F.col(column)], name).drop("_value")


def rank_by_order(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1-based rank of each row over the whole table by any sort order; ties fall as they come.

    A range sort written once, and the row counts of its partitions: no window sees
    more than one row a partition, whatever the order's values repeat.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_part", F.shiftright("_place", 33)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the sort
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return placed.join(F.broadcast(counts), "_part").withColumn(name, rank).drop("_part", "_place", "_first", "_before")


def _offset_rank(
    bucketed: DataFrame, counts: DataFrame, within: list[str], order: list[Column], name: str
) -> DataFrame:
    groups = within or [F.lit(0)]
    earlier = (
        Window.partitionBy(*groups)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    named = {c: f"_of_{c}" for c in [*within, "_bucket"]}
    offsets = counts.select(
        *[F.col(c).alias(n) for c, n in named.items()], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*within, "_bucket").orderBy(*order)
    same = F.lit(True)
    for c, n in named.items():  # a null group is a group
        same = same & F.col(c).eqNullSafe(F.col(n))
    return (
        bucketed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, same)
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_bucket", "_before", "_place", *named.values())
    )
