"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``u, v`` edges.

    Alternates two star steps: every node hands its larger neighbours, then its
    smaller ones, to the smallest neighbour it knows. Each round is aggregates
    and joins only, the rounds grow with the logarithm of the longest path, and
    no node's neighbours are ever gathered. Self-loops and repeated edges do no harm.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    current = materialize(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct())
    state = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = materialize(small.where("u <> v").distinct())
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
