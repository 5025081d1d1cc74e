"""Lookup joins that stay balanced when one key holds much of the fact side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
_SPREAD = 1 << 20


def hot_key_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    *,
    weight: str,
    spread_by: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join ``facts`` to ``lookup`` on ``key``; unmatched facts get nulls.

    ``lookup`` has one row per key and ``weight``, the number of facts per key.
    Keys above ``hot_rows`` facts number at most facts / hot_rows, so they are
    broadcast and their facts never move by key: in the shuffled join they carry
    a spread-out salt that matches nothing. All other keys join as usual; a key
    without weight counts as one of those. That join holds the lookup's rows of a task
    in memory, one per key, and streams the facts, which are never sorted.
    ``weight`` itself is not returned.
    """
    values = [c for c in lookup.columns if c not in (key, weight)]
    held = lookup.where(F.col(key).isNotNull())
    packed = F.struct(*values)
    heavy = F.coalesce(F.col(weight), F.lit(0)) > hot_rows
    hot = held.where(heavy).select(key, packed.alias("_hot"))
    cold = held.where(~heavy).select(
        key, F.lit(0).alias("_salt"), packed.alias("_cold")
    )
    # Facts that are hot, or that have no key at all, are spread over the tasks.
    elsewhere = F.col("_hot").isNotNull() | F.col(key).isNull()
    salt = F.when(elsewhere, 1 + F.pmod(F.xxhash64(spread_by), F.lit(_SPREAD)).cast("int"))
    joined = (
        facts.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0)))
        .join(cold.hint("shuffle_hash"), [key, "_salt"], "left")
    )
    found = F.coalesce("_hot", "_cold")
    return joined.select(*facts.columns, *[found.getField(c).alias(c) for c in values])
