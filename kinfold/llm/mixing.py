"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in shuffled order, gets a virtual finish time: the
tokens its source has served up to and including it, divided by the source's
target. Sources with larger targets advance more slowly and so are served more
often. All documents are then range-sorted by finish time, and the order is cut
where the total budget is spent. A source whose target exceeds its size starts
over; the second and third pass are further entries of the same queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import materialize

MAX_REPEATS = 3
_BUCKET_ROWS = 1000
_BUCKETS_PER_GROUP = 256

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. They share
    the sum of all sizes by weight; no target passes ``repeats`` times its
    source's size, the excess goes to the others by weight until none is above.
    A target is ``min(cap, level * weight)``; the level is found by raising it
    until the set of capped sources no longer grows, one small job a round.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    # one row per source; the window orders that table only
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    table = materialize(
        totals.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * repeats)
    )
    level, held = 0.0, -1
    while True:
        over = (F.col("cap") / F.col("weight") <= level) if held >= 0 else F.lit(False)
        row = table.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("capped"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.sum(F.when(over, 1).otherwise(0)).alias("count"),
        ).first()
        if not row["total"] or not row["free"] or row["count"] == held:
            break
        held, level = row["count"], (row["total"] - row["capped"]) / row["free"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def _served_before(docs: DataFrame, buckets: int) -> DataFrame:
    """Add ``served``: tokens of the source up to and including each row, in shuffled order.

    Rows fall into buckets of about a thousand by hash, buckets into groups of
    256; each level needs only the sums of the one below, so no window ever sees
    a whole source.
    """
    keyed = docs.withColumn("_bucket", F.pmod("_shuffle", F.lit(buckets)))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_group", F.floor(F.col("_bucket") / _BUCKETS_PER_GROUP))

    def earlier(*keys: str, by: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_sum").over(window), F.lit(0))

    groups = sums.groupBy("source", "_group").agg(F.sum("_sum").alias("_sum"))
    groups = groups.select("source", "_group", earlier("source", by="_group").alias("_before_group"))
    inside = sums.withColumn("_before", earlier("source", "_group", by="_bucket"))
    same = inside["source"].eqNullSafe(groups["source"]) & (inside["_group"] == groups["_group"])
    offsets = inside.join(groups, same).select(
        inside["source"].alias("_source"),
        F.col("_bucket").alias("_at"),
        (F.col("_before") + F.col("_before_group")).alias("_offset"),
    )
    running = Window.partitionBy("source", "_bucket").orderBy("_shuffle", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    ranked = keyed.withColumn("_inside", F.sum("size").over(running))
    match = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_at"))
    return ranked.join(offsets, match).withColumn("served", F.col("_offset") + F.col("_inside")).drop(
        "_source", "_at", "_offset", "_inside", "_bucket"
    )


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for rows of ``doc_id, text, source``.

    ``taken`` is ``size`` times the passes of the document inside the budget, the
    sum of all sizes. A null source is a source of its own, a null or empty text
    has size 0 and is never taken, repeated rows queue one by one (which of equal
    rows comes first makes no difference to the result), an empty table gives an
    empty result. Other columns are dropped. Every run gives the same rows.
    """
    narrow = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("_row"))
    narrow = materialize(narrow.withColumn("_shuffle", F.xxhash64("doc_id", "_row")))
    targets = source_targets(narrow, weights, repeats)
    buckets = max(1, -(-narrow.count() // _BUCKET_ROWS))
    rows = _served_before(narrow, buckets).alias("d").join(
        targets.withColumnRenamed("source", "_named"), F.col("source").eqNullSafe(F.col("_named"))
    )
    queue = materialize(rows.drop("_named"))

    def finish(turn: Column) -> Column:
        return (turn * F.col("source_size") + F.col("served")) / F.nullif(F.col("target"), F.lit(0.0))

    entries = (
        queue.where("size > 0")
        .withColumn("turn", F.explode(F.array(*map(F.lit, range(repeats)))))
        .select(finish(F.col("turn")).alias("finish"), F.col("_shuffle").alias("tie"), "doc_id", "_row", "turn", "size")
        .where("finish is not null")
    )
    key = ["finish", "tie", "doc_id", "_row", "turn"]
    ranged = materialize(entries.repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    cut = _cut(ranged, key)
    if cut is None:
        passes = F.lit(0)
    else:
        last = F.struct(*[F.lit(cut[c]).cast(t).alias(c) for c, t in ranged.select(*key).dtypes])
        turns = [
            F.struct(finish(F.lit(t)).alias("finish"), F.col("_shuffle").alias("tie"), "doc_id", "_row", F.lit(t).alias("turn"))
            for t in range(repeats)
        ]
        passes = sum((F.coalesce((t <= last).cast("int"), F.lit(0)) for t in turns), F.lit(0))
    taken = F.when(F.col("size") > 0, F.col("size") * passes).otherwise(0).cast("long")
    return queue.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "_row")


def _cut(ranged: DataFrame, key: list[str]):
    """The last entry inside the budget, or None for an empty queue.

    The driver sees one sum per partition of the sort, and only the partition
    where the budget runs out is summed row by row.
    """
    total = ranged.where("turn = 0").agg(F.sum("size")).first()[0]
    if total is None:
        return None
    left, chosen = total, None
    for part, size in sorted(map(tuple, ranged.groupBy("part").agg(F.sum("size")).collect())):
        chosen = part
        if size > left:
            break
        left -= size
    else:
        return ranged.agg(F.max(F.struct(*key)).alias("top")).first()["top"]
    running = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.where(F.col("part") == chosen).withColumn("spent", F.sum("size").over(running))
    before = ranged.where(F.col("part") < chosen)
    top = inside.where(F.col("spent") <= left).select(F.struct(*key).alias("e")).unionAll(
        before.select(F.struct(*key).alias("e"))
    )
    return top.agg(F.max("e").alias("top")).first()["top"]


def mixture(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of the mix: every document as often as the mix takes it, with all its columns.

    Rows that agree in ``doc_id, source, text`` share their passes and appear as the first of them.
    """
    passes = (
        mix(docs, weights=weights, repeats=repeats)
        .where("taken > 0")
        .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), "_row")
        .agg(F.sum(F.expr("taken div size")).cast("int").alias("_passes"))
    )
    rows = docs.withColumn("_tag", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(passes["_id"]) & rows["source"].eqNullSafe(passes["_from"]) & (rows["_tag"] == passes["_row"])
    joined = rows.dropDuplicates(["doc_id", "source", "_tag"]).join(passes, same)
    return joined.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_passes")))).select(*docs.columns)
