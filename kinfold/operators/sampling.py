"""Contiguous class ids and m-per-class batches: one pass over the classes, or random draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.joins import hot_key_lookup
from kinfold.operators.ranking import hash_order, rank_by_hash, rank_by_value
from kinfold.session import materialize


def class_ids(*splits: DataFrame, label_col: str = "label_group") -> DataFrame:
    """``label, class_id``: 0-based position of each numeric label in label order, over all splits."""
    labels = splits[0].select(label_col)
    for other in splits[1:]:
        labels = labels.unionByName(other.select(label_col))
    distinct = labels.where(F.col(label_col).isNotNull()).distinct()
    ranked = rank_by_value(distinct, label_col, name="class_id")
    return ranked.select(label_col, (F.col("class_id") - 1).alias("class_id"))


def m_per_class_sample(
    rows: DataFrame,
    *,
    m: int = 4,
    batch_size: int = 256,
    seed: int = 42,
    epoch: int = 1,
    id_col: str = "posting_id",
    label_col: str = "label_group",
) -> DataFrame:
    """One epoch of batches: every class once with ``m`` rows, ``batch_size / m`` classes a batch.

    Adds ``step`` (0-based batch) and ``slot`` (0 to m - 1). Rows and classes come
    in md5 order of seed and epoch; a class with fewer than m rows repeats them.
    Spark keeps only the first m rows per class before the shuffle, so a class of
    any size is cheap, and classes are ranked without a global sort.
    """
    if batch_size % m:
        raise ValueError("batch_size must be a multiple of m")
    known = rows.where(F.col(label_col).isNotNull()).withColumn(
        "_order", hash_order(f"{seed}:{epoch}", id_col)
    )
    drawn = Window.partitionBy(label_col).orderBy("_order")
    kept = known.withColumn("_at", F.row_number().over(drawn)).where(F.col("_at") <= m)
    size = F.count("*").over(Window.partitionBy(label_col))
    slots = F.filter(
        F.sequence(F.lit(0), F.lit(m - 1)), lambda s: s % F.col("_size") == F.col("_at") - 1
    )
    sample = kept.withColumn("_size", size.cast("int")).withColumn("slot", F.explode(slots))
    classes = (
        rows.where(F.col(label_col).isNotNull())
        .select(label_col)
        .distinct()
        .withColumn("_order", hash_order(f"{seed}:{epoch}", label_col))
    )
    steps = rank_by_hash(classes, "_order", name="_rank").select(
        label_col, F.floor((F.col("_rank") - 1) / (batch_size // m)).cast("int").alias("step")
    )
    return sample.join(steps, label_col).select(*rows.columns, "step", "slot")


# Fixed value: rows drawn in an epoch of random batches, whatever the size of the data.
EPOCH_ROWS = 100_000
# Candidates for each thing drawn; enough of them differ but for a chance below 1e-15.
_CLASS_DRAWS, _ROW_DRAWS = 4, 8


def draw(size: Column, *parts: Column) -> Column:
    """A position below ``size`` from the md5 of the parts: counter-based, so any task can draw it alone."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % size


def _distinct_draws(slots: DataFrame, keys: Sequence[str], size: str, wanted: int, draws: int, seed: Sequence) -> DataFrame:
    """For each row of ``slots`` the first ``wanted`` different positions below its ``size``, as ``_slot, _pos``.

    Small ranges (up to ``draws * wanted``) are put in md5 order; from larger ones
    positions are drawn and repeats passed over, so no range is ever written out.
    """
    constants = [F.lit(x) for x in seed]
    named = [F.col(k) for k in keys]
    small = F.col(size) <= draws * wanted
    tries = F.when(small, F.col(size)).otherwise(F.lit(draws * wanted)).cast("int")
    # nothing is exploded for more than draws * wanted candidates a slot
    tried = slots.withColumn("_try", F.explode(F.sequence(F.lit(0), tries - 1)))
    text = F.concat_ws(":", *[p.cast("string") for p in (*constants, *named, F.col("_try"))])
    key = F.md5(text)
    pos = F.when(small, F.col("_try").cast("long")).otherwise(draw(F.col(size), *constants, *named, F.col("_try")))
    # in md5 order for small ranges, in order of the draws for large ones
    order = F.when(small, key).otherwise(F.lpad(F.col("_try").cast("string"), 12, "0"))
    first = tried.select(*keys, size, pos.alias("_pos"), order.alias("_order")).groupBy(*keys, size, "_pos").agg(F.min("_order").alias("_order"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))
    return first.withColumn("_slot", place - 1).where(F.col("_slot") < wanted).drop("_order")


def random_batches(
    rows: DataFrame,
    *,
    m: int = 4,
    batch_size: int = 256,
    batches: int | None = None,
    seed: int = 42,
    epoch: int = 1,
    id_col: str = "posting_id",
    label_col: str = "label_group",
    ranked: DataFrame | None = None,
) -> DataFrame:
    """An epoch of random batches: each draws ``batch_size / m`` classes anew and ``m`` rows of each.

    Classes differ within a batch and rows within a class, but a class of fewer than
    ``m`` rows is drawn from with replacement; the next batch draws from all classes
    again. ``batches`` defaults to ``EPOCH_ROWS`` worth of them. Adds ``step`` (0-based
    batch) and ``slot`` (0 to m - 1). Rows without a label are not drawn; with fewer
    classes than a batch holds every batch has all of them.

    Every draw is the md5 of seed, epoch, batch and counter, so an epoch is the same
    on any partitioning. Draws meet classes and rows by position, in joins without
    hot keys; ``ranked`` (see ``ranked_rows``) saves ranking the rows for every epoch.
    """
    if batch_size % m:
        raise ValueError("batch_size must be a multiple of m")
    table = ranked_rows(rows, seed=seed, id_col=id_col, label_col=label_col) if ranked is None else ranked
    classes = table.where("_at = 0").select("_class", F.col("_size").alias("_rows"))
    n_classes = classes.count()
    if not n_classes:
        return rows.limit(0).withColumns({"step": F.lit(0), "slot": F.lit(0)})
    steps = EPOCH_ROWS // batch_size if batches is None else batches
    spark = rows.sparkSession
    slots = spark.range(steps).select(F.col("id").cast("int").alias("step"), F.lit(n_classes).cast("long").alias("_n"))
    chosen = _distinct_draws(slots, ["step"], "_n", batch_size // m, _CLASS_DRAWS, (seed, epoch, "class"))
    held = chosen.select("step", F.col("_pos").alias("_class")).join(classes, "_class")
    large = held.where(F.col("_rows") >= m)
    within = _distinct_draws(large, ["step", "_class"], "_rows", m, _ROW_DRAWS, (seed, epoch, "row"))
    again = held.where(F.col("_rows") < m).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    again = again.withColumn(
        "_pos", draw(F.col("_rows"), F.lit(seed), F.lit(epoch), F.lit("again"), F.col("step"), F.col("_class"), F.col("_slot"))
    )
    columns = ["step", "_class", "_pos", "_slot"]
    drawn = within.select(*columns).unionByName(again.select(*columns))
    met = drawn.join(table, (drawn["_class"] == table["_class"]) & (drawn["_pos"] == table["_at"]))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], "step", F.col("_slot").cast("int").alias("slot"))


def ranked_rows(
    rows: DataFrame, *, seed: int = 42, id_col: str = "posting_id", label_col: str = "label_group"
) -> DataFrame:
    """Rows with ``_class`` (0-based, in label order), ``_at`` (place in the class, in md5 order) and ``_size``.

    Written once; a class of any size is ranked from bucket counts.
    """
    known = rows.where(F.col(label_col).isNotNull())
    ids = class_ids(known, label_col=label_col).select(
        F.col(label_col).alias("_label"), F.col("class_id").alias("_class")
    )
    sizes = known.groupBy(F.col(label_col).alias("_label")).agg(F.count("*").alias("_size"))
    lookup = ids.join(sizes, "_label").withColumn("_weight", F.col("_size"))
    placed = rank_by_hash(known.withColumn("_order", hash_order(seed, id_col)), "_order", within=[label_col], name="_at")
    placed = placed.withColumns({"_at": F.col("_at") - 1, "_label": F.col(label_col)}).drop("_order")
    looked = hot_key_lookup(placed, lookup, "_label", weight="_weight", spread_by=id_col)
    return materialize(looked.drop("_label"))
