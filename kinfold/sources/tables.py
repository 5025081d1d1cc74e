"""Product, embedding and result tables: explicit schemas, readers and writers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.session import materialize

PRODUCT_SCHEMA = T.StructType(
    [
        T.StructField("posting_id", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("label_group", T.LongType()),
    ]
)
AUGMENTED_SCHEMA = T.StructType(
    [
        *PRODUCT_SCHEMA.fields,
        T.StructField("multiples_score", T.DoubleType()),
        T.StructField("indonesian_score", T.DoubleType()),
    ]
)
ASSIGNMENT_SCHEMA = T.StructType(
    [
        *AUGMENTED_SCHEMA.fields,
        T.StructField("split", T.StringType()),
        T.StructField("stratum", T.StringType()),
    ]
)
RESULT_SCHEMA = T.StructType(
    [
        *PRODUCT_SCHEMA.fields,
        T.StructField("stratum", T.StringType()),
        T.StructField("retrieved_products", T.StringType()),
    ]
)
RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PRODUCT_SCHEMA,
    *,
    multi_line: bool = True,
    split: bool = True,
) -> DataFrame:
    """CSV with a header and quoted text; columns are matched by name and none is inferred.

    ``multi_line`` allows line breaks inside quotes. Such files are read in as many
    tasks as any others: see ``csv_records``; the order of the rows is not kept. With
    ``split=False`` Spark reads them instead, in order and one task a file. A malformed
    row is an error.
    """
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
    read = spark.read.option("header", True).options(**options).option("multiLine", multi_line and not split)
    # Without a schema Spark reads just the header line and types nothing.
    names = read.csv(path).columns
    fields = {f.name: f for f in schema.fields}
    full = T.StructType([fields.get(n, T.StructField(n, T.StringType())) for n in names])
    wanted = [F.col(f"`{n}`") for n in schema.names]
    if not (multi_line and split):
        return read.schema(full).csv(path).select(*wanted)
    parsed = F.from_csv("value", full.simpleString()[len("struct<") : -1].replace(":", " "), options)
    return csv_records(spark, path).select(parsed.alias("r")).select("r.*").select(*wanted)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the records of CSV files with a header line, line breaks inside quotes included.

    Whether a line is inside quotes depends on the number of quotes before it in the
    file. A first pass counts them for each split of the files, and the lines that would
    begin a record if the split began inside or outside quotes; the counts of earlier
    splits tell which it is. The second pass numbers the records. Most are one line and
    go straight through; only the lines of longer ones are grouped.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )

    def runs(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple]:
        """Per batch: its splits in order, each with the rows it has there and the quotes and lines seen before."""
        seen: dict[tuple, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch[c].to_pylist() for c in columns)))
            odd = pc.fill_null(pc.count_substring(batch["value"], '"'), 0).to_numpy().astype(np.int64) % 2
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                state = seen.setdefault(keys[lo], [0, 0, 0])  # quotes' parity, lines, records begun
                before = (state[0] + np.concatenate(([0], np.cumsum(odd[lo:hi])))) % 2
                yield batch, keys[lo], lo, hi, before[:-1], odd[lo:hi], state
                state[0], state[1] = int(before[-1]), state[1] + hi - lo

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for _, key, _, _, before, odd, _ in runs(batches, ("file", "block")):
            sums = found.setdefault(key, [0, 0, 0])
            sums[0] += int(odd.sum())
            sums[1] += int((before == 0).sum())
            sums[2] += int((before == 1).sum())
        rows = [(*key, *sums) for key, sums in found.items()]
        names = ["file", "block", "quotes", "outside", "inside"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(
            [("file", pa.string()), *[(n, pa.int64()) for n in names[1:]]]
        ))

    splits = lines.mapInArrow(survey, "file string, block long, quotes long, outside long, inside long")
    splits = splits.groupBy("file", "block").agg(*[F.sum(c).alias(c) for c in ("quotes", "outside", "inside")])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entering = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    splits = splits.withColumn("_open", entering)
    begun = F.when(F.col("_open") == 0, F.col("outside")).otherwise(F.col("inside"))
    splits = splits.withColumn("_begun", begun).select(
        "file", "block", "_open", F.coalesce(F.sum("_begun").over(earlier), F.lit(0)).alias("_before")
    )
    # one row for each split of the files, and a broadcast leaves the lines in their order
    placed = lines.join(F.broadcast(materialize(splits)), ["file", "block"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, key, lo, hi, before, odd, state in runs(batches, ("file", "block", "_open", "_before")):
            _, block, opened, earlier_records = key
            inside = (before + opened) % 2
            record = earlier_records + state[2] + np.cumsum(inside == 0)
            state[2] += int((inside == 0).sum())
            at = state[1] + np.arange(hi - lo)
            whole = (inside == 0) & (odd == 0)
            keep = ~((block == 0) & (at == 0))  # the header
            yield pa.RecordBatch.from_arrays(
                [batch["value"].slice(lo, hi - lo), batch["file"].slice(lo, hi - lo), batch["block"].slice(lo, hi - lo),
                 pa.array(at), pa.array(record, mask=whole)],
                ["value", "file", "block", "at", "record"],
            ).filter(pa.array(keep))

    numbered = placed.mapInArrow(number, "value string, file string, block long, at long, record long")
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    long_records = numbered.where("record is not null").groupBy("file", "record").agg(parts.alias("p"))
    joined = long_records.select(F.array_join(F.col("p.value"), "\n").alias("value"))
    records = numbered.where("record is null").select("value").unionByName(joined)
    ended = F.regexp_replace("value", "\r$", "")  # of files with lines that end in both characters
    return records.select(ended.alias("value")).where(F.trim("value") != "")


def write_csv(df: DataFrame, path: str, *, header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", header).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_embeddings(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Embedding table ``posting_id, embedding`` as Parquet; the id travels with its vector."""
    df.select("posting_id", "embedding").write.mode(mode).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("posting_id", "embedding")


def write_assignments(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Partitioned by split, so reading one split skips the files of the others."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_by_threshold(grid: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """One folder per threshold of a grid search."""
    grid.write.mode(mode).partitionBy("threshold").parquet(path)


def run_log(
    spark: SparkSession,
    run_id: str,
    run_name: str,
    entries: Mapping[str, object] | Sequence[tuple[int | None, str, object]],
) -> DataFrame:
    """Parameters (a mapping) or metrics (``step, key, value``) of a run as log rows."""
    if isinstance(entries, Mapping):
        entries = [(None, key, value) for key, value in entries.items()]
    rows = [(run_id, run_name, step, key, str(value)) for step, key, value in entries]
    return spark.createDataFrame(rows, RUN_LOG_SCHEMA)


def grid_log(summary: DataFrame, run_id: str, run_name: str = "grid_search") -> DataFrame:
    """A grid summary as log rows: one nested run per threshold."""
    metrics = [c for c in summary.columns if c != "threshold"]
    pairs = F.array(
        F.struct(F.lit("threshold").alias("key"), F.col("threshold").alias("value")),
        *[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in metrics],
    )
    return summary.select(
        F.lit(run_id).alias("run_id"),
        F.concat(F.lit(f"{run_name}/threshold_"), F.col("threshold")).alias("run_name"),
        F.lit(None).cast("long").alias("step"),
        F.inline(pairs),
    ).withColumn("value", F.col("value").cast("string"))


def append_run_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def commit_run_log(log: DataFrame, path: str, part: str) -> None:
    """Write one part of one or more runs to a log table, replacing what these runs wrote as that part before.

    A job that is run again adds no row twice, and one that fails leaves the table as it
    was: Spark swaps the folders of the runs only when every task has succeeded. Other
    runs and parts stay. Read the table with ``read_run_log``.
    """
    rows = log.select(*RUN_LOG_SCHEMA.names).withColumn("part", F.lit(part))
    # a run's log is small: one file each
    rows.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_id", "part"
    ).parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows; a filter on ``run_id`` reads the folders of those runs only."""
    schema = T.StructType([*RUN_LOG_SCHEMA.fields, T.StructField("part", T.StringType())])
    return spark.read.schema(schema).parquet(path).select(*RUN_LOG_SCHEMA.names, "part")
