"""Registered queries: tables written by every sink and read back by its source."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators import metrics as mx
from kinfold.operators.embeddings import select_split
from kinfold.operators.projection import ProjectionHead
from kinfold.registry.fragments import assigned_products, fixed_head, products, table
from kinfold.registry.learning import pictures
from kinfold.registry.retrieval import SQL as RETRIEVAL_SQL
from kinfold.registry.retrieval import _rounded, _with_neighbors
from kinfold.session import ensure_checkpoint_dir
from kinfold.sources import images, matrix, tables
from kinfold.sources.matrix import file_system


def _path(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"


def csv_round_trip(spark, folder):
    """Titles with line breaks, quotes and commas through a CSV file; an empty title reads as null."""
    path = _path(spark)
    rows = products(spark, folder).select(
        F.col("posting_id").cast("string"), "image", "title", F.col("label_group")
    )
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path).select("posting_id", "image", F.md5("title").alias("title_md5"), "label_group")


def json_round_trip(spark, folder):
    path = _path(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    tables.write_json(docs, path)
    back = tables.read_json(spark, path, T.StructType.fromDDL("doc_id long, text string, source string"))
    return back.select("doc_id", F.md5("text").alias("text_md5"), "source")


def embeddings_round_trip(spark, folder):
    path = _path(spark)
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("posting_id"), "embedding")
    tables.write_embeddings(vectors, path)
    return tables.read_embeddings(spark, path).select("posting_id", F.posexplode("embedding").alias("pos", "value")).select(
        "posting_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value")
    )


def threshold_tree_round_trip(spark, folder):
    path = _path(spark)
    rows, found = _with_neighbors(spark, folder, min(mx.THRESHOLDS))
    tables.write_by_threshold(mx.metrics_by_threshold(rows, found), path)
    back = spark.read.parquet(path)
    return _rounded(back.withColumn("threshold", F.col("threshold").cast("double")))


def head_round_trip(spark, folder):
    """A stored head applied to every vector."""
    path = _path(spark)
    fixed_head().to_table(spark).write.parquet(path)
    from kinfold.operators.projection import apply_head

    head = ProjectionHead.from_table(spark.read.parquet(path))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("posting_id"), "embedding")
    return apply_head(vectors, head).select("posting_id", F.posexplode("embedding").alias("pos", "value")).select(
        "posting_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def run_log_round_trip(spark, folder):
    """The grid summary of the table as log rows, appended to a log and read back."""
    path = _path(spark)
    rows, found = _with_neighbors(spark, folder, min(mx.THRESHOLDS))
    summary = _rounded(mx.summarize_grid(mx.metrics_by_threshold(rows, found)))
    tables.append_run_log(tables.grid_log(summary, "registered"), path)
    back = spark.read.schema(tables.RUN_LOG_SCHEMA).parquet(path)
    return back.select("run_id", "run_name", "key", F.round(F.col("value").cast("double"), 9).alias("value"))


def matrix_import(spark, folder):
    """All vectors written as a matrix and its row index; the rows of the test split imported from them."""
    path = _path(spark)
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("posting_id"), "embedding")
    matrix.write_matrix(vectors, path)
    test = select_split(assigned_products(spark, folder), "test").select("posting_id")
    found = matrix.import_embeddings(spark, f"{path}/matrix", f"{path}/index", rows_per_partition=256, ids=test)
    return found.select(
        F.col("posting_id").cast("long").alias("posting_id"), F.posexplode("embedding").alias("pos", "value")
    ).select("posting_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


def image_folder_embeddings(spark, folder):
    """Every vector drawn as a picture file by the tasks, read by the image source and encoded."""
    path = _path(spark)
    rows = pictures(spark, folder).select(
        F.concat(F.col("posting_id").cast("string"), F.lit(".bmp")).alias("name"), F.col("image.data").alias("grey")
    )
    save_pictures(rows, path, side=8)
    products_ = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("posting_id"), F.concat(F.col("vec_id").cast("string"), F.lit(".bmp")).alias("image")
    )
    found = images.encode_image_folder(products_, path)
    return found.select("posting_id", F.posexplode("embedding").alias("pos", "value")).select(
        "posting_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def save_pictures(rows, path: str, *, side: int) -> None:
    """Grey square pictures ``name, grey`` as bitmap files in ``path``, one by one as the rows come."""
    # The header of an uncompressed picture of 24 bits a pixel.
    size = 3 * side * side
    header = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + size, 0, 0, 54, 40, side, side, 1, 24, 0, size, 2835, 2835, 0, 0)
    system, inner = file_system(path)
    system.create_dir(inner, recursive=True)

    def save(batches):
        to, folder = file_system(path)
        for batch in batches:
            for name, grey in zip(batch["name"].to_pylist(), batch["grey"].to_pylist()):
                lines = [grey[i : i + side] for i in range(0, side * side, side)][::-1]  # the last line comes first
                body = b"".join(bytes(x for g in line for x in (g, g, g)) for line in lines)
                with to.open_output_stream(f"{folder}/{name}") as file:
                    file.write(header + body)
            yield pa.RecordBatch.from_arrays([batch["name"]], ["name"])

    rows.mapInArrow(save, "name string").count()


QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip,
        json_round_trip,
        embeddings_round_trip,
        threshold_tree_round_trip,
        head_round_trip,
        run_log_round_trip,
        matrix_import,
        image_folder_embeddings,
    )
}



def _sql() -> dict[str, str]:
    from kinfold.registry.fragments import PRODUCTS
    from kinfold.registry.learning import SQL as LEARNING_SQL

    return {
        "csv_round_trip": f"""WITH {PRODUCTS} SELECT CAST(posting_id AS VARCHAR) AS posting_id, image,
CASE WHEN title <> '' THEN md5(title) END AS title_md5, label_group FROM products""",
        "json_round_trip": "SELECT doc_id, md5(text) AS text_md5, source FROM documents",
        "embeddings_round_trip": """SELECT vec_id AS posting_id, CAST(i - 1 AS INT) AS pos,
round(CAST(embedding[i] AS DOUBLE), 6) AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""",
        "threshold_tree_round_trip": RETRIEVAL_SQL["threshold_rows"],
        "run_log_round_trip": f"""SELECT 'registered' AS run_id,
concat('grid_search/threshold_', t) AS run_name, key, round(value, 9) AS value FROM (
  UNPIVOT (SELECT threshold AS t, CAST(COLUMNS(*) AS DOUBLE) FROM ({RETRIEVAL_SQL["threshold_grid"]}))
  ON COLUMNS(* EXCLUDE (t)) INTO NAME key VALUE value)""",
        "head_round_trip": LEARNING_SQL["projection_apply"],
        "matrix_import": RETRIEVAL_SQL["split_vectors"],
        "image_folder_embeddings": LEARNING_SQL["image_embeddings"],
    }


SQL = _sql()
