"""Image folders as embedding tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.encoding import ColorLayout, ImageEncoder, encode_images


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images under ``folder``: ``filename, image``."""
    loaded = spark.read.format("image").option("dropInvalid", True).load(folder)
    name = F.element_at(F.split("image.origin", "/"), -1)
    return loaded.select(F.url_decode(name).alias("filename"), "image")


def encode_image_folder(
    products: DataFrame,
    folder: str,
    encoder_factory: Callable[[], ImageEncoder] = ColorLayout,
    *,
    image_col: str = "image",
    id_col: str = "posting_id",
    batch_size: int = 64,
    strict: bool = True,
) -> DataFrame:
    """``id, embedding`` of each product's image file.

    Files are encoded where they are read and only their vectors are joined to
    the products, so no pixels are shuffled. With ``strict`` a product whose file
    is missing stops the job.
    """
    images = read_images(products.sparkSession, folder)
    vectors = encode_images(images, encoder_factory, id_col="filename", batch_size=batch_size)
    joined = products.select(id_col, F.col(image_col).alias("filename")).join(
        vectors, "filename", "left" if strict else "inner"
    )
    missing = F.raise_error(F.concat(F.lit("no image file "), F.col("filename")))
    return joined.select(
        id_col,
        F.when(F.col("embedding").isNull(), missing).otherwise(F.col("embedding")).alias("embedding"),
    )
