"""Batch encoding of texts and images into unit vectors.

An encoder is any callable from a list of inputs to a 2-d array. It is built by a
factory, once per task, so a heavy model loads on the executor and is reused for
every batch of the task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import SLANG_PHRASES, as_text, clean_text
from kinfold.functions.vectors import lists_of, unit_rows
from kinfold.session import spread

TextEncoder = Callable[[list[str]], np.ndarray]
ImageEncoder = Callable[[list[np.ndarray]], np.ndarray]

# Words an encoder remembers before it starts afresh.
_KNOWN_WORDS = 1 << 16


class HashedWords:
    """Signed feature hashing of lower-cased words: no model, same answer everywhere.

    A word adds +1 or -1 to one component, both read from its md5.
    """

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim
        self._known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self._known) > _KNOWN_WORDS:
            self._known.clear()
        words = [re.findall(r"\w+", text.lower()) for text in texts]
        for w in set().union(*words).difference(self._known):
            code = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            # the components that go up come first, then those that go down
            self._known[w] = code % self.dim + (code // self.dim % 2) * self.dim
        lengths = [len(w) for w in words]
        places = np.fromiter(map(self._known.__getitem__, chain.from_iterable(words)), np.int64, sum(lengths))
        row = np.repeat(np.arange(len(texts)), lengths)
        counts = np.bincount(row * (2 * self.dim) + places, minlength=len(texts) * 2 * self.dim)
        counts = counts.reshape(len(texts), 2, self.dim)
        return (counts[:, 0] - counts[:, 1]).astype(np.float64)


class ColorLayout:
    """Per-channel colour histogram and the mean colour of each cell of a coarse grid."""

    def __init__(self, bins: int = 8, grid: int = 4) -> None:
        self.bins, self.grid = bins, grid

    def __call__(self, images: list[np.ndarray]) -> np.ndarray:
        return np.stack([self._one(image) for image in images])

    def _one(self, image: np.ndarray) -> np.ndarray:
        height, width, channels = image.shape
        level = image.astype(np.int64) * self.bins // 256
        histogram = np.stack(
            [np.bincount(level[..., c].ravel(), minlength=self.bins) for c in range(channels)]
        ) / (height * width)
        down = np.minimum(np.arange(height) * self.grid // height, self.grid - 1)
        across = np.minimum(np.arange(width) * self.grid // width, self.grid - 1)
        cell = (down[:, None] * self.grid + across[None, :]).ravel()
        count = np.maximum(np.bincount(cell, minlength=self.grid**2), 1)
        means = [
            np.bincount(cell, image[..., c].ravel(), minlength=self.grid**2) / count / 255
            for c in range(channels)
        ]
        return np.concatenate([histogram.ravel(), np.concatenate(means)])


def encode_texts(
    rows: DataFrame,
    encoder_factory: Callable[[], TextEncoder] = HashedWords,
    *,
    text_col: str = "title",
    id_col: str = "posting_id",
    batch_size: int = 128,
    clean: bool = True,
    phrases: Sequence[str] = SLANG_PHRASES,
) -> DataFrame:
    """``id, embedding`` of the cleaned texts, unit length. Cleaning stays in the JVM."""
    text = as_text(F.col(text_col))
    texts = spread(rows.select(id_col, text.alias("_text")))
    source = texts.withColumn("_text", clean_text(F.col("_text"), phrases)) if clean else texts
    return _encode(
        source, encoder_factory, id_col, batch_size, lambda column: column.to_pylist()
    )


def encode_images(
    images: DataFrame,
    encoder_factory: Callable[[], ImageEncoder] = ColorLayout,
    *,
    id_col: str = "posting_id",
    image_col: str = "image",
    batch_size: int = 64,
) -> DataFrame:
    """``id, embedding`` of decoded images (Spark's image struct), unit length.

    Channels reach the encoder as RGB. A task holds one Arrow batch, which Spark
    bounds by ``spark.sql.execution.arrow.maxBytesPerBatch`` as well as by rows.
    """
    return _encode(
        images.select(id_col, F.col(image_col).alias("_image")),
        encoder_factory,
        id_col,
        batch_size,
        lambda column: [rgb_array(image) for image in column.to_pylist()],
    )


def rgb_array(image: dict) -> np.ndarray:
    """Height x width x 3 bytes from an image struct in grey, BGR or BGRA."""
    channels = image["nChannels"]
    pixels = np.frombuffer(image["data"], dtype=np.uint8)
    pixels = pixels.reshape(image["height"], image["width"], channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., 2::-1]


def _encode(source, encoder_factory, id_col, batch_size, inputs_of) -> DataFrame:
    kind = dict(source.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_factory()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                batch = whole.slice(start, batch_size)
                vectors = unit_rows(np.asarray(encoder(inputs_of(batch.column(1))), dtype=np.float64))
                valid = np.ones(batch.num_rows, dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists_of(vectors, valid, pa.float32())],
                    names=[id_col, "embedding"],
                )

    return source.mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")
