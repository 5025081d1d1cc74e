"""Vectorised work on the bytes of many texts at once, for use inside Arrow tasks.

A task receives Arrow batches. ``blocks`` cuts them into runs of whole texts of
about a megabyte, joined by line feeds, so that NumPy works on a few large arrays
instead of many small ones and memory is bounded by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 20
_POWERS = BLOCK_BYTES + (1 << 16)  # a block and some overlap; 17 MB for each of the two seeds kept


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Session settings: Arrow batches cut by bytes, so long texts cost no more memory than
    short ones, and shuffle files that go when the execution that wrote them ends."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def releasing(work):
    """For the generator of a task: when it ends, memory it no longer uses goes back to the system.

    Python workers live on after their tasks, several beside each executor, and would
    keep the most they ever needed.
    """

    @wraps(work)
    def run(*args, **kwargs):
        try:
            yield from work(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented Latin-1 capitals; lengths stay."""
    low = LOWER[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[capital] += 32
    return low


class Block:
    """Whole texts: their bytes joined by line feeds, and where each begins and ends."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first = first  # row of the first text in its batch
        self.texts = texts
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
        self.ends = self.starts + lengths
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)

    def __len__(self) -> int:
        return len(self.texts)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text that holds each position."""
        return np.searchsorted(self.starts, positions, "right") - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes of each text."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.ends] - total[self.starts]


def to_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive runs of whole texts, each within the limit or a single text."""
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64) + 1
    total = np.cumsum(sizes)
    first = 0
    while first < len(column):
        after = max(first + 1, int(np.searchsorted(total, total[first] - sizes[first] + limit, "right")))
        yield Block(first, to_bytes(column.slice(first, after - first)))
        first = after


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(8)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 0x5851F42D4C957F2D))


@lru_cache(2)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses."""
    inverse = pow(base, -1, 1 << 64)
    up, down = (np.full(size, x, np.uint64) for x in (base, inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """64-bit hashes of any spans of one byte array, from one pass of prefix sums.

    The power tables of up to a block's size are kept between arrays.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        size = len(data) + 1
        base = _BASE + 4 * seed * 0x1234567 & _MASK | 1
        up, down = _powers(_POWERS, base) if size <= _POWERS else _powers.__wrapped__(size, base)
        self.down = down[:size]
        self.prefix = np.zeros(size, np.uint64)
        np.cumsum(_byte_values(seed)[data] * up[: size - 1], out=self.prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])


def word_spans(data: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not in ``gaps``.

    Blocks end every text with a line feed, so no run crosses texts as long as
    the line feed is a gap.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~gaps[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + words[k : k + count]
    return mix(total)
