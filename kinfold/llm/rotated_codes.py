"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Every vector is turned by one random rotation and kept as the signs of its
components, packed in bits, with two scalars: its length and the cosine between
the signs and the vector. From these the inner product with a query is estimated
without bias, with a known spread; estimate plus or minus a multiple of the spread
bounds the true value. Vectors whose upper bound reaches the k-th best exact value
found so far are ranked again with the original vectors in double precision.

Vectors lie in blocks of bounded size. Every block of queries meets every block of
vectors once, in one task, and gives at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import materialize

NEIGHBOURS = 20
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 4096
SPREADS = 3.5  # the bound lies this many spreads from the estimate
PLANES = 6  # bits of a query component
_QUERY_SLICE = 256


def valid(column: str) -> Column:
    """Vectors that can be compared: not null, not zero, all components finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.size(column) > 0) & ~F.exists(column, odd) & F.exists(column, lambda x: x != 0)


def rotation(size: int, seed: int = 5) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode_block(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and cosines between signs and rotated vectors."""
    size = vectors.shape[1]
    turned = vectors.astype(np.float64) @ rotation(size)
    length = np.linalg.norm(turned, axis=1)
    bits = np.packbits(turned > 0, axis=1)
    padded = np.zeros((len(vectors), -(-size // 64) * 8), np.uint8)
    padded[:, : bits.shape[1]] = bits
    cosine = np.abs(turned).sum(1) / (np.sqrt(size) * length)
    return padded.view(np.uint64), length, cosine


def estimate(codes: np.ndarray, length: np.ndarray, cosine: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of every query with every coded vector, and their spreads.

    A query's rotated components are rounded to ``PLANES`` bits; each plane meets
    the codes by a bitwise and with a population count.
    """
    size = queries.shape[1]
    turned = queries.astype(np.float64) @ rotation(size)
    low, high = turned.min(1), turned.max(1)
    step = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-300)
    levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    dots = np.zeros((len(queries), len(codes)))
    for plane in range(PLANES):
        bits = np.packbits((levels >> plane) & 1, axis=1)
        padded = np.zeros((len(queries), codes.shape[1] * 8), np.uint8)
        padded[:, : bits.shape[1]] = bits
        words = padded.view(np.uint64)
        count = np.zeros(dots.shape, np.uint16)
        for k in range(codes.shape[1]):
            count += np.bitwise_count(words[:, k, None] & codes[None, :, k])
        dots += float(1 << plane) * count
    # sum over the set bits of low + step * level, doubled, less the sum over all components
    signed = 2 * (step[:, None] * dots + low[:, None] * ones) - (step * levels.sum(1) + size * low)[:, None]
    scale = length / (np.sqrt(size) * cosine)
    spread = np.sqrt(
        (np.linalg.norm(turned, axis=1) ** 2)[:, None] * ((1 - cosine**2) / max(1, size - 1))[None, :] / cosine**2
        + (step**2 / 12)[:, None] / cosine[None, :] ** 2
    )
    return signed * scale, spread * length


def search_block(
    query_ids, queries, ids, vectors, codes, length, cosine, k: int, spreads: float = SPREADS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of a block for every query: query rows, vector rows, scores."""
    rows, columns, scores = [], [], []
    wide = vectors.astype(np.float64)
    order = np.argsort(ids, kind="stable")
    for start in range(0, len(queries), _QUERY_SLICE):
        part = queries[start : start + _QUERY_SLICE].astype(np.float64)
        guess, spread = estimate(codes, length, cosine, part)
        own = query_ids[start : start + len(part), None] == ids[None, :]
        guess[own] = -np.inf
        take = min(k, len(ids))
        first = np.argpartition(-guess, take - 1, axis=1)[:, :take]
        exact = np.einsum("qd,qkd->qk", part, wide[first])
        exact[np.take_along_axis(own, first, 1)] = -np.inf
        least = exact.min(1)  # at least k vectors are as good as this
        reach = guess + spreads * spread >= least[:, None] - 1e-9 * (1 + np.abs(least))[:, None]
        for q in range(len(part)):
            chosen = order[(reach[q] & ~own[q])[order]]  # by id, for ties
            score = wide[chosen] @ part[q]
            best = np.argsort(-score, kind="stable")[:k]
            rows.append(np.full(len(best), start + q))
            columns.append(chosen[best])
            scores.append(score[best])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores)


def _blocks(batches: Iterator[pa.RecordBatch], coded: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, size, rows in zip(*(batch[c].to_pylist() for c in ("block", "size", "rows"))):
            ids = np.array([r["id"] for r in rows], np.int64)
            vectors = np.array([r["vector"] for r in rows])
            extra = [x.tobytes() for x in encode_block(vectors)] if coded else [None] * 3
            columns = [[block], [size], [ids.tobytes()], [vectors.astype(np.float64).tobytes()], *([x] for x in extra)]
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["block", "size", "ids", "vectors", "codes", "lengths", "cosines"],
            )


_BLOCK = "block int, size int, ids binary, vectors binary, codes binary, lengths binary, cosines binary"


def _in_blocks(rows: DataFrame, block_rows: int, coded: bool) -> tuple[DataFrame, int]:
    number = max(1, -(-rows.count() // block_rows))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int"))
    # a block holds about block_rows vectors, whatever the size of the table
    grouped = placed.groupBy("block", F.size("vector").alias("size")).agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    return materialize(grouped.mapInArrow(lambda it: _blocks(it, coded), _BLOCK)), number


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    *,
    k: int = NEIGHBOURS,
    spreads: float = SPREADS,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of every query, nearest first.

    Both tables have ``id, vector``. A query does not find its own id. Vectors that
    are null, zero or hold a null or non-finite component, and null ids, take no
    part; of rows that share an id the one with the smallest vector counts; vectors
    of another length than the query's are not compared with it. Equal scores go to
    the smaller id; with fewer than k candidates all are returned.
    """
    def usable(table: DataFrame) -> DataFrame:
        return table.where(F.col("id").isNotNull() & valid("vector")).groupBy("id").agg(F.min("vector").alias("vector"))

    index, parts = _in_blocks(usable(vectors), block_vectors, True)
    asked, asks = _in_blocks(usable(queries), block_queries, False)
    # every pair of blocks is a key of its own, so all pairs spread over the tasks
    left = index.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = asked.select(
        F.col("block").alias("ask"), F.col("size"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"),
    )
    met = left.hint("shuffle_hash").join(right, ["block", "ask", "size"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = row["size"]
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint64).reshape(len(ids), -1)
                q, v, score = search_block(
                    query_ids, np.frombuffer(row["queries"]).reshape(-1, size), ids, np.frombuffer(row["vectors"]).reshape(-1, size),
                    codes, np.frombuffer(row["lengths"]), np.frombuffer(row["cosines"]), k, spreads,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[q]), pa.array(ids[v]), pa.array(score)], ["query_id", "vec_id", "score"]
                )

    columns = ["size", "ids", "vectors", "codes", "lengths", "cosines", "query_ids", "queries"]
    found = met.select(*columns).mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
