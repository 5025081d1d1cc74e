"""Approximate neighbours from a stored inverted-list index with residual codes.

Coarse centroids part the vectors into lists. An entry keeps its list, its id and
what is left after the centroid as one signed byte a component with one scale, a
quarter of the vector's size. The index is a table: built once, stored, and searched
by any number of query tables.

A search sends every query to its nearest lists only (``probes`` of them), scores the
entries there from their codes, keeps the best few times k of each query and scores
these again with the original vectors. How many lists are needed for a wanted recall
is measured on a sample of rows against the exact answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.vectors import dot
from kinfold.operators import neighbors as nb
from kinfold.operators.neighbors import SIM_DECIMALS
from kinfold.session import materialize

CENTROID_BYTES = 32 << 20  # centroids travel to every task
LIST_ROWS = 4096
ROUNDS = 4
REFINE = 4
_LEVELS = 127
_TILE = 1024
_SCORE_BYTES = 16 << 20  # of the scores of a tile, in double precision
_GROUP_ROWS = 32_768  # entries of a list, and queries sent to it, that meet in one task
SAMPLE = 256


@dataclass(frozen=True)
class VectorIndex:
    """Centroids, and ``list, id, code, scale`` of every indexed vector."""

    centroids: np.ndarray
    entries: DataFrame

    def save(self, path: str) -> None:
        """Write centroids and entries below ``path``; entries lie sorted by list, so a search reads its lists only."""
        spark = self.entries.sparkSession
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>").write.parquet(f"{path}/centroids")
        self.entries.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(f"{path}/entries")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most CENTROID_BYTES
        return VectorIndex(np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/entries"))


def _vectors(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a finite vector, and these vectors in double precision."""
    lists = part[column]
    usable = np.asarray(lists.is_valid())
    flat = lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(int(usable.sum()), -1) if usable.any() else np.zeros((0, 0))
    finite = np.isfinite(vectors).all(axis=1) if len(vectors) else np.zeros(0, bool)
    usable = usable.copy()
    usable[usable] = finite
    return usable, vectors[finite]


def nearest_lists(centroids: np.ndarray, vectors: np.ndarray, count: int = 1) -> np.ndarray:
    """The ``count`` lists nearest to each vector by distance, nearest first, ties to the smaller list."""
    half = 0.5 * np.einsum("ij,ij->i", centroids, centroids)
    far = np.round(half - vectors @ centroids.T, 9)
    return np.argsort(far, axis=1, kind="stable")[:, :count]


def fit_centroids(vectors: DataFrame, lists: int, *, vec_col: str = "embedding", id_col: str = "posting_id", rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds over all rows: tasks send sums a list, the driver keeps the centroids.

    The start is the first rows by a hash of the id. A list that loses all rows keeps its centroid.
    """
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    start = rows.orderBy(F.xxhash64(F.lit("centroid"), "id"), "id").limit(lists).select("v").toArrow()
    batches = start.combine_chunks().to_batches()
    if not batches:
        raise ValueError("no vectors to fit centroids on")
    centroids = np.unique(_vectors(batches[0], "v")[1], axis=0)
    if not len(centroids):
        raise ValueError("no finite vectors to fit centroids on")
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most CENTROID_BYTES

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            sums, counts = np.zeros_like(known), np.zeros(len(known), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, _TILE):
                    _, own = _vectors(batch.slice(at, _TILE), "v")
                    if len(own):
                        place = nearest_lists(known, own)[:, 0]
                        np.add.at(sums, place, own)
                        counts += np.bincount(place, minlength=len(known))
            held = np.flatnonzero(counts)
            packed = pa.array([sums[i].tobytes() for i in held], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(held), packed, pa.array(counts[held])], ["list", "sums", "n"])

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float64) for x in table["sums"].to_pylist())
            n = sum(table["n"].to_pylist())
            return pa.table({"list": [key[0].as_py()], "sums": pa.array([total.tobytes()], pa.binary()), "n": [n]})

        schema = "list long, sums binary, n long"
        found = rows.select("v").mapInArrow(add, schema).groupBy("list").applyInArrow(merge, schema)
        centroids = centroids.copy()
        for r in found.collect():  # a row a list
            centroids[r["list"]] = np.frombuffer(r["sums"], np.float64) / r["n"]
    return centroids


def encode(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One signed byte a component, and the scale that turns it back."""
    scale = np.abs(residual).max(axis=1, initial=0) / _LEVELS
    code = np.rint(residual / np.maximum(scale, 1e-300)[:, None])
    return code.astype(np.int8), scale


def build_index(
    vectors: DataFrame,
    *,
    lists: int | None = None,
    centroids: np.ndarray | None = None,
    rounds: int = ROUNDS,
    id_col: str = "posting_id",
    vec_col: str = "embedding",
) -> VectorIndex:
    """Index every row with a finite vector; null and odd vectors are left out.

    Without ``centroids`` they are fitted on all rows, about one for ``LIST_ROWS``
    rows and the square root of their number at least, as far as ``CENTROID_BYTES``
    allow; longer lists are searched in several tasks.
    """
    rows = vectors.where(F.col(vec_col).isNotNull())
    if centroids is None:
        n, dim = nb._shape(rows, vec_col)
        wanted = lists or max(1, n // LIST_ROWS, int(n**0.5))
        centroids = fit_centroids(
            rows, min(wanted, max(1, CENTROID_BYTES // (8 * dim))), vec_col=vec_col, id_col=id_col, rounds=rounds
        )
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = rows.schema[id_col].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _TILE):
                part = batch.slice(at, _TILE)
                usable, own = _vectors(part, "v")
                if not len(own):
                    continue
                place = nearest_lists(known, own)[:, 0]
                codes, scale = encode(own - known[place])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place.astype(np.int32)), part["id"].filter(pa.array(usable)),
                        pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale),
                    ],
                    ["list", "id", "code", "scale"],
                )

    plain = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    entries = materialize(plain.mapInArrow(code, f"list int, id {kind}, code binary, scale double"))
    return VectorIndex(centroids, entries)


def _score_lists(keep: int, centroids) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not table.num_rows:
            return
        asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        asked, held = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if not asked.num_rows or not held.num_rows:
            return
        centre = centroids.value[table["list"][0].as_py()]
        codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.int8).reshape(held.num_rows, -1).astype(np.float32)
        scale = held["scale"].to_numpy()
        queries = asked["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(asked.num_rows, -1)
        ids, names = asked["id"].combine_chunks(), held["id"].combine_chunks()
        width = min(keep, held.num_rows)
        # the scores of a tile of queries stay within _SCORE_BYTES, however many entries meet them
        tile = max(1, min(_TILE, _SCORE_BYTES // (8 * held.num_rows)))
        for at in range(0, asked.num_rows, tile):
            own = queries[at : at + tile]
            rough = (own.astype(np.float32) @ codes.T) * scale + (own @ centre)[:, None]
            best = np.argpartition(-rough, width - 1, axis=1)[:, :width] if width < rough.shape[1] else np.broadcast_to(np.arange(width), rough.shape)
            row = np.repeat(np.arange(at, at + len(own)), width)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(rough, best, axis=1).ravel().astype(np.float64))],
                ["query_id", "neighbor_id", "rough"],
            )

    return score


def search(
    index: VectorIndex,
    queries: DataFrame,
    vectors: DataFrame,
    *,
    k: int = 50,
    probes: int = 8,
    refine: int = REFINE,
    id_col: str = "posting_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, neighbor_id, sim``: the best ``k`` by inner product among the ``probes`` nearest lists.

    ``vectors`` holds the indexed originals, which score the ``refine * k`` best by
    code again. A list and the queries sent to it meet in groups of bounded size,
    however long the list or popular with the queries. Ids should be unique.
    """
    spark = index.entries.sparkSession
    centroids = spark.sparkContext.broadcast(index.centroids)
    kind = queries.schema[id_col].dataType.simpleString()
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TILE):
                part = batch.slice(at, _TILE)
                usable, own = _vectors(part, "vec")
                if not len(own):
                    continue
                near = nearest_lists(centroids.value, own, probes).astype(np.int32)
                ends = pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32))
                kept = part.filter(pa.array(usable))
                yield pa.RecordBatch.from_arrays([kept["id"], kept["vec"], pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], ["id", "vec", "near"])

    routed = materialize(asked.mapInArrow(probe, f"id {kind}, vec array<double>, near array<int>"))
    visits = routed.select(F.explode("near").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / _GROUP_ROWS).cast("int").alias("slices"))
    sizes = index.entries.groupBy("list").agg(F.ceil(F.count("*") / _GROUP_ROWS).cast("int").alias("chunks"))
    plan = F.broadcast(materialize(visits.join(sizes, "list")))  # a row a list
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    columns = ["list", "id", "vec", "code", "scale", "chunk", "slice", "asks"]
    asking = routed.select("id", "vec", F.explode("near").alias("list")).join(plan, "list").select(
        "*", spread("chunks").alias("chunk"), mine("slices").alias("slice"),
        F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("scale"), F.lit(True).alias("asks"),
    )
    held = index.entries.join(plan, "list").select(
        "*", mine("chunks").alias("chunk"), spread("slices").alias("slice"),
        F.lit(None).cast("array<double>").alias("vec"), F.lit(False).alias("asks"),
    )
    met = asking.select(*columns).unionByName(held.select(*columns))
    rough = met.groupBy("list", "chunk", "slice").applyInArrow(
        _score_lists(refine * k, centroids), f"query_id {kind}, neighbor_id {kind}, rough double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("rough"), "neighbor_id")
    drawn = rough.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= refine * k).drop("_place")
    originals = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("neighbor_id"), F.col(vec_col).alias("_b"))
    again = drawn.join(originals, "neighbor_id").join(routed.select(F.col("id").alias("query_id"), F.col("vec").alias("_a")), "query_id")
    product = F.round(dot(F.col("_a"), F.col("_b")), SIM_DECIMALS) + F.lit(0.0)
    return nb._ranked(again.select("query_id", F.lit(0).alias("rank"), "neighbor_id", product.alias("sim")), k)


def exact_best(queries: DataFrame, vectors: DataFrame, *, k: int, id_col: str = "posting_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, neighbor_id`` of the exact best ``k`` for a small set of queries against all rows."""
    found = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).toArrow()
    kind = vectors.schema[id_col].dataType.simpleString()
    batches = found.combine_chunks().to_batches()
    if not batches:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, neighbor_id {kind}")
    usable, own = _vectors(batches[0], "v")
    names = batches[0]["id"].filter(pa.array(usable))
    shared = vectors.sparkSession.sparkContext.broadcast((names, own))  # a sample of bounded size

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _TILE * 8):
                part = batch.slice(at, _TILE * 8)
                ok, held = _vectors(part, "v")
                if not len(held):
                    continue
                sims = np.round(asked @ held.T, SIM_DECIMALS)
                width = min(k, sims.shape[1])
                kth = np.partition(sims, sims.shape[1] - width, axis=1)[:, sims.shape[1] - width]
                row, col = np.nonzero(sims >= kth[:, None])  # all ties stay
                other = part["id"].filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), other.take(pa.array(col)), pa.array(sims[row, col])], ["query_id", "neighbor_id", "sim"])

    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    met = rows.mapInArrow(meet, f"query_id {kind}, neighbor_id {kind}, sim double")
    return nb._ranked(met.withColumn("rank", F.lit(0)), k).select("query_id", "neighbor_id")


def measured_recall(
    index: VectorIndex,
    vectors: DataFrame,
    *,
    k: int = 50,
    probes: int = 8,
    refine: int = REFINE,
    sample: int = SAMPLE,
    id_col: str = "posting_id",
    vec_col: str = "embedding",
) -> float:
    """Share of the exact best ``k`` that a search finds, over the first ``sample`` rows by a hash of the id."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
    asked = materialize(rows.orderBy(F.xxhash64(F.lit("recall"), id_col), id_col).limit(sample))
    columns = {"id_col": id_col, "vec_col": vec_col}
    exact = materialize(exact_best(asked, rows, k=k, **columns))
    found = search(index, asked, rows, k=k, probes=probes, refine=refine, **columns)
    wanted = exact.count()
    hit = found.join(exact, ["query_id", "neighbor_id"], "left_semi").count()
    return hit / wanted if wanted else 1.0


def probes_for(index: VectorIndex, vectors: DataFrame, *, recall: float = 0.9, k: int = 50, **options) -> tuple[int, float]:
    """The fewest lists, doubling from one, whose measured recall reaches ``recall``; all of them at the most."""
    probes = 1
    while True:
        got = measured_recall(index, vectors, k=k, probes=probes, **options)
        if got >= recall or probes >= len(index.centroids):
            return probes, got
        probes = min(2 * probes, len(index.centroids))
