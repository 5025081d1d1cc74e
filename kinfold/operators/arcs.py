"""Exact neighbours with whole cells left out by the triangle inequality on arcs.

Pivots drawn from the set cut it into cells, each row with its nearest pivot. The
angle between two vectors is a metric, so a query at angle a from a pivot is at
least ``max(a - high, low - a)`` away from every row whose own angle to that pivot
lies between ``low`` and ``high``. With the lengths of a cell's rows this bounds
every inner product the query can have there.

A first pass searches each row's own cell, which gives a floor: the k-th best so
far. A second one sends a query only to the cells whose bound reaches its floor.
Small cells are packed into regions, so that a query travels once to a region and
not to each of its cells; their number follows the cores and a task's memory, not
the cells. Larger cells are cut into chunks and the queries of a region into slices,
all of bounded size, and each chunk meets each slice in one group, in which cells out
of reach and members outside the angles that can reach a query's floor are left out too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import neighbors as nb
from kinfold.operators.neighbors import _matrix, best_pairs, found_batch, pairs_above
from kinfold.session import materialize

# Pivots travel to every task; their bytes are bounded, larger sets get larger cells.
PIVOT_BYTES = 32 << 20
_ANGLE_SLACK = 1e-6  # far above the rounding error of an angle in double precision
_MOST_PARTITIONS = 50_000
_OWN_PARTITIONS = 16  # for each core, of the pass over each row's own cell
_TILE = 256
_QUERY_RUN = 2048


@dataclass(frozen=True)
class Cells:
    """Pivots and what is known of the rows of each: angles to the pivot, lengths, count."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    short: np.ndarray
    long: np.ndarray
    rows: np.ndarray

    def reach(self, angles: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with any row of each cell."""
        gap = np.maximum(np.maximum(angles - self.high, self.low - angles) - _ANGLE_SLACK, 0.0)
        cosine = np.cos(np.minimum(gap, np.pi))
        bound = lengths[:, None] * np.where(cosine >= 0, self.long, self.short) * cosine
        return np.where(self.rows > 0, bound + 1e-9 + 1e-6 * lengths[:, None] * self.long, -np.inf)


def angles_to(pivots: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of each vector to each pivot, and lengths; a zero vector is at angle 0 of all."""
    lengths = np.linalg.norm(vectors, axis=1)
    cosine = (vectors / np.maximum(lengths, 1e-300)[:, None]) @ pivots.T
    angle = np.arccos(np.clip(cosine, -1.0, 1.0))
    angle[lengths == 0] = 0.0
    return angle, lengths


def _pivots(rows: DataFrame, count: int, dim: int) -> np.ndarray:
    """The first rows by a hash of the id, as distinct unit vectors; at most 32 MB of them."""
    most = max(1, min(count, PIVOT_BYTES // (8 * dim)))
    drawn = rows.orderBy(F.xxhash64(F.lit("pivot"), "_id"), "_id").limit(most).select("_vec").toArrow()
    flat = drawn["_vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(-1, dim)
    vectors = vectors[np.isfinite(vectors).all(axis=1)]
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    if not len(vectors):
        return np.eye(1, dim)
    return np.unique(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), axis=0)


def place(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``_cell``, ``_angle`` and ``_length``; rows with odd components are near nothing and go."""
    names = rows.columns
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOT_BYTES

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _TILE):
                part = batch.slice(at, _TILE)
                vectors = _matrix(part["_vec"], part.num_rows).astype(np.float64)
                usable = np.isfinite(vectors).all(axis=1)
                if not usable.any():
                    continue
                angle, length = angles_to(centre, vectors[usable])
                cell = angle.argmin(axis=1)
                mine = angle[np.arange(len(cell)), cell]
                kept = part.filter(pa.array(usable))
                columns = [*kept.columns, pa.array(cell.astype(np.int32)), pa.array(mine), pa.array(length)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "_cell", "_angle", "_length"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return materialize(rows.mapInArrow(assign, f"{schema}, _cell int, _angle double, _length double"))


def cells_of(placed: DataFrame, pivots: np.ndarray) -> Cells:
    stats = placed.groupBy("_cell").agg(
        F.min("_angle"), F.max("_angle"), F.min("_length"), F.max("_length"), F.count("*")
    )
    table = np.zeros((5, len(pivots)))
    for cell, *values in stats.collect():  # one row a pivot
        table[:, cell] = values
    return Cells(pivots, *table)


def region_rows(n_rows: int, per_block: int, dim: int, spark) -> int:
    """Rows of a region: as many as a task may hold, but enough regions to keep every core busy."""
    by_cores = math.isqrt(6 * spark.sparkContext.defaultParallelism) + 1
    return max(per_block, min(nb._rows_per_block(dim), -(-n_rows // by_cores)))


def regions_of(rows: np.ndarray, per_region: int) -> np.ndarray:
    """The region of each cell: neighbours in pivot order share one while their rows fit."""
    region, held, found = -1, per_region, np.zeros(len(rows), np.int32)
    for cell, n in enumerate(rows.astype(np.int64)):
        if held + n > per_region:
            region, held = region + 1, 0
        held += n
        found[cell] = region
    return found


def route(
    placed: DataFrame,
    cells: Cells,
    floors: DataFrame | None,
    threshold: float | None,
    regions: np.ndarray | None = None,
    one_way: bool = False,
) -> DataFrame:
    """Queries with ``_floor`` and ``_to``: regions (without ``regions``, cells) that can still matter.

    ``floors`` holds what each query already has from its own cell, which is then
    left out; without it every cell is open and the threshold is the floor. ``one_way``
    leaves out the regions before a query's own, whose rows are sent to it instead.
    """
    regions = np.arange(len(cells.rows), dtype=np.int32) if regions is None else regions
    least = float("-inf") if threshold is None else float(threshold)
    asked = placed.withColumn("_floor", F.lit(least))
    if floors is not None:
        asked = placed.join(floors, "_id", "left").withColumn(
            "_floor", F.greatest(F.coalesce("_floor", F.lit(least)), F.lit(least))
        )
    asked = asked.select(*placed.columns, "_floor")
    names, searched = asked.columns, floors is not None
    shared = placed.sparkSession.sparkContext.broadcast((cells, regions))
    begins = np.flatnonzero(np.r_[True, regions[1:] != regions[:-1]])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, region = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _TILE):
                part = batch.slice(at, _TILE)
                vectors = _matrix(part["_vec"], part.num_rows).astype(np.float64)
                angle, length = angles_to(known.pivots, vectors)
                open_ = known.reach(angle, length) >= part["_floor"].to_numpy()[:, None]
                if searched:
                    open_[np.arange(len(open_)), part["_cell"].to_numpy()] = False
                open_ = np.logical_or.reduceat(open_, begins, axis=1)
                if one_way:
                    open_ &= region[begins] >= region[part["_cell"].to_numpy()][:, None]
                ends = np.concatenate(([0], np.cumsum(open_.sum(axis=1)))).astype(np.int32)
                to = pa.array(region[begins][np.nonzero(open_)[1]])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), to)], names=[*names, "_to"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(choose, f"{schema}, _to array<int>").where(F.size("_to") > 0)


def arc_join(
    rows: DataFrame,
    blocks: int,
    per_block: int,
    dim: int,
    *,
    id_col: str,
    vec_col: str,
    carry: Sequence[str],
    k: int | None,
    threshold: float | None,
) -> DataFrame:
    """The answer of ``knn_self_join`` for a set of several blocks, not yet ranked."""
    carried = [f"_c{i}" for i in range(len(carry))]
    plain = rows.select(
        F.col(id_col).alias("_id"),
        F.col(vec_col).cast("array<float>").alias("_vec"),
        *[F.col(c).alias(n) for c, n in zip(carry, carried)],
    )
    pivots = _pivots(plain, blocks, dim)
    placed = place(plain, pivots)
    cells = cells_of(placed, pivots)
    spark = rows.sparkSession
    per_region = region_rows(int(cells.rows.sum()), per_block, dim, spark)
    if k is None:  # rows travel one way only
        per_region = max(per_block, -(-per_region // 2))
    chunks = np.maximum(1, -(-cells.rows.astype(np.int64) // per_region))
    regions = regions_of(cells.rows, per_region)
    found, floors = None, None
    if k is not None:
        sizes = spark.createDataFrame([(i, int(c)) for i, c in enumerate(chunks)], "_cell int, _blocks int")
        own = placed.select("_id", "_vec", *carried, "_cell").join(F.broadcast(sizes), "_cell")  # a row a pivot
        own = own.select(F.col("_id").alias(id_col), F.col("_vec").alias(vec_col), *[F.col(n).alias(c) for c, n in zip(carry, carried)], "_cell", "_blocks")
        pairs = int((chunks * (chunks + 1) // 2).sum())
        most = _OWN_PARTITIONS * spark.sparkContext.defaultParallelism
        found = nb._meet(own, id_col, vec_col, carry, k, threshold, partitions=min(pairs, most) if pairs == len(chunks) else pairs)
        found = materialize(nb._ranked(found, k))
        last = found.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("sim").alias("_floor"))
        floors = last.groupBy("_id").agg(F.min("_floor").alias("_floor"))
    routes = materialize(route(placed, cells, floors, threshold, regions, one_way=k is None))
    visits = routes.select(F.explode("_to").alias("_region")).groupBy("_region").count()
    asked = {r["_region"]: r["count"] for r in visits.collect()}  # at most one row a pivot
    parts = np.zeros(len(chunks), np.int64)  # a cell of several chunks is a region of its own
    np.maximum.at(parts, regions, chunks)
    plan = [(r, int(parts[r]), -(-n // per_region)) for r, n in sorted(asked.items())]
    if plan:
        more = _meet_routes(spark, placed, routes, plan, (cells, regions, k is not None), id_col, rows, carry, k, threshold)
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = nb._meet(
            rows.limit(0).withColumn("_cell", F.lit(0)).withColumn("_blocks", F.lit(1)), id_col, vec_col, carry, k, threshold
        )
    return found


def _meet_routes(spark, placed, routes, plan, known, id_col, rows, carry, k, threshold) -> DataFrame:
    """Every chunk of a region meets every slice of the queries sent to it, once."""
    carried = [f"_c{i}" for i in range(len(carry))]
    cells, regions, searched = known
    sizes = F.broadcast(spark.createDataFrame(plan, "_region int, _chunks int, _slices int"))  # a row a region
    where = F.broadcast(spark.createDataFrame(list(enumerate(regions.tolist())), "_cell int, _region int"))  # a row a pivot
    shared = ["_id", "_vec", *carried, "_cell", "_angle", "_length", "_floor", "_region"]
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("_id"), F.col(c)).cast("int")
    asking = (
        routes.withColumn("_region", F.explode("_to"))
        .join(sizes, "_region")
        .select(*shared, spread("_chunks").alias("_chunk"), mine("_slices").alias("_slice"), F.lit(True).alias("_asks"))
    )
    held = (
        placed.withColumn("_floor", F.lit(0.0))
        .join(where, "_cell")
        .join(sizes, "_region")
        .select(*shared, mine("_chunks").alias("_chunk"), spread("_slices").alias("_slice"), F.lit(False).alias("_asks"))
    )
    keys = ["_region", "_chunk", "_slice"]
    groups = sum(c * s for _, c, s in plan)
    both = asking.unionByName(held).repartition(min(groups, _MOST_PARTITIONS), *keys)
    fields = nb.found_fields({f.name: f.dataType.simpleString() for f in rows.schema}, id_col, carry, k)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    broadcast = spark.sparkContext.broadcast((cells, regions))
    return both.groupBy(*keys).applyInArrow(_search(list(fields), len(carry), k, threshold, broadcast, searched), schema)


def window(angle: np.ndarray, length: np.ndarray, floor: np.ndarray, short: float, long: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest angle to the pivot at which a member can reach each query's floor."""
    # a member of length m reaches the floor only within arccos(floor / (length m)) of the query
    scale = length * np.where(floor > 0, long, short)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(scale > 0, (floor - 1e-9) / scale - 1e-6, -np.inf)
    ratio = np.where((scale <= 0) & (floor > 1e-9), np.inf, ratio)
    width = np.where(ratio > 1, -1.0, np.arccos(np.clip(ratio, -1.0, 1.0)) + _ANGLE_SLACK)
    return angle - width, angle + width


def _in_reach(known: Cells, present: np.ndarray, vectors, floor, own) -> tuple[np.ndarray, np.ndarray]:
    """For each cell in ``present`` the angles between which a member can reach the floor of any query.

    A cell that no query reaches has a lowest angle above its highest. ``own`` holds the
    cells the queries have searched already, or is None.
    """
    cells = Cells(known.pivots[present], *[getattr(known, f)[present] for f in ("low", "high", "short", "long", "rows")])
    lowest, highest = np.full(len(present), np.inf), np.full(len(present), -np.inf)
    for at in range(0, len(vectors), _TILE):
        part = slice(at, at + _TILE)
        angle, length = angles_to(cells.pivots, vectors[part].astype(np.float64))
        open_ = cells.reach(angle, length) >= floor[part, None]
        if own is not None:
            open_ &= own[part, None] != present
        low, high = window(angle, length[:, None], floor[part, None], cells.short, cells.long)
        zero = cells.short == 0  # a zero vector has no angle
        low, high = np.where(zero, -np.inf, low), np.where(zero, np.inf, high)
        open_ &= high >= low
        lowest = np.minimum(lowest, np.where(open_, low, np.inf).min(axis=0))
        highest = np.maximum(highest, np.where(open_, high, -np.inf).max(axis=0))
    return lowest, highest


def _search(names: list[str], n_carry: int, k: int | None, threshold: float | None, shared, searched: bool) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not table.num_rows:
            return
        ids = table["_id"].combine_chunks()
        vectors = _matrix(table["_vec"].combine_chunks(), table.num_rows)
        carried = [table[f"_c{i}"].combine_chunks() for i in range(n_carry)]
        rank = np.empty(table.num_rows, dtype=np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(table.num_rows)
        asks = table["_asks"].to_numpy()
        cell, angle, floor = (table[c].to_numpy() for c in ("_cell", "_angle", "_floor"))
        queries, members = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(queries) or not len(members):
            return
        known, region = shared.value
        here = table["_region"][0].as_py()
        present, place = np.unique(cell[members], return_inverse=True)
        if len(present) == 1:  # the nearer two queries are in angle, the narrower their window
            first = known.pivots[present[0]]
            queries = queries[np.argsort(-(vectors[queries] @ first) / np.maximum(np.linalg.norm(vectors[queries], axis=1), 1e-300), kind="stable")]
        else:
            queries = queries[np.lexsort((angle[queries], cell[queries]))]
        for at in range(0, len(queries), _QUERY_RUN):
            run = queries[at : at + _QUERY_RUN]
            low, high = _in_reach(known, present, vectors[run], floor[run], cell[run] if searched else None)
            near = members[(angle[members] >= low[place]) & (angle[members] <= high[place])]
            if not len(near):
                continue
            if k is None:
                for q, c, sim in pairs_above(vectors[run], vectors[near], threshold):
                    q, c = run[q], near[c]
                    back = region[cell[q]] != here  # queries of other regions meet these members here only
                    q, c, sim = np.r_[q, c[back]], np.r_[c, q[back]], np.r_[sim, sim[back]]
                    yield found_batch(names, ids, carried, q, c, sim, ranked=False)
                continue
            for q, c, sim in best_pairs(vectors[run], vectors[near], rank[near], k, threshold, floor[run]):
                q, c = run[q], near[c]
                keep = sim >= floor[q]
                if searched:  # pairs of one cell were found in the first pass
                    keep &= cell[q] != cell[c]
                q, c, sim = q[keep], c[keep], sim[keep]
                if not len(q):
                    continue
                yield found_batch(names, ids, carried, q, c, sim, ranked=True)

    return search
