"""Exact and approximate nearest neighbours within one set of vectors.

A set of one block is searched at once. A larger one is cut into cells around
pivots, and cells that the angles rule out are left out (see ``arcs``). Sets searched
side by side are cut into blocks of queries, by which ranges of their rows pass chunk
by chunk. Buckets are cut into blocks by a hash of the id; every pair of blocks meets
in one group. A group emits, for each query, only the rows
that can still be among its best, never all pairs, and a window over these winners
gives the final rank. A task holds two blocks whatever the size of the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from kinfold.session import materialize

# Similarities are rounded before they are compared, so that copies of one vector
# tie exactly however the work was cut, and ties go to the smaller id.
SIM_DECIMALS = 9
_SLACK = 10.0**-SIM_DECIMALS
_BLOCK_BYTES = 32 << 20
_MIN_BLOCK_ROWS = 1024
_MAX_BITS = 30
# Sets side by side: partitions a core for sets of one group; groups a core, rows that ask and chunks that pass by in a group.
_SET_PARTITIONS = 16
_SET_GROUPS = 3
_SET_QUERIES = 1 << 14
_RANGE_CHUNKS = 8
_QUERY_TILE = 512
_CORPUS_TILE = 4096
# Vectors that lie in half of their dimensions or fewer are compared in those.
_MIN_COMPACT = 64
_COMPACT_TILE = 1024
_RESCORE_BYTES = 512 << 10
# Where all pairs are wanted: tiles whose scores stay in a core's cache, rows emitted at once.
_PAIR_TILE = 256
_PAIR_CORPUS_TILE = 2048
_PAIR_ROWS = 1 << 16


def knn_self_join(
    vectors: DataFrame,
    *,
    k: int | None = 50,
    threshold: float | None = None,
    id_col: str = "posting_id",
    vec_col: str = "embedding",
    carry: Sequence[str] = (),
    within: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Best ``k`` rows of the set for each row, by inner product, itself included.

    Returns ``query_id, rank, neighbor_id, sim`` and, for each column in
    ``carry``, ``query_<c>`` and ``neighbor_<c>``, which saves the lookup joins
    later. Rows below ``threshold`` are dropped after the best k are taken; since
    that keeps a prefix of the ranking, it is applied early. ``k=None`` keeps
    every pair at or above the threshold. Persist ``vectors`` first if they are
    costly: one small job reads their count and length to size the blocks.

    ``within`` names columns that part the rows into sets searched in one job but
    each for itself; the result keeps these columns. Rows with a null among them
    belong to no set, and sets may differ in the length of their vectors.
    """
    if k is None and threshold is None:
        raise ValueError("give k, threshold or both")
    rows = vectors.where(F.col(vec_col).isNotNull())
    if within:
        return _knn_within(rows, list(within), k, threshold, id_col, vec_col, list(carry), block_rows)
    n_rows, dim = _shape(rows, vec_col)
    blocks = _block_count(n_rows, dim, block_rows, rows.sparkSession)
    if k is None and block_rows is None and blocks > 1:
        # Rows travel to half of the blocks only, so twice as many cost the same; small ones cost more than their pairs.
        blocks = max(blocks, min(2 * blocks, n_rows // (8 * _MIN_BLOCK_ROWS)))
    if blocks == 1:
        placed = rows.withColumn("_cell", F.lit(0)).withColumn("_blocks", F.lit(1))
        found = _meet(placed, id_col, vec_col, carry, k, threshold, partitions=1)
        # One block holds the whole set: its local ranks are final.
        return found if k is not None else _ranked(found, None)
    from kinfold.operators.arcs import arc_join

    per_block = math.ceil(n_rows / blocks)
    found = arc_join(
        rows, blocks, per_block, dim, id_col=id_col, vec_col=vec_col, carry=carry, k=k, threshold=threshold
    )
    return _ranked(found, k)


def _knn_within(rows, within, k, threshold, id_col, vec_col, carry, block_rows) -> DataFrame:
    for c in within:
        rows = rows.where(F.col(c).isNotNull())
    size = F.size(vec_col)
    sets = rows.groupBy(*within).agg(F.count("*").alias("_n"), F.min(size).alias("_low"), F.max(size).alias("_high"))
    sets = materialize(sets)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_sets, most, uneven = sets.agg(F.count("*"), F.max("_n"), F.max(F.col("_low") != F.col("_high"))).first()
    if uneven:
        raise ValueError("vectors of a set differ in length")
    dim_bytes = 4 * F.greatest(F.col("_high"), F.lit(1))
    # a group holds a block of queries and a chunk of the rows they meet, which pass by in a range of chunks
    by_bytes = F.greatest(F.lit(_MIN_BLOCK_ROWS), F.floor(F.lit(_BLOCK_BYTES) / dim_bytes))
    by_cores = max(_MIN_BLOCK_ROWS, -(-(most or 0) * max(1, n_sets) // (_SET_GROUPS * cores)))
    per_chunk = F.lit(block_rows) if block_rows else by_bytes
    per_block = F.lit(block_rows) if block_rows else F.least(by_bytes, F.lit(min(by_cores, _SET_QUERIES)))
    sets = sets.select(
        *within,
        F.ceil(F.col("_n") / per_block).cast("int").alias("_blocks"),
        F.ceil(F.col("_n") / (per_chunk * _RANGE_CHUNKS)).cast("int").alias("_ranges"),
        per_chunk.cast("int").alias("_chunk"),
    )
    groups = F.col("_blocks").cast("long") * F.col("_ranges")
    single, several = sets.agg(F.sum(F.when(groups == 1, 1)), F.sum(F.when(groups > 1, groups))).first()
    # keys are dealt by hash: with more partitions than groups few share one
    partitions = max(1, min(single or 0, _SET_PARTITIONS * cores) + 4 * (several or 0))
    placed = rows.join(sets, within).withColumn("_cell", F.struct(*within))
    both = [*within, *[c for c in carry if c not in within]]
    if k is None:
        found = _meet(placed, id_col, vec_col, both, k, threshold, partitions=partitions)
    else:
        found = _pass_by(placed, id_col, vec_col, both, k, threshold, partitions)
    found = found.withColumnsRenamed({f"query_{c}": c for c in within}).drop(*[f"neighbor_{c}" for c in within])
    return _ranked(found, k, within)


def similarity_join(
    vectors: DataFrame,
    threshold: float,
    *,
    k: int | None = None,
    id_col: str = "posting_id",
    vec_col: str = "embedding",
    carry: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """All pairs with similarity ``>= threshold``, at most the best ``k`` per query if given."""
    return knn_self_join(
        vectors,
        k=k,
        threshold=threshold,
        id_col=id_col,
        vec_col=vec_col,
        carry=carry,
        block_rows=block_rows,
    )


def approx_similarity_join(
    vectors: DataFrame,
    threshold: float,
    *,
    k: int | None = None,
    bits: int = 4,
    recall: float = 0.95,
    tables: int | None = None,
    seed: int = 42,
    id_col: str = "posting_id",
    vec_col: str = "embedding",
    carry: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Pairs at or above the threshold that share a bucket in at least one hash table.

    Buckets are sign patterns of ``bits`` random hyperplanes, drawn ``tables``
    times: by default as often as a pair at the threshold needs to meet with
    chance ``recall``. Neither depends on the number of rows, so a pair found in a
    table is found in every larger one that holds it; more bits make smaller
    buckets and more tables.
    Inside a bucket the search is exact: a bucket of any size is cut into
    blocks that meet pairwise, as in the exact join, so a bucket holding a third
    of all rows is many bounded groups. Scores are exact; only recall is traded.
    """
    rows = vectors.where(F.col(vec_col).isNotNull())
    _, dim = _shape(rows, vec_col)
    if not 1 <= bits <= _MAX_BITS:
        raise ValueError(f"bits must be between 1 and {_MAX_BITS}")
    if tables is None:
        tables = tables_needed(threshold, bits, recall)
    per_block = block_rows or _rows_per_block(dim)
    cells = rows.withColumn("_cell", F.explode(_sign_cells(dim, tables, bits, seed)(vec_col)))
    sizes = cells.groupBy("_cell").agg(
        F.ceil(F.count("*") / F.lit(per_block)).cast("int").alias("_blocks")
    )
    placed = cells.join(sizes, "_cell")
    found = _meet(placed, id_col, vec_col, carry, k, threshold).drop("rank")
    # One shuffle serves both: copies from several tables go, then ranks are given.
    distinct = found.repartition("query_id").dropDuplicates(["query_id", "neighbor_id"])
    return _ranked(distinct, k)


def tables_needed(threshold: float, bits: int, recall: float) -> int:
    """Tables after which unit vectors at the threshold share a bucket with chance ``recall``."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    together = agree**bits
    if together >= recall:
        return 1
    return math.ceil(math.log1p(-recall) / math.log1p(-together))


def _ranked(found: DataFrame, k: int | None, within: Sequence[str] = ()) -> DataFrame:
    """Rank in the query; with ``k`` Spark prunes to k per query before the shuffle."""
    order = Window.partitionBy(*within, "query_id").orderBy(F.desc("sim"), "neighbor_id")
    ranked = found.drop("rank").withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    rest = [c for c in ranked.columns if c not in ("query_id", "rank", "neighbor_id", "sim")]
    return ranked.select("query_id", "rank", "neighbor_id", "sim", *rest)


def _shape(rows: DataFrame, vec_col: str) -> tuple[int, int]:
    size = F.size(vec_col)
    n, low, high = rows.agg(F.count("*"), F.min(size), F.max(size)).first()
    if n and low != high:
        raise ValueError(f"vectors differ in length: {low} to {high}")
    return n, high or 1


def _rows_per_block(dim: int) -> int:
    return max(_MIN_BLOCK_ROWS, _BLOCK_BYTES // (4 * dim))


def _block_count(n_rows: int, dim: int, block_rows: int | None, spark) -> int:
    """Enough blocks to bound a task's bytes and to keep every core busy."""
    if block_rows:
        return max(1, math.ceil(n_rows / block_rows))
    by_bytes = math.ceil(n_rows / _rows_per_block(dim))
    by_cores = math.isqrt(6 * spark.sparkContext.defaultParallelism) + 1
    return max(1, by_bytes, min(by_cores, n_rows // _MIN_BLOCK_ROWS))


def _sign_cells(dim: int, tables: int, bits: int, seed: int) -> Callable:
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)
    base = np.arange(tables, dtype=np.int64) << bits

    @pandas_udf(T.ArrayType(T.LongType()))
    def cells(vectors):
        if not len(vectors):
            return vectors
        signs = (np.stack(vectors.to_numpy()) @ planes > 0).reshape(-1, tables, bits)
        codes = (signs * weights).sum(axis=2) + base
        return vectors.__class__(list(codes), index=vectors.index)

    return cells


def _meet(
    placed: DataFrame,
    id_col: str,
    vec_col: str,
    carry: Sequence[str],
    k: int | None,
    threshold: float | None,
    partitions: int | None = None,
) -> DataFrame:
    """Bring every two blocks of a cell together once and search both ways."""
    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    rows = (
        placed.withColumn("_block", F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int"))
        .select(
            F.col(id_col).alias("_id"),
            F.col(vec_col).cast("array<float>").alias("_vec"),
            *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
            "_cell",
            "_block",
            other.alias("_other"),
        )
        .withColumn("_low", F.least("_block", "_other"))
        .withColumn("_high", F.greatest("_block", "_other"))
        .drop("_other")
    )
    keys = ["_cell", "_low", "_high"]
    if partitions is not None:
        # Work per byte is far above a scan's, so a fixed number of partitions keeps
        # runtime coalescing (which looks at bytes) from serialising the block pairs.
        rows = rows.repartition(min(partitions, 50_000), *keys)
    fields = found_fields(types, id_col, carry, k)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    return rows.groupBy(*keys).applyInArrow(_pair_search(list(fields), len(carry), k, threshold), schema)


def found_fields(types: dict[str, str], id_col: str, carry: Sequence[str], k: int | None) -> dict[str, str]:
    """Columns a group emits; where all pairs are wanted they come unranked."""
    ranked = {} if k is None else {"rank": "int"}
    fields = {"query_id": types[id_col]} | ranked | {"neighbor_id": types[id_col], "sim": "double"}
    for c in carry:
        fields |= {f"query_{c}": types[c], f"neighbor_{c}": types[c]}
    return fields


def found_batch(names: list[str], ids: pa.Array, carried: list[pa.Array], q, c, sim, ranked: bool) -> pa.RecordBatch:
    q_at, c_at = pa.array(q), pa.array(c)
    columns = [ids.take(q_at)] + ([pa.array(_positions(q), type=pa.int32())] if ranked else [])
    columns += [ids.take(c_at), pa.array(sim)]
    for values in carried:
        columns += [values.take(q_at), values.take(c_at)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _pass_by(
    placed: DataFrame,
    id_col: str,
    vec_col: str,
    carry: Sequence[str],
    k: int,
    threshold: float | None,
    partitions: int,
) -> DataFrame:
    """Let each range of a set's rows pass by each block of its queries once, chunk by chunk.

    A query's best rows so far raise its floor, so that later chunks add little, and a
    range leaves k rows a query at most.
    """
    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    block = F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int")
    range_ = F.pmod(F.xxhash64(F.lit("range"), id_col), F.col("_ranges")).cast("int")
    visit = lambda b, r, held: F.struct(b.alias("_block"), r.alias("_range"), F.lit(held).alias("_held"))
    asking = F.transform(F.sequence(F.lit(0), F.col("_ranges") - 1), lambda r: visit(block, r, False))
    held = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: visit(b, range_, True))
    keys = ["_cell", "_block", "_range"]
    rows = placed.select(
        F.col(id_col).alias("_id"),
        F.col(vec_col).cast("array<float>").alias("_vec"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
        "_cell",
        "_chunk",
        F.inline(F.concat(asking, held)),
    )
    # the group keeps this order: its queries come first
    rows = rows.repartition(min(partitions, 50_000), *keys).sortWithinPartitions(*keys, "_held")
    fields = found_fields(types, id_col, carry, k)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    return rows.groupBy(*keys).applyInArrow(_chunk_search(list(fields), len(carry), k, threshold), schema)


def _chunk_search(names: list[str], n_carry: int, k: int, threshold: float | None) -> Callable:
    columns = ["_id", *[f"_c{i}" for i in range(n_carry)]]

    def usable(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        """Their ids and carried columns, and their vectors; one with NaN or infinite parts is near nothing."""
        table = pa.Table.from_batches(batches).combine_chunks()
        vectors = _matrix(table["_vec"].combine_chunks(), table.num_rows)
        finite = np.isfinite(vectors).all(axis=1)
        table = table.select(columns)
        return (table, vectors) if finite.all() else (table.filter(pa.array(finite)), vectors[finite])

    def meet(queries: np.ndarray, chunk: list[pa.RecordBatch], best: tuple, floors: np.ndarray) -> tuple:
        """The best of each query so far (query, similarity, row) with those of the chunk; raises the floors."""
        rows, vectors = usable(chunk)
        if not len(queries) or not len(vectors):
            return best
        rank = _ranks(rows["_id"])
        found = list(best_pairs(queries, vectors, rank, k, threshold, floors))
        if not found:
            return best
        q, c, sim = (np.concatenate(part) for part in zip(*found))
        rows = rows.take(pa.array(c))
        if best[2] is not None:
            q, sim, rows = np.r_[best[0], q], np.r_[best[1], sim], pa.concat_tables([best[2], rows])
        order = np.lexsort((_ranks(rows["_id"]), -sim, q))
        at = _positions(q[order])
        last = order[at == k]
        floors[q[last]] = sim[last]
        order = order[at <= k]
        return q[order], sim[order], rows.take(pa.array(order)).combine_chunks()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, chunk, n = [], [], 0
        queries, floors, best = None, None, (None, None, None)
        for batch in batches:
            n_asking = batch.num_rows - batch["_held"].true_count
            if n_asking:
                asking.append(batch.slice(0, n_asking))
            if n_asking == batch.num_rows:
                continue
            if queries is None:
                if not asking:
                    return
                about, queries = usable(asking)
                floors = np.full(len(queries), -np.inf)
            chunk.append(batch.slice(n_asking))
            n += len(chunk[-1])
            if n >= batch["_chunk"][0].as_py():
                best, chunk, n = meet(queries, chunk, best, floors), [], 0
        if chunk:
            best = meet(queries, chunk, best, floors)
        q, sim, rows = best
        for start in range(0, 0 if q is None else len(q), _PAIR_ROWS):
            part = slice(start, start + _PAIR_ROWS)
            asked = about.take(pa.array(q[part])).combine_chunks()
            met = rows.slice(start, _PAIR_ROWS)
            # ranks are given by the window over all ranges
            values = [asked["_id"], pa.nulls(len(asked), pa.int32()), met["_id"], pa.array(sim[part])]
            for c in columns[1:]:
                values += [asked[c], met[c]]
            yield from pa.table(values, names=names).combine_chunks().to_batches()

    return search


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    rank = np.empty(len(ids), dtype=np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return rank


def _pair_search(names: list[str], n_carry: int, k: int | None, threshold: float | None) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not table.num_rows:
            return
        low, high = table["_low"][0].as_py(), table["_high"][0].as_py()
        ids = table["_id"].combine_chunks()
        vecs = _matrix(table["_vec"].combine_chunks(), table.num_rows)
        carried = [table[f"_c{i}"].combine_chunks() for i in range(n_carry)]
        block = table["_block"].to_numpy()
        # A vector with NaN or infinite parts is near nothing.
        usable = np.isfinite(vecs).all(axis=1)
        left = np.flatnonzero((block == low) & usable)
        right = np.flatnonzero((block == high) & usable)
        if k is None:
            for q, c, sim in pairs_above(vecs[left], vecs[right], threshold):
                q, c = left[q], right[c]
                if low != high:  # a product is the same both ways
                    q, c, sim = np.r_[q, c], np.r_[c, q], np.r_[sim, sim]
                yield found_batch(names, ids, carried, q, c, sim, ranked=False)
            return
        rank = np.empty(table.num_rows, dtype=np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(table.num_rows)
        for queries, corpus in [(left, right)] if low == high else [(left, right), (right, left)]:
            if not len(queries) or not len(corpus):
                continue
            for q, c, sim in best_pairs(vecs[queries], vecs[corpus], rank[corpus], k, threshold):
                yield found_batch(names, ids, carried, queries[q], corpus[c], sim, ranked=True)

    return search


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _positions(groups: np.ndarray) -> np.ndarray:
    """1-based position of each entry inside its run of equal values."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else groups
    lengths = np.diff(np.r_[starts, len(groups)])
    return np.arange(len(groups)) - np.repeat(starts, lengths) + 1


class _Copies:
    """Distinct rows of a block and the members behind each, in id order.

    A copied vector is scored once however many ids share it, and only its first
    k ids can reach anyone's best k.
    """

    def __init__(self, vectors: np.ndarray, rank: np.ndarray, keep: int | None) -> None:
        width = vectors.dtype.itemsize * vectors.shape[1]
        raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, width))).ravel()
        _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        order = np.lexsort((rank, inverse))
        if keep is not None:
            order = order[_positions(inverse[order]) <= keep]
        self.members = order
        self.sizes = np.bincount(inverse[order], minlength=len(first))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def expand(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``which`` repeated once per member, and those members."""
        sizes = self.sizes[which]
        at = np.repeat(np.arange(len(which)), sizes)
        within = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return at, self.members[self.starts[which[at]] + within]


def best_pairs(
    queries: np.ndarray,
    corpus: np.ndarray,
    corpus_rank: np.ndarray,
    k: int | None,
    threshold: float | None,
    floors: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield ``(query, corpus, sim)`` index arrays, each query's rows together and best first.

    Pairs below a query's entry in ``floors`` may be left out.
    """
    asked = _Copies(queries, np.arange(len(queries)), None)
    least = None
    if floors is not None:
        least = np.full(len(asked.vectors), np.inf)
        np.minimum.at(least, np.repeat(np.arange(len(asked.vectors)), asked.sizes), floors[asked.members])
    held = _Copies(corpus, corpus_rank, k)
    axes = _axes(asked.vectors, held.vectors)
    flat = None if axes is None else _Flat(held.vectors, axes)
    for start in range(0, len(asked.vectors), _QUERY_TILE):
        tile = asked.vectors[start : start + _QUERY_TILE]
        own = None if least is None else least[start : start + _QUERY_TILE]
        if flat is None:
            row, col, sim = _candidates(tile, held.vectors, k, threshold, own)
        else:
            row, col, sim = _candidates(tile, held.vectors, k, threshold, own, (_Flat(tile, axes), flat))
        row, col, sim = _cut_distinct(row, col, sim, held.sizes, k)
        at, member = held.expand(col)
        row, sim = row[at], sim[at]
        order = np.lexsort((corpus_rank[member], -sim, row))
        row, member, sim = row[order], member[order], sim[order]
        if k is not None and len(row):
            keep = _positions(row) <= k
            row, member, sim = row[keep], member[keep], sim[keep]
        if not len(row):
            continue
        # Hand each distinct query's list to all its copies.
        counts = np.bincount(row, minlength=len(tile))
        begins = np.cumsum(counts) - counts
        who, original = asked.expand(np.arange(start, start + len(tile)))
        lengths = counts[who]
        pick = np.arange(lengths.sum()) + np.repeat(
            begins[who] - (np.cumsum(lengths) - lengths), lengths
        )
        yield np.repeat(original, lengths), member[pick], sim[pick]


def pairs_above(
    queries: np.ndarray, corpus: np.ndarray, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield ``(query, corpus, sim)`` index arrays of every pair at or above the threshold, in no order.

    The candidates are those of ``_candidates``. A part holds the pairs of a tile and
    some more at most, whatever the share of pairs that reach the threshold.
    """
    found, held = [], 0
    for right in range(0, len(corpus), _PAIR_CORPUS_TILE):
        tile = corpus[right : right + _PAIR_CORPUS_TILE]
        for left in range(0, len(queries), _PAIR_TILE):
            row, col, sim = _candidates(queries[left : left + _PAIR_TILE], tile, None, threshold)
            if not len(row):
                continue
            found.append((row + left, col + right, sim))
            held += len(row)
            if held >= _PAIR_ROWS:
                yield tuple(np.concatenate(part) for part in zip(*found))
                found, held = [], 0
    if found:
        yield tuple(np.concatenate(part) for part in zip(*found))


def _single_below(floor):
    """The bounds as a single-precision column, rounded down."""
    return np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]


def _axes(*parts: np.ndarray) -> np.ndarray | None:
    """Orthonormal columns near which the vectors lie, or None if half of the dimensions are too few.

    They come from a spread of the rows. How far the others are from them is measured
    later (see ``_Flat``), so the answer does not depend on the draw.
    """
    dim = parts[0].shape[1]
    if dim < _MIN_COMPACT or sum(map(len, parts)) < 4 * dim:
        return None
    drawn = np.concatenate([p[:: max(1, 2 * len(p) // dim)] for p in parts]).astype(np.float64)
    size, mix = np.linalg.eigh(drawn @ drawn.T)
    # what is left out counts with the square of its share
    kept = size > 1e-12 * size[-1]
    return np.linalg.qr(drawn.T @ mix[:, kept])[0] if 2 * np.count_nonzero(kept) <= dim else None


class _Flat:
    """Vectors as coordinates on some axes, and the length of what lies beside these."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray) -> None:
        self.exact = np.empty((len(vectors), axes.shape[1]))
        self.beside = np.empty(len(vectors))
        for at in range(0, len(vectors), _COMPACT_TILE):
            part = slice(at, at + _COMPACT_TILE)
            wide = vectors[part].astype(np.float64)
            self.exact[part] = wide @ axes
            wide -= self.exact[part] @ axes.T
            self.beside[part] = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        self.single = self.exact.astype(np.float32)


def _longest(vectors: np.ndarray) -> float:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64).max(initial=0))


def _candidates(tile, corpus, k, threshold, least=None, flat=None):
    """Every distinct pair of the tile that can still be in the answer, scores rounded.

    Products are first taken in single precision. Their error is at most
    dim * 2^-24 times both norms, so pairs below the k-th best or the threshold by
    more than that margin cannot be in the answer; the few others are scored again
    in double precision. ``flat`` holds tile and corpus as coordinates on few axes;
    the margin then counts what lies beside these, too.
    """
    reach = _longest(tile) * _longest(corpus)
    few, many = (tile, corpus) if flat is None else (flat[0].single, flat[1].single)
    margin = (few.shape[1] + (0 if flat is None else 4)) * 2.0**-23 * reach + _SLACK
    margin = np.full(len(tile), margin)
    if flat is not None:
        margin += flat[0].beside * flat[1].beside.max(initial=0)
    floor = np.full(len(tile), -np.inf) if threshold is None else threshold - margin
    if least is not None:
        floor = np.maximum(floor, least - margin)
    best = np.empty((len(tile), 0), few.dtype)  # the k best scores of each row so far
    rows, cols, rough = [], [], []
    room = np.empty(len(tile) * min(len(corpus), _CORPUS_TILE), few.dtype)
    for start in range(0, len(corpus), _CORPUS_TILE):
        part = many[start : start + _CORPUS_TILE]
        width = len(part)
        scores = np.matmul(few, part.T, out=room[: len(tile) * width].reshape(len(tile), width))
        hit = scores >= _single_below(floor)
        crowded = k is not None and 4 * np.count_nonzero(hit) > hit.size
        if crowded:
            best = _top(_top(scores, k), k, best)
            floor = _raised(floor, best, k, margin)
            hit = scores >= _single_below(floor)
        at = np.flatnonzero(hit)
        row, score = at // width, scores.ravel()[at]
        if k is not None and not crowded and len(at):
            place = _positions(row) - 1
            found = np.full((len(tile), place.max() + 1), -np.inf, few.dtype)
            found[row, place] = score
            best = _top(found, k, best)
            floor = _raised(floor, best, k, margin)
        rows.append(row)
        cols.append(at - row * width + start)
        rough.append(score)
    row, col, rough = np.concatenate(rows), np.concatenate(cols), np.concatenate(rough)
    keep = rough >= floor[row]
    row, col = row[keep], col[keep]
    sim = _rounded_scores(tile, corpus, row, col, reach, flat)
    if threshold is not None:
        keep = sim >= threshold
        row, col, sim = row[keep], col[keep], sim[keep]
    return row, col, sim


def _top(scores: np.ndarray, k: int, more: np.ndarray | None = None) -> np.ndarray:
    """The k best scores of each row, the least of them first; all where there are fewer."""
    scores = scores if more is None else np.concatenate([scores, more], axis=1)
    spare = scores.shape[1] - k
    return np.partition(scores, spare, axis=1)[:, spare:] if spare > 0 else scores


def _raised(floor: np.ndarray, best: np.ndarray, k: int, margin: np.ndarray) -> np.ndarray:
    return floor if best.shape[1] < k else np.maximum(floor, best.min(axis=1) - 2 * margin)


def _double_scores(left, right, row, col) -> np.ndarray:
    sim = np.empty(len(row))
    some = max(1, _RESCORE_BYTES // (8 * left.shape[1]))
    for start in range(0, len(row), some):
        part = slice(start, start + some)
        sim[part] = np.einsum(
            "ij,ij->i",
            left.take(row[part], axis=0).astype(np.float64, copy=False),
            right.take(col[part], axis=0).astype(np.float64, copy=False),
        )
    return sim


def _rounded_scores(tile, corpus, row, col, reach, flat) -> np.ndarray:
    """Products of the pairs in double precision, rounded.

    By ``flat``'s coordinates where these surely round to the same; else by the vectors.
    """
    if flat is not None:
        sim = _double_scores(flat[0].exact, flat[1].exact, row, col)
        error = flat[0].beside[row] * flat[1].beside[col] + 4 * tile.shape[1] * 2.0**-52 * reach
        place = sim * 10.0**SIM_DECIMALS
        unsure = np.flatnonzero(np.abs(place - np.floor(place) - 0.5) <= error * 10.0**SIM_DECIMALS + 2.0**-51 * np.abs(place))
        sim[unsure] = _double_scores(tile, corpus, row[unsure], col[unsure])
    else:
        # a tile is widened once where its rows are scored several times
        wide = len(corpus) <= _CORPUS_TILE and len(row) >= len(tile) + len(corpus)
        left, right = (tile.astype(np.float64), corpus.astype(np.float64)) if wide else (tile, corpus)
        sim = _double_scores(left, right, row, col)
    return np.round(sim, SIM_DECIMALS) + 0.0  # no negative zero


def _cut_distinct(row, col, sim, sizes, k):
    """Drop a distinct vector when k ids already score strictly above it."""
    if sizes.max(initial=1) == 1:  # the final cut does
        return row, col, sim
    order = np.lexsort((col, -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    if k is None or not len(row):
        return row, col, sim
    before = np.cumsum(sizes[col]) - sizes[col]
    new_row = np.r_[True, row[1:] != row[:-1]]
    new_run = new_row | np.r_[True, sim[1:] != sim[:-1]]
    run_starts, row_starts = np.flatnonzero(new_run), np.flatnonzero(new_row)
    above = before[run_starts][np.cumsum(new_run) - 1] - before[row_starts][np.cumsum(new_row) - 1]
    keep = above < k
    return row[keep], col[keep], sim[keep]
