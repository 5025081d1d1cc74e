"""Exact Jaccard join of word shingle sets as a metric-space join.

The Jaccard distance is a metric, so documents within radius ``r`` of each other
can be found region by region:

1. Equal sets are one point. A point can only have a link if four fifths of its
   shingles occur in other points too; the shingles are sorted in rounds, a share of
   the hash range at a time, to find those that do. The rest are at a distance
   beyond the radius from everything and are set aside.
2. Two sets within ``r`` share one of their first ``floor(r * n) + 1`` shingles in any
   common order (unshared ones first, then by hash). Points that share any of
   theirs form clusters; no link leaves a cluster. Inside a cluster the size of the
   sets is a first coordinate: sets within ``r`` differ in size by at most the factor
   ``1 - r``, so a size class meets the next one only.
3. A region larger than a task takes gets pivots. Each point goes to the Voronoi
   region of its nearest pivot and, by the triangle inequality, also into every
   region whose pivot is at most ``2 r`` farther: the window. A pair within ``r``
   therefore meets in the home region of either point. Regions split again while
   that makes them smaller.
4. A region is joined exactly in blocks of bounded size; every two blocks of a
   region meet once. Only a spanning forest of the links found is kept, so a
   dense region never writes out its pairs.

No pair within the radius is lost and no candidate list is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.blocks import LOWER, Block, Hasher, blocks, bound_batches, mix, releasing, shingles, word_spans
from kinfold.llm.components import components
from kinfold.llm.suffixes import ENTRY, FOUND, bucket_count, find_ties, flushed, gathered
from kinfold.session import materialize

WORDS = 5
PERCENT = 80  # smallest similarity of a link, in hundredths
ROUNDS = 3  # shares of the shingles sorted one after the other
BLOCK_POINTS = 1024  # points of a block; a task holds two
BLOCK_SHINGLES = 2_000_000
PIVOTS = 6
LEVELS = 3


def shingle_sets(block: Block, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of each text, by owner and hash.

    A text with fewer words than a shingle, but at least one, has one shingle:
    the whole sequence.
    """
    data = LOWER[block.bytes]
    starts, ends = word_spans(data)
    owner = block.owner(starts)
    words = Hasher(data).spans(starts, ends)
    runs = shingles(words, size)
    at = np.flatnonzero(owner[: len(runs)] == owner[size - 1 :]) if len(runs) else np.zeros(0, np.int64)
    owners, hashes = owner[at], runs[at]
    count = np.bincount(owner, minlength=len(block)) if len(owner) else np.zeros(len(block), np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(owner, short)
        whole = np.concatenate([shingles(words[f : f + count[i]], int(count[i])) for f, i in zip(first, short)])
        owners, hashes = np.append(owners, short), np.append(hashes, mix(whole ^ count[short].astype(np.uint64)))
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    fresh = np.ones(len(owners), bool)
    fresh[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
    return owners[fresh], hashes[fresh]


def _identities(count: int, owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit identity of each set; the identity of the empty set is 0."""
    sizes = np.bincount(owners, minlength=count)
    total = np.zeros(count, np.uint64)
    np.add.at(total, owners, mix(hashes + np.uint64(0x632BE59BD9B4E019)))
    return sizes, np.where(sizes > 0, mix(total + sizes.astype(np.uint64)), 0).astype(np.uint64).view(np.int64)


@releasing
def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch["text"]):
            sizes, keys = _identities(len(block), *shingle_sets(block))
            rows = batch.slice(block.first, len(block))
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], rows["tag"], rows["row_id"], pa.array(sizes), pa.array(keys)], ["doc_id", "tag", "row_id", "n", "key"]
            )


@releasing
def _shingle_entries(batches, buckets: int, turn: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Shingles of one share of the hash range, by bucket, with their places in the sorted set."""

    def parts():
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch["text"]):
                owners, hashes = shingle_sets(block)
                sizes, keys = _identities(len(block), owners, hashes)
                fresh = np.array([n > 0 and not (k in seen or seen.add(k)) for n, k in zip(sizes.tolist(), keys.tolist())], bool)
                place = np.arange(len(owners)) - np.searchsorted(owners, np.arange(len(block)))[owners]
                # ranges of the hash, so that a set's shingles in a bucket are neighbours
                slot = ((hashes >> np.uint64(32)) * np.uint64(buckets * rounds) >> np.uint64(32)).astype(np.int64)
                mine = fresh[owners] & (slot // buckets == turn)
                if mine.any():
                    yield slot[mine] % buckets, keys[owners[mine]], hashes[mine], None, place[mine]

    yield from flushed(parts(), buckets)


@releasing
def _enough(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Points whose shared shingles suffice for a link."""
    for batch in batches:
        runs = (np.frombuffer(x, np.int32) for x in batch["places"].to_pylist())
        shared = np.array([int(x[1::2].sum(dtype=np.int64) - x[::2].sum(dtype=np.int64)) for x in runs], np.int64)
        yield batch.filter(pa.array(100 * shared >= percent * batch["n"].to_numpy())).select(["row_id", "key", "places"])


@releasing
def _sets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The shared shingles of each candidate, and how many of them are in its prefix."""
    for batch in batches:
        for block in blocks(batch["text"]):
            owners, hashes = shingle_sets(block)
            sizes, keys = _identities(len(block), owners, hashes)
            edge = np.searchsorted(owners, np.arange(len(block) + 1))
            rows = batch.slice(block.first, len(block))
            sets, prefixes = [], []
            for i, places in enumerate(rows["places"].to_pylist()):
                mine = np.zeros(sizes[i] + 1, np.int64)
                for start, end in np.frombuffer(places, np.int32).reshape(-1, 2).tolist():
                    mine[min(start, sizes[i])] += 1
                    mine[min(end, sizes[i])] -= 1
                shared = hashes[edge[i] : edge[i + 1]][np.cumsum(mine[:-1]) > 0]
                sets.append(shared.tobytes())
                prefixes.append(int(len(shared) - (percent * sizes[i] + 99) // 100 + 1))
            found = pa.RecordBatch.from_arrays(
                [rows["key"], pa.array(sizes), pa.array(prefixes, pa.int64()), pa.array(sets, pa.binary())],
                ["key", "n", "prefix", "shingles"],
            )
            yield found.filter(pa.array((keys == rows["key"].to_numpy()) & (np.array(prefixes) > 0)))


@releasing
def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, sizes = [], []
        for prefix, own in zip(batch["prefix"].to_pylist(), batch["shingles"].to_pylist()):
            mine = np.frombuffer(own, np.int64)[:prefix]
            tokens.append(mine)
            sizes.append(len(mine))
        if tokens:
            keys = np.repeat(batch["key"].to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(keys)], ["token", "key"])


def intersections(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every two sets.

    Shingles of many sets go through matrix products, those of few give their
    pairs one by one.
    """
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    total = np.zeros((count, count), np.int32)
    if not len(owner):
        return total
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    size = np.diff(np.append(first, len(values)))
    common = size > max(8, count // 16)
    column = np.repeat(np.cumsum(common) - 1, size)
    many = np.repeat(common, size)
    dense_owner, dense_column = owner[many], column[many]
    for start in range(0, int(common.sum()), columns):
        a, b = np.searchsorted(dense_column, (start, start + columns))
        part = np.zeros((count, min(columns, int(common.sum()) - start)), np.float32)
        part[dense_owner[a:b], dense_column[a:b] - start] = 1
        total += (part @ part.T).astype(np.int32)
    # the k-th next holder of the same shingle, for k = 1, 2, ...
    left = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(values))  # holders that follow
    at, k = np.flatnonzero(~many & (left > 0)), 1
    flat = total.reshape(-1)
    while len(at):
        codes = owner[at] * count + owner[at + k]
        if len(codes) * 8 > count * count:
            flat += np.bincount(codes, minlength=count * count).astype(np.int32)
        else:
            np.add.at(flat, codes, 1)
        k += 1
        at = at[left[at] >= k]
    # holders come in rising order, so the pairs are all in the upper triangle
    upper = np.triu(total, 1)
    total = upper + upper.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _forest(keys: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For every point with a link: itself and the smallest key it reaches in this group."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    common = intersections([sets[i] for i in order])
    linked = 100 * common.astype(np.int64) >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(linked, True)
    label = np.arange(len(keys))
    while True:
        low = np.where(linked, label[None, :], len(keys)).min(1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    mine = np.flatnonzero(label != np.arange(len(keys)))
    return keys[mine], keys[label[mine]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``group`` from rows sorted by it, across batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array(batch["group"].to_pylist(), object)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0]["group"][0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


@releasing
def _join_groups(batches, percent: int) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        keys = group["key"].to_numpy()
        if len(keys) < 2:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        u, v = _forest(keys, group["n"].to_numpy(), sets, percent)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


@releasing
def _nearest(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Home and window regions of every point among its region's pivots."""
    window = 2 * (100 - percent) / 100
    for batch in batches:
        regions, keys, homes, sizes, sets = [], [], [], [], []
        for region, key, n, own, pivots in zip(*(batch[c].to_pylist() for c in ("region", "key", "n", "shingles", "pivots"))):
            mine = np.frombuffer(own, np.uint64)
            far = []
            for pivot in pivots:
                other = np.frombuffer(pivot["shingles"], np.uint64)
                common = np.isin(mine, other, assume_unique=True).sum()
                far.append(1 - common / (n + pivot["n"] - common))
            for k in np.flatnonzero(np.array(far) <= min(far) + window + 1e-9):
                regions.append(region)
                keys.append(key)
                homes.append(pivots[k]["key"])
                sizes.append(n)
                sets.append(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(regions, pa.int64()), pa.array(keys, pa.int64()), pa.array(homes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())],
            ["parent", "key", "home", "n", "shingles"],
        )


def _region_sizes(points: DataFrame, block_points: int) -> DataFrame:
    """``region, size, number``: points of each region, and the blocks they make; 1 if a task holds all."""
    load = F.greatest(F.count("*") / block_points, F.sum(F.length("shingles")) / (8 * BLOCK_SHINGLES))
    number = F.when(load <= 2, 1).otherwise(F.ceil(load)).cast("int")
    return points.groupBy("region").agg(F.count("*").alias("size"), number.alias("number"))


def _split(points: DataFrame, percent: int, block_points: int, pivots: int) -> tuple[DataFrame, DataFrame | None]:
    """Regions that are small or do not shrink, and the Voronoi regions of the others."""
    sizes = _region_sizes(points, block_points)
    sized = points.join(sizes, "region")
    large = sized.where(F.col("number") > 1)
    if large.isEmpty():
        return sized, None
    # a hash draws the pivots; a hundred-odd candidates at most reach each region's aggregate
    drawn = large.where(F.pmod(F.xxhash64("key", F.lit(7)), F.col("size")) < 16 * pivots)
    chosen = drawn.groupBy("region").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("key", F.lit(8)).alias("o"), "key", "n", "shingles"))), 1, pivots).alias("pivots")
    )
    placed = large.join(chosen, "region", "inner").select("region", "key", "n", "shingles", "pivots")
    children = materialize(
        placed.mapInArrow(lambda it: _nearest(it, percent), "parent long, key long, home long, n long, shingles binary")
    )
    child_sizes = children.groupBy("parent", "home").agg(F.count("*").alias("n"))
    largest = child_sizes.groupBy("parent").agg(F.max("n").alias("n"))
    shrunk = materialize(
        largest.join(sizes, largest["parent"] == sizes["region"]).where("n < 0.7 * size").select("parent")
    )
    done = sized.join(shrunk, sized["region"] == shrunk["parent"], "left_anti")
    next_points = children.join(shrunk, "parent", "left_semi").select(
        F.xxhash64("parent", "home").alias("region"), "key", "n", "shingles"
    )
    return done, next_points


def links(
    points: DataFrame, *, percent: int = PERCENT, block_points: int = BLOCK_POINTS, pivots: int = PIVOTS, levels: int = LEVELS
) -> DataFrame:
    """A spanning forest ``u, v`` of the links among points of one ``region`` (``region, key, n, shingles``)."""
    found, rest = [], points
    for _ in range(levels):
        done, rest = _split(rest, percent, block_points, pivots)
        found.append(done)
        if rest is None:
            break
        rest = materialize(rest)
    if rest is not None:
        found.append(rest.join(_region_sizes(rest, block_points), "region"))
    edges = None
    for done in found:
        own = F.pmod(F.xxhash64("key", F.lit(9)), F.col("number")).cast("int")
        met = done.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("number") - 1)))
        # with one block it meets itself; with more, two blocks meet once and a block needs no meeting of its own
        met = met.where("number = 1 or own <> other").withColumn(
            "group", F.concat_ws("/", "region", F.least("own", "other"), F.greatest("own", "other"))
        )
        joined = (
            met.select("group", "key", "n", "shingles").repartition("group").sortWithinPartitions("group")
            .mapInArrow(lambda it: _join_groups(it, percent), "u long, v long")
        )
        edges = joined if edges is None else edges.unionByName(joined)
    return edges


def jaccard_components(
    docs: DataFrame, *, percent: int = PERCENT, block_points: int = BLOCK_POINTS, rounds: int = ROUNDS
) -> DataFrame:
    """``doc_id, tag, n_shingles, key, component`` for rows of ``doc_id, text``.

    ``tag`` is ``xxhash64(text)``, ``key`` names the set, ``component`` the linked group of sets; both are null
    for a null text or one without words, which link with nothing. Repeated texts
    share key and component. ``doc_id`` is any long, repeated or null; one row comes
    out for each row that goes in. Other columns are dropped; an empty table gives
    an empty result.
    """
    bound_batches(docs.sparkSession)
    tag = F.xxhash64("text")
    texts = docs.select("doc_id", tag.alias("tag"), F.coalesce("doc_id", tag).alias("row_id"), "text")
    survey = materialize(texts.mapInArrow(_survey, "doc_id long, tag long, row_id long, n long, key long"))
    rows = survey.select("doc_id", "tag", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key"))
    points = materialize(survey.where("n > 0").groupBy("key").agg(F.min("row_id").alias("row_id"), F.first("n").alias("n")))

    buckets = bucket_count(docs, (points.agg(F.sum("n")).first()[0] or 0) / rounds)
    found = None
    for turn in range(rounds):
        entries = texts.select("text").mapInArrow(lambda it, turn=turn: _shingle_entries(it, buckets, turn, rounds), ENTRY)
        ties = materialize(entries.repartition(buckets, "bucket").mapInArrow(lambda it: find_ties(it, buckets), FOUND))
        found = ties if found is None else found.unionByName(ties)
    shared = gathered(found, buckets)
    needed = shared.join(points, "key").select("row_id", "key", "n", "places")
    needed = needed.mapInArrow(lambda it: _enough(it, percent), "row_id long, key long, places binary")
    chosen = texts.select("row_id", "text").join(needed, "row_id")
    sets = materialize(
        chosen.mapInArrow(lambda it: _sets(it, percent), "key long, n long, prefix long, shingles binary").dropDuplicates(["key"])
    )
    tokens = sets.select("key", "prefix", "shingles").mapInArrow(_prefixes, "token long, key long")
    least = tokens.groupBy("token").agg(F.min("key").alias("u"), F.count("*").alias("c")).where("c > 1")
    star = tokens.join(least.select("token", "u"), "token").select("u", F.col("key").alias("v")).where("u <> v").distinct()
    clusters = components(star)
    # sets within the radius are in the same or neighbouring classes of size
    width = (float(-np.log(percent / 100)) or 1.0) * (1 + 1e-9)  # a ratio of exactly r stays within one class
    size_class = F.floor(F.log(F.col("n").cast("double")) / width)
    placed = sets.join(clusters, sets["key"] == clusters["node"]).withColumn("class", F.explode(F.array(size_class, size_class - 1)))
    regions = materialize(placed.select(F.xxhash64("component", "class").alias("region"), "key", "n", "shingles"))
    linked = components(links(regions, percent=percent, block_points=block_points))
    joined = rows.join(linked, rows["key"] == linked["node"], "left")
    return joined.select("doc_id", "tag", "n_shingles", "key", F.coalesce("component", "key").alias("component"))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest ``doc_id`` reachable by links.

    A null ``doc_id`` names its group only where the group has no other.
    """
    named = materialize(jaccard_components(docs, percent=percent))
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one of each linked group: that with the smallest ``doc_id``.

    Rows of null texts or texts without words all stay; of rows that agree in
    ``doc_id`` and text one stays. All columns are kept.
    """
    named = jaccard_components(docs, percent=percent)
    chosen = named.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("r"))
    chosen = chosen.select(F.col("r.doc_id").alias("_id"), F.col("r.tag").alias("_as"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.withColumn("_tag", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(chosen["_id"]) & (rows["_tag"] == chosen["_as"])
    kept = rows.where(worded).join(chosen, same, "left_semi").dropDuplicates(["doc_id", "_tag"])
    return kept.unionByName(rows.where(~worded)).drop("_tag")
