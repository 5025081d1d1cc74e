from __future__ import annotations

import numpy as np
import pytest

from kinfold.operators import arcs
from kinfold.operators import neighbors as nb


def table(spark, vectors, ids=None, labels=None, parts=3):
    ids = list(range(len(vectors))) if ids is None else ids
    labels = [0] * len(vectors) if labels is None else labels
    rows = [(i, [float(x) for x in v], g) for i, v, g in zip(ids, vectors, labels)]
    kind = "string" if isinstance(ids[0], str) else "long"
    return spark.createDataFrame(rows, f"posting_id {kind}, embedding array<float>, g int").repartition(parts)


def brute(vectors, ids, k, threshold):
    v = np.asarray(vectors, dtype=np.float32).astype(np.float64)
    sims = np.round(v @ v.T, nb.SIM_DECIMALS)
    answer = {}
    for i, q in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-sims[i, j], ids[j]))
        order = order if k is None else order[:k]
        answer[q] = [(ids[j], sims[i, j]) for j in order if threshold is None or sims[i, j] >= threshold]
    return {q: a for q, a in answer.items() if a}


def collected(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["neighbor_id"], r["sim"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def unit(rng, n, d):
    v = rng.standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("block_rows", [None, 40, 7])
@pytest.mark.parametrize("k,threshold", [(5, None), (5, 0.3), (None, 0.3), (500, -2.0), (1, None)])
def test_matches_brute_force(spark, block_rows, k, threshold):
    v = unit(np.random.default_rng(1), 120, 8)
    ids = list(range(120))
    got = collected(nb.knn_self_join(table(spark, v), k=k, threshold=threshold, block_rows=block_rows))
    assert got == brute(v, ids, k, threshold)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_copies_tie_by_id_whatever_the_cut(spark, parts):
    rng = np.random.default_rng(2)
    v = unit(rng, 90, 6)
    v[rng.choice(90, 40, replace=False)] = v[0]
    ids = [f"p{i:03d}" for i in rng.permutation(90)]
    want = brute(v, ids, 7, None)
    for block_rows in (None, 20):
        assert collected(nb.knn_self_join(table(spark, v, ids, parts=parts), k=7, block_rows=block_rows)) == want


def test_all_pairs_of_copies_are_kept_without_k(spark):
    v = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 10
    pairs = nb.similarity_join(table(spark, v), 0.5, block_rows=9)
    assert pairs.count() == 30 * 30 + 10 * 10


def test_tiles_and_members_match_brute_force(monkeypatch):
    monkeypatch.setattr(nb, "_QUERY_TILE", 7)
    monkeypatch.setattr(nb, "_CORPUS_TILE", 11)
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((80, 2)), 1).astype(np.float32)  # many exact ties
    rank = rng.permutation(80)
    for k, threshold in [(3, None), (10, 0.5), (None, 0.5), (100, None)]:
        got = {}
        for q, c, s in nb.best_pairs(v, v, rank, k, threshold):
            for a, b, sim in zip(q, c, s):
                got.setdefault(int(a), []).append((int(rank[b]), sim))
        want = brute(v, list(rank), k, threshold)
        assert got == {i: want[rank[i]] for i in range(80) if rank[i] in want}


def test_carried_columns_and_null_vectors(spark):
    df = table(spark, [[1.0, 0.0], [0.0, 1.0]], labels=[7, 8])
    more = spark.createDataFrame([(9, None, 1)], df.schema)
    rows = nb.knn_self_join(df.unionByName(more), k=2, carry=["g"]).collect()
    assert len(rows) == 4
    assert {(r["query_id"], r["query_g"]) for r in rows} == {(0, 7), (1, 8)}
    assert all(r["neighbor_g"] == 7 + r["neighbor_id"] for r in rows)


def test_zero_and_nan_vectors(spark):
    rows = nb.knn_self_join(table(spark, [[0.0, 0.0], [1.0, 0.0], [float("nan"), 1.0]]), k=3).collect()
    assert all(2 not in (r["query_id"], r["neighbor_id"]) for r in rows)
    assert {(r["query_id"], r["neighbor_id"], r["sim"]) for r in rows} == {
        (0, 0, 0.0), (0, 1, 0.0), (1, 1, 1.0), (1, 0, 0.0)
    }


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        nb.knn_self_join(table(spark, [[1.0]]), k=None)
    with pytest.raises(ValueError):
        nb.knn_self_join(table(spark, [[1.0], [1.0, 2.0]]))


def test_empty_input(spark):
    assert nb.knn_self_join(table(spark, [[1.0]]).limit(0), k=3).count() == 0


def test_approximate_pairs_are_true_and_mostly_found(spark):
    rng = np.random.default_rng(4)
    centres = unit(rng, 12, 16)
    v = np.repeat(centres, 12, axis=0) + 0.05 * rng.standard_normal((144, 16))
    v[100:] = v[100]  # one bucket holds almost a third of the rows
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = table(spark, v)
    exact = {(r["query_id"], r["neighbor_id"]): r["sim"] for r in nb.similarity_join(df, 0.8).collect()}
    found = nb.approx_similarity_join(df, 0.8, bits=3, tables=6, block_rows=10).collect()
    got = {(r["query_id"], r["neighbor_id"]): r["sim"] for r in found}
    assert len(got) == len(found)
    assert set(got.items()) <= set(exact.items())
    assert len(got) >= 0.9 * len(exact)
    top = nb.approx_similarity_join(df, 0.8, k=5, bits=3, tables=6).collect()
    assert max(r["rank"] for r in top) == 5


def test_recall_does_not_depend_on_the_number_of_rows(spark):
    """The pairs found in a table are found again in a larger one that holds it."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(900, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    data = [(i, v.tolist()) for i, v in enumerate(rows)]
    small = spark.createDataFrame(data[:300], "posting_id long, embedding array<double>")
    large = spark.createDataFrame(data, "posting_id long, embedding array<double>")
    pairs = lambda df: {(r["query_id"], r["neighbor_id"]) for r in nb.approx_similarity_join(df, 0.6).collect()}
    few, many = pairs(small), pairs(large)
    assert few <= many
    exact = {(i, j) for i, j in zip(*np.nonzero(rows @ rows.T >= 0.6))}
    assert len(many) / len(exact) >= 0.95 and many <= exact


def clustered(rng, groups, per_group, d, noise=0.05):
    v = np.repeat(unit(rng, groups, d), per_group, axis=0)
    v = v + noise * rng.standard_normal(v.shape)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("k,threshold", [(6, None), (6, 0.9), (None, 0.95)])
def test_cells_out_of_reach_are_left_out_and_nothing_is_lost(spark, k, threshold):
    v = clustered(np.random.default_rng(11), 20, 12, 6)
    df = table(spark, v)
    assert collected(nb.knn_self_join(df, k=k, threshold=threshold, block_rows=12)) == brute(v, list(range(240)), k, threshold)
    plain = df.select(nb.F.col("posting_id").alias("_id"), nb.F.col("embedding").alias("_vec"))
    pivots = arcs._pivots(plain, 20, 6)
    placed = arcs.place(plain, pivots)
    cells = arcs.cells_of(placed, pivots)
    floors = None
    if k is not None:
        own = {}  # the k-th best inside a row's own cell
        rows = placed.collect()
        for r in rows:
            sims = sorted((float(np.dot(np.float32(r._vec).astype(float), np.float32(o._vec).astype(float))) for o in rows if o._cell == r._cell), reverse=True)
            if len(sims) >= k:
                own[r._id] = sims[k - 1]
        floors = spark.createDataFrame(list(own.items()), "_id long, _floor double")
    sent = sum(len(r._to) for r in arcs.route(placed, cells, floors, threshold).collect())
    # all pairs of blocks would send each of 240 rows to some twenty cells
    assert sent < 0.35 * 240 * len(pivots)


def test_small_blocks_do_not_multiply_the_copies_of_a_query(spark):
    """Sixty cells that the angles cannot rule out: a query travels once to each of a few regions."""
    v = unit(np.random.default_rng(12), 600, 24)
    df = table(spark, v)
    assert collected(nb.knn_self_join(df, k=5, block_rows=10)) == brute(v, list(range(600)), 5, None)
    plain = df.select(nb.F.col("posting_id").alias("_id"), nb.F.col("embedding").alias("_vec"))
    pivots = arcs._pivots(plain, 60, 24)
    placed = arcs.place(plain, pivots)
    cells = arcs.cells_of(placed, pivots)
    regions = arcs.regions_of(cells.rows, arcs.region_rows(600, 10, 24, spark))
    sent = [len(r._to) for r in arcs.route(placed, cells, None, None, regions).collect()]
    assert len(sent) == 600 and max(sent) <= 14 < len(pivots)
    assert arcs.regions_of(np.array([3, 4, 9, 30, 0, 5]), 10).tolist() == [0, 0, 1, 2, 3, 3]


def test_bounds_hold_for_vectors_of_any_length():
    rng = np.random.default_rng(5)
    for _ in range(40):
        d = int(rng.integers(1, 6))
        members = rng.standard_normal((30, d)) * rng.choice([0.0, 0.1, 1.0, 50.0], (30, 1))
        queries = rng.standard_normal((20, d)) * rng.choice([0.0, 0.5, 9.0], (20, 1))
        pivots = unit(rng, 3, d)
        angle, length = arcs.angles_to(pivots, members)
        cell = angle.argmin(axis=1)
        mine = angle[np.arange(30), cell]
        stats = np.zeros((5, 3))
        for c in range(3):
            if (cell == c).any():
                at = cell == c
                stats[:, c] = mine[at].min(), mine[at].max(), length[at].min(), length[at].max(), at.sum()
        cells = arcs.Cells(pivots, *stats)
        q_angle, q_length = arcs.angles_to(pivots, queries)
        reach = cells.reach(q_angle, q_length)
        products = queries @ members.T
        for c in range(3):
            at = cell == c
            if not at.any():
                assert (reach[:, c] == -np.inf).all()
                continue
            assert (products[:, at].max(axis=1) <= reach[:, c]).all()
            if length[at].min() > 0:
                floor = rng.standard_normal(20) * q_length
                low, high = arcs.window(q_angle[:, c], q_length, floor, length[at].min(), length[at].max())
                hit = products[:, at] >= floor[:, None]
                inside = (mine[at][None, :] >= low[:, None]) & (mine[at][None, :] <= high[:, None])
                assert (inside | ~hit).all()


@pytest.mark.parametrize("block_rows", [None, 15])
def test_vectors_of_mixed_lengths_and_zeros_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(6)
    v = unit(rng, 100, 4) * rng.choice([0.0, 0.2, 1.0, 7.0], (100, 1))
    v[60:] = v[60]
    got = collected(nb.knn_self_join(table(spark, v), k=8, block_rows=block_rows))
    assert got == brute(v, list(range(100)), 8, None)


@pytest.mark.parametrize("block_rows", [None, 9])
def test_sets_side_by_side_are_searched_each_for_itself(spark, block_rows):
    rng = np.random.default_rng(7)
    a, b = unit(rng, 30, 4), unit(rng, 40, 6)
    rows = [("a", i, [float(x) for x in v], 1) for i, v in enumerate(a)] + [("b", i, [float(x) for x in v], 2) for i, v in enumerate(b)]
    rows += [(None, 3, [1.0], 3)]
    df = spark.createDataFrame(rows, "name string, posting_id long, embedding array<float>, g int").repartition(3)
    found = nb.knn_self_join(df, k=5, within=["name"], carry=["g"], block_rows=block_rows)
    assert found.columns == ["query_id", "rank", "neighbor_id", "sim", "name", "query_g", "neighbor_g"]
    for name, v, g in (("a", a, 1), ("b", b, 2)):
        own = found.where(nb.F.col("name") == name)
        assert collected(own) == brute(v, list(range(len(v))), 5, None)
        assert {(r.query_g, r.neighbor_g) for r in own.collect()} == {(g, g)}
    assert found.where("name is null").count() == 0


def test_all_pairs_come_in_bounded_parts(monkeypatch):
    """Copies that all reach the threshold fill no part with more than a tile and the rows waiting for it."""
    monkeypatch.setattr(nb, "_PAIR_TILE", 16)
    monkeypatch.setattr(nb, "_PAIR_CORPUS_TILE", 32)
    monkeypatch.setattr(nb, "_PAIR_ROWS", 100)
    v = np.float32([[0.6, 0.8]] * 150 + [[-0.6, 0.8]] * 50)
    parts = list(nb.pairs_above(v, v[::-1], 0.9))
    assert max(len(sim) for _, _, sim in parts) <= 100 + 16 * 32
    pairs = {(int(a), 199 - int(b)) for q, c, _ in parts for a, b in zip(q, c)}
    assert len(pairs) == sum(len(sim) for _, _, sim in parts) == 150 * 150 + 50 * 50
    assert all((a < 150) == (b < 150) for a, b in pairs)
    assert not list(nb.pairs_above(v[:0], v, 0.9)) and not list(nb.pairs_above(v, -v, 0.99))


@pytest.mark.parametrize("low,high", [(0, 1), (1, 1)])
def test_two_blocks_are_multiplied_once_for_both_directions(monkeypatch, low, high):
    products = []
    scored = nb._candidates
    monkeypatch.setattr(nb, "_candidates", lambda tile, corpus, *a: (products.append(len(tile) * len(corpus)), scored(tile, corpus, *a))[1])
    rng = np.random.default_rng(21)
    v = unit(rng, 50, 3).astype(np.float32)
    block = np.where(np.arange(50) < 20, low, high)
    batch = nb.pa.RecordBatch.from_pydict({
        "_id": nb.pa.array([f"i{i:02d}" for i in range(50)]), "_vec": nb.pa.array(v.tolist(), nb.pa.list_(nb.pa.float32())),
        "_c0": nb.pa.array(range(100, 150)), "_block": nb.pa.array(block, nb.pa.int32()), "_low": nb.pa.array([low] * 50), "_high": nb.pa.array([high] * 50),
    })
    fields = nb.found_fields({"i": "string", "g": "long"}, "i", ["g"], None)
    found = [r for b in nb._pair_search(list(fields), 1, None, 0.2)([batch]) for r in b.to_pylist()]
    sims = np.round(v.astype(float) @ v.astype(float).T, nb.SIM_DECIMALS)
    want = {(i, j): sims[i, j] for i in range(50) for j in range(50) if sims[i, j] >= 0.2 and (low == high or block[i] != block[j])}
    assert {(r["query_g"] - 100, r["neighbor_g"] - 100): r["sim"] for r in found} == want and len(found) == len(want)
    assert all((r["query_id"], r["neighbor_id"]) == (f"i{r['query_g'] - 100:02d}", f"i{r['neighbor_g'] - 100:02d}") for r in found)
    assert sum(products) == (20 * 30 if low != high else 50 * 50)


def test_rows_of_an_all_pairs_join_travel_one_way(spark):
    """Each pair of regions meets once; carried columns follow both directions, and no length of vectors is lost."""
    rng = np.random.default_rng(22)
    v = unit(rng, 300, 16) * rng.choice([0.0, 0.3, 1.0, 3.0], (300, 1))
    v[200:240] = v[200]
    df = table(spark, v, labels=[1000 + i for i in range(300)])
    rows = nb.knn_self_join(df, k=None, threshold=0.2, block_rows=20, carry=["g"])
    assert collected(rows) == brute(v, list(range(300)), None, 0.2)
    assert rows.where("query_g <> query_id + 1000 or neighbor_g <> neighbor_id + 1000").count() == 0
    assert rows.where(nb.F.col("sim") != nb.F.round("sim", 9)).count() == 0
    plain = df.select(nb.F.col("posting_id").alias("_id"), nb.F.col("embedding").alias("_vec"))
    pivots = arcs._pivots(plain, 15, 16)
    placed = arcs.place(plain, pivots)
    cells = arcs.cells_of(placed, pivots)
    regions = arcs.regions_of(cells.rows, 40)
    both = [len(r._to) for r in arcs.route(placed, cells, None, 0.2, regions).collect()]
    routed = arcs.route(placed, cells, None, 0.2, regions, one_way=True).collect()
    assert all(min(r._to) >= regions[r._cell] for r in routed)
    assert sum(len(r._to) for r in routed) < 0.7 * sum(both)


def test_sets_pass_by_in_chunks_and_ranges(spark, monkeypatch):
    """Copies, odd vectors and lengths of their own; a set's queries are several blocks and its rows several ranges."""
    monkeypatch.setattr(nb, "_RANGE_CHUNKS", 2)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for name, n, dim in (("a", 90, 6), ("b", 25, 4), ("c", 3, 9)):
        v = unit(rng, n, dim)
        v[rng.choice(n, n // 3, replace=False)] = v[0]
        ids = [f"p{i:03d}" for i in rng.permutation(n)]
        rows += [(i, [float(x) for x in x_], name) for i, x_ in zip(ids, v)]
        rows.append((f"q{name}", [float("nan")] * dim, name))
        want[name] = brute(v, ids, 5, 0.2)
    frame = spark.createDataFrame(rows, "posting_id string, embedding array<float>, set string").repartition(3)
    for block_rows in (None, 7):
        found = nb.knn_self_join(frame, k=5, threshold=0.2, within=["set"], carry=["set"], block_rows=block_rows)
        for name in want:
            assert collected(found.where(found["set"] == name)) == want[name]
        assert found.where("query_set <> neighbor_set").count() == 0


def test_chunks_raise_the_floor_and_leave_k_rows_a_query(spark):
    v = unit(np.random.default_rng(6), 300, 8)
    rows = [(i, [float(x) for x in x_], "a") for i, x_ in enumerate(v)]
    frame = spark.createDataFrame(rows, "posting_id long, embedding array<float>, set string")
    search = nb.knn_self_join(frame, k=4, within=["set"], block_rows=50)
    emitted = nb._pass_by(
        frame.selectExpr("*", "6 as _blocks", "1 as _ranges", "50 as _chunk", "struct(set) as _cell"),
        "posting_id", "embedding", ["set"], 4, None, 8,
    )
    assert emitted.count() == 300 * 4  # pairs of blocks left 4 rows a query and block
    assert collected(search) == brute(v, list(range(300)), 4, None)


@pytest.mark.parametrize("spoilt", [0, 3])
def test_vectors_of_few_dimensions_are_compared_in_those(monkeypatch, spoilt):
    rng = np.random.default_rng(7)
    v = (unit(rng, 700, 9) @ rng.standard_normal((9, 96))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[rng.choice(700, 200, replace=False)] = v[1]
    v[698:, :] = unit(rng, 2, 96) * (spoilt > 0) + v[698:] * (spoilt == 0)  # rows that the draw of axes misses
    widths, flat = [], nb._Flat
    monkeypatch.setattr(nb, "_Flat", lambda x, axes: (widths.append(axes.shape[1]), flat(x, axes))[1])
    rank = rng.permutation(700)
    for k, threshold in [(6, None), (400, 0.5)]:
        got = {}
        for q, c, s in nb.best_pairs(v, v, rank, k, threshold):
            for a, b, sim in zip(q, c, s):
                got.setdefault(int(a), []).append((int(rank[b]), sim))
        want = brute(v, list(rank), k, threshold)
        assert got == {i: want[rank[i]] for i in range(700) if rank[i] in want}
    assert widths and max(widths) <= 9 + spoilt
