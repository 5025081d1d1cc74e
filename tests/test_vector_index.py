from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from kinfold.operators import neighbors as nb
from kinfold.operators import vector_index as vi


def rows_of(spark, v, parts=3):
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    return spark.createDataFrame(rows, "posting_id long, embedding array<float>").repartition(parts)


def clustered(n, groups, d, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((groups, d))[rng.integers(0, groups, n)] + 0.3 * rng.standard_normal((n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def lists_of(found):
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["neighbor_id"], r["sim"]))
    return got


@pytest.mark.parametrize("group_rows", [32_768, 20])
def test_a_search_is_exact_among_the_probed_lists(spark, monkeypatch, group_rows):
    """Twenty rows a group cut lists into chunks and their queries into slices."""
    monkeypatch.setattr(vi, "_GROUP_ROWS", group_rows)
    v = clustered(300, 9, 8)
    df = rows_of(spark, v)
    index = vi.build_index(df, lists=7)
    own = vi.nearest_lists(index.centroids, v.astype(float), 2)
    sims = np.round(v.astype(float) @ v.astype(float).T, nb.SIM_DECIMALS)
    want = {}
    for i in range(300):
        held = [j for j in range(300) if own[j, 0] in own[i]]
        want[i] = [(j, sims[i, j]) for j in sorted(held, key=lambda j: (-sims[i, j], j))[:5]]
    assert lists_of(vi.search(index, df, df, k=5, probes=2, refine=8)) == want


def test_all_lists_give_the_exact_answer_and_recall_is_measured(spark):
    df = rows_of(spark, clustered(400, 12, 16, seed=3))
    index = vi.build_index(df)
    everything = len(index.centroids)
    assert lists_of(vi.search(index, df, df, k=6, probes=everything, refine=8)) == lists_of(nb.knn_self_join(df, k=6))
    assert vi.measured_recall(index, df, k=6, probes=everything, refine=8, sample=50) == 1.0
    probes, recall = vi.probes_for(index, df, recall=0.9, k=6)
    assert recall >= 0.9 and 1 <= probes < everything
    found = vi.search(index, df, df, k=6, probes=probes).join(
        nb.knn_self_join(df, k=6).select("query_id", "neighbor_id"), ["query_id", "neighbor_id"], "left_semi"
    )
    assert found.count() >= 0.85 * 6 * 400


def test_a_stored_index_answers_like_the_built_one(spark, tmp_path):
    df = rows_of(spark, clustered(120, 5, 6, seed=1))
    index = vi.build_index(df, lists=4)
    index.save(f"{tmp_path}/index")
    stored = vi.VectorIndex.load(spark, f"{tmp_path}/index")
    assert (stored.centroids == index.centroids).all()
    asked = df.where("posting_id < 30")
    assert lists_of(vi.search(stored, asked, df, k=4, probes=2)) == lists_of(vi.search(index, asked, df, k=4, probes=2))


def test_rounds_bring_centroids_nearer(spark):
    v = clustered(500, 6, 5, seed=2)
    df = rows_of(spark, v, parts=5)

    def spread(c):
        place = vi.nearest_lists(c, v.astype(float))[:, 0]
        return ((v - c[place]) ** 2).sum()

    start, after = (vi.fit_centroids(df, 6, rounds=r) for r in (0, 5))
    assert spread(after) < spread(start)
    again = vi.fit_centroids(df.repartition(2), 6, rounds=5)
    assert again == pytest.approx(after, abs=1e-9)


def test_codes_come_back_within_half_a_step():
    x = np.random.default_rng(0).standard_normal((50, 9)) * 3
    x[7] = 0
    code, scale = vi.encode(x)
    assert np.abs(code * scale[:, None] - x).max(axis=1) == pytest.approx(scale / 2, abs=scale.max() / 2 + 1e-12)


def test_odd_vectors_are_left_out(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "posting_id long, embedding array<float>")
    index = vi.build_index(df.where("posting_id <> 2"), lists=2)
    found = lists_of(vi.search(index, df, df, k=9, probes=9))
    assert set(found) == {0, 3, 4, 5} and [n for n, _ in found[0]][:2] == [0, 5]
    with pytest.raises(ValueError):
        vi.build_index(df.limit(0))


def test_scores_of_a_long_list_stay_within_a_tile():
    """Two thousand queries meet twenty thousand entries: all scores would be 160 MB, a tile of old 80 and more."""
    rng = np.random.default_rng(3)
    asked, held = 2000, 20_000
    queries = rng.standard_normal((asked, 4))
    codes = rng.integers(-127, 128, (held, 4)).astype(np.int8)
    n = asked + held
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)),
            pa.array([q.tolist() for q in queries] + [None] * held, pa.list_(pa.float64())),
            pa.array([None] * asked + [c.tobytes() for c in codes], pa.binary()),
            pa.array([None] * asked + [0.01] * held, pa.float64()), pa.array(np.arange(n) < asked),
        ],
        ["list", "id", "vec", "code", "scale", "asks"],
    )
    score = vi._score_lists(3, SimpleNamespace(value=np.zeros((1, 4))))
    tracemalloc.start()
    best = pa.Table.from_batches(list(score(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    want = np.argsort(-(queries.astype(np.float32) @ codes.T.astype(np.float32)), axis=1)[:, :3] + asked
    got = best["neighbor_id"].to_numpy().reshape(asked, 3)
    assert (np.sort(got, axis=1) == np.sort(want, axis=1)).all()
