from __future__ import annotations

import json

import pytest

from kinfold.operators import metrics as mx
from kinfold.plans.retrieval import evaluate

SCHEMA = "posting_id string, label_group long, stratum string, retrieved_products string"


def frame(spark, ids, groups, lists, strata=None):
    strata = strata or ["low"] * len(ids)
    rows = [(i, g, s, json.dumps(x)) for i, g, s, x in zip(ids, groups, strata, lists)]
    return spark.createDataFrame(rows, SCHEMA)


# Eight listings in three groups; every list is given as ids and scored by hand-written rules below.
GROUP = {"k": 10, "l": 10, "m": 10, "n": 20, "o": 20, "p": 30, "q": 30, "r": 30}
LISTS = {
    "k": ["k", "m", "n", "l"], "l": ["l"], "m": ["o", "n"], "n": ["n", "o", "k"],
    "o": [], "p": ["q", "q", "r"], "q": ["missing", "q"], "r": ["r", "p", "q"],
}


def expected(posting_id: str, ks: list[int]) -> dict[str, float]:
    found = [GROUP.get(i) == GROUP[posting_id] for i in LISTS[posting_id]]
    size = sum(g == GROUP[posting_id] for g in GROUP.values())
    precision = sum(found) / len(found) if found else 0.0
    recall = sum(found) / size
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return {"precision": precision, "recall": recall, "f1": f1, **{f"recall-{k}": sum(found[:k]) / size for k in ks}}


@pytest.mark.parametrize("ks", [[1], [2, 3, 50]])
def test_per_row_values(spark, ks):
    rows = mx.compute_per_row_metrics(frame(spark, list(GROUP), list(GROUP.values()), list(LISTS.values())), ks)
    assert rows.columns == ["posting_id", "label_group", "stratum", "precision", "recall", "f1", *[f"recall-{k}" for k in ks]]
    got = {r["posting_id"]: r for r in rows.collect()}
    assert got.keys() == GROUP.keys()
    for posting_id in GROUP:
        for name, value in expected(posting_id, ks).items():
            assert got[posting_id][name] == pytest.approx(value), (posting_id, name)


def test_hot_ids_give_the_same_metrics(spark, monkeypatch):
    ids = [f"p{i}" for i in range(40)]
    groups = [i % 3 for i in range(40)]
    lists = [["p0", ids[i], f"p{(i * 7) % 40}"] for i in range(40)]
    df = frame(spark, ids, groups, lists)
    plain = sorted(map(tuple, mx.compute_per_row_metrics(df, [1, 2]).collect()))
    import kinfold.operators.joins as joins

    real = joins.hot_key_lookup
    monkeypatch.setattr(mx, "hot_key_lookup", lambda *a, **k: real(*a, **k, hot_rows=2))
    assert sorted(map(tuple, mx.compute_per_row_metrics(df, [1, 2]).collect())) == plain


def test_array_lists_and_long_form_agree(spark):
    df = frame(spark, list("abcd"), [1, 1, 1, 2], [list("abd"), list("ba"), [], list("d")])
    as_json = sorted(map(tuple, mx.compute_per_row_metrics(df, [2]).collect()))
    group = dict(zip("abcd", [1, 1, 1, 2]))
    long = [
        (q, r + 1, n, 1.0, group[q], group[n])
        for q, ns in zip("abcd", ["abd", "ba", "", "d"])
        for r, n in enumerate(ns)
    ]
    neighbors = spark.createDataFrame(
        long, "query_id string, rank int, neighbor_id string, sim double, query_label_group long, neighbor_label_group long"
    )
    assert sorted(map(tuple, mx.metrics_from_neighbors(df, neighbors, [2]).collect())) == as_json
    running = {(r["query_id"], r["rank"]): r["matches"] for r in mx.running_matches(neighbors).collect()}
    assert running == {("a", 1): 1, ("a", 2): 2, ("a", 3): 2, ("b", 1): 1, ("b", 2): 2, ("d", 1): 1}


METRICS = "posting_id string, label_group long, stratum string, precision double, recall double, f1 double, `recall-5` double"


def test_means(spark):
    df = spark.createDataFrame([("a", 1, "s", 0.2, 0.4, 0.6, 0.8), ("b", 1, "s", 0.4, 0.8, 0.0, 0.2), ("c", 2, "t", 0.6, 0.6, 0.3, 0.5)], METRICS)
    assert list(mx.summarize_metrics(df).first()) == pytest.approx([0.4, 0.6, 0.3, 0.5])
    renamed = df.withColumnRenamed("label_group", "family")
    assert len(mx.summarize_metrics(renamed, group_col="family").columns) == 4


def test_means_by_stratum(spark):
    values = [("a", "s", 0.1), ("b", "s", 0.3), ("c", "t", 0.4), ("d", "s", 0.8), ("e", None, 1.0)]
    df = spark.createDataFrame([(i, 1, s, v, v, v, v) for i, s, v in values], METRICS)
    got = {r["stratum"]: r["precision"] for r in mx.summarize_by_stratum(df).collect()}
    assert got == pytest.approx({"s": 0.4, "t": 0.4})


def test_evaluate_job(spark):
    df = frame(spark, list("abc"), [1, 1, 2], [list("ab"), list("ba"), list("c")], ["x", "x", "y"])
    result = evaluate(df, [1])
    assert result.rows.count() == 3
    assert result.overall.first()["f1"] == 1.0
    assert {r["stratum"] for r in result.by_stratum.collect()} == {"x", "y"}


def test_grid_is_the_filter_at_each_threshold(spark):
    products = spark.createDataFrame([("a", 1, "s"), ("b", 1, "s"), ("c", 2, "s")], "posting_id string, label_group long, stratum string")
    sims = {("a", "a"): 1.0, ("a", "c"): 0.7, ("a", "b"): 0.4, ("b", "b"): 1.0, ("b", "a"): 0.4, ("c", "c"): 1.0, ("c", "a"): 0.7}
    group = {"a": 1, "b": 1, "c": 2}
    seen, rows = {}, []
    for (q, n), s in sims.items():
        seen[q] = seen.get(q, 0) + 1
        rows.append((q, seen[q], n, s, group[q], group[n]))
    neighbors = spark.createDataFrame(
        rows, "query_id string, rank int, neighbor_id string, sim double, query_label_group long, neighbor_label_group long"
    )
    grid = mx.metrics_by_threshold(products, neighbors, [0.3, 0.5, 0.9], [1, 2])
    for t in (0.3, 0.5, 0.9):
        kept = neighbors.where(neighbors.sim >= t)
        want = sorted(map(tuple, mx.metrics_from_neighbors(products, kept, [1, 2]).collect()))
        assert sorted(map(tuple, grid.where(grid.threshold == t).drop("threshold").collect())) == want
    summary = mx.summarize_grid(grid)
    assert [r["threshold"] for r in summary.collect()] == [0.3, 0.5, 0.9]
    best = mx.best_threshold(summary).first()
    assert best["avg_f1"] == max(r["avg_f1"] for r in summary.collect())


def test_best_threshold_takes_the_lowest_of_equals(spark):
    df = spark.createDataFrame([(0.3, 0.5), (0.2, 0.5), (0.1, 0.4)], "threshold double, avg_f1 double")
    assert mx.best_threshold(df).first()["threshold"] == 0.2


def test_recall_at_zero_is_refused(spark):
    with pytest.raises(ValueError):
        mx.compute_per_row_metrics(frame(spark, ["a"], [1], [["a"]]), [0])
