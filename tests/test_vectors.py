from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import vectors as vx
from kinfold.operators import embeddings as emb
from kinfold.operators import prototypes as proto


def frame(spark, rows, id_type="long"):
    return spark.createDataFrame(rows, f"posting_id {id_type}, embedding array<float>").repartition(3)


def vectors_of(df, column="embedding"):
    return {r["posting_id"]: None if r[column] is None else np.array(r[column]) for r in df.collect()}


def test_l2_normalize_with_zero_and_null(spark):
    df = frame(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [-2.0, 0.0])])
    got = vectors_of(df.withColumn("embedding", vx.l2_normalize(F.col("embedding"))))
    assert got[1] == pytest.approx([0.6, 0.8]) and got[4] == pytest.approx([-1, 0])
    assert list(got[2]) == [0, 0] and got[3] is None


@pytest.mark.parametrize("how", ["concat", "sum"])
def test_fusion_matches_numpy(spark, how):
    rng = np.random.default_rng(0)
    a, b, c = rng.standard_normal((3, 20, 6)).astype(np.float32)
    tables = [frame(spark, [(i, [float(x) for x in m[i]]) for i in range(20)]) for m in (a, b, c)]
    got = vectors_of(emb.combine_modalities(tables, how))
    want = np.concatenate([a, b, c], axis=1) if how == "concat" else a + b + c
    want = want / np.linalg.norm(want, axis=1, keepdims=True)
    for i in range(20):
        assert got[i] == pytest.approx(want[i], abs=1e-6)


def test_one_modality_passes_through(spark):
    df = frame(spark, [(1, [3.0, 4.0])])
    assert list(vectors_of(emb.combine_modalities([df]))[1]) == [3, 4]


def test_fusion_arguments_and_mismatches(spark):
    a, b = frame(spark, [(1, [1.0]), (2, [1.0])]), frame(spark, [(1, [1.0]), (3, [2.0])])
    with pytest.raises(ValueError):
        emb.combine_modalities([a, b], "mean")
    with pytest.raises(Exception, match="missing from a modality"):
        emb.combine_modalities([a, b], "sum").collect()
    assert set(vectors_of(emb.combine_modalities([a, b], "sum", strict=False))) == {1}
    with pytest.raises(Exception, match="lengths"):
        emb.combine_modalities([a, frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])], "sum").collect()


def test_attach_embeddings_checks_every_row(spark):
    rows = spark.createDataFrame([(1, "train"), (2, "test"), (9, "test")], "posting_id long, split string")
    vectors = frame(spark, [(1, [1.0]), (2, [2.0]), (3, [3.0])])
    assert emb.attach_embeddings(emb.select_split(rows, "train"), vectors).count() == 1
    with pytest.raises(Exception, match="no embedding for 9"):
        emb.attach_embeddings(rows, vectors).collect()
    assert emb.attach_embeddings(rows, vectors, strict=False).count() == 2


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), (None, [1.0, 1.0]), ([1.0, 1.0], None)], "a array<float>, b array<float>")
    assert [r[0] for r in df.coalesce(1).select(vx.dot(F.col("a"), F.col("b"))).collect()] == [11.0, None, None]


@pytest.mark.parametrize("limit", [proto.BROADCAST_BYTES, 0])
def test_prototype_scores_broadcast_and_blocked(spark, monkeypatch, limit):
    monkeypatch.setattr(proto, "_BLOCK_BYTES", 3 * 8 * 8)  # three prototypes a block
    rng = np.random.default_rng(1)
    x, p = rng.standard_normal((10, 8)).astype(np.float32), rng.standard_normal((7, 8)).astype(np.float32)
    rows = frame(spark, [(i, [float(v) for v in x[i]]) for i in range(10)] + [(99, None)])
    classes = spark.createDataFrame([(i * 10, [float(v) for v in p[i]]) for i in range(7)], "class_id int, embedding array<float>")
    got = vectors_of(proto.classify_by_prototypes(rows, classes, scale=3, broadcast_bytes=limit), "probs")
    scores = 3 * x.astype(float) @ p.T.astype(float)
    want = np.exp(scores - scores.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    assert got.pop(99) is None and len(got) == 10
    for i in range(10):
        assert got[i] == pytest.approx(want[i], abs=1e-9)
        assert got[i].sum() == pytest.approx(1)


def test_equal_prototypes_score_equally(spark):
    rows = frame(spark, [(i, [1.0] * 4) for i in range(3)])
    classes = spark.createDataFrame([(i, [1.0] * 4) for i in range(2)], "class_id int, embedding array<float>")
    for v in vectors_of(proto.classify_by_prototypes(rows, classes), "probs").values():
        assert list(v) == [0.5, 0.5]


def test_class_prototypes_are_unit_means(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 5)).astype(np.float32)
    labels = rng.integers(0, 3, 50)
    df = spark.createDataFrame([(int(g), [float(v) for v in r]) for g, r in zip(labels, x)], "label int, embedding array<float>").repartition(4)
    for r in proto.class_prototypes(df).collect():
        mean = x[labels == r["class_id"]].astype(float).sum(axis=0)
        assert r["embedding"] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-6)


def test_repeated_and_null_ids_are_classified_alike_on_both_paths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (2, None)], "posting_id long, embedding array<double>")
    classes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "class_id int, embedding array<double>")
    one = proto.classify_by_prototypes(rows, classes).collect()
    two = proto.classify_by_prototypes(rows, classes, broadcast_bytes=0).collect()
    plain = lambda found: sorted((str(r["posting_id"]), str(r["embedding"]), [round(p, 9) for p in r["probs"] or []]) for r in found)
    assert plain(one) == plain(two) and len(two) == 4
