from __future__ import annotations

import hashlib
import warnings

import numpy as np
import pytest

from kinfold.operators import encoding, training
from kinfold.operators.projection import BN_EPS, DROPOUT, ProjectionHead, apply_head
from kinfold.plans.variants import fit_variants, run_variants


def test_text_encoding_batches_and_cleaning(spark):
    texts = [f"baju {i} murah" for i in range(30)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "posting_id long, title string").repartition(2)

    def factory():
        seen = []

        def encode(batch):
            seen.append(len(batch))
            assert len(batch) <= 7 and not any("murah" in t for t in batch)
            return np.array([[float(len(t)), 1.0] for t in batch])

        return encode

    got = {r["posting_id"]: r["embedding"] for r in encoding.encode_texts(df, factory, batch_size=7).collect()}
    assert len(got) == 32
    for i, text in enumerate(texts):
        clean = "nan" if text is None else text.replace("murah", "").strip()
        want = np.array([len(clean), 1.0])
        assert got[i] == pytest.approx(want / np.linalg.norm(want), abs=1e-6)


def test_hashed_words():
    v = encoding.HashedWords(16)(["tas Tas merah", "", "merah"])
    code = int(hashlib.md5(b"tas").hexdigest()[:8], 16)
    sign = 1 if code // 16 % 2 == 0 else -1
    assert v[0][code % 16] == 2 * sign + (v[2][code % 16])
    assert not v[1].any() and np.abs(v[0]).sum() == 3


def test_hashed_words_remembers_few(monkeypatch):
    monkeypatch.setattr(encoding, "_KNOWN_WORDS", 2)
    encoder = encoding.HashedWords(8)
    texts = ["tas merah", "biru tas", "", "satu dua tiga"]
    together = encoder(texts)
    assert (together == np.concatenate([encoder([t]) for t in texts])).all()
    assert len(encoder._known) <= 3


def test_grey_and_transparent_images():
    grey = {"height": 2, "width": 2, "nChannels": 1, "data": bytes([0, 64, 128, 255])}
    assert encoding.rgb_array(grey)[1, 1].tolist() == [255, 255, 255]
    bgra = {"height": 1, "width": 1, "nChannels": 4, "data": bytes([1, 2, 3, 9])}
    assert encoding.rgb_array(bgra)[0, 0].tolist() == [3, 2, 1]


@pytest.mark.parametrize("block", [3, 4096])
def test_arcface_matches_a_direct_computation(monkeypatch, block):
    monkeypatch.setattr(training, "_CLASS_BLOCK", block)
    rng = np.random.default_rng(0)
    e = rng.standard_normal((6, 5))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    labels = np.array([0, 3, 7, 3, 1, 6])
    options = {"margin_degrees": 20.0, "scale": 8.0, "seed": 3}
    loss, slope = training.arcface_loss_and_gradient(e, labels, 8, **options)
    blocks = [np.random.default_rng([3, b]).standard_normal((block, 5)) for b in range(-(-8 // block))]
    w = np.concatenate(blocks)[:8]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    cos = e @ w.T
    rows = np.arange(6)
    cos[rows, labels] = np.cos(np.arccos(cos[rows, labels]) + np.deg2rad(20))
    z = 8 * cos
    assert loss == pytest.approx(np.log(np.exp(z).sum(axis=1)) - z[rows, labels])
    step = 1e-6
    for i in range(6):
        for j in range(5):
            up, down = e.copy(), e.copy()
            up[i, j] += step
            down[i, j] -= step
            a = training.arcface_loss_and_gradient(up, labels, 8, **options)[0].sum()
            b = training.arcface_loss_and_gradient(down, labels, 8, **options)[0].sum()
            assert slope[i, j] == pytest.approx((a - b) / (2 * step), abs=1e-5)


def whole_loss(head, x, labels, keys, n_classes, options):
    """The training loss of one batch on one machine."""
    z = head.linear(x)
    normed = (z - z.mean(axis=0)) / np.sqrt(z.var(axis=0) + BN_EPS)
    keep = training.keep_mask(keys, len(head.bias), options["seed"], 0) / (1 - DROPOUT)
    y = (normed * head.bn_gamma + head.bn_beta) * keep
    e = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return training.arcface_loss_and_gradient(e, labels, n_classes, **options, gradient=False)[0].mean()


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_distributed_gradient_is_the_numeric_one(spark, parts):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((48, 4)).astype(np.float32)
    labels = rng.integers(0, 6, 48)
    keys = rng.integers(0, 2**60, 48)
    rows = [([float(v) for v in a], int(c), int(k)) for a, c, k in zip(x, labels, keys)]
    batch = spark.createDataFrame(rows, "embedding array<float>, class_id long, row_key long").repartition(parts)
    options = {"margin_degrees": 10.0, "scale": 5.0, "seed": 2}
    head = ProjectionHead.initial(4, 3, seed=5)
    loss, gradients = training.train_step(head, batch, 6, step=0, **options)
    x = x.astype(float)
    assert loss == pytest.approx(whole_loss(head, x, labels, keys, 6, options))
    for name, at in [("weight", (0, 1)), ("weight", (2, 3)), ("bn_gamma", (1,)), ("bn_beta", (2,)), ("bias", (0,))]:
        values = getattr(head, name)
        old, step = values[at], 1e-6
        values[at] = old + step
        up = whole_loss(head, x, labels, keys, 6, options)
        values[at] = old - step
        down = whole_loss(head, x, labels, keys, 6, options)
        values[at] = old
        assert gradients[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-5)
    assert head.bn_mean == pytest.approx(0.1 * head.linear(x).mean(axis=0), abs=1e-9)


def test_dropout_mask_drops_half():
    mask = training.keep_mask(np.arange(2000), 50, 1, 3)
    assert mask.mean() == pytest.approx(0.5, abs=0.01)
    assert (mask[7] == training.keep_mask(np.array([7]), 50, 1, 3)[0]).all()
    assert (mask != training.keep_mask(np.arange(2000), 50, 1, 4)).any()


def clusters(spark, n_groups=12, per_group=8, dim=8):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((n_groups, dim))
    rows = []
    for g in range(n_groups):
        for i in range(per_group):
            v = centres[g] + 0.6 * rng.standard_normal(dim)
            split = "train" if g < n_groups - 6 else ("val" if g < n_groups - 3 else "test")
            rows.append((f"p{g}_{i}", f"{g}.png", "title", g, split, "s", [float(x) for x in v / np.linalg.norm(v)]))
    schema = "posting_id string, image string, title string, label_group long, split string, stratum string, embedding array<float>"
    return spark.createDataFrame(rows, schema).repartition(3)


def test_fit_lowers_the_loss_and_repeats(spark):
    df = clusters(spark)
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    options = dict(projection_dim=16, num_epochs=4, batch_size=16, learning_rate=0.02, scale=8.0, margin_degrees=5.0)
    fit = training.fit_head(train, val, **options)
    losses = [v for _, k, v in fit.history if k == "train_loss"]
    assert losses[-1] < losses[0]
    rates = [v for _, k, v in fit.history if k == "learning_rate"]
    assert rates[0] == 0.02 and rates == sorted(rates, reverse=True)
    assert fit.parameters["num_classes"] == 9
    assert fit.metrics["avg_f1"] == max(v for _, k, v in fit.history if k == "avg_f1")
    again = training.fit_head(train, val, **options)
    assert again.head.weight == pytest.approx(fit.head.weight, abs=1e-6)
    lengths = [np.linalg.norm(r["embedding"]) for r in apply_head(val, fit.head).collect()]
    assert lengths == pytest.approx([1.0] * len(lengths), abs=1e-5)
    stored = ProjectionHead.from_table(fit.head.to_table(spark))
    assert (stored.weight == fit.head.weight).all() and (stored.bn_var == fit.head.bn_var).all()


def test_variants_skip_missing_inputs_and_tune_on_val(spark):
    df = clusters(spark)
    images = df.select("posting_id", "embedding")
    head = ProjectionHead.initial(8, 6)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        table = run_variants(df.drop("embedding"), {"images": images}, heads={"images": head})
    assert {str(w.message).split()[1] for w in caught if "skipped" in str(w.message)} == {
        "titles", "multimodal_concat", "multimodal_sum"
    }
    got = table.toPandas()
    assert set(got.variant) == {"images"} and set(got["head"]) == {"frozen", "projected"}
    for _, part in got.groupby("head"):
        val, test = part[part.split == "val"], part[part.split == "test"]
        assert len(val) == 9 and len(test) == 1
        assert test.threshold.iloc[0] == val.sort_values(["avg_f1", "threshold"], ascending=[False, True]).threshold.iloc[0]


def test_heads_fitted_together_are_those_fitted_alone(spark):
    df = clusters(spark).withColumn("other", training.F.reverse("embedding")).withColumn(
        "long", training.F.concat("embedding", "other")
    )
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    options = dict(projection_dim=12, num_epochs=3, batch_size=16, learning_rate=0.02, scale=8.0, margin_degrees=5.0)
    both = training.fit_heads(train, val, {"a": "embedding", "b": "long"}, **options)
    for name, column in (("a", "embedding"), ("b", "long")):
        alone = training.fit_head(train, val, vec_col=column, **options)
        assert both[name].head.weight == pytest.approx(alone.head.weight, abs=1e-6)
        assert both[name].head.bn_var == pytest.approx(alone.head.bn_var, abs=1e-6)
        assert [h[:2] for h in both[name].history] == [h[:2] for h in alone.history]
        assert [h[2] for h in both[name].history] == pytest.approx([h[2] for h in alone.history], abs=1e-6)
        assert both[name].parameters["input_dim"] == len(both[name].head.weight[0])


def test_a_head_stops_while_others_go_on(spark):
    df = clusters(spark).withColumn("flat", training.F.transform("embedding", lambda x: x * 0 + 1.0).cast("array<float>"))
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    fits = training.fit_heads(
        train, val, {"good": "embedding", "flat": "flat"}, projection_dim=8, num_epochs=6, batch_size=16,
        learning_rate=0.05, scale=8.0, margin_degrees=5.0, early_stopping_patience=1,
    )
    epochs = {name: max(h[0] for h in fit.history) for name, fit in fits.items()}
    assert epochs["flat"] == 2  # equal vectors give the same F1 in every epoch
    assert epochs["good"] >= epochs["flat"]


@pytest.mark.parametrize("n_classes,shard_blocks", [(100, 8), (5000, 1), (9000, 2), (90_000, 1)])
def test_sharded_softmax_is_the_whole_one(spark, n_classes, shard_blocks):
    """Blocks hold 2,048 classes; 44 shards are more than are merged at once."""
    rng = np.random.default_rng(0)
    units = []
    for dim in (3, 4):
        e = rng.standard_normal((9, dim))
        units.append(e / np.linalg.norm(e, axis=1, keepdims=True))
    labels = rng.integers(0, n_classes, 9)
    options = {"margin_degrees": 20.0, "scale": 8.0, "seed": 3}
    found = training.sharded_softmax(spark, units, labels, n_classes, shard_blocks=shard_blocks, **options)
    for e, (loss, slope) in zip(units, found):
        want_loss, want_slope = training.arcface_loss_and_gradient(e, labels, n_classes, **options)
        assert loss == pytest.approx(want_loss) and slope == pytest.approx(want_slope, abs=1e-9)


def test_joined_sums_of_class_ranges_are_those_of_all():
    rng = np.random.default_rng(2)
    e = rng.standard_normal((6, 5))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    labels = np.array([0, 3, 2100, 4500, 1, 6000])
    options = (6200, 0.1, 8.0, 3)
    parts = [list(training.log_sums(e, labels, [start], *options)) for start in (0, 2048, 4096)]
    for joined in (training._joined(parts), training._joined(parts[::-1])):
        for got, want in zip(joined, training.log_sums(e, labels, (0, 2048, 4096), *options)):
            assert got == pytest.approx(want)


def test_a_step_with_dealt_classes_is_the_same_step(spark):
    rng = np.random.default_rng(1)
    n_classes = 5000  # three blocks
    rows = [([float(x) for x in rng.standard_normal(4)], int(rng.integers(0, n_classes)), int(k)) for k in range(40)]
    batch = spark.createDataFrame(rows, "embedding array<float>, class_id long, row_key long").repartition(3)
    options = {"margin_degrees": 10.0, "scale": 5.0, "seed": 2, "step": 0}
    results = []
    for shard in (10_000, 100):
        head = ProjectionHead.initial(4, 3, seed=5)
        results.append((*training.train_step(head, batch, n_classes, shard_classes=shard, **options), head.bn_mean))
    (loss, gradients, mean), (loss2, gradients2, mean2) = results
    assert loss == pytest.approx(loss2) and mean == pytest.approx(mean2)
    for name in gradients:
        assert gradients[name] == pytest.approx(gradients2[name], abs=1e-9)


def test_the_whole_matrix_has_every_variant_frozen_and_projected(spark):
    df = clusters(spark)
    images = df.select("posting_id", "embedding")
    titles = df.select("posting_id", training.F.reverse("embedding").alias("embedding"))
    options = dict(projection_dim=8, num_epochs=2, batch_size=16, learning_rate=0.02, scale=8.0, margin_degrees=5.0)
    rows = df.drop("embedding")
    fits = fit_variants(rows, {"images": images, "titles": titles}, **options)
    assert {n: f.parameters["fusion_type"] for n, f in fits.items()} == {
        "images": "none", "titles": "none", "multimodal_concat": "concat", "multimodal_sum": "sum"
    }
    heads = {n: f.head for n, f in fits.items()}
    got = run_variants(rows, {"images": images, "titles": titles}, heads=heads).toPandas()
    assert len(got) == 4 * 2 * 10
    assert got.groupby(["variant", "head", "split"]).size().to_dict() == {
        (v, h, s): n for v in heads for h in ("frozen", "projected") for s, n in (("val", 9), ("test", 1))
    }
    # a vector and its reverse agree on all similarities, alone and side by side
    frozen = got[got["head"] == "frozen"].set_index(["variant", "split", "threshold"])["avg_f1"]
    assert frozen.loc["images"].tolist() == pytest.approx(frozen.loc["titles"].tolist())
    assert frozen.loc["images"].tolist() == pytest.approx(frozen.loc["multimodal_concat"].tolist())


def test_a_long_batch_is_projected_and_judged_in_tiles(spark):
    class Narrow(ProjectionHead):
        most = 1024

        def project(self, x):
            assert len(x) <= self.most
            return ProjectionHead.project(self, x)

    rng = np.random.default_rng(4)
    v = rng.standard_normal((2500, 3)).astype(np.float32)
    rows = [(i, i % 5, i // 256, None if i == 1030 else x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "posting_id long, class_id long, batch long, embedding array<float>").coalesce(1)
    plain = ProjectionHead.initial(3, 4)
    head = Narrow(**vars(plain))
    got = {r.posting_id: r.embedding for r in apply_head(df, head).collect()}
    want = plain.project(v.astype(np.float64)).astype(np.float32)
    assert got.pop(1030) is None and len(got) == 2499
    for i, x in got.items():
        assert np.allclose(x, want[i], atol=1e-7)
    head.most = 512
    options = {"margin_degrees": 10.0, "scale": 4.0, "seed": 1}
    val = df.where("posting_id <> 1030").select("class_id", "batch", "embedding")
    loss = training._validation_losses([head], val, 5, options)[0]
    own = np.delete(np.arange(2500), 1030)
    unit = plain.project(v[own].astype(np.float64))
    each, _ = training.arcface_loss_and_gradient(unit, own % 5, 5, **options, gradient=False)
    means = [each[own // 256 == b].mean() for b in range(10)]
    assert np.isclose(loss, np.mean(means))
