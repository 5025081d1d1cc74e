"""Collocations, the byte network and whitening against plain computations."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from kinfold.llm import byte_net, collocations, whitening
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"

# ---- collocations ----

DOCS = "doc_id long, text string, lang string, rank string, phrase long, n string, score string, id string, c long"


def phrase_texts(seed: int = 4) -> list[tuple[str | None, str | None]]:
    rng = random.Random(seed)
    names = ["new", "York", "city", "of", "the", "hall", "é", "x" * 300, "a'b", "ZÜG", " "]
    rows: list[tuple[str | None, str | None]] = [(None, "en"), ("", "en"), (" \t\n", None), (".,;", "de"), ("one", "en")]
    for k in range(120):
        words = rng.choices(names, k=rng.randint(1, 14))
        if k % 3 == 0:
            words[1:1] = ["New", "york", "city", "hall", "of", "Fame"]
        if k % 4 == 0:
            words += ["the"] * 7
        gaps = [rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "! "]) for _ in words]
        rows.append(("".join(w + g for w, g in zip(words, gaps)), rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, rows[9], (" ".join(["long", "text"] * 4000), "en")]


def expected_collocations(rows, least: int, top: int) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i : i + size])] += 1
    found = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, words), a in found.items():
        inside = lambda longer: any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        if any(x == lang and len(w) > len(words) and inside(w) and 100 * b >= 100 * a for (x, w), b in found.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = count[lang, words[:k]], count[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, total[lang], score))
    ranked, place = [], Counter()
    for lang, phrase, a, left, right, n, score in sorted(out, key=lambda r: (-r[6], -r[2], r[1].encode())):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase, a, left, right, n, score))
    return sorted(ranked)


@pytest.fixture(scope="module")
def phrase_docs(spark):
    rows = [(i, t, lang, "r", 1, "n", "s", "i", 2) for i, (t, lang) in enumerate(phrase_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.mark.parametrize("least,head,top", [(5, 1 << 20, 2000), (5, 6, 2000), (3, 1 << 20, 4)])
def test_collocations_are_those_of_a_direct_count(phrase_docs, least, head, top):
    """A head of six entries sends most words and pairs through the join."""
    found = collocations.collocations(phrase_docs, min_count=least, head=head, top=top)
    want = expected_collocations(phrase_texts(), least, top)
    assert sorted(tuple(r) for r in found.collect()) == want and want
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_empty_tables(spark, phrase_docs):
    assert collocations.collocations(phrase_docs.limit(0)).count() == 0
    silent = spark.createDataFrame([(None, None), ("", "en"), ("...", "en")], "text string, lang string")
    assert collocations.collocations(silent, min_count=1).count() == 0


def test_crowded_and_thin_tiles_count_alike(monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 4)
    rng = np.random.default_rng(0)
    counter, want = collocations.TileCounter(), Counter()
    got: Counter = Counter()
    for _ in range(5):
        a, b = rng.geometric(0.2, 50) - 1, rng.geometric(0.2, 50) - 1
        counter.add(a, b)
        want.update(zip(a.tolist(), b.tolist()))
        codes, counts = counter.settle()
        got.update({(int(c) >> 32, int(c) & 0xFFFFFFFF): int(n) for c, n in zip(codes, counts)})
    assert counter.dense  # the corner became a dense tile
    for codes, counts in counter.dense_cells():
        got.update({(int(c) >> 32, int(c) & 0xFFFFFFFF): int(n) for c, n in zip(codes, counts)})
    assert got == want


def test_ids_follow_falling_counts(spark):
    rows = [(lang, f"w{i}", 1000 // (i + 1)) for i in range(60) for lang in ("en", "de")]
    ranked = collocations._ranked(spark.createDataFrame(rows, "lang string, word string, c long").repartition(7), ["word"])
    for lang in ("en", "de"):
        mine = sorted((r.id, -r.c, r.word) for r in ranked.where(F.col("lang") == lang).collect())
        assert [m[0] for m in mine] == list(range(60))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)


# ---- the byte network ----


def plain_probability(net: byte_net.ByteNet, text: bytes) -> float:
    positions = max(1, len(text))
    data = text + b"\0" * 600
    answers = np.array([sum(net.tables[k][data[p + k]] for k in range(byte_net.WINDOW)) for p in range(positions)])
    hidden = []
    for at in range(0, max(1, positions - byte_net.STEP), byte_net.STEP):
        best = answers[at : at + byte_net.CHUNK].max(0)
        hidden.append(np.maximum(np.maximum(best + net.bias, 0) @ net.dense + net.dense_bias, 0))
    pooled = np.concatenate((np.mean(hidden, 0), np.max(hidden, 0)))
    return 1 / (1 + math.exp(-(pooled @ net.out + net.out_bias)))


def random_net() -> byte_net.ByteNet:
    rng = np.random.default_rng(3)
    net = byte_net.ByteNet.start()
    net.bias, net.dense_bias = rng.standard_normal(byte_net.FILTERS), rng.standard_normal(byte_net.HIDDEN)
    net.out_bias = 0.3
    return net


def test_scores_are_those_of_a_plain_pass_over_every_position():
    rng = random.Random(1)
    lengths = [0, 1, 2, 5, 6, 63, 64, 65, 127, 128, 129, 255, 256, 257, 300, 384, 385, 512, 1000, 5000]
    texts = [bytes(rng.choices(range(256), k=n)) for n in lengths]
    net = random_net()
    want = [plain_probability(net, t) for t in texts]
    assert np.allclose(byte_net._Scorer(net).texts(texts), want, atol=1e-5)
    alone = np.concatenate([byte_net._Scorer(net).texts([t]) for t in texts])
    assert (alone == byte_net._Scorer(net).texts(texts)).all()  # neighbours in a batch do not matter


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    size = byte_net.CHUNK + byte_net.WINDOW - 1
    texts = [rng.integers(97, 105, (n, size)).astype(np.uint8) for n in (1, 3, 2)]
    wanted = np.array([1.0, 0.0, 1.0])
    net = random_net()
    net.tables = net.tables.astype(np.float64)

    def loss() -> float:
        total = 0.0
        for t, w in zip(texts, wanted):
            answers = sum(net.tables[k][t[:, k : k + byte_net.CHUNK]] for k in range(byte_net.WINDOW))
            hidden = np.maximum(np.maximum(answers.max(1) + net.bias, 0) @ net.dense + net.dense_bias, 0)
            z = np.concatenate((hidden.mean(0), hidden.max(0))) @ net.out + net.out_bias
            total += np.logaddexp(0, -z) if w else np.logaddexp(0, z)
        return total / len(texts)

    gradient = byte_net._gradient(net, texts, wanted, decay=0.0)
    for name in ("tables", "bias", "dense", "dense_bias", "out"):
        weights, own = getattr(net, name), np.asarray(gradient[name])
        for at in np.argsort(-np.abs(own).ravel())[:5]:
            where = np.unravel_index(at, own.shape)
            old = weights[where]
            weights[where] = old + 1e-6
            up = loss()
            weights[where] = old - 1e-6
            down = loss()
            weights[where] = old
            assert abs((up - down) / 2e-6 - own[where]) < 1e-5


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = byte_net.score(docs, byte_net.fit(docs, labels), keep=["doc_id"]).join(labels, "doc_id")
    rows = rows.where(byte_net.fold() == byte_net.HELD_OUT).select("predicted", "score", "quality").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.8 * len(bad) and len(bad) > 5


def test_byte_net_odd_rows(spark):
    schema = "doc_id long, text string, score string, predicted string, label string, digest string, quality string"
    texts = [None, "", "é" * 50_000, "good words here", "good words here", "### %%% &&&"]
    docs = spark.createDataFrame([(i if i != 4 else 3, t, "s", "p", "l", "d", "q") for i, t in enumerate(texts)], schema)
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (0, 1), (None, 1), (2, None), (1, 1)], "doc_id long, quality int")
    net = byte_net.fit(docs, labels, epochs=1, min_steps=1)
    rows = byte_net.score(docs, net).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert rows[0].score == rows[1].score and rows[3].score == rows[4].score
    assert set(docs.columns) <= set(byte_net.score(docs, net).columns)
    one = byte_net.fit(docs, labels.where("quality = 1"), epochs=1)
    assert {r.predicted for r in byte_net.score(docs, one).collect()} == {1}
    none = byte_net.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in byte_net.score(docs, none).collect()} == {0.5}
    assert byte_net.score(docs.limit(0), none).count() == 0


def test_training_chunks_are_bounded_and_reach_the_end():
    text = bytes(range(256)) * 400
    chunks = byte_net.training_chunks(text, 12)
    assert len(chunks) == 12 * (byte_net.CHUNK + byte_net.WINDOW - 1)
    assert chunks.rstrip(b"\0").endswith(text[-10:])


# ---- whitening ----

VECTORS = "vec_id long, embedding array<float>, component string, n string, deviation string, explained string, i long"


def expected_whitening(vectors: list[list[float]]):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    u = [[n * a - s for a, s in zip(row, sums)] for row in x]
    deviation = [sum(a * a for a in row) for row in u]
    size = len(sums)
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in u), n**3)) for j in range(size)] for i in range(size)])
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    white = np.array(u, float) / n @ directions / np.sqrt(values)
    return n, deviation, white, values / np.trace(v)


def compare_whitening(rows, vectors: dict[int, list[float]]):
    keys = sorted(vectors)
    n, deviation, white, explained = expected_whitening([vectors[k] for k in keys])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(keys) * min(8, white.shape[1])
    for c in range(white.shape[1]):
        own = np.array([got[k, c + 1].whitened for k in keys])
        assert np.allclose(own, white[:, c], atol=1e-7) or np.allclose(own, -white[:, c], atol=1e-7)
        assert abs(got[keys[0], c + 1].explained - explained[c]) <= 1e-9
    assert all(int(got[k, 1].deviation) == d and got[k, 1].n == n for k, d in zip(keys, deviation))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8


def test_whitening_of_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = {r.vec_id: [float(c) for c in r.embedding] for r in table.collect()}
    compare_whitening(whitening.whiten(table.repartition(7), keep=["vec_id"]).collect(), vectors)


def test_whitening_leaves_odd_vectors_out(spark):
    rng = np.random.default_rng(1)
    good = {i: [float(np.float32(c)) for c in rng.normal(-3, 9, 5)] for i in range(40)}
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 0.0, 0.0, 0.0], [float("inf")] * 5, [1.0, 2.0], [None] * 5]
    rows = [(k, v) for k, v in good.items()] + [(100 + k, v) for k, v in enumerate(odd)]
    table = spark.createDataFrame([(k, v, "c", "n", "d", "e", 1) for k, v in rows], VECTORS).repartition(4)
    white = whitening.whiten(table)
    compare_whitening(white.collect(), good)
    assert white.columns == ["vec_id", "i", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    copies = spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)
    assert whitening.whiten(copies).count() == 0  # no variance, no component
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(10)], schema)
    rows = whitening.whiten(line).collect()
    assert len(rows) == 10 and {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-9


def test_sums_stay_exact_beyond_doubles_and_longs(spark):
    values = [[1e15, -3.0], [-1e15, 1e9 + 0.5], [123456789.25, 3e12], [1e300, 0.0]]
    table = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")
    found = whitening.moments(table)
    x = [[max(-(1 << 61), min(1 << 61, math.floor(Fraction(c) * 1024))) + 100000 for c in v] for v in values]
    n, sums = 4, [sum(c) for c in zip(*x)]
    u = [[n * a - s for a, s in zip(row, sums)] for row in x]
    assert (found.n, found.sums) == (n, sums)
    assert found.squares == [[sum(r[0] ** 2 for r in u), sum((r[0] + r[1]) ** 2 for r in u)], [sum(r[1] ** 2 for r in u)]]
    rows = whitening.whiten(table).collect()
    want = [sum(a * a for a in row) for row in u]
    assert {r.vec_id: r.deviation and int(r.deviation) for r in rows} == {i: w if w < 10**38 else None for i, w in enumerate(want)}


def test_limbs_round_trip():
    for value in (0, 1, -1, 1 << 40, -(1 << 150) + 12345, (1 << 190) - 1):
        assert whitening.from_limbs(whitening.limbs(value)) == value
