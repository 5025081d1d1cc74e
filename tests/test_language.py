from __future__ import annotations

import math
from collections import Counter

import pytest

from kinfold.operators import language
from kinfold.operators.language import language_scores, target_score, train_language_model

SAMPLES = [
    ("en", "the quick women bag with free paper and leather shoes for the summer party"),
    ("en", "a secret gift box of victoria style from the paper store with fast shipping"),
    ("en", "this bag is made of strong paper and has a black handle"),
    ("id", "tas wanita terbaru model import harga termurah untuk fashion wanita"),
    ("id", "sepatu pria dan baju anak dengan harga murah bahan katun lembut"),
    ("id", "celana panjang wanita kekinian termurah dan terlaris di kota ini"),
]


@pytest.fixture(scope="module")
def model(spark):
    return train_language_model(spark.createDataFrame(SAMPLES, "lang string, text string"))


def scores_of(spark, model, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "posting_id long, title string")
    got = language_scores(df, model, **options).withColumn("id", target_score("scores", model, "id"))
    return {r["posting_id"]: r for r in got.collect()}


def test_two_known_titles(spark, model):
    got = scores_of(spark, model, ["Paper Bag Victoria Secret", "Tas Wanita Fashion Import Termurah"])
    assert model.languages == ("en", "id")
    assert got[0]["id"] < 0.5 < got[1]["id"]
    assert all(sum(r["scores"]) == pytest.approx(1) for r in got.values())


def brute(text, max_n=5):
    grams = {lang: Counter() for lang in ("en", "id")}

    def letters(t):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        return [w[i : i + n] for w in words for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    for lang, sample in SAMPLES:
        grams[lang].update(letters(sample))
    known = set(grams["en"]) | set(grams["id"])
    sums = []
    for lang in ("en", "id"):
        total = 0.0
        for g in letters(text):
            space = sum(c for x, c in grams[lang].items() if len(x) == len(g))
            space += sum(len(x) == len(g) for x in known) + 1
            total += math.log((grams[lang][g] + 1) / space)
        sums.append(total)
    powers = [math.exp(s - max(sums)) for s in sums]
    return powers[1] / sum(powers)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_scores_match_brute_force_broadcast_and_shuffled(spark, model, limit):
    texts = ["tas", "bag of", "qqzzx", "é ñ", "wan shoe 12"]
    got = scores_of(spark, model, texts, broadcast_grams=limit)
    for i, text in enumerate(texts):
        assert got[i]["id"] == pytest.approx(brute(text), abs=1e-9)


def test_text_without_letters_is_neutral(spark, model):
    got = scores_of(spark, model, ["", "123 !!"])
    assert all(r["scores"] == [0.5, 0.5] for r in got.values())


def test_missing_text_is_scored_as_nan(spark, model):
    got = scores_of(spark, model, [None, "nan"])
    assert got[0]["scores"] == got[1]["scores"]


def test_words_are_counted_in_their_row_before_any_shuffle(spark):
    rows = [(1, "La casa, la CASA la"), (2, "12 - 3"), (1, "casa"), (None, "x x")]
    counted = language._words_in_rows(spark.createDataFrame(rows, "id long, _text string").coalesce(1), "id")
    got = sorted((tuple(r) for r in counted.collect()), key=str)
    assert got == sorted([(1, "la", 3), (1, "casa", 2), (1, "casa", 1), (None, "x", 2)], key=str)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()

