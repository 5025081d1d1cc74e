from __future__ import annotations

import random

import re

import pyarrow as pa

import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as fx
from kinfold.functions.stopwords import default_stop_words
from kinfold.operators.ngrams import SLICE_TOKENS, common_ngrams, frequent_ngrams, list_slices, ngram_counts, ngram_report

# Titles of our own around every rule. A phrase goes with the white space after it.
WRAPPED = [(f"kopi {phrase.upper() if i % 2 else phrase}  bubuk", "kopi bubuk") for i, phrase in enumerate(fx.SLANG_PHRASES)]
LETTERED = [(f"x{phrase} {phrase}x", f"x{phrase} {phrase}x") for phrase in fx.SLANG_PHRASES if " " not in phrase]
MARKED = [
    ("\U0001f600teh\u2b50 hijau\u200d", "teh hijau"),
    ("lampu [meja] (biru)!!", "lampu meja biru"),
    (r"rak\xAf buku \xg1", r"rak buku \xg1"),
    ("  payung\t\n lipat ", "payung lipat"),
    ("promo! (diskon)", ""),
    ("murah meriahnya", "meriahnya"),
    ("", ""),
]
CLEANING = WRAPPED + LETTERED + MARKED


def test_clean_text_cases(spark):
    rows = [(i, raw) for i, (raw, _) in enumerate(CLEANING)]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r["i"]: r["c"] for r in df.select("i", fx.clean_text(F.col("text")).alias("c")).collect()}
    assert [got[i] for i in range(len(CLEANING))] == [clean for _, clean in CLEANING]


def test_cleaning_is_unicode_aware(spark):
    cases = ["murahé ok", "émurah ok", "murah ok", "a 　b", "MURAH ok", "x\x1cy"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.coalesce(1).select(fx.clean_text(F.col("t"))).collect()]
    assert got == ["murahé ok", "émurah ok", "ok", "a b", "ok", "x y"]


def test_missing_text_reads_nan(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    got = sorted(r[0] for r in df.select(fx.clean_text(fx.as_text(F.col("t")))).collect())
    assert got == ["", "nan"]


def test_phrases_are_plain_text(spark):
    df = spark.createDataFrame([("a c++ b.b bxb",)], "t string")
    got = df.select(fx.remove_slang(F.col("t"), ["b.b", "c++"])).first()[0]
    assert got == "a bxb"


TITLES = [f"{size} {color} ceramic bowl {shape}" for size, color, shape in (
    ("small", "blue", "round"), ("small", "blue", "oval"), ("large", "blue", "round"), ("large", "green", "round"),
    ("small", "green", "square"), ("tiny", "blue", "round"),
)] + ["wooden spoon set", "ceramic bowl set", "blue spoon", "ceramic bowl ceramic bowl"]


@pytest.fixture(scope="module")
def titles(spark):
    return spark.createDataFrame([(t,) for t in TITLES], "title string")


def brute_ngrams(texts, lo, hi, stop):
    doc, term = {}, {}
    for text in texts:
        tokens = [t for t in re.findall(r"\w+", text.lower()) if t not in stop]
        grams = [" ".join(tokens[i : i + n]) for n in range(lo, hi + 1) for i in range(len(tokens) - n + 1)]
        for g in grams:
            term[g] = term.get(g, 0) + 1
        for g in set(grams):
            doc[g] = doc.get(g, 0) + 1
    return {g: (doc[g], term[g]) for g in term}


def test_ngram_counts_match_brute_force(spark):
    texts = [*TITLES, "a a a a b a a", "", "x", "the free the shipping", None]
    df = spark.createDataFrame([(t,) for t in texts], "title string")
    got = {r["ngram"]: (r["doc_freq"], r["term_freq"]) for r in ngram_counts(df, stop_words=["the"]).collect()}
    want = brute_ngrams(["nan" if t is None else t for t in texts], 2, 4, {"the"})
    assert got == want


def test_common_ngrams_floor_top_and_order(titles):
    got = common_ngrams(titles, min_frequency=3, n_top=10, min_n=2, max_n=3, stop_words=["blue"])
    rows = got.orderBy("rank").collect()
    counts = brute_ngrams(TITLES, 2, 3, {"blue"})
    want = sorted((g for g, (d, _) in counts.items() if d >= 3), key=lambda g: (-counts[g][1], g))[:10]
    assert [r["ngram"] for r in rows] == want
    assert [r["rank"] for r in rows] == list(range(1, len(want) + 1))


def test_no_default_stop_word_in_result(titles):
    stop = set(default_stop_words())
    for r in common_ngrams(titles, min_frequency=2, n_top=50, min_n=2, max_n=3).collect():
        assert not stop & set(r["ngram"].split())


def test_report(titles):
    report = ngram_report(titles, min_frequency=3, n_top=10, min_n=2, max_n=3, stop_words=[]).first()
    assert report["min_frequency"] == 3 and report["total_titles"] == 10
    assert 0 < len(report["ngrams"]) <= 10
    empty = ngram_report(titles, min_frequency=99, stop_words=[]).first()
    assert empty["ngrams"] == [] and empty["total_titles"] == 10


@pytest.mark.parametrize("lo,hi,floor", [(1, 1, 2), (2, 4, 2), (2, 4, 5), (3, 5, 3), (2, 3, 1)])
def test_frequent_ngrams_are_the_counted_ones_above_the_floor(spark, lo, hi, floor):
    rng = random.Random(9)
    words = ["tas", "Tas", "kecil", "merah", "é", "x1", "the", "of", *[f"rare{i}" for i in range(40)]]
    texts = [" ".join(rng.choices(words[:8], k=rng.randint(0, 9)) + rng.choices(words, k=rng.randint(0, 4))) for _ in range(150)]
    texts += [None, "", "tas " * 300, texts[3], texts[3]]
    df = spark.createDataFrame([(t,) for t in texts], "title string").repartition(4)
    options = dict(min_n=lo, max_n=hi, stop_words=["of"])
    want = {tuple(r) for r in ngram_counts(df, **options).where(f"doc_freq >= {floor}").collect()}
    assert {tuple(r) for r in frequent_ngrams(df, min_frequency=floor, **options).collect()} == want and want


def test_a_full_bloom_filter_costs_no_result(spark, monkeypatch):
    from kinfold.operators import ngrams

    monkeypatch.setattr(ngrams, "_MOST_BITS", 10)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "title string").repartition(3)
    options = dict(min_n=1, max_n=3, stop_words=[])
    want = {tuple(r) for r in ngram_counts(df, **options).where("doc_freq >= 2").collect()}
    assert {tuple(r) for r in frequent_ngrams(df, min_frequency=2, **options).collect()} == want


def test_bloom_filters_hold_what_they_were_given(spark):
    from kinfold.operators import ngrams

    rows = [([f"a{i}", f"b{i % 7}"],) for i in range(500)]
    bloom, bits = ngrams._bloom_of(spark.createDataFrame(rows, "words array<string>").repartition(5), 2)
    import pyarrow as pa

    hashes = ngrams._gram_hashes(ngrams._token_hashes(pa.array([w for (pair,) in rows for w in pair])), 2)[::2]
    assert len(bloom) << 6 == 1 << bits and ngrams._holds(bloom, bits, hashes).all()
    others = ngrams._gram_hashes(ngrams._token_hashes(pa.array([f"z{i}" for i in range(4000)])), 2)
    assert ngrams._holds(bloom, bits, others).mean() < 0.1


def test_long_batches_are_counted_in_slices_of_whole_rows(spark):
    batch = pa.RecordBatch.from_pylist([{"t": ["a"] * n} for n in (3, 0, 4, 9, 1, 1)])
    assert [part.num_rows for part in list_slices(batch, "t", 7)] == [3, 1, 2]
    assert [part.num_rows for part in list_slices(batch.slice(2), "t", 100)] == [4]
    # three rows of a slice's tokens each
    rows = [("one two " * (SLICE_TOKENS // 2),)] * 3
    found = frequent_ngrams(spark.createDataFrame(rows, "title string").coalesce(1), min_frequency=3, max_n=2, stop_words=[])
    half = SLICE_TOKENS // 2
    assert {tuple(r) for r in found.collect()} == {("one two", 3, 3 * half), ("two one", 3, 3 * half - 3)}


def test_no_rows_have_no_frequent_ngrams(spark):
    df = spark.createDataFrame([], "title string")
    assert frequent_ngrams(df, min_frequency=1, stop_words=[]).count() == 0
