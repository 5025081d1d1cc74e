"""Language shares of a text from character n-gram profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import as_text
from kinfold.operators.ngrams import list_slices
from kinfold.session import materialize, spread

BROADCAST_GRAMS = 1_000_000
_BROADCAST_BYTES = 64 << 20  # a row is about 64 bytes and 8 for each language
_MAX_LANGUAGES = 200


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of n-grams per language, and those of an unseen n-gram.

    ``profile`` has ``gram`` and ``logp array<double>`` in the order of
    ``languages``; ``unseen[n - 1]`` is the same for a gram of length n that no
    language showed. ``grams`` is the number of profile rows.
    """

    languages: tuple[str, ...]
    max_n: int
    profile: DataFrame
    unseen: tuple[tuple[float, ...], ...]
    grams: int


def letter_ngrams(text: Column, max_n: int) -> Column:
    """All runs of 1 to ``max_n`` letters of the lower-cased text, overlaps and repeats kept.

    A lookahead finds overlapping runs in one linear pass per length.
    """
    lowered = F.lower(text)
    runs = [
        F.regexp_extract_all(lowered, F.lit(r"(?=(\p{L}{%d}))" % n), F.lit(1))
        for n in range(1, max_n + 1)
    ]
    return F.concat(*runs)


def letter_words(text: Column) -> Column:
    """Maximal runs of letters of the lower-cased text; every n-gram lies inside one."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def train_language_model(
    labelled: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    languages: Sequence[str] | None = None,
    max_n: int = 5,
) -> LanguageModel:
    """Count letter n-grams per language and smooth by adding one.

    Words are counted first, so n-grams are cut once per distinct word; both shuffles
    have map-side sums. The driver sees ``max_n`` rows of totals. The counts are written once, for the totals and every scoring.
    """
    if languages is None:
        found = labelled.select(lang_col).where(F.col(lang_col).isNotNull()).distinct()
        languages = sorted(r[0] for r in found.limit(_MAX_LANGUAGES + 1).collect())
        if len(languages) > _MAX_LANGUAGES:
            raise ValueError(f"more than {_MAX_LANGUAGES} languages; name the ones to tell apart")
    languages = tuple(languages)
    known = labelled.where(F.col(lang_col).isin(list(languages)))
    texts = spread(known.select(lang_col, as_text(F.col(text_col)).alias("_text")))
    words = texts.select(lang_col, F.explode(letter_words(F.col("_text"))).alias("word"))
    seen = [F.count(F.when(F.col(lang_col) == lang, 1)).alias(f"_c{i}") for i, lang in enumerate(languages)]
    by_word = words.groupBy("word").agg(*seen)
    each = [F.col(f"_c{i}") for i in range(len(languages))]
    grams = by_word.select(*each, F.explode(letter_ngrams(F.col("word"), max_n)).alias("gram"))
    counts = materialize(grams.groupBy("gram").agg(F.array(*[F.sum(c) for c in each]).alias("seen")))
    length = F.char_length("gram")
    per_length = counts.groupBy(length.alias("n")).agg(
        F.count("*").alias("grams"),
        F.array(*[F.sum(F.get("seen", F.lit(i))) for i in range(len(languages))]).alias("seen"),
    )
    totals = {r["n"]: (r["grams"], list(r["seen"])) for r in per_length.collect()}
    totals = {n: totals.get(n, (0, [0] * len(languages))) for n in range(1, max_n + 1)}
    # One more than the grams seen, for the unseen ones.
    spaces = {n: [t + v + 1 for t in seen] for n, (v, seen) in totals.items()}
    sizes = F.array(*[F.array(*[F.lit(float(s)) for s in spaces[n]]) for n in spaces])
    space = F.get(sizes, length - 1)
    logp = F.transform("seen", lambda c, i: F.log((c + 1) / F.get(space, i)))
    return LanguageModel(
        languages=languages,
        max_n=max_n,
        profile=counts.select("gram", logp.alias("logp")),
        unseen=tuple(tuple(-math.log(s) for s in spaces[n]) for n in spaces),
        grams=sum(v for v, _ in totals.values()),
    )


def language_scores(
    rows: DataFrame,
    model: LanguageModel,
    *,
    text_col: str = "title",
    id_col: str = "posting_id",
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """Per id the share of each language: ``id, scores array<double>`` summing to 1.

    A profile of at most ``broadcast_grams`` rows and 64 MB travels to every task as a
    sorted table, in which the n-grams of a batch's distinct words are looked up: rows
    are scored where they are read. With a larger one every distinct word of the table
    is scored once in a join, and the words of the rows meet their scores: by broadcast
    up to the same bounds, else after each row's repeats are counted. A text without
    letters scores evenly.
    """
    texts = spread(rows.select(id_col, as_text(F.col(text_col)).alias("_text")))
    if model.grams <= min(broadcast_grams, _BROADCAST_BYTES // (16 + 8 * len(model.languages))):
        return _scored_in_rows(texts, model, id_col)
    words = texts.select(id_col, F.explode(letter_words(F.col("_text"))).alias("word"))
    distinct = words.select("word").distinct()
    grams = distinct.select("word", F.explode(letter_ngrams(F.col("word"), model.max_n)).alias("gram"))
    broadcast_grams = min(broadcast_grams, _BROADCAST_BYTES // (64 + 8 * len(model.languages)))
    profile = F.broadcast(model.profile) if model.grams <= broadcast_grams else model.profile
    unseen = F.array(*[F.array(*[F.lit(x) for x in row]) for row in model.unseen])
    logp = F.coalesce("logp", F.get(unseen, F.char_length("gram") - 1))
    each = range(len(model.languages))
    word_scores = materialize(
        grams.join(profile, "gram", "left").groupBy("word").agg(*[F.sum(F.get(logp, F.lit(i))).alias(f"_w{i}") for i in each])
    )
    if word_scores.count() <= broadcast_grams:
        weighed = words.join(F.broadcast(word_scores), "word").withColumn("_n", F.lit(1))
    else:
        weighed = _words_in_rows(texts, id_col).join(word_scores, "word")
    sums = weighed.groupBy(id_col).agg(*[F.sum(F.col(f"_w{i}") * F.col("_n")).alias(f"_s{i}") for i in each])
    scores = [F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(len(model.languages))]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = F.array(*[F.exp(s - top) for s in scores])
    total = sum(F.get("_p", F.lit(i)) for i in range(len(scores)))
    return (
        rows.select(id_col)
        .join(sums, id_col, "left")
        .select(id_col, powers.alias("_p"))
        .select(id_col, F.transform("_p", lambda p: p / total).alias("scores"))
    )


def gram_hashes(words: pa.Array, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length its n-grams of all words, in order: the length, 64-bit hashes, and whose they are."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # letters from here to the word's end
    held = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max_n + 1):
            tail = np.zeros(len(points), np.uint64)
            tail[: max(0, len(points) - n + 1)] = points[n - 1 :]
            held = (held ^ (tail + np.uint64(0x9E3779B97F4A7C15) * np.uint64(n))) * np.uint64(0xBF58476D1CE4E5B9)
            held ^= held >> np.uint64(29)
            whole = np.flatnonzero(left >= n)
            yield n, held[whole], owner[whole]


@dataclass(frozen=True)
class _Packed:
    """A profile in memory: sorted hashes of its n-grams and their log-probabilities."""

    hashes: np.ndarray
    logp: np.ndarray
    unseen: np.ndarray

    @staticmethod
    def of(model: LanguageModel) -> _Packed:
        table = model.profile.toArrow()
        grams = table["gram"].combine_chunks()
        hashes = np.zeros(len(grams), np.uint64)
        sizes = pc.utf8_length(grams).to_numpy(zero_copy_only=False)
        for n, found, owner in gram_hashes(grams, model.max_n):
            own = sizes[owner] == n  # the whole gram
            hashes[owner[own]] = found[own]
        logp = table["logp"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(grams), -1)
        order = np.argsort(hashes)
        return _Packed(hashes[order], logp[order], np.array(model.unseen))

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Sums of the log-probabilities of each word's n-grams, a column for each language."""
        total = np.zeros((len(words), self.unseen.shape[1]))
        for n, found, owner in gram_hashes(words, len(self.unseen)):
            values = np.broadcast_to(self.unseen[n - 1], (len(found), self.unseen.shape[1]))
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
                values = np.where((self.hashes[at] == found)[:, None], self.logp[at], values)
            for lang in range(total.shape[1]):
                total[:, lang] += np.bincount(owner, values[:, lang], len(words))
        return total


def _scored_in_rows(texts: DataFrame, model: LanguageModel, id_col: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(_Packed.of(model))  # at most 64 MB
    count = len(model.languages)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in (part for whole in batches for part in list_slices(whole, "words")):
            lists = batch["words"]
            coded = lists.flatten().dictionary_encode()
            by_word = packed.of_words(coded.dictionary.cast(pa.string()))
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            word = coded.indices.to_numpy(zero_copy_only=False)
            sums = np.column_stack([np.bincount(row, by_word[word, i], batch.num_rows) for i in range(count)])
            powers = np.exp(sums - sums.max(axis=1, keepdims=True))
            shares = powers / powers.sum(axis=1, keepdims=True)
            ends = pa.array(np.arange(0, shares.size + 1, count, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.ListArray.from_arrays(ends, pa.array(shares.ravel()))], [id_col, "scores"])

    kind = texts.schema[id_col].dataType.simpleString()
    words = texts.select(id_col, letter_words(F.col("_text")).alias("words"))
    return words.mapInArrow(score, f"`{id_col}` {kind}, scores array<double>")


def _words_in_rows(texts: DataFrame, id_col: str) -> DataFrame:
    """``id, word, _n``: the different words of each row and their repeats, counted where the row is read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in list_slices(whole, "words")):
            lists = batch["words"]
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            size = len(coded.dictionary)
            both, times = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            for lo in range(0, len(both), 50_000):
                some = both[lo : lo + 50_000]
                columns = [batch[id_col].take(pa.array(some // size)), coded.dictionary.take(pa.array(some % size)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(times[lo : lo + 50_000])], [id_col, "word", "_n"])

    kind = texts.schema[id_col].dataType.simpleString()
    words = texts.select(id_col, letter_words(F.col("_text")).alias("words"))
    return words.mapInArrow(count, f"`{id_col}` {kind}, word string, _n long")


def target_score(scores: str, model: LanguageModel, target: str) -> Column:
    """The share of one language."""
    return F.get(F.col(scores), F.lit(model.languages.index(target)))
