"""Frequent word n-grams of a text column.

All counts come from one shuffle of all n-grams (``ngram_counts``). Where only those
above a floor are wanted, that is mostly wasted work, since nearly all long n-grams
are rare. ``frequent_ngrams`` goes length by length instead: an n-gram in at least
``min_frequency`` rows has both its parts of length n - 1 in as many, so a pass
counts only n-grams whose parts were frequent in the pass before. What was frequent
travels as a Bloom filter of bounded size, put together by an aggregate; a false
positive costs a little work and no result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.stopwords import default_stop_words
from kinfold.functions.text import as_text, without_stop_words, word_ngrams, word_tokens
from kinfold.session import materialize, spread

# Bits of a Bloom filter: ten for each frequent n-gram, within these bounds (8 MB).
_LEAST_BITS, _MOST_BITS = 10, 26
_PROBES = 4
# A task works on so many tokens at a time, however long the rows of an Arrow batch are.
SLICE_TOKENS = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_counts(
    df: DataFrame,
    text_col: str = "title",
    *,
    min_n: int = 2,
    max_n: int = 4,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Document and term frequency of every n-gram: ``ngram, doc_freq, term_freq``.

    Stop words go before the n-grams are formed, so an n-gram may bridge them.
    Each row's n-grams are sorted inside the row, which marks the first
    occurrence there; both counts then come from one shuffle on the n-gram with
    map-side partial sums, and none on (document, n-gram).
    """
    if not 1 <= min_n <= max_n:
        raise ValueError("need 1 <= min_n <= max_n")
    words = default_stop_words() if stop_words is None else stop_words
    texts = spread(df.select(as_text(F.col(text_col)).alias("text")))
    tokens = texts.select(without_stop_words(word_tokens(F.col("text")), words).alias("t"))
    grams = tokens.select(F.sort_array(word_ngrams(F.col("t"), min_n, max_n)).alias("g"))
    flagged = F.transform(
        F.col("g"),
        lambda gram, i: F.struct(
            gram.alias("ngram"),
            (~gram.eqNullSafe(F.get(F.col("g"), i - 1))).cast("long").alias("first"),
        ),
    )
    return (
        grams.select(F.inline(flagged))
        .groupBy("ngram")
        .agg(F.sum("first").alias("doc_freq"), F.count("*").alias("term_freq"))
    )


def list_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_TOKENS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole rows with at most ``most`` list entries in ``column``, but one row at least."""
    ends = np.cumsum(batch[column].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _token_hashes(tokens: pa.Array) -> np.ndarray:
    """A 64-bit hash of every token, computed once for each distinct one."""
    coded = tokens.dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, np.uint64)
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return known[coded.indices.to_numpy(zero_copy_only=False)]


def _gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that begins at each token."""
    count = max(0, len(words) - n + 1)
    total = np.full(count, np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            total = (total ^ words[k : k + count]) * _MIX
            total ^= total >> np.uint64(29)
    return total


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bit positions of each hash in a filter of ``2 ** bits`` bits."""
    with np.errstate(over="ignore"):
        step = (hashes * _MIX) | np.uint64(1)
        for k in range(_PROBES):
            yield ((hashes + np.uint64(k) * step) >> np.uint64(64 - bits)).astype(np.int64)


def _holds(bloom: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _probes(hashes, bits):
        found &= (bloom[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return found


def _bloom_of(frequent: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The filter of the n-grams in column ``words`` (arrays of n words); bits are or-ed by Spark."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, int(10 * frequent.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _gram_hashes(_token_hashes(batch["words"].flatten()), n)[::n] if batch.num_rows else np.zeros(0, np.uint64)
            at = np.concatenate(list(_probes(hashes, bits)))
            words, where = np.unique(at >> 6, return_inverse=True)
            parts = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(parts, where, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(parts.view(np.int64))], ["at", "part"])

    merged = frequent.select("words").mapInArrow(mark, "at long, part long").groupBy("at").agg(F.bit_or("part").alias("part"))
    bloom = np.zeros(1 << (bits - 6), np.uint64)
    found = merged.toArrow()  # at most 8 MB of bits
    bloom[found["at"].to_numpy()] = found["part"].to_numpy().view(np.uint64)
    return bloom, bits


def _counted(tokens: DataFrame, n: int, bloom: tuple[np.ndarray, int] | None, min_frequency: int) -> DataFrame:
    """``words, doc_freq, term_freq`` of the n-grams in enough rows, counted where both parts pass ``bloom``.

    A slice of a batch sends each n-gram once, with its rows and occurrences there.
    """
    shared = None if bloom is None else tokens.sparkSession.sparkContext.broadcast(bloom)  # at most 8 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in list_slices(whole, "t")):
            lists = batch["t"]
            flat = lists.flatten()
            words = _token_hashes(flat)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            grams = _gram_hashes(words, n)
            keep = row[: len(grams)] == row[n - 1 :] if len(grams) else np.zeros(0, bool)
            if shared is not None and len(grams):
                parts = _holds(*shared.value, _gram_hashes(words, n - 1))
                keep &= parts[: len(grams)] & parts[1 : len(grams) + 1]
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            order = np.lexsort((row[at], grams[at]))
            gram, owner = grams[at][order], row[at][order]
            first = np.concatenate(([True], gram[1:] != gram[:-1]))
            fresh = first | np.concatenate(([True], owner[1:] != owner[:-1]))
            starts = np.flatnonzero(first)
            rows = np.add.reduceat(fresh.astype(np.int64), starts)
            times = np.diff(np.append(starts, len(gram)))
            places = at[order][starts][:, None] + np.arange(n)
            ends = pa.array(np.arange(0, places.size + 1, n, dtype=np.int32))
            lists_out = pa.ListArray.from_arrays(ends, pc.cast(flat.take(pa.array(places.ravel())), pa.string()))
            for lo in range(0, len(lists_out), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [lists_out.slice(lo, 50_000), pa.array(rows[part]), pa.array(times[part])], ["words", "d", "c"]
                )

    partial = tokens.mapInArrow(count, "words array<string>, d long, c long")
    summed = partial.groupBy("words").agg(F.sum("d").alias("doc_freq"), F.sum("c").alias("term_freq"))
    return summed.where(F.col("doc_freq") >= min_frequency)


def frequent_ngrams(
    df: DataFrame,
    text_col: str = "title",
    *,
    min_frequency: int = 100,
    min_n: int = 2,
    max_n: int = 4,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of ``ngram_counts`` with ``doc_freq`` of at least ``min_frequency``, length by length."""
    if not 1 <= min_n <= max_n:
        raise ValueError("need 1 <= min_n <= max_n")
    words = default_stop_words() if stop_words is None else stop_words
    texts = spread(df.select(as_text(F.col(text_col)).alias("text")))
    # tokenised once, read by every pass
    tokens = materialize(texts.select(without_stop_words(word_tokens(F.col("text")), words).alias("t")))
    found, bloom = None, None
    for n in range(1, max_n + 1):
        level = materialize(_counted(tokens, n, bloom, min_frequency))
        if n >= min_n:
            found = level if found is None else found.unionByName(level)
        if n < max_n:
            bloom = _bloom_of(level, n)
    return found.select(F.array_join("words", " ").alias("ngram"), "doc_freq", "term_freq")


def common_ngrams(
    df: DataFrame,
    text_col: str = "title",
    *,
    min_frequency: int = 100,
    n_top: int = 200,
    min_n: int = 2,
    max_n: int = 4,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """The ``n_top`` n-grams by term frequency among those in ``min_frequency`` rows or more.

    Ties go by n-gram, ascending. The ranking window sees at most ``n_top`` rows.
    """
    counts = frequent_ngrams(
        df, text_col, min_frequency=min_frequency, min_n=min_n, max_n=max_n, stop_words=stop_words
    )
    top = counts.orderBy(F.desc("term_freq"), "ngram").limit(n_top)
    order = Window.orderBy(F.desc("term_freq"), "ngram")
    return top.withColumn("rank", F.row_number().over(order))


def ngram_report(
    df: DataFrame,
    text_col: str = "title",
    *,
    min_frequency: int = 100,
    n_top: int = 200,
    min_n: int = 2,
    max_n: int = 4,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """One row: ``ngrams`` best first, ``min_frequency`` and ``total_titles``."""
    top = common_ngrams(
        df,
        text_col,
        min_frequency=min_frequency,
        n_top=n_top,
        min_n=min_n,
        max_n=max_n,
        stop_words=stop_words,
    )
    ranked = F.sort_array(F.collect_list(F.struct("rank", "ngram")))
    total = df.agg(F.count("*").alias("total_titles")).scalar()
    return top.agg(ranked.getField("ngram").alias("ngrams")).select(
        "ngrams", F.lit(min_frequency).alias("min_frequency"), total.alias("total_titles")
    )
