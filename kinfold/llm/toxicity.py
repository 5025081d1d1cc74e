"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A logistic model scores each sentence by its words,
and the text's score is the noisy-or of its sentences: one toxic sentence is
enough. Only texts carry labels, so the gradient of the text's loss decides which
of its sentences take the blame; the fitted model then points at those sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kinfold.llm.blocks import Block, Hasher, blocks, bound_batches, lower_latin, mix, releasing, word_spans

FEATURE_BITS = 18
MAX_TRAINING_ROWS = 8_000
FOLDS = 5
PREFIXES = (5, 6, 7, 8, 10)  # bytes of a word's beginning

# Words are runs of ASCII letters and digits and of all bytes outside ASCII.
_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True

SENTENCES = "array<struct<start:int,end:int,score:double>>"


def fold(key: str = "doc_id") -> Column:
    """The label fold of a row: crc32 of its key as text, modulo five; null keys have none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


@dataclass(frozen=True)
class SentenceModel:
    """Weights by hashed word, and the bias of a sentence."""

    weights: np.ndarray
    bias: float


def _featurise(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, first feature of each sentence, its text, and its byte span.

    A word gives itself and its longer beginnings, so inflected and compounded
    forms share evidence. Sentences end after . ! ? or a line feed; those without a word are left out.
    """
    data = lower_latin(block.bytes)
    starts, ends = word_spans(data, _GAPS)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    closed = np.cumsum(_ENDS[data])  # sentence ends up to and including each byte
    first = np.flatnonzero(np.diff(closed[starts], prepend=-1))
    last = np.append(first[1:], len(starts)) - 1
    hasher, lengths = Hasher(data), ends - starts
    table = np.full((len(starts), 1 + len(PREFIXES)), -1, np.int64)
    table[:, 0] = hasher.spans(starts, ends) >> np.uint64(64 - FEATURE_BITS)
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(lengths > size)
        beginning = mix(hasher.spans(starts[long], starts[long] + size) + np.uint64(k))
        table[long, k] = beginning >> np.uint64(64 - FEATURE_BITS)
    used = table >= 0
    before = np.concatenate(([0], np.cumsum(used.sum(1))))
    return table[used], before[first], block.owner(starts[first]), starts[first], ends[last]


def _log_none(scores: np.ndarray, first: np.ndarray, count: int, owner: np.ndarray) -> np.ndarray:
    """Log of the chance that no sentence of a text is toxic."""
    return np.bincount(owner, weights=-np.logaddexp(0, scores), minlength=count)


@releasing
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch["text"]):
            features, first, owner, _, _ = _featurise(block)
            rows = batch.slice(block.first, len(block))
            words, bags = [], []
            cuts = np.searchsorted(owner, np.arange(len(block) + 1))
            edge = np.append(first, len(features))
            for i in range(len(block)):
                mine = edge[cuts[i] : cuts[i + 1] + 1]
                words.append(features[mine[0] : mine[-1]].astype(np.int32).tobytes() if len(mine) > 1 else b"")
                bags.append(np.diff(mine).astype(np.int32).tobytes() if len(mine) > 1 else b"")
            yield pa.RecordBatch.from_arrays(
                [rows["toxic"], pa.array(words, pa.binary()), pa.array(bags, pa.binary())],
                ["toxic", "words", "bags"],
            )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = MAX_TRAINING_ROWS,
    steps: int = 100,
    rate: float = 0.1,
    decay: float = 3e-5,
    screen: float = 4.0,
) -> SentenceModel:
    """Fit on labelled texts outside fold 0, at most about ``max_rows`` of them.

    The rows are drawn by a hash of ``doc_id`` with both labels at their natural
    shares; all of them are used where there are no more. A key with several
    labels takes the largest; null keys and labels teach nothing. Without a toxic
    and a clean example the model scores every text near zero.
    """
    bound_batches(docs.sparkSession)
    known = (
        labels.where(F.col("toxic").isNotNull() & (fold() != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # at most max_rows keys and labels: a few hundred kilobytes
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text")
    found = rows.mapInArrow(_pack, "toxic int, words binary, bags binary").toArrow()
    return _descend(
        np.array([int(x > 0) for x in found["toxic"].to_pylist()], np.int64),
        [np.frombuffer(x, np.int32) for x in found["words"].to_pylist()],
        [np.frombuffer(x, np.int32) for x in found["bags"].to_pylist()],
        steps, rate, decay, screen,
    )


def _descend(toxic, words, bags, steps: int, rate: float, decay: float, screen: float) -> SentenceModel:
    weights, bias = np.zeros(1 << FEATURE_BITS), -6.0
    if not len(toxic) or toxic.min() == toxic.max():
        return SentenceModel(weights, bias)
    order = sorted(range(len(toxic)), key=lambda i: (toxic[i], words[i].tobytes(), bags[i].tobytes()))
    toxic = toxic[order].astype(float)
    # screen: features of three texts or more whose share of toxic texts is far from the usual
    text_count, toxic_count = np.zeros(len(weights)), np.zeros(len(weights))
    for y, i in zip(toxic, order):
        own = np.unique(words[i])
        text_count[own] += 1
        toxic_count[own] += y
    usual = toxic.mean()
    apart = (toxic_count - text_count * usual) / np.sqrt(np.maximum(1, text_count) * usual * (1 - usual))
    telling = (text_count >= 3) & (np.abs(apart) >= screen)
    lengths = [bags[i] for i in order]
    owner = np.repeat(np.arange(len(order)), [len(x) for x in lengths])
    kept, sentence, base = [], [], 0
    for i, own in zip(order, lengths):
        mine = telling[words[i]]
        kept.append(words[i][mine])
        sentence.append((base + np.repeat(np.arange(len(own)), own))[mine])
        base += len(own)
    used, column = np.unique(np.concatenate(kept), return_inverse=True)
    sentence = np.concatenate(sentence)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = bias
    for step in range(1, steps + 1):
        s = np.bincount(sentence, weights=w[column], minlength=base) + w[-1]
        none = np.minimum(np.bincount(owner, weights=-np.logaddexp(0, s), minlength=len(toxic)), -1e-12)
        chance = -np.expm1(none)
        pull = np.where(toxic > 0, -np.exp(none) / chance, 1.0)
        slope = pull[owner] * np.exp(-np.logaddexp(0, -s)) / len(toxic)
        g = np.append(np.bincount(column, weights=slope[sentence], minlength=len(used)), slope.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights[used] = w[:-1]
    return SentenceModel(weights, float(w[-1]))


def chance(model: SentenceModel, text: Column) -> Column:
    """The noisy-or of a text's sentences as a column: only the text goes to Python and one double comes back.

    0 for a text without words or a null text.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)  # a fixed 2 MB

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        fitted, parts = shared.value, [np.zeros(0)]
        for block in blocks(texts):
            features, first, owner, _, _ = _featurise(block)
            sums = np.add.reduceat(fitted.weights[features], first) if len(first) else np.zeros(0)
            parts.append(-np.expm1(_log_none(sums + fitted.bias, first, len(block), owner)))
        return pa.array(np.concatenate(parts))

    return scored(text)


def score(
    docs: DataFrame, model: SentenceModel, *, threshold: float = 0.5, keep: list[str] | None = None
) -> DataFrame:
    """Add ``score``, ``predicted`` and the offending ``sentences`` to every row.

    ``score`` is the noisy-or over the sentences of the whole text, 0 for a text
    without words or a null text. ``sentences`` lists, in text order, the byte
    spans whose own chance reaches ``threshold``. Input columns of those names
    are replaced; all others, or those in ``keep``, and repeated rows are kept.
    """
    bound_batches(docs.sparkSession)
    rest = docs.drop("score", "predicted", "sentences")
    kept = [c for c in rest.columns if keep is None or c in keep]
    shared = rest.sparkSession.sparkContext.broadcast(model)  # a fixed 2 MB
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for block in blocks(batch["text"]):
                features, first, owner, starts, ends = _featurise(block)
                sums = np.add.reduceat(fitted.weights[features], first) if len(first) else np.zeros(0)
                s = sums + fitted.bias
                chance = -np.expm1(_log_none(s, first, len(block), owner))
                own = 1 / (1 + np.exp(-s))
                marked = np.flatnonzero(own >= threshold)
                spans = [[] for _ in range(len(block))]
                for k in marked:
                    base = block.starts[owner[k]]
                    spans[owner[k]].append(
                        {"start": int(starts[k] - base), "end": int(ends[k] - base), "score": float(own[k])}
                    )
                found = [
                    pa.array(chance),
                    pa.array((chance >= threshold).astype(np.int32)),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
                ]
                rows = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*(rows[c] for c in kept), *found], [*kept, "score", "predicted", "sentences"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.select(*kept).schema)
    return rest.mapInArrow(apply, f"{schema}, score double, predicted int, sentences {SENTENCES}")
