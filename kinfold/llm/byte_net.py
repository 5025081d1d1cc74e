"""Text quality by a small convolutional network over bytes, in NumPy.

A text is its UTF-8 bytes, with zero bytes behind the end. Filters over ``WINDOW``
consecutive bytes look at every position. Positions are cut into chunks of
``CHUNK``, each half over the one before, so the chunks cover the whole text
however long it is. A chunk keeps the strongest answer of each filter; a dense
layer turns these into hidden values, their mean and maximum over all chunks give
the text's probability.

Filters, dense layer and output are trained together by back-propagation on a
bounded sample of labelled texts. A filter is a table of one value a byte and
place, so looking a window up replaces multiplying it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.blocks import blocks, bound_batches

WINDOW, FILTERS, HIDDEN = 6, 24, 16
CHUNK = 128  # positions of a chunk
STEP = CHUNK // 2
MAX_TRAINING_TEXTS = 4_000
MAX_TRAINING_CHUNKS = 24  # drawn from each training text, evenly over the whole of it
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
BATCH = 32
_SLICE = 192  # half chunks looked up at a time
_PAD = b"\0" * WINDOW


def fold(key: str = "doc_id") -> Column:
    """The label fold of a row: crc32 of its key as text, modulo four; null keys have none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


@dataclass
class ByteNet:
    """Filter tables (place, byte, filter), dense layer and output."""

    tables: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray  # for the mean and the maximum of the hidden values
    out_bias: float

    @staticmethod
    def start(seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        tables = (rng.standard_normal((WINDOW, 256, FILTERS)) * 0.3).astype(np.float32)
        dense = rng.standard_normal((FILTERS, HIDDEN)) * np.sqrt(2 / FILTERS)
        out = rng.standard_normal(2 * HIDDEN) * 0.1
        return ByteNet(tables, np.zeros(FILTERS), dense, np.zeros(HIDDEN), out, 0.0)


class _Scorer:
    """Applies a network: two places of the window are looked up at once."""

    def __init__(self, net: ByteNet):
        self.net = net
        pairs = [(net.tables[k][:, None, :] + net.tables[k + 1][None, :, :]) for k in range(0, WINDOW, 2)]
        self.pairs = [p.reshape(65536, FILTERS) for p in pairs]

    def half_chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Strongest answers over the positions ``starts`` to ``ends`` of every half chunk, in text order."""
        best = np.empty((len(starts), FILTERS), np.float32)
        for first in range(0, len(starts), _SLICE):
            s, e = starts[first : first + _SLICE], ends[first : first + _SLICE]
            low, high = int(s[0]), int(e[-1])
            near = data[low : high + WINDOW].astype(np.uint16)
            code = near[:-1] << np.uint16(8) | near[1:]
            answers = self.pairs[0].take(code[: high - low], axis=0)
            for k in range(1, len(self.pairs)):
                answers += self.pairs[k].take(code[2 * k : 2 * k + high - low], axis=0)
            edges = np.column_stack((s, np.minimum(e, high - 1))).ravel() - low
            found = np.maximum.reduceat(answers, edges, axis=0)[::2]
            if e[-1] - 1 == high - 1:  # the last edge stands one early, so its position is added here
                np.maximum(found[-1], answers[-1], out=found[-1])
            best[first : first + _SLICE] = found
        return best

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        net = self.net
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(_PAD.join(texts) + _PAD + _PAD, np.uint8)
        begin = np.concatenate(([0], np.cumsum(lengths + WINDOW)[:-1])).astype(np.int64)
        positions = np.maximum(lengths, 1)
        halves = -(-positions // STEP)
        owner = np.repeat(np.arange(len(texts)), halves)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(halves) - halves, halves)
        starts = begin[owner] + place * STEP
        ends = np.minimum(starts + STEP, begin[owner] + positions[owner])
        best = self.half_chunks(data, starts, ends)
        # a chunk is two neighbouring halves; a text of one half is one chunk
        chunk = np.flatnonzero((place + 1 < halves[owner]) | (halves[owner] == 1))
        after = np.minimum(chunk + 1, len(best) - 1)
        second = np.where((halves[owner[chunk]] == 1)[:, None], best[chunk], best[after])
        pooled = np.maximum(np.maximum(best[chunk], second).astype(np.float64) + net.bias, 0)
        hidden = np.maximum(pooled @ net.dense + net.dense_bias, 0)
        first = np.flatnonzero(np.diff(owner[chunk], prepend=-1))
        count = np.diff(np.append(first, len(chunk)))
        mean = np.add.reduceat(hidden, first, axis=0) / count[:, None]
        top = np.maximum.reduceat(hidden, first, axis=0)
        logit = mean @ net.out[:HIDDEN] + top @ net.out[HIDDEN:] + net.out_bias
        return np.round(1 / (1 + np.exp(-np.clip(logit, -50, 50))), 9)


def training_chunks(text: bytes, most: int = MAX_TRAINING_CHUNKS) -> bytes:
    """Up to ``most`` chunks, evenly over the text, each padded to the same number of bytes."""
    positions = max(len(text), 1)
    count = max(1, -(-positions // STEP) - 1)
    chosen = np.unique(np.linspace(0, count - 1, min(most, count)).astype(np.int64))
    size = CHUNK + WINDOW - 1
    return b"".join(text[c * STEP : c * STEP + size].ljust(size, b"\0") for c in chosen)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    max_texts: int = MAX_TRAINING_TEXTS,
    max_chunks: int = MAX_TRAINING_CHUNKS,
    epochs: int = 10,
    min_steps: int = 600,
    rate: float = 4e-3,
) -> ByteNet:
    """Train on labelled texts outside the held-out fold, at most about ``max_texts`` of them.

    Keys are drawn by a hash, both labels at their natural shares; all are used where
    there are no more. What reaches the driver is at most ``max_chunks`` chunks a key
    (about 3 kB), however long the texts are and however many rows share a key (the
    one of the smallest md5 counts). A key with several labels takes the smallest;
    null keys and labels teach nothing. Few texts are gone over more often, until
    ``min_steps`` batches are done. Without two kinds of labels every text gets the
    share of label 1, or one half without any.
    """
    bound_batches(docs.sparkSession)
    known = (
        labels.where(F.col(label).isNotNull() & (fold() != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min(label).alias("__label"))
    )
    share = min(1.0, max_texts / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most about max_texts keys

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]
            chunks = pa.array([training_chunks(t, max_chunks) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["__label"], batch["digest"], chunks], ["doc_id", "label", "digest", "chunks"])

    digest = F.md5(F.coalesce("text", F.lit("")))
    cut_rows = rows.select("doc_id", F.col("__label").cast("int"), "text", digest.alias("digest")).mapInArrow(
        cut, "doc_id long, label int, digest string, chunks binary"
    )
    one = cut_rows.groupBy("doc_id").agg(F.min(F.struct("digest", "label", "chunks")).alias("r")).select("r.*")
    found = one.toArrow().sort_by([("digest", "ascending"), ("label", "ascending")])
    size = CHUNK + WINDOW - 1
    texts = [np.frombuffer(x, np.uint8).reshape(-1, size) for x in found["chunks"].to_pylist()]
    epochs = max(epochs, -(-min_steps * BATCH // max(1, len(texts))))
    return train(texts, (found["label"].to_numpy() > 0).astype(float), epochs=epochs, rate=rate)


def train(texts: list[np.ndarray], wanted: np.ndarray, *, epochs: int, rate: float, batch: int = BATCH, seed: int = 11) -> ByteNet:
    """Adam over batches of texts, given as chunks of bytes, with a falling rate."""
    net = ByteNet.start()
    if not len(wanted) or wanted.min() == wanted.max():
        share = wanted.mean() if len(wanted) else 0.5
        net.out[:] = 0
        net.out_bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    net.out_bias = float(np.log(wanted.mean() / (1 - wanted.mean())))
    rng = np.random.default_rng(seed)
    names = ("tables", "bias", "dense", "dense_bias", "out")
    first = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    second = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    steps, done = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            gradient = _gradient(net, [texts[i] for i in mine], wanted[mine])
            done += 1
            pace = rate * 0.5 * (1 + np.cos(np.pi * done / steps))
            for k, g in gradient.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = pace * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)
                setattr(net, k, getattr(net, k) - (move.astype(np.float32) if k == "tables" else move))
    net.out_bias = float(net.out_bias)
    return net


def _gradient(net: ByteNet, texts: list[np.ndarray], wanted: np.ndarray, decay: float = 1e-4) -> dict:
    """Mean logistic loss of some texts, differentiated by every weight."""
    count = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    data = np.concatenate(texts)
    answers = net.tables[0].take(data[:, :CHUNK], axis=0)
    for k in range(1, WINDOW):
        answers += net.tables[k].take(data[:, k : k + CHUNK], axis=0)
    place = answers.argmax(axis=1)  # chunk, filter
    best = np.take_along_axis(answers, place[:, None, :], axis=1)[:, 0].astype(np.float64)
    pooled = np.maximum(best + net.bias, 0)
    hidden = np.maximum(pooled @ net.dense + net.dense_bias, 0)
    mean = np.add.reduceat(hidden, first, axis=0) / count[:, None]
    top = np.maximum.reduceat(hidden, first, axis=0)
    logit = mean @ net.out[:HIDDEN] + top @ net.out[HIDDEN:] + net.out_bias
    pull = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - wanted) / len(texts)
    g_out = np.concatenate((pull @ mean, pull @ top)) + decay * net.out
    winner = (hidden == top[owner]) & (hidden > 0)
    winner = winner / np.maximum(1, np.add.reduceat(winner.astype(float), first, axis=0))[owner]
    g_hidden = pull[owner][:, None] * (net.out[:HIDDEN] / count[owner][:, None] + net.out[HIDDEN:] * winner)
    g_hidden *= hidden > 0
    g_dense = pooled.T @ g_hidden + decay * net.dense
    g_pooled = (g_hidden @ net.dense.T) * (pooled > 0)
    g_tables = np.zeros_like(net.tables)
    column = np.broadcast_to(np.arange(FILTERS), place.shape)
    for k in range(WINDOW):
        byte = np.take_along_axis(data, place + k, axis=1).astype(np.int64)
        g_tables[k] = np.bincount((byte * FILTERS + column).ravel(), g_pooled.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return {
        "tables": g_tables, "bias": g_pooled.sum(0), "dense": g_dense, "dense_bias": g_hidden.sum(0),
        "out": g_out, "out_bias": pull.sum(),
    }


def score(
    docs: DataFrame, net: ByteNet, *, threshold: float = THRESHOLD, keep: list[str] | None = None
) -> DataFrame:
    """Add ``score`` (chance of label 1) and ``predicted`` to every row, from its whole text.

    A null text counts as empty; an empty text is scored as one window of zero bytes.
    Input columns of these names give way; others, or those in ``keep``, and repeated
    rows stay. Memory is bounded by the longest text.
    """
    bound_batches(docs.sparkSession)
    rest = docs.drop("score", "predicted")
    kept = [c for c in rest.columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed, 150 kB

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            for block in blocks(batch["text"]):
                chance = pa.array(scorer.texts(block.texts))
                rows = batch.slice(block.first, len(block))
                predicted = pc.greater_equal(chance, threshold).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in kept), chance, predicted], [*kept, "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.select(*[F.col(f"`{c}`") for c in kept]).schema)
    return rest.mapInArrow(apply, f"{schema}score double, predicted int")
