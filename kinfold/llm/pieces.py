"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once; at every position its
output links name the pieces that end there, and a single Viterbi pass relaxes the
best score with each. Pieces hold the space mark only at their beginning, so the
best path of a text is the joined best paths of its words, which are remembered
while a task runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from kinfold.llm.blocks import bound_batches, releasing

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_MARK_BYTES = MARK.encode()
UNKNOWN_PENALTY = 10.0
_REMEMBERED = 200_000  # words; longer ones than _WORD characters are not kept
_WORD = 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores, ids of the single bytes, and the id of the unknown piece."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str  # one letter per id: n normal, b byte, c control or unused, u unknown


def read_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file, read on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = "".join(
        "b" if model.is_byte(i) else "u" if model.is_unknown(i) else "c" if model.is_control(i) or model.is_unused(i) else "n"
        for i in ids
    )
    return Vocabulary(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), kinds)


@dataclass
class Codec:
    """Encoder and decoder of one vocabulary; spaces become marks and a mark is put in front."""

    vocabulary: Vocabulary
    remembered: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.automaton = ahocorasick.Automaton()
        self.bytes: dict[int, int] = {}
        self.unknown = max(0, v.kinds.find("u"))
        spelled, inner, low = [], False, 0.0
        for i, (piece, score, kind) in enumerate(zip(v.pieces, v.scores, v.kinds)):
            if kind == "n":
                self.automaton.add_word(piece, (i, len(piece), score))
                inner |= MARK in piece.lstrip(MARK)
                low = min(low, score)
            elif kind == "b":
                self.bytes[int(piece[1:-1], 16)] = i
            spelled.append(
                bytes([int(piece[1:-1], 16)]) if kind == "b" else piece.replace(MARK, " ").encode() if kind == "n" else b""
            )
        if len(self.automaton):
            self.automaton.make_automaton()
        self.spelled = spelled
        self.penalty = low - UNKNOWN_PENALTY
        # a vocabulary with marks inside pieces is encoded as a whole
        self.words = re.compile(".+" if inner else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.S)

    def _single(self, char: str) -> list[int]:
        raw = char.encode()
        if all(b in self.bytes for b in raw):
            return [self.bytes[b] for b in raw]
        return [self.unknown]

    def viterbi(self, word: str) -> tuple[int, ...]:
        """Ids of the path with the largest sum of scores; of equal ones, that with the longest last piece.

        A character that is no piece of its own may stand alone at a penalty, as its
        bytes. The automaton names pieces by where they end, longest first, so every
        position is final when the first piece beyond it comes.
        """
        size, penalty = len(word), self.penalty
        best = [0.0] + [-np.inf] * size
        back: list[tuple[int, int]] = [(1, -1)] * (size + 1)
        at, single = 0, -1  # positions below ``at`` are final; the last end of a piece of one character
        for end, (piece, width, score) in self.automaton.iter(word) if len(self.automaton) else ():
            while at < end:
                if single != at and best[at] + penalty > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + penalty, (1, -1)
                at += 1
            reached = best[end + 1 - width] + score
            if reached > best[end + 1]:
                best[end + 1], back[end + 1] = reached, (width, piece)
            if width == 1:
                single = end
        while at < size:
            if single != at and best[at] + penalty > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + penalty, (1, -1)
            at += 1
        ids: list[int] = []
        at = size
        while at > 0:
            width, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self._single(word[at - 1])[::-1])
            at -= width
        return tuple(ids[::-1])

    def _raw(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        if MARK in text:
            # a mark that the text itself holds is spelled in bytes, so it is no space when decoded
            mark = np.array(self._single(MARK), np.int32).tobytes()
            first, *rest = text.split(MARK)
            return self._part(MARK + first) + b"".join(mark + self._part(x) for x in rest)
        return self._part(MARK + text) if text else b""

    def _part(self, text: str) -> bytes:
        words = self.words.findall(text.replace(" ", MARK))
        known = self.remembered
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        own: dict[str, bytes] = {}
        for word in set(words):
            found = known.get(word)
            if found is None:
                found = np.array(self.viterbi(word), np.int32).tobytes()
                if len(word) <= _WORD:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known[word] = found
            own[word] = found
        return b"".join([own[w] for w in words])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self._raw(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence; ids outside the vocabulary and control pieces give nothing."""
        spelled = self.spelled
        try:
            raw = b"".join(map(spelled.__getitem__, ids)) if not ids or min(ids) >= 0 else None
        except IndexError:
            raw = None
        if raw is None:
            raw = b"".join([spelled[i] for i in ids if 0 <= i < len(spelled)])
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


_codecs: dict[Vocabulary, Codec] = {}


def _codec(vocabulary: Vocabulary) -> Codec:
    """The codec of this Python worker, built once."""
    if vocabulary not in _codecs:
        _codecs.clear()
        _codecs[vocabulary] = Codec(vocabulary)
    return _codecs[vocabulary]


def _lists(rows: list[bytes | None]) -> pa.Array:
    flat = b"".join([r for r in rows if r])
    sizes = np.cumsum([0] + [len(r) // 4 if r else 0 for r in rows]).astype(np.int32)
    mask = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(flat, np.int32)), mask=mask)


def encode(docs: DataFrame, vocabulary: Vocabulary, *, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` to every row: the pieces of the whole ``text``.

    A null text has null ids, an empty one none. Columns in ``keep`` (all by
    default) and repeated rows are kept, an ``ids`` column is replaced.
    """
    bound_batches(docs.sparkSession)
    rest = docs.drop("ids")
    kept = [c for c in rest.columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a fixed megabyte

    @releasing
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            ids = [None if x is None else codec._raw(x) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), _lists(ids)], [*kept, "ids"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.select(*kept).schema)
    return rest.mapInArrow(apply, f"{schema}ids array<int>")


def decode(coded: DataFrame, vocabulary: Vocabulary, *, name: str = "decoded") -> DataFrame:
    """Add the text of ``ids``; null for null ids. A null id inside a list gives nothing."""
    rest = coded.drop(name)
    names = rest.columns
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    @releasing
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            column = batch["ids"]
            # nulls inside a list become ids that give nothing
            flat = pc.fill_null(column.flatten(), -1).to_numpy().tolist()
            edge = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())))
            missing = column.is_null().to_pylist()
            texts = [None if gone else codec.decode(flat[a:b]) for gone, a, b in zip(missing, edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, name])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema)
    return rest.mapInArrow(apply, f"{schema}`{name}` string")
