"""Removal of long passages that occur more than once, by blockwise suffix sorting.

A byte goes when a ``length``-byte string that covers it starts anywhere else, in
the same text or another. Sorting all suffixes would do: equal beginnings end up
side by side. The sort is made small in two steps, after the blockwise
construction with a difference cover.

1. Cover sample. ``D`` is a set of residues modulo ``v`` such that every difference
   occurs: for any two positions some shift below ``v`` takes both into the sample.
   Only sampled positions (9 %) are ranked, by the ``length - v + 1`` bytes that
   follow. Two suffixes that agree on ``length`` bytes have equally ranked samples
   within ``v`` positions, so a suffix without a repeated rank nearby is unique and
   is never sorted.
2. Suffix buckets. The other suffixes go to buckets by the smallest 8-byte hashes in
   the four quarters of their first ``length`` bytes. Neighbouring suffixes mostly stay
   together; those around a line that many texts share spread over all buckets, as some
   quarter of them holds what is beside the line. Buckets are sorted a share of them at a
   time, so what is on disk and in memory is bounded; ties are runs of one 96-bit hash of
   the ``length`` bytes.

Inside a batch equal keys are merged before the shuffle, so a passage that a third
of all texts share arrives once per batch. Texts are named by a 64-bit hash;
copies of one text count as one and are removed whole where they are long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.blocks import BLOCK_BYTES, Block, Hasher, bound_batches, mix, releasing, to_bytes
from kinfold.session import materialize

LENGTH = 200
ORDER = 11  # prime; the cover has ORDER + 1 residues modulo ORDER^2 + ORDER + 1
ROUNDS = 6
_GRAM = 8
QUARTERS = 4
_FLUSH = 1 << 18
_BUCKET_ENTRIES = 1 << 20

ENTRY = "bucket int, keys binary, counts binary, high binary, low binary, places binary"
FOUND = "slot int, keys binary, counts binary, places binary"  # runs of many texts
PLACES = "key long, places binary"


def difference_cover(order: int = ORDER) -> tuple[int, list[int]]:
    """Modulus and residues of a perfect difference set, from the plane of GF(order).

    Powers of a generator of GF(order^3) that fall into a fixed plane have exponents
    which differ by every residue exactly once.
    """
    modulus = order * order + order + 1
    for a in range(order):
        for b in range(order):
            for c in range(1, order):
                exponents, x = [], (1, 0, 0)
                for k in range(modulus):
                    if x[2] == 0:
                        exponents.append(k)
                    x = (x[2] * c % order, (x[0] + x[2] * b) % order, (x[1] + x[2] * a) % order)
                if len({(s - t) % modulus for s in exponents for t in exponents}) == modulus:
                    if len(exponents) == order + 1:
                        return modulus, exponents
    raise ValueError("order must be a prime")


class _Segments:
    """Texts as a block of segments; long texts are cut with an overlap of a whole window."""

    def __init__(self, texts: list[bytes], length: int):
        parts, self.text, self.offset = [], [], []
        for i, text in enumerate(texts):
            for start in range(0, max(1, len(text) - length + 1), BLOCK_BYTES):
                parts.append(text[start : start + BLOCK_BYTES + length - 1])
                self.text.append(i)
                self.offset.append(start)
        self.text, self.offset = np.array(self.text), np.array(self.offset, np.int64)
        self.block = Block(0, parts)
        self.hasher = Hasher(self.block.bytes)

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """Segment and place in the text of every byte (line feeds between segments included)."""
        segment = np.repeat(np.arange(len(self.block)), self.block.ends - self.block.starts + 1)
        return segment, np.arange(len(segment)) - self.block.starts[segment] + self.offset[segment]


def _read(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Groups of distinct texts with at most about a block of bytes, with their keys and other columns."""
    held, size = [], 0
    for batch in batches:
        for row in zip(batch["key"].to_pylist(), to_bytes(batch["text"]), *(batch[c].to_pylist() for c in extra)):
            if held and size + len(row[1]) > BLOCK_BYTES:
                yield tuple(map(list, zip(*held)))
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield tuple(map(list, zip(*held)))


def _pack(buckets: int, bucket, key, high, low, place) -> Iterator[pa.RecordBatch]:
    """Entries merged by value and packed by bucket; a merged entry has its place negated.

    All places of a merged value are repeated: they go ahead as found, under bucket -1 - x.
    """
    values = high if low is None else mix(high) ^ low.astype(np.uint64)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    if low is not None:
        same &= (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    first = np.concatenate(([True], ~same))
    again = np.concatenate((same, [False])) | ~first
    names = ["bucket", "keys", "counts", "high", "low", "places"]
    if again.any():
        found = order[again]
        for slot, *packed in _by_slot(key[found], place[found], buckets):
            none = pa.array([b""], pa.binary())
            keys, counts, places = (pa.array([x], pa.binary()) for x in packed)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - slot], pa.int32()), keys, counts, none, none, places], names)
    place = place.copy()
    place[order[first & again]] = -1 - place[order[first & again]]
    sent = np.sort(order[first])
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[sent], prepend=-1))
    rows = [[] for _ in names]
    for a, b in zip(cuts, np.append(cuts[1:], len(sent))):
        mine = sent[a:b]
        edge = np.flatnonzero(np.concatenate(([True], key[mine][1:] != key[mine][:-1])))
        rows[0].append(int(bucket[mine[0]]))
        rows[1].append(key[mine][edge].tobytes())
        rows[2].append(np.diff(np.append(edge, b - a)).astype(np.int32).tobytes())
        rows[3].append(high[mine].tobytes())
        rows[4].append(b"" if low is None else low[mine].tobytes())
        rows[5].append(place[mine].astype(np.int32).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names)


def _by_slot(key: np.ndarray, place: np.ndarray, slots: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Places as runs, packed by slots of the key: slot, keys, runs of each, starts and ends (exclusive)."""
    order = np.lexsort((place, key, _slot(key, slots)))
    key, place = key[order], place[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] > place[:-1] + 1)))
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], len(key)) - 1
    runs = np.column_stack((place[start], place[end] + 1)).astype(np.int32)
    names = key[start]
    edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    counts = np.diff(np.append(edge, len(names))).astype(np.int32)
    slot = _slot(names[edge], slots)
    cuts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    for a, b in zip(cuts, np.append(cuts[1:], len(slot))):
        last = edge[b] if b < len(edge) else len(runs)
        yield int(slot[a]), names[edge[a:b]].tobytes(), counts[a:b].tobytes(), runs[edge[a] : last].tobytes()


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % np.uint64(slots)).astype(np.int64)


def flushed(parts: Iterator[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs what the blocks give whenever a quarter of a million entries have come together."""
    held, count = [], 0
    for part in parts:
        held.append(part)
        count += len(part[0])
        if count >= _FLUSH:
            whole = _joined(held)
            held, count = [], 0  # the parts go before their union is sorted
            yield from _pack(buckets, *whole)
    if count:
        whole = _joined(held)
        held = []
        yield from _pack(buckets, *whole)


def _joined(parts: list[tuple]) -> list:
    return [None if x[0] is None else np.concatenate(x) for x in zip(*parts)]


def _unseen(groups: Iterator[tuple]) -> Iterator[tuple]:
    """Leaves out texts whose key has come before in this task; the keys of a task fit in memory."""
    seen: set[int] = set()
    for group in groups:
        fresh = [k not in seen and not seen.add(k) for k in group[0]]
        if any(fresh):
            yield tuple([x for x, ok in zip(column, fresh) if ok] for column in group)


@releasing
def _cover_entries(batches, buckets: int, length: int, order: int) -> Iterator[pa.RecordBatch]:
    modulus, residues = difference_cover(order)
    sampled = np.zeros(modulus, bool)
    sampled[residues] = True
    width = length - modulus + 1

    def parts():
        for keys, texts in _unseen(_read(batches)):
            s = _Segments(texts, length)
            segment, place = s.positions()
            room = s.block.ends[segment] - np.arange(len(segment))
            # places past a cut belong to the next segment
            last = np.append(s.text[1:] != s.text[:-1], True)
            at = np.flatnonzero(sampled[place % modulus] & (room >= width) & (last[segment] | (place - s.offset[segment] < BLOCK_BYTES)))
            values = s.hasher.spans(at, at + width)
            key = np.array(keys, np.int64)[s.text[segment[at]]]
            yield (values >> np.uint64(33)).astype(np.int64) % buckets, key, values, None, place[at]

    yield from flushed(parts(), buckets)


def _gram_values(data: np.ndarray, size: int) -> np.ndarray:
    """A spread-out value of the ``size`` bytes (8 at most) from every position on; zeros lie behind the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray(len(data), np.dtype("<u8"), padded, strides=(1,))
    values = (words & np.uint64((1 << 8 * size) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values


@releasing
def _suffix_entries(batches, buckets: int, length: int, modulus: int, turn: int, rounds: int) -> Iterator[pa.RecordBatch]:
    def parts():
        for keys, texts, runs in _unseen(_read(batches, ("places",))):
            s = _Segments(texts, length)
            data = s.block.bytes
            marks = np.zeros(len(data) + 1, np.int32)
            for k, (i, offset) in enumerate(zip(s.text, s.offset)):
                spans = np.frombuffer(runs[i], np.int32).reshape(-1, 2).astype(np.int64) - offset
                size = min(s.block.ends[k] - s.block.starts[k] - length + 1, BLOCK_BYTES)
                low, high = np.clip(spans[:, 0] - modulus + 1, 0, max(0, size)), np.clip(spans[:, 1], 0, max(0, size))
                np.add.at(marks, low + s.block.starts[k], 1)
                np.add.at(marks, high + s.block.starts[k], -1)
            at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            if not len(at):
                continue
            # the smallest gram of each quarter: equal strings share all four, neighbours mostly too
            quarter = length // QUARTERS
            gram = min(_GRAM, max(1, quarter // 2))
            low = _gram_values(data, gram)
            span, step = quarter - gram + 1, 1
            while 2 * step <= span:
                np.minimum(low[:-step], low[step:], out=low[:-step])
                step *= 2
            least = np.minimum(low[: len(low) - span + step], low[span - step :])
            room = len(data) - length + 1  # every marked place has a whole string behind it
            anchor = least[:room].copy()
            for k in range(1, QUARTERS):
                anchor *= np.uint64(0x9E3779B97F4A7C15)
                anchor += least[k * quarter : k * quarter + room]
            share = mix(anchor[at]) % np.uint64(buckets * rounds)
            mine = share % np.uint64(rounds) == turn
            if not mine.any():
                continue
            at, share = at[mine], share[mine]
            segment = s.block.owner(at)
            place = at - s.block.starts[segment] + s.offset[segment]
            other = Hasher(data, 1).spans(at, at + length)
            key = np.array(keys, np.int64)[s.text[segment]]
            yield (share // np.uint64(rounds)).astype(np.int64), key, s.hasher.spans(at, at + length), (other >> np.uint64(32)).astype(np.uint32), place

    yield from flushed(parts(), buckets)


@releasing
def find_ties(batches, slots: int) -> Iterator[pa.RecordBatch]:
    """Sorts the entries of this task's buckets and gives the places of repeated values by text."""
    held, names = [], ["slot", "keys", "counts", "places"]
    for batch in batches:
        for bucket, keys, counts, high, low, places in zip(*(batch[c].to_pylist() for c in range(6))):
            if bucket < 0:
                packed = (pa.array([x], pa.binary()) for x in (keys, counts, places))
                yield pa.RecordBatch.from_arrays([pa.array([-1 - bucket], pa.int32()), *packed], names)
                continue
            high = np.frombuffer(high, np.uint64)
            held.append((
                np.repeat(np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int32)),
                high,
                np.frombuffer(low, np.uint32) if low else np.zeros(len(high), np.uint32),
                np.frombuffer(places, np.int32),
            ))
    if not held:
        return
    key, high, low, place = _joined(held)
    merged, place = place < 0, np.where(place < 0, -1 - place, place)
    order = np.lexsort((low, high))
    key, high, low, place, merged = key[order], high[order], low[order], place[order], merged[order]
    first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
    size = np.diff(np.append(first, len(key)))
    head = np.repeat(first, size)
    # copies of a text bring the same place of the same key; only another place is a repeat
    other = (key != key[head]) | (place != place[head])
    repeated = np.repeat(np.logical_or.reduceat(other, first), size) & ~merged
    # what met a merged value is repeated too, and the merged places are known already
    near = np.repeat(np.logical_or.reduceat(merged, first), size) & ~merged
    found = repeated | near
    if found.any():
        rows = list(zip(*_by_slot(key[found], place[found], slots)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names)


@releasing
def _union(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """The union of the runs of each text of this task's slots, each run made longer by ``reach``."""
    keys, runs = [], []
    for batch in batches:
        for names, counts, places in zip(*(batch[c].to_pylist() for c in ("keys", "counts", "places"))):
            keys.append(np.repeat(np.frombuffer(names, np.int64), np.frombuffer(counts, np.int32)))
            runs.append(np.frombuffer(places, np.int32).reshape(-1, 2).astype(np.int64))
    if not keys:
        return
    key, runs = np.concatenate(keys), np.concatenate(runs)
    order = np.lexsort((runs[:, 0], key))
    key, runs = key[order], runs[order]
    text = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) << 33
    start, end = runs[:, 0] + text, np.maximum.accumulate(runs[:, 1] + reach + text)
    fresh = np.concatenate(([True], (start[1:] > end[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(key)) - 1
    joined = np.column_stack((start[first] - text[first], end[last] - text[first])).astype(np.int32)
    edge = np.flatnonzero(np.concatenate(([True], key[first][1:] != key[first][:-1])))
    for begin in range(0, len(edge), 10_000):
        cuts = np.append(edge[begin : begin + 10_000], edge[begin + 10_000] if begin + 10_000 < len(edge) else len(first))
        places = [joined[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(key[first][cuts[:-1]]), pa.array(places, pa.binary())], ["key", "places"])


def gathered(found: DataFrame, slots: int, reach: int = 0) -> DataFrame:
    """``key, places``: one row per text with the union of its runs."""
    return found.repartition(slots, "slot").mapInArrow(lambda it: _union(it, reach), PLACES)


def bucket_count(df: DataFrame, entries: float) -> int:
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, int(entries // _BUCKET_ENTRIES) + 1)


def repeated_spans(
    docs: DataFrame, *, length: int = LENGTH, order: int = ORDER, rounds: int = ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``key, copies, n_bytes`` of every text, and ``key, places`` of what repeats.

    ``places`` holds the byte spans to remove as 32-bit starts and ends. ``docs``
    has ``doc_id, text``; ``key`` is ``xxhash64(text)``.
    """
    modulus, _ = difference_cover(order)
    if length <= modulus:
        raise ValueError("length must exceed the cover's modulus")
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("key"), "text")
    long_texts = texts.where(F.octet_length("text") >= length)
    survey = materialize(
        texts.groupBy("key").agg(
            F.count("*").alias("copies"),
            F.min(F.coalesce("doc_id", "key")).alias("row_id"),
            F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("n_bytes"),
        )
    )
    total = survey.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = bucket_count(docs, total * (order + 1) / modulus)
    ranks = long_texts.select("key", "text").mapInArrow(lambda it: _cover_entries(it, buckets, length, order), ENTRY)
    ties = ranks.repartition(buckets, "bucket").mapInArrow(lambda it: find_ties(it, buckets), FOUND)
    flagged = materialize(gathered(materialize(ties), buckets))
    # one row of each text, found by its smallest doc_id, so copies do not travel
    chosen = flagged.join(survey.select("key", "row_id"), "key")
    rows = long_texts.select("key", F.coalesce("doc_id", "key").alias("row_id"), "text")
    candidates = materialize(rows.join(chosen, ["key", "row_id"]).select("key", "text", "places"))
    size = candidates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(docs, size / rounds)
    found = None
    for turn in range(rounds):
        entries = candidates.mapInArrow(
            lambda it, turn=turn: _suffix_entries(it, buckets, length, modulus, turn, rounds), ENTRY
        )
        ties = materialize(entries.repartition(buckets, "bucket").mapInArrow(lambda it: find_ties(it, buckets), FOUND))
        found = ties if found is None else found.unionByName(ties)
    # a run of starts covers the bytes up to the end of its last string
    return survey, materialize(gathered(found, buckets, length - 1))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, as_text: bool = False, **options) -> DataFrame:
    """Add ``n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the remaining bytes) to every row.

    With ``as_text``, ``kept`` is a string without the bytes of characters that were cut
    through. A null text counts as empty; texts under ``length`` bytes stay whole; of several
    equal texts of ``length`` bytes or more nothing stays. Other columns, repeated
    rows included, are kept; columns of the added names are replaced. An empty table
    gives an empty result.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    rest = docs.drop(*added)
    bound_batches(docs.sparkSession)
    survey, spans = repeated_spans(rest, length=length, **options)
    copied = survey.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("key", F.lit(True).alias("_copied"))
    marks = spans.join(copied, "key", "full").select(F.col("key").alias("_key"), F.col("places").alias("_places"), "_copied")
    joined = rest.withColumn("_at", F.xxhash64("text")).join(marks, F.col("_at") == F.col("_key"), "left").drop("_at", "_key")
    names = rest.columns

    @releasing
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in added]
            for text, places, copied in zip(to_bytes(batch["text"]), batch["_places"].to_pylist(), batch["_copied"].to_pylist()):
                runs = [(0, len(text))] if copied else np.frombuffer(places or b"", np.int32).reshape(-1, 2).tolist()
                parts, last = [], 0
                for a, b in runs:
                    parts.append(text[last:a])
                    last = b
                kept = b"".join([*parts, text[last:]])
                for column, x in zip(columns, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if as_text else kept)):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*names, *added]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return joined.mapInArrow(
        apply, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}"
    )
