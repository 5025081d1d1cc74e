"""Collocations: frequent phrases of two to five words, counted in tiles of ranked ids.

Frequent words get ids by falling frequency, texts become arrays of ids, and every
two neighbouring ids are one cell of a table addressed by both ids. The table is
cut into square tiles. A task counts a crowded tile, which by the ranks lies at the
low ids, in a dense array by ``bincount``; thinly filled tiles share one sorted
list of cells and counts. Spark adds the counts of all tasks.

Frequent pairs are ranked again and become the ids of the next round, in which two
neighbouring ids are two phrases that overlap in all but one word each. A phrase
is at most as frequent as its parts, so nothing frequent is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.blocks import LOWER, Block, Hasher, blocks, bound_batches, word_spans
from kinfold.session import materialize

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
TILE = 1024  # ids a side
HEAD = 1 << 20  # most frequent entries of a dictionary that travel to every task, 24 MB at most
UNKNOWN = "und"
_DENSE_SHARE = 16  # a tile is dense while its batch fills one cell in this many
_DENSE_TILES = 4  # dense counters a task keeps, 8 MB each
_BUFFER = 1 << 21  # cells a task gathers before it sorts them
_BLOCK = 1 << 18
_MOST = 1 << 31  # ids of one language

_BREAK = np.zeros(256, bool)
_BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _language(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(UNKNOWN))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, Block, np.ndarray]]:
    """Runs of texts of one language with their lower-cased bytes."""
    for lang in pc.unique(batch["lang"]).to_pylist():
        column = batch["text"].filter(pc.equal(batch["lang"], lang))
        for block in blocks(column, _BLOCK):
            yield lang, block, LOWER[block.bytes]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and two 64-bit hashes of each."""
    starts, ends = word_spans(data, _GAP)
    return starts, ends, Hasher(data, 0).spans(starts, ends), Hasher(data, 1).spans(starts, ends)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, _, data in _blocks(batch):
            starts, ends, one, two = _words(data)
            if not len(starts):
                continue
            _, first, count = np.unique(one, return_index=True, return_counts=True)
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(one[first].view(np.int64)), pa.array(two[first].view(np.int64)), pa.array(count.astype(np.int64)),
                ],
                ["lang", "word", "one", "two", "c"],
            )


def _ranked(found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``id``: the place from 0 by falling ``c`` in the language, ties by ``keys``.

    A range sort over all languages, counts of its partitions, and places inside
    them: no language is ever in one task.
    """
    order = ["lang", F.desc("c"), *keys]
    place = F.monotonically_increasing_id()
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place)
    dealt = materialize(dealt.withColumn("__part", F.shiftright("__place", 33)))
    counts = dealt.groupBy("lang", "__part").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy("lang").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each language and partition
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = dealt.join(F.broadcast(counts), ["lang", "__part"])
    ids = F.col("__before") + F.col("__place") - F.col("__first")
    return ranked.withColumn("id", ids).drop("__place", "__part", "__before", "__first")


class _Head:
    """The most frequent keys of each language, sorted for binary search."""

    def __init__(self, table: pa.Table):
        self.by_lang = {}
        langs = table["lang"].to_pylist()
        one, two, ids = (table[c].to_numpy() for c in ("one", "two", "id"))
        order = np.argsort(one, kind="stable")
        group = np.array([langs[i] for i in order], object)
        for lang in set(langs):
            mine = order[group == lang]
            self.by_lang[lang] = one[mine], two[mine], ids[mine].astype(np.int32)

    def find(self, lang: str, one: np.ndarray, two: np.ndarray | None) -> np.ndarray:
        """The id of each key, -1 for keys that are not here."""
        keys, checks, ids = self.by_lang.get(lang, (np.zeros(0, np.int64),) * 3)
        if not len(keys) or not len(one):
            return np.full(len(one), -1, np.int32)
        at = np.minimum(np.searchsorted(keys, one), len(keys) - 1)
        same = keys[at] == one
        if two is not None:
            same &= checks[at] == two
        return np.where(same, ids[at], -1).astype(np.int32)


def _shipped(dictionary: DataFrame, head: int):
    """The head of the dictionary for every task, and what lies beyond it (None where nothing does)."""
    if dictionary.where(F.col("id") >= _MOST - 1).limit(1).count():
        raise ValueError("a language has more than 2^31 frequent phrases")
    total = dictionary.count()
    langs = max(1, dictionary.select("lang").distinct().count())
    cut = head // langs if total > head else _MOST
    near = dictionary.where(F.col("id") < cut).select("lang", "one", "two", "id")
    # at most ``head`` rows
    shared = dictionary.sparkSession.sparkContext.broadcast(_Head(near.toArrow()))
    return shared, (dictionary.where(F.col("id") >= cut).select("lang", "one", "two", "id") if total > head else None)


_ENCODED = "lang string, ids binary, places binary, open array<struct<place:int,one:bigint,two:bigint>>"
_OPEN = pa.list_(pa.struct([("place", pa.int32()), ("one", pa.int64()), ("two", pa.int64())]))


def _row(lang: str, ids: np.ndarray, unknown: np.ndarray, one, two) -> pa.RecordBatch:
    rest = [{"place": int(p), "one": int(one[k]), "two": 0 if two is None else int(two[k])} for k, p in unknown] if unknown is not None else None
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([rest], _OPEN)],
        ["lang", "ids", "places", "open"],
    )


def _finish(encoded: DataFrame, tail: DataFrame | None) -> DataFrame:
    """``lang, ids`` with the ids of the dictionary's tail put in by a join on the keys."""
    if tail is None:
        return materialize(encoded.select("lang", "ids"))
    rows = materialize(encoded.withColumn("row", F.monotonically_increasing_id()))
    asked = rows.select("row", "lang", F.explode("open").alias("o")).select("row", "lang", "o.*")
    found = asked.join(tail, ["lang", "one", "two"])  # keys outside the head: no hot one is left
    # a row is a run of texts of about 256 kB or one text
    found = found.groupBy("row").agg(F.collect_list(F.struct("place", "id")).alias("found"))
    joined = rows.select("row", "lang", "ids").join(found, "row", "left").select("lang", "ids", "found")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for raw, late in zip(batch["ids"].to_pylist(), batch["found"].to_pylist()):
                ids = np.frombuffer(raw, np.int32).copy()
                if late:
                    ids[[x["place"] for x in late]] = [x["id"] for x in late]
                done.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(done, pa.binary())], ["lang", "ids"])

    return materialize(joined.mapInArrow(put, "lang string, ids binary"))


def _encode_words(texts: DataFrame, dictionary: DataFrame, head: int) -> DataFrame:
    """``lang, ids``: word ids in text order, -1 for other words and between pieces."""
    shared, tail = _shipped(dictionary, head)
    wanted = tail is not None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, data in _blocks(batch):
                starts, _, one, two = _words(data)
                if not len(starts):
                    continue
                one, two = one.view(np.int64), two.view(np.int64)
                known = shared.value.find(lang, one, two)
                closed = np.cumsum(_BREAK[data])[starts]
                place = np.arange(len(starts)) + np.cumsum(np.diff(closed, prepend=closed[0]) > 0)
                ids = np.full(place[-1] + 1, -1, np.int32)
                ids[place] = known
                unknown = [(k, place[k]) for k in np.flatnonzero(known < 0)] if wanted else None
                yield _row(lang, ids, unknown, one, two)

    return _finish(texts.mapInArrow(encode, _ENCODED), tail)


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _encode_pairs(below: DataFrame, dictionary: DataFrame, head: int) -> DataFrame:
    """``lang, ids`` of the next round: each frequent pair of neighbouring ids gets its own id.

    Runs of -1 shrink to one, and rows without two neighbouring ids are left out.
    """
    shared, tail = _shipped(dictionary, head)
    wanted = tail is not None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, raw in zip(batch["lang"].to_pylist(), batch["ids"].to_pylist()):
                g = np.frombuffer(raw, np.int32)
                both = (g[:-1] >= 0) & (g[1:] >= 0)
                ids = np.full(max(0, len(g) - 1), -1, np.int32)
                codes = _code(g[:-1][both], g[1:][both])
                ids[both] = shared.value.find(lang, codes, None)
                if wanted:
                    where = np.flatnonzero(both)
                    unknown = [(k, where[k]) for k in np.flatnonzero(ids[both] < 0)]
                    yield _row(lang, ids, unknown, codes, None)
                    continue
                keep = (ids >= 0) | (np.append(True, ids[:-1] >= 0))
                ids = ids[keep]
                if ((ids[:-1] >= 0) & (ids[1:] >= 0)).any():
                    yield _row(lang, ids, None, None, None)

    return _finish(below.mapInArrow(encode, _ENCODED), tail)


class TileCounter:
    """Counts the cells of one language: crowded tiles densely, the rest as a sorted list."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append(_code(a, b))
        self.size += len(a)

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes and counts of the thin tiles among the waiting cells; dense ones are kept."""
        codes = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int64)
        self.waiting, self.size = [], 0
        a, b = codes >> 32, codes & 0xFFFFFFFF
        tile = (a // TILE) << 32 | b // TILE
        # dense tiles lie at the lowest ranks; look at the few tiles nearest the corner only
        for corner in (0, 1, 1 << 32, 1 << 32 | 1):
            mine = tile == corner
            crowded = mine.sum() * _DENSE_SHARE >= TILE * TILE
            if not (crowded or corner in self.dense) or (corner not in self.dense and len(self.dense) >= _DENSE_TILES):
                continue
            cells = (a[mine] % TILE) * TILE + b[mine] % TILE
            counts = np.bincount(cells, minlength=TILE * TILE)
            self.dense[corner] = self.dense[corner] + counts if corner in self.dense else counts
            left = ~mine
            codes, a, b, tile = codes[left], a[left], b[left], tile[left]
        return np.unique(codes, return_counts=True)

    def dense_cells(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for tile, counts in self.dense.items():
            cells = np.flatnonzero(counts)
            a = (tile >> 32) * TILE + cells // TILE
            b = (tile & 0xFFFFFFFF) * TILE + cells % TILE
            yield _code(a, b), counts[cells]
        self.dense = {}


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(lang: str, codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), 1 << 17):
            part = codes[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(part)), pa.array(part >> 32), pa.array(part & 0xFFFFFFFF),
                    pa.array(counts[at : at + (1 << 17)].astype(np.int64)),
                ],
                ["lang", "a", "b", "c"],
            )

    # one counter at a time in memory beyond its waiting cells: languages settle when they are many
    counters: dict[str, TileCounter] = {}
    for batch in batches:
        for lang, raw in zip(batch["lang"].to_pylist(), batch["ids"].to_pylist()):
            g = np.frombuffer(raw, np.int32)
            for at in range(0, max(0, len(g) - 1), _BUFFER):  # a long text is counted in parts
                part = g[at : at + _BUFFER + 1]
                both = (part[:-1] >= 0) & (part[1:] >= 0)
                counter = counters.setdefault(lang, TileCounter())
                counter.add(part[:-1][both], part[1:][both])
                if sum(c.size for c in counters.values()) >= _BUFFER:
                    for name, own in counters.items():
                        yield from rows(name, *own.settle())
                    if len(counters) > 8:
                        for name, own in counters.items():
                            for found in own.dense_cells():
                                yield from rows(name, *found)
                        counters = {}
    for name, own in counters.items():
        yield from rows(name, *own.settle())
        for found in own.dense_cells():
            yield from rows(name, *found)


def phrases(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    head: int = HEAD,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``max_words`` words with ``min_count`` or more occurrences, by language.

    Returns a table ``lang, k, id, a, phrase, last, pre, suf, left, right`` - ``a``
    the count, ``pre[m]`` and ``suf[m]`` the counts of the first and of the last m
    words, ``left`` and ``right`` the ids of the phrase without its last and its
    first word - and a table ``lang, n`` of all word occurrences. Null texts count
    as empty, a null language as ``und``; repeated rows count each time. Equal
    words meet by 128-bit hashes when texts are encoded, by themselves when counted.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(_language(lang_col).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    counted = texts.mapInArrow(_count_words, "lang string, word string, one long, two long, c long")
    words = materialize(counted.groupBy("lang", "word", "one", "two").agg(F.sum("c").alias("c")))
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    ranked = materialize(_ranked(words.where(F.col("c") >= min_count), ["word"]))
    none = F.array().cast("array<long>")
    level = ranked.select(
        "lang", F.lit(1).alias("k"), "id", F.col("c").alias("a"), F.col("word").alias("phrase"), F.col("word").alias("last"),
        none.alias("pre"), none.alias("suf"), F.lit(-1).cast("long").alias("left"), F.lit(-1).cast("long").alias("right"),
    )
    level = materialize(level)
    levels, ids = [level], _encode_words(texts, ranked.select("lang", "one", "two", "id"), head)
    for k in range(2, max_words + 1):
        counts = ids.mapInArrow(_count_pairs, "lang string, a long, b long, c long")
        counts = counts.groupBy("lang", "a", "b").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count)
        pairs = _ranked(materialize(counts), ["a", "b"])  # the range sort reads its input twice
        left = level.select("lang", F.col("id").alias("a"), F.col("a").alias("__la"), F.col("phrase").alias("__lp"), F.col("pre").alias("__pre"))
        right = level.select("lang", F.col("id").alias("b"), F.col("a").alias("__ra"), F.col("last").alias("__last"), F.col("suf").alias("__suf"))
        level = materialize(
            pairs.join(left, ["lang", "a"]).join(right, ["lang", "b"]).select(
                "lang", F.lit(k).alias("k"), "id", F.col("c").alias("a"),
                F.concat_ws(" ", "__lp", "__last").alias("phrase"), F.col("__last").alias("last"),
                F.concat("__pre", F.array("__la")).alias("pre"), F.concat("__suf", F.array("__ra")).alias("suf"),
                F.col("a").alias("left"), F.col("b").alias("right"),
            )
        )
        levels.append(level)
        if k < max_words:
            key = (F.shiftleft("left", 32) + F.col("right")).alias("one")
            ids = _encode_pairs(ids, level.select("lang", key, F.lit(0).cast("long").alias("two"), "id"), head)
    table = levels[0]
    for more in levels[1:]:
        table = table.unionByName(more)
    return table, totals


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    head: int = HEAD,
) -> DataFrame:
    """The best-bound phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Every cut of a phrase scores floor(1000 a n / (l r)), in exact decimals; the
    lowest counts, of equal ones the earliest. A phrase is dropped where one word
    more on either side keeps its count: any longer phrase around it with the same
    count holds such a one, as counts never grow with length. See ``phrases`` for
    null, empty, long and repeated texts; an empty table gives no rows.
    """
    table, totals = phrases(
        docs, text_col=text_col, lang_col=lang_col, min_count=min_count, max_words=max_words, head=head
    )
    whole = lambda c: c.cast("decimal(38,0)")
    longer = table.where("k > 2")
    around = longer.select("lang", (F.col("k") - 1).alias("k"), F.explode(F.array("left", "right")).alias("id"), "a").distinct()
    kept = table.where("k > 1").join(around, ["lang", "k", "id", "a"], "left_anti")
    # one row for each language
    scored = kept.join(totals, "lang").withColumn("__top", whole(F.lit(1000)) * whole(F.col("a")) * whole(F.col("n")))
    cuts = F.expr(
        "array_min(transform(sequence(1, k - 1), m -> struct("
        "__top div (cast(pre[m - 1] as decimal(38,0)) * cast(suf[k - m - 1] as decimal(38,0))) as score, "
        "m, pre[m - 1] as l, suf[k - m - 1] as r)))"
    )
    scored = scored.withColumn("__cut", cuts).select("lang", "phrase", "a", "__cut.l", "__cut.r", "n", "__cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
