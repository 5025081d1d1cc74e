"""Repeats, near duplicates, mixing, counts and pieces against plain computations."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from kinfold.llm import jaccard, mixing, pieces, quality, suffixes
from kinfold.llm.blocks import Block

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, key string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(120)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + rng.choice([".", "\n", ""])
    passage, base = prose(40), prose(60)
    texts: list[str | None] = [None, "", " \t\n", "one", "ONE", "two words", "x" * 3000, prose(3000)]
    for k in range(40):
        kind = rng.randrange(5)
        if kind == 0:
            texts.append(prose(20) + passage[rng.randrange(30) :] + prose(20))
        elif kind == 1:
            changed = base.split(" ")
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            texts.append(" ".join(changed))
        elif kind == 2:
            texts.append(base)
        else:
            texts.append(prose(rng.randint(1, 80)))
    return texts


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, 0, "r", "k", 1) for i, t in enumerate(texts)]
    rows += [rows[12], (None, texts[13], "en", "s1", 0, "r", "k", 1), (3, texts[14], "en", "s1", 0, "r", "k", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def expected_spans(rows: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    seen = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    found = []
    for t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(np.int8)))
        found.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])])
    return found


@pytest.mark.parametrize("length,order,rounds", [(30, 3, 2), (60, 5, 1), (200, 11, 3)])
def test_repeats_are_those_of_a_direct_count(docs, length, order, rounds):
    rows = [(r.text or "").encode() for r in docs.collect()]
    spans = expected_spans(rows, length)
    want = Counter()
    for t, runs in zip(rows, spans):
        kept, last = b"", 0
        for a, b in runs:
            kept, last = kept + t[last:a], b
        kept += t[last:]
        want[len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()] += 1
    got = suffixes.remove_repeats(docs, length=length, order=order, rounds=rounds)
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert set(docs.columns) <= set(got.columns)


def test_long_texts_are_cut_into_segments_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 500)
    text = make_texts(5)[7].encode() * 2
    entries = list(suffixes._cover_entries(iter([_batch(1, text)]), 4, 60, 3))
    found = list(suffixes.find_ties(iter(entries), 4))
    places = np.concatenate([np.frombuffer(p, np.int32).reshape(-1, 2) for b in found for p in b["places"].to_pylist()])
    covered = np.zeros(len(text), bool)
    for a, b in places:
        covered[a:b] = True
    modulus, residues = suffixes.difference_cover(3)
    sampled = [p for p in range(len(text) - (60 - modulus + 1) + 1) if p % modulus in residues]
    seen = Counter(text[p : p + 60 - modulus + 1] for p in sampled)
    assert [p for p in sampled if seen[text[p : p + 60 - modulus + 1]] > 1] == np.flatnonzero(covered).tolist()


def _batch(key: int, text: bytes):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([text.decode()])], ["key", "text"])


def test_a_line_of_many_texts_fills_no_bucket(spark):
    """120 bytes in a third of the texts, among other neighbours each time: its suffixes spread over all buckets."""
    rng = random.Random(6)
    line = "".join(rng.choices("abcdefgh ", k=120))
    other = lambda: "".join(rng.choices("ijklmnop ", k=300))
    texts = [other() + line + other() if i % 3 == 0 else other() + other() for i in range(600)]
    places = np.array([[300 - 100, 420]], np.int32).tobytes()
    batch = _batches([(i, t, places) for i, t in enumerate(texts) if i % 3 == 0])
    sizes = Counter()
    for turn in range(4):
        for found in suffixes._suffix_entries(iter([batch]), 16, 200, 133, turn, 4):
            for bucket, high in zip(found["bucket"].to_pylist(), found["high"].to_pylist()):
                sizes[turn, bucket] += len(high) // 8
    assert len(sizes) == 64 and max(sizes.values()) < 2 * np.median(list(sizes.values()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert suffixes.remove_repeats(docs).where("n_removed > 0").isEmpty()
    assert suffixes.remove_repeats(docs, length=100, order=7).where("n_removed between 120 and 140").count() == 200


def _batches(rows):
    import pyarrow as pa

    keys, texts, places = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(texts), pa.array(places, pa.binary())], ["key", "text", "places"])


def test_difference_cover_holds_every_difference_once():
    for order in (2, 3, 5, 7, 11):
        modulus, residues = suffixes.difference_cover(order)
        assert len(residues) == order + 1
        assert Counter((a - b) % modulus for a in residues for b in residues if a != b) == Counter(range(1, modulus))


def shingle_set(text: str | None) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected_components(sets: list[frozenset]) -> list[int]:
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("block_points", [2, 1024])
def test_near_duplicates_are_those_of_all_pairs(docs, block_points):
    """Two points a block force pivots, windows and block pairs."""
    rows = docs.collect()
    sets = [shingle_set(r.text) for r in rows]
    label = expected_components(sets)
    groups = defaultdict(list)
    for x, r in zip(label, rows):
        groups[x].append(r.doc_id)
    least = {x: min((i for i in ids if i is not None), default=None) for x, ids in groups.items()}
    want = Counter((r.doc_id, len(s), least[x] if s else r.doc_id) for r, s, x in zip(rows, sets, label))
    named = jaccard.jaccard_components(docs, block_points=block_points)
    ids = {}
    for r in named.collect():
        ids.setdefault(r.component, []).append(r.doc_id)
    low = {c: min((i for i in x if i is not None), default=None) for c, x in ids.items()}
    got = Counter((r.doc_id, r.n_shingles, r.doc_id if r.component is None else low[r.component]) for r in named.collect())
    assert got == want
    if block_points > 2:
        direct = jaccard.near_duplicates(docs).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in direct) == want


def test_voronoi_regions_keep_every_pair(spark):
    """A chain of sets around far centres: regions shrink, and no link is lost at their borders."""
    rng = np.random.default_rng(2)
    sets, centre = [], rng.integers(1, 1 << 60, (6, 60)).astype(np.uint64)
    for k in range(90):
        own = centre[k % 6].copy()
        own[rng.integers(0, 60, rng.integers(0, 7))] = rng.integers(1, 1 << 60)
        sets.append(np.unique(own))
    rows = [(1, i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)]
    points = spark.createDataFrame(rows, "region long, key long, n long, shingles binary")
    done, rest = jaccard._split(points, 80, 8, 6)
    assert rest is not None and rest.count() >= 90 and rest.select("region").distinct().count() > 1
    edges = [(r.u, r.v) for r in jaccard.links(points, block_points=8).collect()]
    label = list(range(90))
    for u, v in edges:
        low, high = sorted((label[u], label[v]))
        label = [low if x == high else x for x in label]
    plain = [frozenset(s.tolist()) for s in sets]
    assert label == expected_components(plain)


def test_intersections_of_common_and_rare_members():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, 60)).astype(np.uint64) for _ in range(150)]
    sets += [np.unique(np.append(np.arange(1000, 1040), rng.integers(0, 9999, 5))).astype(np.uint64) for _ in range(60)]
    plain = [set(s.tolist()) for s in sets]
    assert (jaccard.intersections(sets, columns=7) == np.array([[len(a & b) for b in plain] for a in plain])).all()


def test_one_of_each_group_stays(docs):
    kept = jaccard.keep_one(docs).collect()
    rows = docs.collect()
    label = dict(zip([(r.doc_id, r.text) for r in rows], expected_components([shingle_set(r.text) for r in rows])))
    groups = Counter(label[r.doc_id, r.text] for r in kept if WORD.search(r.text or ""))
    assert set(groups.values()) == {1} and len(groups) == len({x for (i, t), x in label.items() if WORD.search(t or "")})
    assert sum(not WORD.search(r.text or "") for r in kept) == sum(not WORD.search(r.text or "") for r in rows)


def expected_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_mix_follows_targets_and_repeats(docs):
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size
    target = expected_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + max(largest.values())
    assert sum(taken.values()) <= sum(sizes.values())
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect())
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_small_and_lone_sources_are_capped(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate("a" * 20 + "b" * 2 + "c")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.source: r.target for r in got} == pytest.approx({"a": 140.0, "b": 60.0, "c": 30.0})


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def test_counts_are_those_of_a_plain_loop(docs, spark):
    extra = ["a b\na b\n a b\n\n\n", "é# | é*　x", "a b c d e f g h " * 5, "a b c d e f g h i a b c d e f g h", "\x0b\x1f\x85 x"]
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = quality.text_counts(both, ["doc_id"]).collect()
    want = Counter((r.doc_id, *plain_counts(r.text)) for r in both.collect())
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got) == want


def test_upper_bound_is_exact():
    from math import comb

    for k, n, level in ((0, 50, 0.05), (3, 40, 0.01), (7, 200, 1e-4)):
        rate = quality.upper_bound(k, n, level)
        tail = sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(level, rel=1e-6)
    assert quality.upper_bound(5, 5, 0.1) == 1.0


def test_cutoffs_hold_their_limit_and_pay():
    good, bad = np.zeros(41, np.int64), np.zeros(41, np.int64)
    good[0], good[5], bad[0], bad[30] = 5000, 5, 10, 400
    assert quality.choose_cutoff(good, bad, 0.01, 1e-4, 20) == 30  # the mildest that has the whole gain
    good[35] = 100
    assert quality.choose_cutoff(good, bad, 0.01, 1e-4, 20) is None
    assert quality.choose_cutoff(np.zeros(41, np.int64), bad, 0.01, 1e-4, 20) is None


def test_quality_keeps_where_labels_cannot_tell(docs, spark):
    counts = quality.base_rules(quality.text_counts(docs, ["doc_id", "lang"]))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(counts, quality.thresholds(counts, labels)).collect()
    assert all(r.kept == (not r.base_failed) for r in judged) and len(judged) == docs.count()


@pytest.mark.parametrize("labelled", [300, 500])
def test_quality_finds_separable_bad_texts_of_small_strata(spark, labelled):
    """A few hundred labels decide; together the rules reject no more good texts than the limit."""
    rng = random.Random(labelled)
    rows, labels = [], []
    for i in range(8 * labelled):
        quality_of = int(i % 10 > 0)
        words = [rng.choice(["alpha", "beta", "of", "gamma", "deltas", "to"]) + str(rng.randrange(99)) for _ in range(60)]
        if not quality_of:
            words += ["#$%|#$%|"] * rng.randint(15, 30)
        rows.append((i, " ".join(words), ("aa", "bb", "cc", None)[i // 10 % 4]))
        if i < 4 * labelled:
            labels.append((i, quality_of, 0))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = quality.base_rules(quality.text_counts(table, ["doc_id", "lang"])).cache()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judged = quality.judge(counts, quality.thresholds(counts, marks)).where("not base_failed").collect()
    for lang in ("aa", "bb", "cc", None):
        mine = [r for r in judged if r.lang == lang]
        good, bad = [r for r in mine if r.doc_id % 10], [r for r in mine if r.doc_id % 10 == 0]
        assert len(bad) > 30 and sum(r.kept for r in bad) <= 0.05 * len(bad)
        assert sum(not r.kept for r in good) <= 0.05 * len(good)


def test_verdicts_share_one_limit():
    """Two rules that each hold alone are not both taken when together they pass the limit."""
    steps = np.array([[0, 0], [9, 0], [0, 9]])
    good, bad = np.array([960, 20, 20]), np.array([0, 60, 50])
    path = quality.propose(steps, good, bad, 0.05)
    assert {r for r, _ in path} == {0, 1}
    assert set(quality.certify(path, steps, good, bad, 0.05, 0.01)) == {0}
    assert set(quality.certify(path, steps, good * [1, 0, 0], bad, 0.05, 0.01)) == {0, 1}


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_vocabulary())


def plain_viterbi(codec, word: str) -> float:
    scores = {p: s for p, s, k in zip(codec.vocabulary.pieces, codec.vocabulary.scores, codec.vocabulary.kinds) if k == "n"}
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 20), end):
            part = word[start:end]
            score = scores.get(part, codec.penalty if len(part) == 1 else -np.inf)
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_viterbi_finds_the_best_sum(codec):
    rng = random.Random(4)
    for _ in range(200):
        word = "▁" + "".join(rng.choices("thea nerißé日\u0001x▁".replace(" ", ""), k=rng.randint(1, 25))).replace("▁", "")
        ids = codec.viterbi(word)
        kinds, scores, total, at = codec.vocabulary.kinds, codec.vocabulary.scores, 0.0, 0
        while at < len(ids):
            if kinds[ids[at]] == "b":
                first = int(codec.vocabulary.pieces[ids[at]][1:-1], 16)
                width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                total, at = total + codec.penalty, at + width
            else:
                total, at = total + scores[ids[at]], at + 1
        assert total == pytest.approx(plain_viterbi(codec, word))


def test_every_text_comes_back(spark, docs, codec):
    odd = ["▁ ▁▁a", "  two  spaces ", "\n\t\r\x00", "日本語 \U0001f600", " ", "a" * 5000, "é" * 3]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    coded = pieces.decode(pieces.encode(both, codec.vocabulary), codec.vocabulary)
    rows = coded.collect()
    assert all(r.text == r.decoded for r in rows) and len(rows) == both.count()
    assert all(r.ids is None if r.text is None else bool(r.ids) == bool(r.text) for r in rows)


def test_empty_tables_give_empty_results(spark, empty, codec):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert suffixes.remove_repeats(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0
    counts = quality.base_rules(quality.text_counts(empty, ["doc_id", "lang"]))
    assert quality.judge(counts, quality.thresholds(counts, labels)).count() == 0
    assert pieces.encode(empty, codec.vocabulary).count() == 0


def test_block_positions():
    block = Block(0, [b"", b"ab", b"", b"c"])
    assert block.owner(np.array([0, 1, 2, 3, 4, 5])).tolist() == [0, 1, 1, 1, 2, 3]
    assert block.count(block.bytes != 10).tolist() == [0, 2, 0, 1]
