"""Licence scan: a trained paragraph classifier confirmed by template comparison.

What is judged are single lines and windows of paragraphs. A paragraph is a run of
lines with words, comment marks passed over; its windows are the passages of about a
template's length that hold most of the template's word pairs, across line breaks and
inside long lines. The words, word pairs and triples of a line or window feed a sparse
multinomial logistic regression over licence families and an unknown class. The
probabilities are calibrated on held-out paragraphs by one temperature. A family
is reported where its probability reaches the threshold and the line or window also
holds most of the word pairs of one of the family's templates.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm.blocks import LOWER, Block, Hasher, blocks, bound_batches, mix, word_spans

FEATURE_BITS = 16
EXAMPLES = 80  # made paragraphs per family
UNKNOWN = "unknown"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

# Public names and short identifiers of each licence family.
NAMES = {
    "0bsd": (["Zero-Clause BSD"], ["0BSD"]),
    "afl": (["Academic Free License"], ["AFL-3.0"]),
    "agpl": (["GNU Affero General Public License", "AGPL"], ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"]),
    "apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"], ["Apache-2.0"]),
    "artistic": (["Artistic License 2.0"], ["Artistic-2.0"]),
    "boost": (["Boost Software License, Version 1.0"], ["BSL-1.0"]),
    "bsd": (["BSD 3-Clause License", "BSD 2-Clause License", "BSD License"], ["BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"]),
    "cc-by": (["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], ["CC-BY-3.0", "CC-BY-4.0"]),
    "cc-by-nc": (["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"], ["CC-BY-NC-4.0"]),
    "cc-by-nc-sa": (["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"], ["CC-BY-NC-SA-4.0"]),
    "cc-by-nd": (["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"], ["CC-BY-ND-4.0"]),
    "cc-by-sa": (["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], ["CC-BY-SA-3.0", "CC-BY-SA-4.0"]),
    "cc0": (["CC0 1.0"], ["CC0-1.0"]),
    "cddl": (["Common Development and Distribution License"], ["CDDL-1.0", "CDDL-1.1"]),
    "epl": (["Eclipse Public License"], ["EPL-1.0", "EPL-2.0"]),
    "eupl": (["European Union Public Licence"], ["EUPL-1.2"]),
    "gpl": (["GNU General Public License", "GNU GPL"], ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"]),
    "isc": (["ISC License"], ["ISC"]),
    "lgpl": (["GNU Lesser General Public License", "GNU LGPL"], ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"]),
    "lppl": (["LaTeX Project Public License"], ["LPPL-1.3c"]),
    "mit": (["MIT License", "MIT"], ["MIT", "MIT-0"]),
    "mpl-2.0": (["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"], ["MPL-2.0"]),
    "ms-pl": (["Microsoft Public License"], ["MS-PL"]),
    "ncsa": (["University of Illinois/NCSA Open Source License"], ["NCSA"]),
    "odbl": (["Open Database License"], ["ODbL-1.0"]),
    "ofl": (["SIL Open Font License, Version 1.1"], ["OFL-1.1"]),
    "osl": (["Open Software License"], ["OSL-3.0"]),
    "postgresql": (["PostgreSQL License"], ["PostgreSQL"]),
    "python": (["Python Software Foundation License"], ["PSF-2.0", "Python-2.0"]),
    "unlicense": (["The Unlicense"], ["Unlicense"]),
    "wtfpl": (["Do What The F*ck You Want To Public License"], ["WTFPL"]),
    "zlib": (["zlib License"], ["Zlib"]),
}
# Customary notices of the families, as licensors publish them.
NOTICES = {
    "agpl": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "boost": ["Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at boost.org"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
    ],
    "cc0": ["released under CC0 1.0", "dedicated to the public domain under the CC0 1.0 Universal dedication"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "proprietary": ["All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"],
}
RESERVED = "proprietary"
# Notices of fewer word pairs than this must be there whole.
_SHORT = 8
# A bare "all rights reserved" belongs to another licence that lies within this many bytes.
_NEAR = 600


def _templates() -> dict[str, list[str]]:
    found = {}
    for family in sorted({*NAMES, *NOTICES}):
        names, ids = NAMES.get(family, ([], []))
        found[family] = [
            *NOTICES.get(family, []),
            *[f"{lead} {name}" for name in names for lead in ("Licensed under the", "Released under the", "License:")],
            # names of three words or more need no lead
            *[name for name in names if len(_TERM.findall(name.lower().encode())) >= 4],
            *[f"{lead} {x}" for x in ids for lead in ("SPDX-License-Identifier:", "License:")],
        ]
        # short names as people write them, without an article
        found[family] += [f"Licensed under {name}" for name in names if len(name) <= 16]
    return found


# Sentences with the same words that grant nothing.
DECOYS = [
    "the driver lost his license after the race", "she studied at MIT and later worked in public service", "a version of the story was released in spring",
    "the general public was not invited", "permission to enter is granted at the door", "the file is under the table", "a license to fish costs four dollars",
    "they reserved all rooms of the hotel", "you have the right to remain and all rights reserved by the hotel", "the apache helicopter landed", "free software is often discussed", "we use the source and the binary", "version two of the plan",
]

TEMPLATES = _templates()

_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class LicenceModel:
    """Weights by hashed n-gram and family, biases, temperature, and template word pairs."""

    families: tuple[str, ...]  # the last is unknown
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    pairs: tuple[tuple[frozenset, ...], ...]


def needed(size: int, similarity: float) -> float:
    """Word pairs of a template of ``size`` pairs that confirm it."""
    return size if size < _SHORT else similarity * size


def _pairs(text: bytes) -> frozenset:
    words = _TERM.findall(text.lower())
    return frozenset(zip(words, words[1:]))


def _features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all lines, and for each the line; spans of the words of each line."""
    low = LOWER[data]
    starts, ends = word_spans(low, _GAPS)
    line = np.cumsum(low == 10)[starts] if len(starts) else np.zeros(0, np.int64)
    words = Hasher(low).spans(starts, ends)
    found, owners, total = [], [], words
    for size in (1, 2, 3):
        count = len(words) - size + 1
        if count <= 0:
            break
        if size > 1:
            total = mix(total[:count] * np.uint64(31) + words[size - 1 :])
        whole = line[:count] == line[size - 1 :]
        found.append((total[:count][whole] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
        owners.append(line[:count][whole])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return np.concatenate(found), np.concatenate(owners), starts, ends


def _examples(seed: int, count: int) -> list[tuple[bytes, int]]:
    """Made paragraphs: templates with words dropped, added around or changed, and paragraphs without a licence."""
    rng = random.Random(seed)
    syllables = "an en er in on re st th ti ou la le de es ar al".split()

    def noise(low: int, high: int) -> list[str]:
        return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]

    made = []
    families = list(TEMPLATES)
    for label, family in enumerate(families):
        for _ in range(count):
            words = rng.choice(TEMPLATES[family]).split()
            if len(words) > 8:
                words = [w for w in words if rng.random() > 0.06]
                cut = rng.randint(0, max(0, len(words) - 12)) if rng.random() < 0.4 else 0
                words = words[cut:]
            before = noise(0, 6) if rng.random() < 0.3 else ["Copyright", "(c)", str(rng.randint(1990, 2030)), *noise(1, 2)] if rng.random() < 0.2 else []
            after = noise(0, 8) if rng.random() < 0.3 else []
            made.append((" ".join([*before, *words, *after]).encode(), label))
    for _ in range(12 * count):
        words = noise(3, 40)
        if rng.random() < 0.5:
            decoy = rng.choice(DECOYS).split()
            if rng.random() < 0.5:
                other = rng.choice(TEMPLATES[rng.choice(families)]).split()
                decoy = rng.sample(other, min(len(other), rng.randint(1, 2)))
            at = rng.randint(0, len(words))
            words[at:at] = decoy
        made.append((" ".join(words).encode(), len(families)))
    rng.shuffle(made)
    return made


@lru_cache(2)
def fit(*, examples: int = EXAMPLES, steps: int = 80, seed: int = 11) -> LicenceModel:
    """Fit on made paragraphs, calibrate on a fifth of them; a fixed amount of work on the driver, done once a process."""
    made = _examples(seed, examples)
    names = (*TEMPLATES, UNKNOWN)
    labels = np.array([y for _, y in made])
    features, owner, _, _ = _features(np.frombuffer(b"\n".join(t for t, _ in made) + b"\n", np.uint8))
    used, column = np.unique(features, return_inverse=True)
    # n-grams of one paragraph only say nothing about others
    common = np.bincount(column) >= 3
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    used = used[common]
    held = np.arange(len(made)) % 5 == 0
    target = np.eye(len(names))[labels]
    train = ~held
    w, b = np.zeros((len(used), len(names))), np.zeros(len(names))
    order = np.argsort(owner, kind="stable")
    column, owner = column[order], owner[order]
    back = np.argsort(column, kind="stable")

    def sums(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, values.shape[1]))
        first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        out[index[first]] = np.add.reduceat(values, first)
        return out

    mw = vw = np.zeros_like(w)
    mb = vb = np.zeros_like(b)
    for step in range(1, steps + 1):
        score = sums(w[column], owner, len(made)) + b
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        pull = (p - target) * train[:, None] / train.sum()
        gw, gb = sums(pull[owner[back]], column[back], len(used)) + 1e-5 * w, pull.sum(0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w = w - 0.05 * (mw / fix) / (np.sqrt(vw / fix2) + 1e-9)
        b = b - 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-9)
    score = (sums(w[column], owner, len(made)) + b)[held]

    def loss(temperature: float) -> float:
        s = score / temperature
        top = s.max(1)
        return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(s)), labels[held]]).mean())

    temperature = min((0.25 * 1.15**k for k in range(30)), key=loss)
    weights = np.zeros((1 << FEATURE_BITS, len(names)), np.float32)
    weights[used] = w
    pairs = tuple(tuple(_pairs(t.encode()) for t in TEMPLATES[f]) for f in TEMPLATES)
    return LicenceModel(names, weights, b.astype(np.float32), temperature, pairs)


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(31) + words[1:])


def _template_hashes(pairs: frozenset) -> np.ndarray:
    data = np.frombuffer(b"\n".join(a + b" " + b for a, b in sorted(pairs)) + b"\n", np.uint8)
    return _pair_hashes(Hasher(data).spans(*word_spans(data, _GAPS)))[::2]


def _windows(
    words: np.ndarray, whole: np.ndarray, templates: list[tuple[int, np.ndarray]], similarity: float
) -> Iterator[tuple[int, int, int, float, int]]:
    """``family, first word, last word, similarity, pairs of the template`` of passages that hold a template's word pairs.

    ``whole`` marks the pairs of neighbours in one paragraph. Windows of one template
    do not overlap, the most similar and then the shortest come first.
    """
    if len(words) < 2:
        return
    pair = _pair_hashes(words)
    hits = np.flatnonzero(np.isin(pair, np.concatenate([h for _, h in templates])) & whole)
    paragraph = np.cumsum(~whole)[hits]
    value = pair[hits]
    for family, hashes in templates:
        mine = np.isin(value, hashes)
        at, seen = hits[mine], value[mine].tolist()
        size = len(hashes)
        room, need = size + max(4, size // 2), needed(size, similarity)
        # paragraphs lie further apart than a window is long
        place = at + paragraph[mine] * (room + 1)
        after = np.searchsorted(place, place + room)
        found = []
        for i in np.flatnonzero(after - np.arange(len(at)) >= need).tolist():
            distinct, last = set(), i
            for j in range(i, int(after[i])):
                if seen[j] not in distinct:
                    distinct.add(seen[j])
                    last = j
            if len(distinct) >= need:
                found.append((-len(distinct) / size, int(at[last] - at[i]), int(at[i]), int(at[last]) + 1))
        taken: set[int] = set()
        for near, _, a, b in sorted(found):
            if taken.isdisjoint(range(a, b + 1)):
                taken.update(range(a, b + 1))
                yield family, a, b, -near, size


_STOPS = frozenset(b".,;:!?\n\r)]")


def _ends(data: np.ndarray, ends: np.ndarray, own: frozenset, templates: tuple, starts: np.ndarray) -> bool:
    """Whether a very short notice that a line holds is followed by a stop, as at the end of a sentence."""
    words = [data[x:y].tobytes().lower() for x, y in zip(starts, ends)]
    for t in templates:
        if len(t) < 4 and t <= own:
            for i in range(len(words) - len(t)):
                if all((words[i + k], words[i + k + 1]) in t for k in range(len(t))) and data[ends[i + len(t)]] in _STOPS:
                    return True
    return False


def _apart(lone: list[tuple], wide: list[tuple], block: Block, reserved: int, short: int = 4) -> list[tuple]:
    """Lines and windows in text order; a span has one family.

    Of overlapping ones that with most word pairs of its template stays, then the more
    similar, then the shorter. A bare reservation of rights yields to any other licence near it.
    """
    ranked = sorted([(-x[4] * x[5], -x[4], x[2] - x[1], 0, x) for x in lone] + [(-x[4] * x[5], -x[4], x[2] - x[1], 1, x) for x in wide])
    kept: list[tuple] = []
    for *_, x in ranked:
        at = bisect_left(kept, x[1], key=lambda y: y[1])
        if (at == 0 or kept[at - 1][2] <= x[1]) and (at == len(kept) or x[2] <= kept[at][1]):
            kept.insert(at, x)
    text = block.owner(np.array([x[1] for x in kept], np.int64)) if kept else []

    def yields(i: int) -> bool:
        x = kept[i]
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(kept) and text[j] == text[i] and kept[j][0] != reserved]
        bare = x[0] == reserved and x[5] < short
        return bare and any(max(kept[j][1] - x[2], x[1] - kept[j][2]) <= _NEAR for j in near)

    return [x for i, x in enumerate(kept) if not yields(i)]


LICENCES = "array<struct<family:string,start:int,end:int,probability:double,similarity:double>>"
_KIND = pa.list_(pa.struct([
    ("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("similarity", pa.float64()),
]))


def scan(
    docs: DataFrame, model: LicenceModel | None = None, *, threshold: float = 0.5, similarity: float = 0.6, keep: list[str] | None = None
) -> DataFrame:
    """Add ``licences`` to every row: the confirmed notices of the whole text, in text order.

    ``start`` and ``end`` are bytes, from the first to the last word of the line or
    window; of those that overlap one stays. Templates of under eight word pairs must be
    there whole and need no chance, very short ones must also end a sentence; of longer ones
    ``similarity`` of the pairs suffices, and the classifier must agree. A bare "all rights
    reserved" near another licence belongs to that one.
    A null or empty text has none. Columns in ``keep`` (all by default) and repeated
    rows are kept; a ``licences`` column is replaced.
    """
    bound_batches(docs.sparkSession)
    rest = docs.drop("licences")
    kept = [c for c in rest.columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model or fit())  # a fixed 3.5 MB

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        telling = (m.weights != 0).any(1)
        templates = [(k, _template_hashes(t)) for k, family in enumerate(m.pairs) for t in family]

        def judge(passage: bytes) -> np.ndarray:
            features = _features(np.frombuffer(passage + b"\n", np.uint8))[0]
            score = (m.weights[features[telling[features]]].sum(0) + m.bias) / m.temperature
            p = np.exp(score - score.max())
            return p / p.sum()

        # a paragraph without a known n-gram has the biases alone
        for batch in batches:
            for block in blocks(batch["text"]):
                features, line, starts, ends = _features(block.bytes)
                known = telling[features]
                lines, at = np.unique(line[known], return_inverse=True)
                order = np.argsort(at, kind="stable")
                score = np.zeros((len(lines), len(m.families)), np.float32)
                if len(lines):
                    edge = np.flatnonzero(np.diff(at[order], prepend=-1))
                    score = np.add.reduceat(m.weights[features[known][order]], edge)
                score = (score + m.bias) / m.temperature
                p = np.exp(score - score.max(1, keepdims=True)) if len(lines) else score
                p = p / p.sum(1, keepdims=True) if len(lines) else p
                best = p.argmax(1) if len(lines) else np.zeros(0, np.int64)
                word_line = np.cumsum(block.bytes == 10)[starts] if len(starts) else starts
                # family, start, end, probability, similarity of lines, then of windows
                lone, wide = [], []
                for k in np.flatnonzero((best < len(m.families) - 1) & (p[np.arange(len(best)), best] >= threshold)):
                    a, b = np.searchsorted(word_line, (lines[k], lines[k] + 1))
                    start, end = int(starts[a]), int(ends[b - 1])
                    own = _pairs(block.bytes[start:end].tobytes())
                    # the template that covers most, whole ones first
                    near, size = max((len(own & t) / len(t), len(t)) for t in m.pairs[best[k]])
                    if near * size >= needed(size, similarity) and (size >= 4 or _ends(block.bytes, ends[a:b], own, m.pairs[best[k]], starts[a:b])):
                        lone.append((int(best[k]), start, end, float(p[k, best[k]]), near, size))
                low = LOWER[block.bytes]
                whole = (np.diff(word_line) <= 1) & (np.diff(block.owner(starts)) == 0)
                for family, a, b, near, size in _windows(Hasher(low).spans(starts, ends), whole, templates, similarity):
                    start, end = int(starts[a]), int(ends[b])
                    chance = judge(b" ".join(low[x:y].tobytes() for x, y in zip(starts[a : b + 1], ends[a : b + 1])))
                    if size < 4 and block.bytes[end] not in _STOPS:
                        continue
                    if size < _SHORT or (chance.argmax() == family and chance[family] >= threshold):
                        wide.append((family, start, end, float(chance[family]), near, size))
                found: list[list[dict]] = [[] for _ in range(len(block))]
                for family, start, end, chance, near, _ in _apart(lone, wide, block, m.families.index(RESERVED)):
                    text = int(block.owner(np.array([start]))[0])
                    base = int(block.starts[text])
                    found[text].append({
                        "family": m.families[family], "start": start - base, "end": end - base,
                        "probability": chance, "similarity": near,
                    })
                rows = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in kept), pa.array(found, _KIND)], [*kept, "licences"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.select(*kept).schema)
    return rest.mapInArrow(apply, f"{schema}licences {LICENCES}")
