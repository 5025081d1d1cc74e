"""Archives, extraction, neighbours, toxicity and licences, and the registered pipeline."""

from __future__ import annotations

import base64
import hashlib
import heapq
import html
import random
import textwrap
import zlib

import numpy as np
import pytest
from kinfold.llm import licenses, main_text, rotated_codes, toxicity, warc
from kinfold.llm.html_nodes import Pages
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, captured string, text string, value string, ids string"


@pytest.fixture(scope="module")
def captures(spark):
    bodies = ["<p>a</p>", "<p>a</p>", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "", None, "é\n" * 9000, "<p>a</p>", ""]
    urls = ["http://www.b.org/x?q=1", "https://a.com:8080/", None, "not a url", "http://[bad", "http://b.org/x?q=1\r\n", "http://a.com/", "http://a.com"]
    rows = [(i, u, h, f"2024-01-0{1 + i % 3}T00:00:00Z", "t", "v", "i") for i, (u, h) in enumerate(zip(urls, bodies))]
    rows += [rows[6], (None, "http://a.com/", "<p>a</p>", None, None, None, None)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_archives_come_back_in_global_order(captures):
    rows = captures.collect()
    last: dict[bytes, int] = {}
    for r in rows:
        body = (r.html or "").encode()
        if r.page_id is not None:
            last[body] = max(last.get(body, -1), r.page_id)
    want = []
    for r in rows:
        body = (r.html or "").encode()
        revisit = r.page_id is None or r.page_id < last[body]
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((r.page_id, len(body), sha, "revisit" if revisit else "response", last[body] if revisit else None))
    got = sorted(warc.capture_history(captures).collect(), key=lambda r: (r.part, r.place))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got))) == sorted(map(str, want))
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)


def test_small_payloads_are_all_responses(captures):
    kinds = {(r.payload_bytes, r.record_type) for r in warc.capture_history(captures, min_bytes=9).collect()}
    assert {k for n, k in kinds if n < 9} == {"response"}


def test_loser_tree_merges_like_a_heap():
    rng = random.Random(3)
    for count in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.choice("abc"), str(rng.randrange(5)), rng.randrange(9), "", None, 0, "", f"f{k}", n) for n in range(rng.randrange(12))) for k in range(count)]
        runs = [sorted(run, key=warc._order) for run in runs]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs, key=warc._order))


def test_a_broken_payload_is_an_error():
    record = warc._record(1, "http://a", "", b"abc", warc.digest(b"abd"), None) + "\r\n\r\n"
    with pytest.raises(ValueError):
        warc.parse_archive(record.encode(), "x")


def test_held_out_pages_keep_their_main_text():
    model = main_text.fit(300)
    made = main_text.training_pages(150, seed=77)
    found = main_text.extract_pages(model, [p for p, _ in made])
    exact = lost = total = 0
    for (_, main), text in zip(made, found):
        want = {" ".join(html.unescape(t).split()) for t in main} - {""}
        exact += want == set(text.split("\n\n"))
        lost, total = lost + len(want - set(text.split("\n\n"))), total + len(want)
    assert exact / len(made) > 0.75 and lost / total < 0.05


def test_kept_nodes_never_hang_below_rejected_ones():
    pages = Pages()
    for page, _ in main_text.training_pages(40, seed=5):
        pages.parse(page)
    c = pages.columns()
    kept = main_text.decode(c, np.random.default_rng(1).normal(0, 3, len(c["page"])))
    inner = np.flatnonzero(c["parent"] >= 0)
    assert not (kept[inner] & ~kept[c["parent"][inner]]).any()


def test_broken_and_empty_pages(spark):
    odd = [None, "", "plain words", "<p", "<p>a<p>b</div></span>", "<!-- open", "<script>var a='<p>'", "<ul><li>a<li>b</ul>", "&am &amp &#233; &nbsp;x", "<" * 500, "<div>" * 300 + "x"]
    rows = [(i, "u", h, None, "old", None, None) for i, h in enumerate(odd)]
    got = main_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(odd) and all(r.text is not None for r in got)
    assert [r.text for r in got][:2] == ["", ""]
    assert main_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_text_after_unclosed_elements_and_heads_is_kept():
    pages = {
        "<body><svg width='1'/><p>one</p><svg-icon></svg-icon><template-part></template-part><select-box><p>two</p></body>": ["one", "two"],
        "<p>one</p><svg viewBox='0'><p>two</p><iframe src='x'><p>three</p>": ["one", "two", "three"],
        "<p>one</p><svg><text>out</text></svg><select><option>out</select><p>two</p>": ["one", "two"],
        "<html><head><title>out</title><meta charset=utf-8><script>out</script><p>one<p>two": ["one", "two"],
        "<head><title>out</title><link rel=x>one<p>two</p>": ["one", "two"],
        "<head><title>out</title><span>one</span><p>two</p>": ["one", "two"],
        "<p>one</p><script>var a='<p>out'": ["one"],
    }
    for page, want in pages.items():
        parsed = Pages()
        parsed.parse(page)
        assert [x for x in parsed.texts if x] == want, page


def test_page_text_of_the_table(spark):
    """The given pages hold their article in one element; nothing else may come out."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for r in main_text.extract(pages).collect():
        body = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        for tag in ("h1", "p"):
            body = body.replace(f"<{tag}>", "\0").replace(f"</{tag}>", "\0")
        for mark in ("<b>", "</b>", "<br>"):
            body = body.replace(mark, " ")
        blocks = (" ".join(html.unescape(x).split()) for x in body.split("\0"))
        assert r.text == "\n\n".join(x for x in blocks if x)


ONE = "Many words stand here and make a sentence of the article, with commas and such. Another one follows it now."
TWO = "The second paragraph says more about the matter, and it goes on for quite a while before it stops at last."
MENU = "<ul class='menu'><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Sport</a></li></ul>"
SHAPES = {
    "text between line breaks": (f'{MENU}<div class="content">{ONE}<br><br>{TWO}</div><div class="footer">Copyright 2020 Someone</div>', f"{ONE} {TWO}"),
    "plain boxes": (f"{MENU}<div>{ONE}</div><div>{TWO}</div><footer>(c) 2020</footer>", f"{ONE}\n\n{TWO}"),
    "nested boxes": (f"{MENU}<div><div><div>{ONE}</div><div>{TWO}</div></div></div><footer>(c) 2020</footer>", f"{ONE}\n\n{TWO}"),
    "misleading names": (f'{MENU}<article class="has-sidebar with-comments"><h1>A title of it</h1><p>{ONE}</p><p>{TWO}</p></article>', f"A title of it\n\n{ONE}\n\n{TWO}"),
    "form in main": (f"{MENU}<main><form><p>{ONE}</p><p>{TWO}</p></form></main>", f"{ONE}\n\n{TWO}"),
    "form around the page": (f"<form id='aspnetForm'><input type=hidden>{MENU}<div class=content><p>{ONE}</p><p>{TWO}</p></div><div class=footer>Copyright 2020</div></form>", f"{ONE}\n\n{TWO}"),
    "layout table": (f"<table><tr><td><a href=/h>Home</a><br><a href=/n>News</a></td><td><h1>A title of it</h1><p>{ONE}</p><p>{TWO}</p></td></tr></table>", f"A title of it\n\n{ONE}\n\n{TWO}"),
    "bare text in a layout table": (f"<table><tr><td><a href=/h>Home</a><a href=/n>News</a></td><td>{ONE}<br><br>{TWO}</td></tr></table>", f"{ONE} {TWO}"),
    "preformatted": (f"{MENU}<article><h1>Title here</h1><pre>{ONE}</pre><pre>{TWO}</pre></article>", f"Title here\n\n{ONE}\n\n{TWO}"),
    "spans": (f"{MENU}<div class=post><span>{ONE}</span><br><span>{TWO}</span></div><div class=sidebar>Related things</div>", f"{ONE} {TWO}"),
    "captions": (f"{MENU}<article><p>{ONE}</p><figure><img><figcaption>A picture of the thing in question</figcaption></figure><p>{TWO}</p></article>", f"{ONE}\n\nA picture of the thing in question\n\n{TWO}"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_article_text_is_kept_wherever_it_stands(shape):
    body, want = SHAPES[shape]
    page = f"<html><head><title>x</title></head><body>{body}</body></html>"
    assert main_text.extract_pages(main_text.fit(), [page]) == [want]


def test_held_out_made_pages():
    pages = main_text.training_pages(200, seed=99)
    got = main_text.extract_pages(main_text.fit(), [p for p, _ in pages])
    right = wrong = missed = 0
    for (_, main), text in zip(pages, got):
        want, have = {" ".join(t.replace("&amp;", "&").split()) for t in main}, set(text.split("\n\n")) - {""}
        right, wrong, missed = right + sum(map(len, want & have)), wrong + sum(map(len, have - want)), missed + sum(map(len, want - have))
    assert right >= 0.97 * (right + wrong) and right >= 0.97 * (right + missed)


def test_a_very_long_page_comes_out_whole():
    parts = [f"<p>{ONE} Part {i} of it.</p>" for i in range(3000)]
    page = f"<body>{MENU}<article><h1>Title here</h1>{''.join(parts)}</article><footer>(c) 2020</footer></body>"
    assert main_text.extract_pages(main_text.fit(), [page])[0].count(ONE) == 3000


def exact_neighbours(rows, k):
    found = {}
    for i, v in rows:
        scores = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), j) for j, w in rows if j != i and len(w) == len(v))
        found[i] = scores[:k]
    return found


def test_neighbours_are_those_of_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=40).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000 + i, rng.normal(size=3).tolist()) for i in range(4)]
    odd = [(5000, None), (5001, [0.0] * 40), (5002, [float("nan")] + [1.0] * 39), (5003, [None] + [1.0] * 39), (5004, []), (None, [1.0] * 40), (5005, [float("inf")] * 40)]
    table = spark.createDataFrame(rows + odd + rows[:3], "id long, vector array<double>")
    want = exact_neighbours(rows, 5)
    got: dict[int, list] = {}
    result = rotated_codes.nearest(table, table, k=5, block_vectors=64, block_queries=50).collect()
    for r in sorted(result, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got.keys() == want.keys()
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits / sum(map(len, want.values())) > 0.99
    assert all(a == pytest.approx(b) for i in want for (a, _), (b, _) in zip(got[i], want[i]) if {j for _, j in got[i]} == {j for _, j in want[i]})
    assert rotated_codes.nearest(table.limit(0), table.limit(0)).count() == 0


def test_code_estimates_lie_within_their_spread():
    rng = np.random.default_rng(4)
    vectors, queries = rng.normal(size=(2000, 70)), rng.normal(size=(20, 70))
    guess, spread = rotated_codes.estimate(*rotated_codes.encode_block(vectors), queries)
    off = np.abs(guess - queries @ vectors.T) / spread
    assert (off < 2).mean() > 0.93 and (off < rotated_codes.SPREADS).mean() > 0.998


def test_toxic_sentences_are_found_from_text_labels(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 9))]
        if i % 4 == 0:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(["MORON", "filthwort", "filthworts"])
        rows.append((i, ". ".join(sentences), 0.0, 0, "x"))
        labels.append((i, 0, int(i % 4 == 0)))
    rows += [(None, None, 1.0, 1, ""), (2000, "", 1.0, 1, ""), (2001, "w " * 50000, 1.0, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, sentences string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (9999, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(scored[i].predicted == int(i % 4 == 0) for i in held)
    assert right / len(held) > 0.97
    for i in held:
        if scored[i].predicted and i % 4 == 0:
            text = rows[i][1].encode()
            assert any(w in text[s.start : s.end].lower() for s in scored[i].sentences for w in (b"moron", b"filthwort"))
    assert scored[None].score < 0.5 and scored[2000].score == 0.0 and scored[2001].predicted == 0
    nothing = toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).agg(F.max("score")).first()[0]
    assert nothing < 0.5
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), marks)).count() == 0


def test_licences_are_told_apart_from_look_alikes(spark):
    texts = [
        "some words\nReleased under the MIT License.\nmore words", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0",
        "she studied at MIT and was released", "All rights reserved.", "all rooms were reserved for the general public", None, "",
        "Copyright (c) 2001 x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software", "a b\n" * 9000,
        "GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the Apache License, Version 2.0",
    ]
    want = [["mit"], ["cc-by-nc"], ["cc-by-sa"], [], ["proprietary"], [], [], [], ["mit"], [], ["lgpl"], ["apache-2.0"]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licences string")
    got = {r.doc_id: r.licences for r in licenses.scan(docs).collect()}
    assert [[x.family for x in got[i]] for i in range(len(texts))] == want
    first = got[0][0]
    assert texts[0].encode()[first.start : first.end] == b"Released under the MIT License"
    assert licenses.scan(docs.limit(0)).count() == 0


NOTICES = [
    ("SPDX-License-Identifier: BSD-3-Clause", ["bsd"]),
    ("// SPDX-License-Identifier: LGPL-2.1-only", ["lgpl"]),
    ("SPDX-License-Identifier: CC-BY-4.0", ["cc-by"]),
    ("License: MIT", ["mit"]),
    ("License: ISC", ["isc"]),
    ("it under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation", ["agpl"]),
    ("Copyright (c) 2020 Someone. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\n"
     "modification, are permitted provided that the following conditions are met:", ["bsd"]),
    ("You have the right to remain. All rights reserved by the hotel.", []),
    ("Some prose. Copyright 2001 Foo Inc. All rights reserved.", ["proprietary"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice", ["isc"]),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["mit"]),
    ("the accompanying materials are made available under the terms of the Eclipse Public License v2.0", ["epl"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa"]),
    ("Licensed under the MIT License or Licensed under the Apache License, Version 2.0.", ["mit", "apache-2.0"]),
    ("the license of a driver and the apache version 2 of it", []),
]


def test_a_span_has_one_family_and_whole_short_notices(spark):
    """All in one batch, and each with its neighbours repeated: a text's notices do not depend on other texts."""
    rows = [(i, t) for i, (t, _) in enumerate(NOTICES)] + [(i + 100, t) for i, (t, _) in enumerate(NOTICES[::-1])]
    got = {r.doc_id: [x.family for x in r.licences] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [f for _, f in NOTICES]
    assert [got[100 + i] for i in range(len(NOTICES))] == [f for _, f in NOTICES[::-1]]


def test_every_identifier_names_its_family(spark):
    rows, want = [], []
    for family, (_, ids) in licenses.NAMES.items():
        for x in ids:
            rows.append((len(rows), f"# SPDX-License-Identifier: {x}\nimport os"))
            want.append([family])
    got = {r.doc_id: [x.family for x in r.licences] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_hard_wrapped_notices_are_found(spark):
    """Every family's longest notice, wrapped at 72 columns, behind comment marks and inside one long line."""
    longest = {f: max(t, key=len) for f, t in licenses.TEMPLATES.items()}
    rows, want = [], []
    for family, notice in longest.items():
        # the filler makes the notice start in the middle of a line
        wrapped = textwrap.wrap("some words of a plain paragraph that ends half way along. " + notice + ". More plain words go on behind it until here.", 72)
        for text in ("\n".join(wrapped), "/*\n" + "\n".join(" * " + x for x in wrapped) + "\n */", "plain words " * 60 + notice + " plain words" * 60):
            rows.append((len(rows), "before\n\n" + text + "\n\nafter"))
            want.append([family])
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    gpl = (
        "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
        "# the Free Software Foundation, either version 3 of the License, or"
    )
    parts = ("Permission is hereby granted, free of charge,\n\nto any person", "Unauthorized copying\n\nof this file")
    for text, families in ((bsd, ["bsd"]), (gpl, ["gpl"]), *((x, []) for x in parts)):
        rows.append((len(rows), text))
        want.append(families)
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: [x.family for x in got[i]] for i in got} == dict(enumerate(want))


def test_registered_queries_run_on_whole_tables(spark):
    import __spark_entry__ as contract
    import corpus_pipeline
    from kinfold.llm.registry import QUERIES

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "mix", "pieces"]
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name, query in QUERIES.items():
        assert contract.queries()[name] is query
        rows = query(spark, FOLDER).count()
        others = ("op6_warc", "op7_rotated_codes", "op8_main_text", "op11_collocations", "op13_whitening")
        assert rows == documents or name in others, name
    assert contract.queries()["pipeline"](spark, FOLDER).count() > 0


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    names, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER).cache()
        assert after.columns == names
        left = {r.doc_id for r in after.select("doc_id").collect()}
        assert left <= ids and (left < ids or name == "repeats")
        if name == "repeats":
            assert after.agg(F.sum("n_chars")).first()[0] < before.agg(F.sum("n_chars")).first()[0]
            assert after.where("n_chars <> length(text)").isEmpty()
        ids, before = left, after


CLASHES = ["score", "sentences", "predicted", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "key", "tag", "row_id", "size", "taken", "ids", "component"]


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name in CLASHES:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string")))
    docs = docs.cache()
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, FOLDER).cache()
        assert before.columns == docs.columns
    assert before.count() > 50
    for name in CLASHES:
        assert before.where(F.col(name) != F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string"))).isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert last.columns == ["doc_id", "source", "n_pieces", "ids"] and last.count() == before.count()


def test_stages_take_nulls_empty_texts_and_empty_tables(spark):
    import corpus_pipeline

    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(900001, None, None, None, None), (900002, "", "en", "s", 0), (None, " \n", "en", None, 2), (900003, "a few words", None, "s", 11)]
    rows += [rows[3], (900004, "w " * 40_000, "en", "s", 80_000)]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, FOLDER).cache()
            assert after.columns == docs.columns, name
            if not docs.isEmpty() and name in ("toxicity", "near_duplicates", "repeats"):
                assert {r.doc_id for r in after.collect()} == {900001, 900002, None, 900003, 900004}, name
            docs = after
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()


def test_chances_of_a_column_are_the_scores(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    )
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    both = toxicity.score(docs, model).withColumn("chance", toxicity.chance(model, F.col("text")))
    assert both.where("score <> chance").isEmpty() and both.where("doc_id < 0").select("chance").distinct().collect() == [(0.0,)]
