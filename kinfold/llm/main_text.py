"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element and every run of text gets features: its tag and attribute
words, depth, text and link density of its subtree, and how it compares with its
siblings. Boosted trees give each node the chance that it holds main text. The
decoding is hierarchical: the kept nodes of a page form one tree from the root, so
a kept node never hangs below a rejected one, and among all such trees the one
with the largest likelihood is taken.

The trees are fitted on the driver to pages made by ``training_pages``, which know
their main text; no page of the table is needed for it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm.blocks import bound_batches
from kinfold.llm.html_nodes import Pages

TRAINING_PAGES = 1000
TREES = 80
DEPTH = 4
BINS = 32
_RATE = 0.15

# Words that page authors give to parts of a page; the trees learn which side they speak for.
OUTER = {
    "nav": "nav navigation menu navbar topnav mainmenu breadcrumb breadcrumbs pagination pager",
    "header": "header masthead topbar banner logo branding sitehead",
    "footer": "footer foot copyright legal colophon bottom",
    "aside": "sidebar side aside rail widget related recommended popular trending more teaser",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion dfp",
    "notice": "cookie consent gdpr notice alert popup modal overlay banner privacy toast dialog announcement",
    "form": "form search login signup subscribe newsletter register contact",
    "comments": "comment comments commentlist reply replies discussion disqus respond thread reader",
    "share": "share social follow tags tagcloud meta byline toolbar print rating",
}
INNER = "article content post entry main story body text page hentry maincontent articlebody prose copy single"


@dataclass(frozen=True)
class NodeModel:
    """Evidence of tags and attribute words, bin borders, and complete trees of one depth."""

    tag_odds: dict[str, float]
    token_odds: dict[str, float]
    borders: np.ndarray  # features x (BINS - 1)
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    leaves: np.ndarray  # trees x 2^DEPTH
    base: float


def training_pages(count: int = TRAINING_PAGES, seed: int = 3) -> list[tuple[str, set[str]]]:
    """Pages and the texts of their main blocks, made from random words and common layouts."""
    rng = random.Random(seed)
    syllables = "an en er in on re st th ti ou la le de es ar al ch ei un or ra ne io ma".split()

    def words(low: int, high: int) -> str:
        made = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        text = " ".join(w + rng.choice(["", "", "", "", "", "", ",", "."]) for w in made)
        junk = rng.random()
        if junk < 0.05:
            text = " ".join(w + rng.choice(["***", "###", "%%%", "&amp;&amp;"]) for w in made)
        elif junk < 0.1:
            text = " | ".join(made)
        elif junk < 0.15:
            text = text.upper() + "!!"
        return text[0].upper() + text[1:] + rng.choice([".", ".", ".", "", "?"])

    def named(tag: str, pool: str, inside: str) -> str:
        chosen = rng.sample(pool.split(), min(len(pool.split()), rng.randint(1, 2)))
        joined = rng.choice(["-", "_", " "]).join(chosen)
        attribute = rng.choice(["class", "class", "id"]) if rng.random() < 0.85 else None
        return f"<{tag} {attribute}=\"{joined}\">{inside}</{tag}>" if attribute else f"<{tag}>{inside}</{tag}>"

    def links(low: int, high: int) -> str:
        return "".join(f"<li><a href='/x'>{words(1, 4)}</a></li>" for _ in range(rng.randint(low, high)))

    def outer(kind: str) -> str:
        div = rng.choice(["div", "div", "section", "aside"])
        if kind == "nav":
            return named(rng.choice(["nav", "nav", "div", "ul"]), OUTER[kind], f"<ul>{links(2, 10)}</ul>")
        if kind == "header":
            return named(rng.choice(["header", "header", "div"]), OUTER[kind], rng.choice([f"<div>{words(1, 6)}</div>", f"<h1>{words(1, 4)}</h1><p>{words(3, 12)}</p>", f"<ul>{links(2, 5)}</ul>"]))
        if kind == "footer":
            return named(rng.choice(["footer", "footer", "div"]), OUTER[kind], rng.choice([f"&copy; {words(2, 20)}", f"<p>&copy; 2020 {words(3, 30)}</p>", f"<ul>{links(2, 8)}</ul><p>{words(4, 40)}</p>"]))
        if kind == "aside":
            return named(rng.choice(["aside", div]), OUTER[kind], rng.choice([f"<h3>{words(1, 4)}</h3><ul>{links(2, 8)}</ul>", f"<h3>{words(1, 4)}</h3><p>{words(8, 60)}</p>", f"<p>{words(10, 80)}</p>"]))
        if kind == "form":
            return f"<form class='{rng.choice(OUTER[kind].split())}'><label>{words(1, 4)}</label><input type='text'><p>{words(3, 25)}</p><button>{words(1, 2)}</button></form>"
        if kind == "comments":
            one = lambda: rng.choice([f"<div class='{rng.choice(['comment', 'reply', 'comment-body'])}'><p>{words(4, 120)}</p></div>", f"<li><p>{words(4, 120)}</p></li>", f"<p>{words(4, 120)}</p>"])
            return named(rng.choice(["div", "section", "ol", "aside"]), OUTER[kind], f"<h2>{words(1, 3)}</h2>" * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 6))))
        if kind in ("ad", "notice"):
            attribute = " role='alert'" if kind == "notice" and rng.random() < 0.3 else ""
            body = rng.choice([words(3, 40), f"<p>{words(4, 60)}</p>", f"<p>{words(4, 40)}</p><button>{words(1, 2)}</button>", f"<a href='/y'>{words(2, 12)}</a>"])
            return named(div, OUTER[kind], body).replace(">", f"{attribute}>", 1)
        return named(div, OUTER[kind], rng.choice([f"<ul>{links(2, 6)}</ul>", f"<span>{words(2, 8)}</span>", f"<p>{words(2, 12)}</p>"]))

    def inline(text: str) -> str:
        kind = rng.random()
        if kind < 0.15:
            return f"<b>{text}</b>"
        if kind < 0.2:
            return f"<a href='/z'>{text[:6]}</a>{text[6:]}"
        return f"<span>{text}</span>" if kind < 0.25 else text

    pages = []
    for _ in range(count):
        main: list[str] = []
        # what holds the paragraphs of this page: elements of their own, or one run of lines
        prose = rng.choices(["p", "div", "span", "br", "pre", "dd", "section"], [60, 14, 4, 12, 3, 3, 4])[0]

        def block(tag: str, low: int, high: int) -> str:
            text = words(low, high)
            main.append(text)
            ends = [f"</{tag}>", f"</{tag}>", f"</{tag}>", ""] if tag == "p" else [f"</{tag}>"]
            return f"<{tag}>{inline(text)}" + rng.choice(ends)

        def lines(low: int, high: int) -> str:
            made = [words(low, high) for _ in range(rng.choice([1, 2, 3, 6]))]
            main.append(" ".join(made))
            return rng.choice(["<br>", "<br><br>", "<br />"]).join(map(inline, made))

        def paragraph(low: int, high: int) -> str:
            if prose == "br":
                return lines(low, high)
            if prose == "span":  # a box around an inline element
                return f"<div>{block('span', low, high)}</div>"
            if prose == "dd":
                return f"<dl>{block('dt', 1, 5)}{block('dd', low, high)}</dl>"
            return block(prose, low, high)

        body = []
        if rng.random() < 0.85:
            body.append(block("h1", 2, 12))
        run, plain = False, rng.choice([0.72, 0.72, 0.95, 1.0])
        for _ in range(rng.choices([1, 2, 3, 5, 8, 14, 30, 70], [20, 14, 14, 14, 14, 12, 8, 4])[0]):
            kind = rng.random()
            if kind < plain:
                if prose == "br" and run:  # two runs without a border would be one
                    body.append(block("h2", 1, 8))
                body.append(paragraph(rng.choice([1, 3, 8]), rng.choice([12, 50, 160])))
                run = prose == "br"
                continue
            run = False
            if kind < plain + 0.3 * (1 - plain):
                body.append(block(rng.choice(["h2", "h3"]), 1, 8))
            elif kind < plain + 0.46 * (1 - plain):
                body.append("<ul>" + "".join(block("li", 2, 25) for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < plain + 0.57 * (1 - plain):
                body.append("<blockquote>" + block(rng.choice(["p", "div"]), 5, 60) + "</blockquote>")
            elif kind < plain + 0.66 * (1 - plain):
                body.append(f"<table><tr>{block('td', 1, 8)}{block('td', 1, 8)}</tr></table>")
            elif kind < plain + 0.75 * (1 - plain):
                body.append(f"<figure><img src='i.png'>{block('figcaption', 2, 20)}</figure>")
            else:
                body.append(outer(rng.choice(["ad", "aside", "share", "notice", "form"])))
        inside = "".join(body)
        # names of the outer parts on the article itself: a page with a sidebar, a post with comments
        wrong = " ".join(rng.choice(["has-", "with-", "no-", "post-", ""]) + rng.choice(OUTER[k].split()) for k in rng.sample(sorted(OUTER), 2))
        article = rng.choice([
            f"<article>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>",
            named("article", INNER, inside), named("div", INNER, inside), named("div", INNER, named("div", INNER, inside)),
            f"<main>{named('div', INNER, inside)}</main>", named("section", INNER, inside), f"<main><article>{inside}</article></main>",
            f"<{(tag := rng.choice(['article', 'main', 'div', 'section']))} class='{wrong}'>{inside}</{tag}>",
            f"<div><div>{inside}</div></div>",
        ])
        if rng.random() < 0.2 and "comment" not in article:
            article = article.replace("</article>", outer("comments") + "</article>")
        before = [outer(k) for k in ("header", "nav", "notice", "ad", "share", "form") if rng.random() < 0.45]
        after = [outer(k) for k in ("comments", "aside", "share", "ad", "form", "footer", "notice") if rng.random() < 0.4]
        rng.shuffle(before)
        layout = rng.random()
        if layout < 0.2:  # a table as the frame of the page
            cells = [f"<td>{article}</td>", f"<td>{rng.choice([links(2, 8), outer('nav'), rng.choice(['<br>', ' | ', ' ']).join(f'<a href=/m>{words(1, 2)}</a>' for _ in range(rng.randint(2, 8)))])}</td>"]
            rng.shuffle(cells)
            article = f"<table><tr>{''.join(cells)}</tr></table>"
        page = "".join(before) + article + "".join(after)
        if layout > 0.92:  # a form around the whole page
            page = f"<form id='{rng.choice(['aspnetForm', 'form1', 'mainform'])}' method='post'><input type='hidden'>{page}</form>"
        elif layout > 0.86:
            article_form = f"<form action='/'>{article}</form>"
            page = "".join(before) + article_form + "".join(after)
        if rng.random() < 0.3:
            page = named("div", "wrapper container page site wrap layout root", page)
        tail = "</body></html>" if rng.random() < 0.9 else ""
        pages.append((f"<html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{page}{tail}", set(main)))
    return pages


def _sums(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum over the subtree of every node; nodes are in preorder."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[end] - total[np.arange(len(values))]


def node_features(pages: Pages, model: NodeModel | None, tags: np.ndarray, attributes: np.ndarray) -> np.ndarray:
    """Features of every node; ``tags`` and ``attributes`` are the evidence of its own tag and words."""
    c = pages.columns()
    count = len(c["page"])
    parent, end, leaf = c["parent"], c["end"], c["leaf"]
    own = tags + attributes
    low, high, total = own.copy(), own.copy(), own.copy()
    top = np.maximum(parent, 0)
    for depth in range(1, int(c["depth"].max()) + 1 if count else 0):
        at = np.flatnonzero(c["depth"] == depth)
        low[at] = np.minimum(own[at], low[parent[at]])
        high[at] = np.maximum(own[at], high[parent[at]])
        total[at] += total[parent[at]]
    text, links = _sums(c["text"], end), _sums(c["links"], end)
    linked, leaves = _sums(c["linked"], end), _sums(leaf, end)
    nodes = end - np.arange(count)
    controls = _sums(c["controls"], end)
    roots = np.flatnonzero(parent < 0)
    root = roots[c["page"]] if count else parent
    page_text = np.maximum(1, text[root])
    before = np.concatenate(([0], np.cumsum(c["text"])))[:-1]
    before = before - before[root]
    siblings = np.bincount(top[parent >= 0], minlength=count)[top]
    order = np.lexsort((np.arange(count), parent))
    place = np.zeros(count, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], parent[order][1:] != parent[order][:-1])))
    place[order] = np.arange(count) - np.repeat(starts, np.diff(np.append(starts, count)))
    family = np.maximum(1, text[top])
    marks = np.array([sum(map(t.count, ".,;:?!")) for t in pages.texts], np.int64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in pages.texts], np.int64)
    signs = np.array([("©" in t) + ("@" in t) for t in pages.texts], np.int64)
    words_in, marks_in = _sums(words, end), _sums(marks, end)
    return np.column_stack([
        leaf, c["depth"], tags, attributes, low, high, total, tags[top], attributes[top],
        np.log1p(text), linked / np.maximum(1, text), np.log1p(links), np.log1p(words_in), words_in / np.maximum(1, leaves),
        marks_in / np.maximum(1, words_in), leaves, text / np.maximum(1, nodes), text / page_text, before / page_text,
        siblings, place / np.maximum(1, siblings), text / family, controls, _sums(signs, end),
    ]).astype(float)


def _evidence(pages: Pages, tag_odds: dict[str, float], token_odds: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    tags = np.array([tag_odds.get(t, 0.0) for t in pages.tags])
    attributes = np.array([sum(token_odds.get(w, 0.0) for w in set(words)) if words else 0.0 for words in pages.tokens])
    return tags, attributes


def _bin(features: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(b, x, "right") for b, x in zip(borders, features.T)]).astype(np.uint8)


def _chances(model: NodeModel, features: np.ndarray) -> np.ndarray:
    """Log odds of every node."""
    bins = _bin(features, model.borders)
    rows, total = np.arange(len(bins)), np.full(len(bins), model.base)
    for feature, cut, leaf in zip(model.features, model.cuts, model.leaves):
        at = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
        total += leaf[at - (2**DEPTH - 1)]
    return total


@lru_cache(2)
def fit(count: int = TRAINING_PAGES, trees: int = TREES, seed: int = 3) -> NodeModel:
    """Fit on ``count`` made pages; a fixed amount of work on the driver, done once a process."""
    pages, keep = Pages(), []
    for page, main in training_pages(count, seed):
        first = len(pages.tags)
        pages.parse(page)
        clean = {" ".join(t.replace("&amp;", "&").split()) for t in main}
        keep += [bool(t) and t in clean for t in pages.texts[first:]]
    c = pages.columns()
    label = (_sums(np.array(keep, np.int64), c["end"]) > 0).astype(float)

    def odds(rows: Iterator[tuple[str, float]]) -> dict[str, float]:
        seen: dict[str, list[float]] = {}
        for name, y in rows:
            pair = seen.setdefault(name, [2.0, 2.0])
            pair[int(y)] += 1
        return {name: float(np.log(yes / no)) for name, (no, yes) in seen.items()}

    elements = np.flatnonzero(c["leaf"] == 0)
    tag_odds = odds((pages.tags[i], label[i]) for i in elements)
    token_odds = odds((w, label[i]) for i in elements for w in set(pages.tokens[i]))
    features = node_features(pages, None, *_evidence(pages, tag_odds, token_odds))
    borders = np.array([np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1]) for x in features.T])
    bins, width = _bin(features, borders), features.shape[1]
    base = float(np.log(label.mean() / (1 - label.mean())))
    score, grown = np.full(len(label), base), []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        pull, weight = label - chance, chance * (1 - chance)
        at = np.zeros(len(label), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, 255, np.int64)
        for level in range(DEPTH):
            first, size = 2**level - 1, 2**level
            code = ((at - first)[:, None] * width + np.arange(width)) * BINS + bins
            shape = (size, width, BINS)
            g = np.bincount(code.ravel(), np.repeat(pull, width), size * width * BINS).reshape(shape).cumsum(2)
            h = np.bincount(code.ravel(), np.repeat(weight, width), size * width * BINS).reshape(shape).cumsum(2)
            gl, hl, g_all, h_all = g[..., :-1], h[..., :-1], g[..., -1:], h[..., -1:]
            gain = gl**2 / (hl + 1) + (g_all - gl) ** 2 / (h_all - hl + 1) - g_all**2 / (h_all + 1)
            gain[(hl < 2) | (h_all - hl < 2)] = 0
            best = gain.reshape(size, -1).argmax(1)
            better = gain.reshape(size, -1).max(1) > 1e-6
            feature[first : first + size] = np.where(better, best // (BINS - 1), 0)
            cut[first : first + size] = np.where(better, best % (BINS - 1), 255)
            at = 2 * at + 1 + (bins[np.arange(len(at)), feature[at]] > cut[at])
        slot = at - (2**DEPTH - 1)
        leaf = _RATE * np.bincount(slot, pull, 2**DEPTH) / (np.bincount(slot, weight, 2**DEPTH) + 1)
        score += leaf[slot]
        grown.append((feature, cut, leaf))
    f, t, leaf = map(np.array, zip(*grown))
    return NodeModel(tag_odds, token_odds, borders, f, t, leaf, base)


def decode(columns: dict[str, np.ndarray], log_odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the tree from each root with the largest likelihood.

    A node's log odds weigh with the logarithm of its text. From the deepest nodes
    up, a subtree is worth its node plus its children that gain, or nothing; from
    the roots down, a node is kept if its parent is and it gains.
    """
    parent, depth = columns["parent"], columns["depth"]
    size = _sums(columns["text"], columns["end"])
    worth = np.clip(log_odds, -6, 6) * (1 + np.where(columns["leaf"] == 1, np.log1p(size), 0))
    deepest = int(depth.max()) if len(depth) else 0
    for level in range(deepest, 0, -1):
        at = np.flatnonzero(depth == level)
        np.add.at(worth, parent[at], np.maximum(worth[at], 0))
    kept = parent < 0
    for level in range(1, deepest + 1):
        at = np.flatnonzero(depth == level)
        kept[at] = kept[parent[at]] & (worth[at] > 0)
    return kept


def extract_pages(model: NodeModel, htmls: list[str]) -> list[str]:
    """Main text of each page: the kept runs of text in page order, two line feeds apart."""
    pages = Pages()
    for page in htmls:
        pages.parse(page)
    columns = pages.columns()
    features = node_features(pages, model, *_evidence(pages, model.tag_odds, model.token_odds))
    kept = decode(columns, _chances(model, features)) & (columns["leaf"] == 1)
    parts: list[list[str]] = [[] for _ in htmls]
    for node in np.flatnonzero(kept):
        parts[columns["page"][node]].append(pages.texts[node])
    return ["\n\n".join(x) for x in parts]


def extract(pages: DataFrame, model: NodeModel | None = None, *, keep: list[str] | None = None, group: int = 256) -> DataFrame:
    """Add ``text``, the main text of ``html``, to every row.

    A null or empty page, and one without main text, has an empty text. Broken
    markup is read as far as it goes. Columns in ``keep`` (all by default) and
    repeated rows are kept; a ``text`` column is replaced.
    """
    bound_batches(pages.sparkSession)
    rest = pages.drop("text")
    kept = [c for c in rest.columns if keep is None or c in keep]
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())  # some hundred kilobytes

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, group):
                part = batch.slice(start, group)
                texts = extract_pages(shared.value, [x or "" for x in part["html"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.select(*kept).schema)
    return rest.mapInArrow(apply, f"{schema}text string")
