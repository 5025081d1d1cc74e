"""A page as a table of nodes: block elements and the text runs between their borders."""

from __future__ import annotations

import html as entities
import re

import numpy as np

# An element that is dropped whole needs its end tag; without one only its tag goes,
# except that nothing but text follows an open script, style or textarea.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/])[^>]*/>"
    r"|<(script|style|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|svg|iframe|select)(?=[\s/>])[^>]*>.*?</\2\s*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop|type)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements that break a line of text, of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
# A new one of these ends an open one: itself or its kind, up to the given borders.
_CLOSES = {
    **{t: ({"p"}, frozenset()) for t in BLOCKS - {"head", "html", "body", "title"}},
    "li": ({"li", "p"}, frozenset({"ul", "ol", "menu", "dir"})),
    "dt": ({"dt", "dd", "p"}, frozenset({"dl"})),
    "dd": ({"dt", "dd", "p"}, frozenset({"dl"})),
    "tr": ({"tr", "td", "th", "p"}, frozenset({"table"})),
    "td": ({"td", "th", "p"}, frozenset({"table", "tr"})),
    "th": ({"td", "th", "p"}, frozenset({"table", "tr"})),
    "body": ({"head", "title"}, frozenset()),
}
_ALWAYS_OUT = frozenset({"head", "title"})
# What a head may hold; anything else ends it, as text does.
_IN_HEAD = frozenset("html head title base basefont bgsound link meta noframes script style noscript template".split())
_CONTROLS = frozenset({"input", "button", "option", "label"})

FIELDS = ("page", "parent", "leaf", "depth", "text", "links", "linked", "controls", "end")


class Pages:
    """Nodes of many pages in page order, as columns; leaves also hold their text."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {name: [] for name in FIELDS}
        self.tags: list[str] = []
        self.tokens: list[tuple[str, ...]] = []
        self.texts: list[str] = []
        self.count = 0

    def _add(self, parent: int, leaf: bool, tag: str, tokens: tuple[str, ...], text: str = "") -> int:
        r, node = self.rows, len(self.tags)
        r["page"].append(self.count)
        r["parent"].append(parent)
        r["leaf"].append(leaf)
        r["depth"].append(r["depth"][parent] + 1 if parent >= 0 else 0)
        r["text"].append(len(text))
        r["links"].append(0)
        r["linked"].append(0)
        r["controls"].append(0)
        r["end"].append(node + 1)
        self.tags.append(tag)
        self.tokens.append(tokens)
        self.texts.append(text)
        return node

    def parse(self, page: str) -> None:
        """Append one page. Never fails: stray ends are passed over, open elements end with the page."""
        root = self._add(-1, False, "html", ())
        stack, names = [root], ["html"]
        held: list[str] = []
        in_link = links = linked = controls = 0

        def close_text() -> None:
            nonlocal links, linked, controls
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text and names[-1] == "head":
                pop(len(names) - 1)
            if text and not _ALWAYS_OUT & set(names):
                node = self._add(stack[-1], True, names[-1], (), text)
                self.rows["links"][node], self.rows["linked"][node] = links, min(linked, len(text))
            if text or links or controls:
                self.rows["controls"][stack[-1]] += controls
            links = linked = controls = 0

        def pop(to: int) -> None:
            for node in stack[to:]:
                self.rows["end"][node] = len(self.tags)
            del stack[to:], names[to:]

        at = 0
        for match in _TOKEN.finditer(page):
            if match.start() > at:
                piece = page[at : match.start()]
                held.append(piece)
                linked += len(piece) if in_link else 0
            at = match.end()
            name = match[4]
            if name is None:
                held.append(" " if match[1] or match[2] else "")
                continue
            name, closing = name.lower(), bool(match[3])
            if not closing and names[-1] == "head" and name not in _IN_HEAD:
                close_text()
                if names[-1] == "head":
                    pop(len(names) - 1)
            if name not in BLOCKS:
                if name == "a":
                    in_link, links = int(not closing), links + (not closing)
                elif name == "br":
                    held.append(" ")
                elif name in _CONTROLS and not closing:
                    controls += 1
                continue
            close_text()
            in_link = 0
            if closing:
                if name in names[1:]:
                    pop(len(names) - 1 - names[::-1].index(name))
                continue
            kinds, borders = _CLOSES.get(name, (frozenset(), frozenset()))
            for place in range(len(names) - 1, 0, -1):
                if names[place] in borders or (name not in ("li", "dt", "dd", "tr", "td", "th", "body") and names[place] != "p"):
                    break
                if names[place] in kinds:
                    pop(place)
            if name == "hr" or (name in ("html", "body") and name in names and name == "html"):
                continue
            stack.append(self._add(stack[-1], False, name, _attribute_tokens(match[5])))
            names.append(name)
        held.append(page[at:])
        linked += len(page) - at if in_link else 0
        close_text()
        pop(0)
        self.count += 1

    def columns(self) -> dict[str, np.ndarray]:
        return {name: np.array(values, np.int64) for name, values in self.rows.items()}


def _attribute_tokens(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role and the like, lower case."""
    if "=" not in attributes:
        return ()
    found = (m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes))
    return tuple(w.lower() for value in found for w in _WORD.findall(value))
