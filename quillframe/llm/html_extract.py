"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into leaf blocks, runs of text without a block-level boundary (or a line break) inside, each with
its open ancestors.  A block's features are its ancestors' tags, the words of their classes, ids and roles (hashed to
``TOKENS`` numbers; none is known beforehand), and counts of its text; the field has a weight for each feature and for
each pair of neighbouring labels, is trained on labelled pages by gradient ascent on their log likelihood
(forward-backward), and decoded by Viterbi.

``labelled_pages`` makes labelled pages from a seed, of many layouts; others can be passed to ``train``.  Both the
number of pages and the features are bounded, so the model is a few hundred kilobytes.

Rules: scripts, styles, templates, titles, drawings, fields to type in, text for browsers without scripts and comments hold no text.  A script,
style or comment that is never closed reaches to the end of the page; any other such element is passed over.  Character
references are decoded, then white space in a block (all that Unicode calls so, U+00A0 too) becomes one space and is trimmed;
empty blocks vanish; kept blocks are joined by one \\n in page order; nothing is capped.  Tags that are never closed end with what
encloses them; a tag cut off at the end of the page is dropped.  Extraction takes time and memory in proportion to the page, however
deep its elements lie in each other and however they are called: an element keeps only what it adds to those around it, and the sum
of all their weights.  A null html is an empty page, and a page without main text has the text "".  Rows that repeat
are extracted each; an empty table gives an empty result; other columns may have any name, but one named ``text`` goes.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(rf"(?P<text>[^<]++)|(?P<comment><!--)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>{_ATTRIBUTES})>|(?P<cut><[!?/a-z][^>]*+(?:>|\Z))|(?P<stray><)", re.S | re.I)
_HINTING = re.compile(r"""\b(?:class|id|role|hidden|style)\b\s*=?\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))?""", re.I)
#: Elements without text of the page; the first ones reach to the end of the page if they are never closed.
_TO_THE_END = frozenset(("script", "style"))
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in ("script", "style", "template", "title", "noscript", "svg", "textarea")}
_NO_HINTS = frozenset(("html", "body"))
TOKENS = 1 << 12
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Open elements that a start tag of this kind ends.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDING = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol".split())
_KNOWN_TAGS = frozenset("article aside blockquote body button dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header label li main nav ol option p pre section select table td th tr ul".split())

_MAIN = frozenset(("article", "main"))
_APART = frozenset("aside button footer form header label nav select".split())

#: Attributes up to this length are remembered from tag to tag.
REMEMBERED = 200


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[str, ...]:
    found = set()
    for m in _HINTING.finditer(attributes):
        value = next((v for v in m.groups() if v), "")
        name = m[0][:5].lower()
        if name == "style":
            found |= {"hidden"} if re.search(r"display\s*:\s*none", value) else set()
        elif name == "hidde":
            found.add("hidden")
        else:
            words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            found |= {f"c:{zlib.crc32(w.encode()) % TOKENS}" for w in words if w}
    return tuple(sorted(found))


class _Open:
    """An open element: the features that none around it has, and the sums of weights with and without its own place."""

    __slots__ = ("tag", "added", "place", "main", "apart", "inherited", "total")

    def __init__(self, tag: str, added: tuple[str, ...], around: "_Open | None", weights: dict[str, float]):
        self.tag, self.added = tag, added
        block, self.main, self.apart, self.inherited = (around.place[0][2:], around.main, around.apart, around.inherited) if around else ("none", False, False, 0.0)
        block = tag if tag in _KNOWN_TAGS else block
        self.main, self.apart = self.main or tag in _MAIN, self.apart or tag in _APART
        self.place = (f"p:{block}", f"main:{self.main}", f"apart:{self.apart}", f"main:{self.main} apart:{self.apart}")
        self.inherited += sum(weights.get(f, 0.0) for f in added)
        self.total = self.inherited + sum(weights.get(f, 0.0) for f in self.place)


class _Ancestors:
    """The open elements; where the last of each kind stands is known, so no step walks through all of them."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.outside = weights, _Open("", (), None, weights)
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []
        self.features: dict[str, None] = {}

    @property
    def last(self) -> _Open:
        return self.stack[-1] if self.stack else self.outside

    def place(self, tag: str) -> int:
        """Of the innermost open one, or -1."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def open(self, tag: str, hints: tuple[str, ...]) -> None:
        own = (f"t:{tag}", *hints) if tag in _KNOWN_TAGS else hints
        added = tuple(f for f in own if f not in self.features)
        self.features.update(dict.fromkeys(added))
        self.places[tag].append(len(self.stack))
        if tag in _SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(_Open(tag, added, self.last, self.weights))

    def close(self, upto: int) -> None:
        """Closes all from this place on."""
        while len(self.stack) > upto:
            e = self.stack.pop()
            self.places[e.tag].pop()
            if e.tag in _SCOPES:
                self.scopes.pop()
            for f in e.added:
                del self.features[f]


def _text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    return [
        "bias", f"words:{0 if words < 4 else 1 if words < 10 else 2 if words < 25 else 3}", f"links:{0 if not linked else 1 if 2 * linked < len(text) else 2}",
        f"ends:{text[-1] in '.!?…:;”»'}", f"commas:{min(text.count(','), 2)}", f"sign:{'©' in text or '·' in text or '|' in text or '»' in text}",
    ]


def _read(page: str | None, weights: dict[str, float] | None) -> Iterator[tuple[str, list[str], float]]:
    """The text of each leaf block, its features, and the sum of their weights.

    Without weights the sum is 0; with weights the features are left out, as a deep block may have as many as the page has
    words in its attributes."""
    page = page or ""
    around = _Ancestors(weights or {})
    unclosed: set[str] = set()
    parts: list[str] = []
    linked = at = 0

    def told() -> Iterator[tuple[str, list[str], float]]:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(parts)).split()) if parts else ""
        if text:
            own = _text_features(text, linked)
            if weights is None:
                yield text, [*own, *around.features, *around.last.place], 0.0
            else:
                yield text, [], sum(weights.get(f, 0.0) for f in own) + around.last.total
        parts.clear()
        linked = 0

    while at < len(page):
        m = _TOKEN.match(page, at)
        at, kind = m.end(), m.lastgroup
        if kind == "text" or kind == "stray":
            parts.append(m[0])
            if around.place("a") >= 0:
                linked += len(m[0].strip())
        elif kind == "comment":
            found = page.find("-->", at)
            at = len(page) if found < 0 else found + 3
        elif kind == "attributes":
            tag = m["tag"].lower()
            own_end = m["attributes"].rstrip().endswith("/")
            if tag in _RAW and not m["end"]:
                if own_end and tag == "svg":
                    continue
                found = None if tag in unclosed else _RAW[tag].search(page, at)
                if found:
                    at = found.end()
                elif tag in _TO_THE_END:
                    at = len(page)
                else:
                    unclosed.add(tag)  # looked for only once
                continue
            if tag not in _INLINE:
                yield from told()
            if m["end"]:
                place = around.place(tag)
                if place >= 0:
                    if tag in _INLINE and any(e.tag not in _INLINE for e in around.stack[place:]):
                        yield from told()
                    around.close(place)
            elif tag not in _VOID:
                ends = _ENDS.get(tag, frozenset()) | ({"p"} if tag in _P_ENDING else frozenset())
                ended = max(map(around.place, ends), default=-1)
                if ended >= 0 and (not around.scopes or ended >= around.scopes[-1]):
                    around.close(ended)
                if not own_end or tag not in _INLINE:
                    attributes = m["attributes"] if tag not in _NO_HINTS else ""
                    around.open(tag, (_hints if len(attributes) <= REMEMBERED else _hints.__wrapped__)(attributes) if attributes else ())
    yield from told()


def leaf_blocks(page: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of each leaf block, to learn from."""
    return [(text, features) for text, features, _ in _read(page, None)]


class ChainField:
    """Labels 0 (left out) and 1 (main text) along a page's blocks."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs  # pairs[from, to]; row 2 is the start

    def decode(self, features: list[list[str]]) -> list[int]:
        """The most probable labels."""
        return self.best([sum(self.weights.get(f, 0.0) for f in fs) for fs in features])

    def best(self, weights: list[float]) -> list[int]:
        """The most probable labels by Viterbi, from the sum of the weights of each block's features."""
        back = []
        (a00, a01), (a10, a11), (s0, s1) = self.pairs.tolist()
        v0, v1 = s0, s1
        for i, own in enumerate(weights):
            if i:
                from0, from1 = (v0 + a00 < v1 + a10), (v0 + a01 < v1 + a11)
                v0, v1 = max(v0 + a00, v1 + a10), max(v0 + a01, v1 + a11)
                back.append((from0, from1))
            v1 += own
        if not weights:
            return []
        labels = [int(v1 > v0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def train(pages: Iterable[tuple[list[list[str]], list[int]]], rounds: int = 100, rate: float = 0.3, decay: float = 1e-3) -> ChainField:
    """Adam on the penalised log likelihood, all pages at once."""
    pages = [p for p in pages if p[1]]
    names = sorted({f for fs, _ in pages for b in fs for f in b})
    index = {f: i for i, f in enumerate(names)}
    n, length = len(pages), max(len(y) for _, y in pages)
    x, y, mask = np.zeros((n, length, len(names)), np.float32), np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, (fs, labels) in enumerate(pages):
        for t, b in enumerate(fs):
            x[i, t, [index[f] for f in b]] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    w, a = np.zeros(len(names)), np.zeros((3, 2))
    moments = [np.zeros_like(p) for p in (w, w, a, a)]
    gold_pairs = np.zeros((3, 2))
    np.add.at(gold_pairs, (2, y[:, 0]), 1)
    np.add.at(gold_pairs, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
    gold = np.einsum("ntf,nt->f", x, y * mask)
    for r in range(1, rounds + 1):
        own = np.stack([np.zeros((n, length)), x @ w], 2)
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = a[2] + own[:, 0]
        for t in range(1, length):
            step = np.logaddexp(alpha[:, t - 1, :1] + a[0], alpha[:, t - 1, 1:] + a[1]) + own[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            ahead = own[:, t + 1] + beta[:, t + 1]
            step = np.stack([np.logaddexp(*(a[k] + ahead).T) for k in (0, 1)], 1)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = np.logaddexp(*alpha[:, -1].T)
        chance = np.exp(alpha + beta - total[:, None, None])
        both = np.exp(alpha[:, :-1, :, None] + a[:2] + (own + beta)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        grads = (gold - np.einsum("ntf,nt->f", x, chance[:, :, 1] * mask)) / n - decay * w, (gold_pairs - np.vstack([both.sum((0, 1)), chance[:, 0].sum(0)])) / n - decay * a
        for p, g, m1, m2 in ((w, grads[0], *moments[:2]), (a, grads[1], *moments[2:])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return ChainField(dict(zip(names, w.tolist(), strict=True)), a)


#: What the made pages call their parts.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toc pagination pager skip",
    "head": "header masthead head logo brand tagline",
    "foot": "footer foot copyright legal imprint colophon contentinfo",
    "side": "sidebar side aside widget related recommended trending popular more rail complementary",
    "ad": "ad ads advert adverts advertisement banner sponsor sponsored promo promotion adsense",
    "notice": "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription alert alertdialog paywall",
    "comment": "comment comments commentlist reply replies disqus respond discussion",
    "meta": "share social tags byline author meta follow",
    "main": "article content post entry main story body text maincontent articlebody",
}


def labelled_pages(n: int = 400, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """(html, its main blocks): pages of many layouts with text of random words; a part's name is at times one that tells
    nothing."""
    rng = random.Random(seed)
    syllables = ["".join(p) for p in zip("bdfghklmnprstvz" * 5, "aeiou" * 15, "nrst lmn rk " * 7, strict=False)]
    word = lambda: "".join(rng.choice(syllables).strip() for _ in range(rng.randint(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize()
    sentence = lambda: words(1, 20).replace(" ", ", ", rng.randint(0, 2)) + rng.choice("...?!")
    plain = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 6))))
    # Some text is odd, within the article or without: bars, signs, shouting, no stops.
    odd = lambda t: rng.choice((t.replace(" ", " | "), t.replace(" ", "### "), "&copy; " + t, t.replace(" ", " &middot; "), t.upper(), t.rstrip(".?!"), t.replace(" ", ", ")))
    prose = lambda: odd(plain()) if rng.random() < 0.15 else plain()
    hint = lambda kind: rng.choice(NAMES[kind].split()) if rng.random() < 0.98 else rng.choice(("box", "col", "wrapper", "section", word()))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"

    def part(kind: str, inside: str, tag: str | None = None) -> str:
        if tag and rng.random() < 0.6:
            return f"<{tag}>{inside}</{tag}>"
        where = rng.choice(("class", "class", "id"))
        return f'<{rng.choice(("div", "div", "section", tag or "div"))} {where}="{rng.choice(("", "site-", "box "))}{hint(kind)}">{inside}</div>'

    def clutter(kind: str) -> str:
        p = lambda: rng.choice((prose(), f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>"))
        return {
            "menu": lambda: part("menu", links(), "nav"),
            "head": lambda: part("head", rng.choice((words(1, 4), f"<h1>{words(1, 4)}</h1><p>{sentence()}</p>", links())), "header"),
            "foot": lambda: part("foot", rng.choice((f"&copy; {word()} &middot; {prose()}", prose(), links(), f"<p>&copy; {words(2, 5)}</p>")), "footer"),
            "side": lambda: part("side", f"<h3>{words(1, 4)}</h3>" + rng.choice((links(), p())), "aside"),
            "ad": lambda: f'<div class="{hint("ad")}">{rng.choice((p(), links()))}</div>',
            "notice": lambda: f'<div class="{hint("notice")}">{p()}<button>{words(1, 2)}</button></div>',
            "comment": lambda: part("comment", "".join(f'<div class="{hint("comment")}"><b>{word()}</b><p>{prose()}</p></div>' for _ in range(rng.randint(1, 4)))),
            "form": lambda: f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>{rng.choice(('', p()))}</form>",
            "meta": lambda: f'<div class="{hint("meta")}">{rng.choice((links(), words(1, 4)))}</div>',
            "hidden": lambda: f'<div style="display:none">{p()}</div>',
        }[kind]()

    for _ in range(n):
        main: list[str] = []

        def kept(text: str, main: list[str] = main) -> str:
            main.append(html_lib.unescape(text))
            return text

        body = [f"<h1>{kept(words(2, 12))}</h1>"] if rng.random() < 0.8 else []
        body += [clutter("meta")] if rng.random() < 0.25 else []
        for _ in range(rng.choice((1, 1, 2, 4, 8, 15))):
            body.append(rng.choices((
                lambda: f"<p>{kept(prose())}</p>", lambda: f"<p><b>{kept(prose())}<br>", lambda: f"<h2>{kept(words(1, 6))}</h2>",
                lambda: "<ul>" + "".join(f"<li>{kept(sentence())}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote><p>{kept(prose())}</p></blockquote>",
                lambda: f"<table><tr><td>{kept(words(1, 3))}</td><td>{kept(words(1, 3))}</td></tr></table>", lambda: f"<pre>{kept(prose())}</pre>",
                lambda: "<dl>" + "".join(f"<dt>{kept(words(1, 3))}</dt><dd>{kept(words(2, 9))}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>",
                lambda: f"<figure><img src=x><figcaption>{kept(words(2, 9))}</figcaption></figure>",
            ), (12, 2, 2, 1, 1, 1, 1, 1, 1))[0]())
            if rng.random() < 0.2:
                body.append(clutter(rng.choice(("ad", "side", "meta", "form", "notice"))))
        inner = "".join(body)
        inner = rng.choice((f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f'<div class="{hint("main")}">{inner}</div>', f'<div id="{hint("main")}">{inner}</div>', f"<main><article>{inner}</article></main>", f"<div>{inner}</div>"))
        before = [clutter(k) for k in rng.sample(("menu", "head", "ad", "notice", "form", "menu", "ad", "side", "hidden"), rng.randint(0, 4))]
        after = [clutter(k) for k in rng.sample(("foot", "comment", "side", "ad", "notice", "foot", "form", "meta"), rng.randint(0, 4))]
        yield "<html><body>" + "".join(before) + inner + "".join(after) + "</body></html>", main


@lru_cache(maxsize=1)
def default_field() -> ChainField:
    pages = []
    for page, main in labelled_pages():
        blocks, wanted = leaf_blocks(page), {" ".join(t.split()) for t in main}
        pages.append(([f for _, f in blocks], [int(t in wanted) for t, _ in blocks]))
    return train(pages)


def main_text(page: str | None, field: ChainField) -> str:
    blocks = [(text, weight) for text, _, weight in _read(page, field.weights)]
    return "\n".join(t for (t, _), keep in zip(blocks, field.best([w for _, w in blocks]), strict=True) if keep)


def extract(pages: DataFrame, field: ChainField | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of the html, all other columns as they are (one named ``text`` goes)."""
    model = field or default_field()
    others = [c for c in pages.columns if c not in (html_col, "text")]

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[others].copy()
            out["text"] = [main_text(h, model) for h in batch[html_col]]
            yield out

    schema = pages.select(*others, F.lit("").alias("text")).schema
    return pages.select(*others, html_col).mapInPandas(extracted, schema)
