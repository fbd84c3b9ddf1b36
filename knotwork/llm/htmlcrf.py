"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into tags and text once, left to right, then read with a stack of open elements (with the implied ends of p, li, td and
the like); text gathers in the leaf block of the innermost block element. Comments and scripts, styles and other raw text are no text.
Elements that are no running text (SKIP) and hidden ones (`hidden`, `aria-hidden`, `display:none`) are left out with all that they
hold, if they are closed before the block around them is; of others only the tag is. Each block gets features of its ancestors' tags,
of the words of their class, id and role, and of its text and links. The field labels the blocks jointly, main text or not (Viterbi),
and the main blocks' texts are joined in page order.

It is trained on generated pages with known labels: several layouts, with semantic elements and without, running text in any kind of
block, whose menus, headers, footers, sidebars, notices, adverts, forms, related links and reader comments are known, a fixed number
of them.

Null and empty pages give the empty text. One row out for each row in, whatever its id, repeated rows too; other columns are ignored.
Work is linear in the page, broken ones included; memory is bounded by one page.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+)>""")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # quotes mean nothing: for pages in which they do not close
_ATTR = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none")
_WORD = re.compile(r"[a-z]+")
DEEP = 256  # elements around a block that are looked at; deeper nesting than that is no layout
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}\b[^>]*+>", re.I) for n in "script style textarea title iframe".split()}
SKIP = frozenset("noscript template svg object select option button datalist canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption center".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
FENCE = frozenset("ul ol dl table div article section aside body td".split())
HINTS = frozenset("ad ads advert advertisement adverts sponsored promo banner cookie cookies consent notice alert modal popup newsletter subscribe signup sidebar side widget rail menu nav navbar navigation breadcrumb breadcrumbs toolbar header masthead topbar footer bottom copyright legal comment comments reply replies discussion disqus share sharing social related recommended more trending tags meta author byline content post entry article main body text story page login search form".split())


@dataclass
class Block:
    path: tuple[str, ...]
    words: frozenset[str]
    text: str
    linked: int  # characters within links


Token = tuple[int, str, str, int, int]  # 0 text, 1 start tag, 2 end tag; name; attributes; place in the page


def tokens(page: str) -> list[Token]:
    """Tags and text in order, without comments and raw text. Every character is looked at a bounded number of times."""
    out: list[Token] = []
    at = text = 0
    last, tag = page.rfind(">") + 1, _TAG
    while (at := page.find("<", at)) >= 0:
        sign = page[at + 1 : at + 2]
        name, kind, attributes = "", 1, ""
        if sign in ("!", "?"):
            end = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
            end = end + 1 if end > at else len(page)
        elif at < last and (sign == "/" or sign.isalpha()):
            m = tag.match(page, at, last)
            if not m and tag is _TAG:
                tag = _BARE
                m = tag.match(page, at, last)
            if not m:
                at += 1
                continue
            name, kind, attributes, end = m[2].lower(), 2 if m[1] else 1, m[3], m.end()
        else:
            at += 1
            continue
        if at > text:
            out.append((0, "", "", text, at))
        if kind == 1 and name in RAW and not attributes.endswith("/"):
            close = RAW[name].search(page, end)
            end = close.end() if close else len(page)
        elif name:
            out.append((kind, name, attributes, at, end))
        at = text = end
    if text < len(page):
        out.append((0, "", "", text, len(page)))
    return out


def attributes_of(text: str) -> tuple[frozenset[str], bool]:
    """Hint words of class, id and role; whether the element is hidden."""
    hints, unseen = set(), False
    for a in _ATTR.finditer(text):
        key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if key == "hidden":
            # of "aria-hidden" and "data-hidden" only the former counts, by its value
            unseen |= not text[a.start() - 1 : a.start()].endswith("-")
        elif key == "aria-hidden":
            unseen |= value.strip() == "true"
        elif key == "style":
            unseen |= _UNSEEN.search(value) is not None
        else:
            hints |= HINTS.intersection(_WORD.findall(value))
    return frozenset(hints), unseen


def left_out(page: list[Token]) -> dict[int, int]:
    """Start tags of elements that are left out, each with its end tag: those that close before a block around them does."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []  # open elements; start token of those to leave out, else -1
    count: dict[str, int] = {}  # open elements by name
    for k, (kind, name, attributes, _, _) in enumerate(page):
        if kind == 1 and name not in VOID:
            gone = not attributes.endswith("/") and (name in SKIP or ("hidden" in attributes or "none" in attributes) and attributes_of(attributes)[1])
            if gone or name in BLOCK or count.get(name):
                stack.append((name, k if gone else -1))
                count[name] = count.get(name, 0) + 1
        elif kind == 2 and count.get(name):
            while True:
                own, start = stack.pop()
                count[own] -= 1
                if own == name:
                    break
            if start >= 0:
                out[start] = k
    return out


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    path: tuple[str, ...] = ()
    words: frozenset[str] = frozenset()
    buffer: list[str] = []
    link = linked = 0
    page = page or ""
    own = tokens(page)
    gone = left_out(own)

    def flush() -> None:
        nonlocal buffer, linked
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            out.append(Block(path, words, text, min(linked, len(text))))
        buffer, linked = [], 0

    def opened() -> None:
        nonlocal path, words
        path = tuple(t for t, _ in stack[-DEEP:])
        words = stack[-1][1] if stack else frozenset()

    k = -1
    while (k := k + 1) < len(own):
        kind, name, attributes, begin, end = own[k]
        if not kind:
            buffer.append(page[begin:end])
            linked += end - begin if link else 0
            continue
        if kind == 2:
            if name == "a":
                link = 0
            elif name in BLOCK:
                if name == "p" and not any(t == "p" for t, _ in stack[-DEEP:]):
                    flush()
                if any(t == name for t, _ in stack[-DEEP:]):
                    flush()
                    while stack.pop()[0] != name:
                        pass
                    opened()
            continue
        if k in gone:
            if name in BLOCK:
                flush()
            k = gone[k]
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name == "a":
            link = 1
        if name not in BLOCK:
            continue
        flush()
        if name == "hr":
            continue
        while stack and stack[-1][0] == "p":
            stack.pop()
        if name in ENDS:
            for j in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEP), -1):
                if stack[j][0] in ENDS[name]:
                    del stack[j:]
                    break
                if stack[j][0] in FENCE:
                    break
        above = stack[-1][1] if stack else frozenset()
        hints = attributes_of(attributes)[0] if attributes else above
        stack.append((name, above if hints <= above else above | hints))  # words of all elements around
        opened()
    flush()
    return out


_SMALL = {"share", "login", "subscribe", "cookie", "cookies", "copyright", "advertisement", "sponsored", "menu", "search", "comments", "reply", "related", "©"}


def features(block: Block, first: bool) -> list[str]:
    """Ancestor tags and their words, then the text's shape."""
    near = block.path[-1] if block.path else "none"
    out = ["1", f"near={near}", *(f"in={t}" for t in set(block.path)), *(f"word={w}" for w in block.words)]
    inside = [t for t in block.path if t in ("article", "main", "aside", "nav", "header", "footer", "form")]
    out.append("inner=" + (inside[-1] if inside else "none"))
    n, share = len(block.text), block.linked / max(1, len(block.text))
    words = block.text.lower().split(maxsplit=40)
    out += [f"size={min(8, n.bit_length())}", f"links={int(share * 3.99)}", f"stop={block.text[-1] in '.!?…:”'}", f"{near} size={min(8, n.bit_length()) // 2}"]
    out += [f"says={w}" for w in _SMALL.intersection(words)]
    if first:
        out.append("first")
    return out


@dataclass
class Chain:
    weights: np.ndarray  # features x 2
    change: np.ndarray  # 2 x 2
    number: dict[str, int]
    paths: dict = field(default_factory=dict, repr=False)

    def ids(self, page: list[Block], grow: bool = False) -> list[list[int]]:
        get = (lambda x: self.number.setdefault(x, len(self.number))) if grow else self.number.get
        return [[i for i in map(get, features(b, k == 0)) if i is not None] for k, b in enumerate(page)]

    def scores(self, ids: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((i for f in ids for i in f), np.int64)
        at = np.cumsum([0, *map(len, ids)])[:-1]
        return np.add.reduceat(self.weights[flat], at, axis=0)

    def label(self, page: list[Block]) -> list[int]:
        """Viterbi."""
        if not page:
            return []
        s = self.scores(self.ids(page)).tolist()
        (aa, ab), (ba, bb) = self.change.tolist()
        x, y = s[0]
        back = []
        for u, v in s[1:]:
            p, q = x + aa < y + ba, x + ab < y + bb
            back.append((p, q))
            x, y = (y + ba if p else x + aa) + u, (y + bb if q else x + ab) + v
        out = [int(y > x)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]

    def text(self, page: str | None) -> str:
        own = blocks(page)
        return " ".join(b.text for b, k in zip(own, self.label(own), strict=True) if k)


def pages(n: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """Generated pages, and the texts of their main blocks in order."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "the", "or", "re", "in", "st", "qua", "ver", "ci", "eau", "ung", "do"]) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    line = lambda a, b: (words(a, b) + r.choice([".", ".", ".", "", "!", "?"])).capitalize()
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(r.randint(a, b)))
    div = lambda names, inner, tag="div": f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(names)}">{inner}</{tag}>'

    def noise() -> str:
        sem = r.random() < 0.5
        kind = r.randrange(10)
        if kind == 0:
            return f"<nav><ul>{links(2, 8)}</ul></nav>" if sem else div(["menu", "nav", "navbar", "breadcrumb", "toolbar"], f"<ul>{links(2, 8)}</ul>")
        if kind == 1:
            inner = f"<h1>{words(1, 3)}</h1>" * (r.random() < 0.5) + f"<p>{words(2, 6)}</p>" + f"<ul>{links(1, 4)}</ul>" * (r.random() < 0.5)
            return f"<header>{inner}</header>" if sem else div(["header", "site-header", "masthead", "topbar"], inner)
        if kind in (2, 3):
            inner = r.choice(["&copy; ", "Copyright 2020 ", ""]) + words(1, 5) + " &middot; " + line(3, 14)
            inner = f"<p>{inner}</p>" if r.random() < 0.4 else inner
            return f"<footer>{inner}</footer>" if sem else div(["footer", "site-footer", "bottom", "legal"], inner)
        if kind == 4:
            inner = f"<h3>{words(1, 3)}</h3>" + r.choice([f"<ul>{links(2, 6)}</ul>", f"<p>{line(4, 30)}</p>"])
            return f"<aside>{inner}</aside>" if sem else div(["sidebar", "side rail", "widget"], inner)
        if kind == 5:
            return div(["ad", "ads", "advert", "ad-banner", "sponsored", "promo"], r.choice(["{}", "<p>{}</p>", "<a href='/x'>{}</a>"]).format(line(3, 25)))
        if kind == 6:
            return div(["cookie", "cookie-notice", "consent", "notice", "alert", "popup"], r.choice(["{}", "<p>{}</p>"]).format(line(5, 25)))
        if kind == 7:
            inner = f"<label>{words(1, 3)}</label><input name=q><p>{line(2, 10)}</p><button>{word()}</button>"
            return f"<form action=/{word()}>{inner}</form>" if sem else div(["newsletter", "subscribe", "login form", "search"], f"<form>{inner}</form>")
        if kind == 8:
            one = lambda: div(["comment", "reply"], r.choice(["<p>{}</p>", "<b>{}</b><p>{}</p>", "{}"]).replace("{}", line(3, 40)))
            inner = f"<h3>{r.choice(['Comments', words(1, 2)])}</h3>" + "".join(one() for _ in range(r.randint(1, 5)))
            return div(["comments", "discussion", "replies"], inner, r.choice(["section", "div", "ul"]))
        return div(["related", "share", "social", "recommended", "more", "trending"], f"<h4>{words(1, 3)}</h4><ul>{links(2, 5)}</ul>", r.choice(["div", "section"]))

    for _ in range(n):
        main: list[str] = []

        def put(tag: str, text: str) -> str:
            main.append(text)  # noqa: B023
            if not tag:
                return text
            return f"<{tag}>{text}" + ("" if tag in ("p", "li") and r.random() < 0.2 else f"</{tag}>")

        body, plain = [], r.random() < 0.2
        if r.random() < 0.85:
            title = put(r.choice(["h1", "h1", "h2"]), line(2, 10))
            body.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            k = r.random()
            if k < 0.72:
                if plain and r.random() < 0.9 or r.random() < 0.12:
                    kind = r.choice(["div", "div", "div", "section", "pre", "span", "figure", "dl", "text"])
                    if kind == "span":
                        body.append(f"<div><span>{put('', line(1, 90))}</span></div>")
                    elif kind == "figure":
                        body.append(f"<figure><img src=x>{put('figcaption', line(2, 30))}</figure>")
                    elif kind == "dl":
                        body.append(f"<dl>{put('dt', words(1, 4))}{put('dd', line(2, 40))}</dl>")
                    elif kind == "text":
                        body.append(put("", line(3, 90)) + "<hr>")
                    else:
                        body.append(put(kind, line(1, 90)))
                else:
                    body.append(put("p", line(1, 90)))
            elif k < 0.8:
                body.append(put(r.choice(["h2", "h3"]), line(2, 7)))
            elif k < 0.87:
                body.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(put("li", line(2, 20)) for _ in range(r.randint(1, 4))) + f"</{t}>")
            elif k < 0.92:
                body.append(put("blockquote", line(4, 30)))
            elif k < 0.96:
                body.append("<table><tr>" + "".join(put("td", words(1, 5)) for _ in range(3)) + "</tr></table>")
            else:
                body.append(noise())
        inner = "".join(body)
        shell = r.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post entry">{}</div></div>', '<section class="story">{}</section>', "<div><article class=post>{}</article></div>", '<div class="content">{}</div>', "<div>{}</div>", "<div><div>{}</div></div>"])
        page = "".join(noise() for _ in range(r.randint(0, 4))) + shell.format(inner) + "".join(noise() for _ in range(r.randint(0, 4)))
        yield f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>", main


@functools.lru_cache
def train(n: int = 500, seed: int = 21, rounds: int = 12, rate: float = 0.5, decay: float = 1e-4) -> Chain:
    """Gradient ascent (Adagrad, a page at a time) on the conditional log-likelihood."""
    chain, data = Chain(np.zeros((0, 2)), np.zeros((2, 2)), {}), []
    for page, main in pages(n, seed):
        own, left = blocks(page), list(main)
        y = []
        for b in own:
            hit = bool(left) and b.text == " ".join(html.unescape(left[0]).split())
            y.append(int(hit))
            if hit:
                left.pop(0)
        if own and not left:
            data.append((chain.ids(own, grow=True), np.array(y)))
    chain.weights = np.zeros((len(chain.number), 2))
    step_w, step_c = np.full(chain.weights.shape, 1e-3), np.full((2, 2), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(data)):
            ids, y = data[k]
            s, n_ = chain.scores(ids), len(ids)
            fwd, bwd = np.empty((n_, 2)), np.zeros((n_, 2))
            fwd[0] = s[0]
            for i in range(1, n_):
                fwd[i] = s[i] + np.logaddexp.reduce(fwd[i - 1][:, None] + chain.change, 0)
            for i in range(n_ - 2, -1, -1):
                bwd[i] = np.logaddexp.reduce(chain.change + s[i + 1] + bwd[i + 1], 1)
            z = np.logaddexp.reduce(fwd[-1])
            g = -np.exp(fwd + bwd - z)
            g[np.arange(n_), y] += 1
            gc = -np.exp(fwd[:-1, :, None] + chain.change + (s + bwd)[1:, None, :] - z).sum(0)
            np.add.at(gc, (y[:-1], y[1:]), 1)
            gw = np.zeros_like(chain.weights)
            np.add.at(gw, np.concatenate(ids).astype(np.int64), np.repeat(g, [len(f) for f in ids], 0))
            gw -= decay * chain.weights
            step_w += gw**2
            step_c += gc**2
            chain.weights += rate * gw / np.sqrt(step_w)
            chain.change += rate * gc / np.sqrt(step_c)
    return chain


def extract(pages_: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages_.sparkSession.sparkContext.broadcast(train())
    kinds = [pages_.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in it:
            got = [chain.text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages_.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
