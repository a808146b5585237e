"""Main text of HTML pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks. Each has a tag-path vector (hashed names, classes, ids and
roles of its ancestors), a hashed-word vector and a few counts; a bidirectional LSTM in numpy reads
the sequence and labels every block in the context of the whole page. It is trained here (`train`), on pages that
`training_page` composes from common layouts, with a fixed seed; the weights are stored beside this module.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_list

#: Elements that start and end blocks, and those whose content is never text of the page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset(["hr"])
#: Elements whose content is text of their own up to their end tag, or to the page's end, whatever stands in it; and other silent ones.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SILENT = frozenset("noscript template svg math select button canvas object datalist".split())
#: A comment; or a tag, whose quoted attributes may hold anything; or a tag or declaration that is never closed, up to the next one.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^<>]*(?:>|(?=<)|\Z)|<[!?][^<>]*(?:>|(?=<)|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")
#: A new element of the first kind ends an open one of the second kind that nothing of the third kind encloses.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
PATHS, WORDS, COUNTS = 2048, 512, 6
#: Innermost elements in a block's tag path.
DEPTH = 32
#: Open elements that are looked through for one that a new one ends.
NEAR = 256


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    linked: int  # characters inside links


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


@functools.lru_cache(maxsize=1 << 16)
def _names(tag: str, attributes: str) -> tuple[int, ...]:
    found = [tag]
    for name, *values in ATTRIBUTE.findall(attributes):
        found += [f"{'.' if name.lower() == 'class' else '#'}{x}" for x in NAME.findall("".join(values).lower())]
    return tuple(_bucket(x, PATHS) for x in found)


@dataclass
class Tag:
    start: int
    end: int
    closing: bool
    name: str
    attributes: str


def _raw_end(page: str, name: str, at: int) -> re.Match | None:
    return re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)


def tags(page: str) -> Iterator[Tag]:
    """Markup in order; a raw-text element is one piece of markup, to its end tag or the page's end. Comments have no name."""
    at, ends = 0, {}
    while m := MARKUP.search(page, at):
        closing, name, attributes = bool(m.group(1)), (m.group(2) or "").lower(), m.group(3) or ""
        start, at = m.start(), m.end()
        if not name and (broken := BROKEN.match(page, start)):  # a tag with a stray quote or a stray < is a tag none the less
            closing, name = bool(broken.group(1)), broken.group(2).lower()
        if name in RAW and not closing and not attributes.endswith("/"):
            # an element without an end tag is looked for once
            found = None if ends.get(name) is False else _raw_end(page, name, at)
            ends[name] = found is not None
            at = found.end() if found else len(page)
            name = ""
        yield Tag(start, at, closing, name, attributes)


BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")


class Open:
    """Open elements, innermost last. Finding out whether one of a name is open takes no search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, object]] = []
        self.count: dict[str, int] = {}

    def push(self, name: str, what: object) -> None:
        self.stack.append((name, what))
        self.count[name] = self.count.get(name, 0) + 1

    def pop(self) -> tuple[str, object]:
        name, what = self.stack.pop()
        self.count[name] -= 1
        return name, what

    def close(self, name: str) -> object | None:
        """Closes the innermost of a name and all in it; what was pushed with it, None if none is open."""
        if not self.count.get(name):
            return None
        while (found := self.pop())[0] != name:
            pass
        return found[1]


def _silent(listed: list[Tag]) -> set[int]:
    """Places of the tags that start silent elements which also end, within the block they start in."""
    open_, found = Open(), set()
    for i, t in enumerate(listed):
        if t.name not in SILENT and t.name not in BLOCKS or t.name in VOID or t.attributes.endswith("/") and not t.closing:
            continue
        if not t.closing:
            open_.push(t.name, i)
        elif (start := open_.close(t.name)) is not None and t.name in SILENT:
            found.add(start)
    return found


def blocks(page: str) -> list[Block]:
    """The page's non-empty leaf blocks in order, with character references decoded and white space collapsed.

    Silent elements (buttons, drawings and so on) end with their end tag; an element of that kind without one is
    taken to have no content, so it hides nothing. Time is linear in the page's length.
    """
    listed = list(tags(page))
    silent = _silent(listed)
    open_ = Open()
    found: list[Block] = []
    parts: list[str] = []
    linked = at = links = depth = 0
    hushed = ""

    def close() -> None:
        nonlocal linked
        if parts and (text := " ".join(html.unescape("".join(parts)).split())):
            found.append(Block(text, tuple(b for _, names in open_.stack[-DEPTH:] for b in names), min(linked, len(text))))  # type: ignore[union-attr]
        parts.clear()
        linked = 0

    for i, t in enumerate(listed):
        if t.start > at and not depth:
            parts.append(page[at : t.start])
            if links:
                linked += t.start - at
        at = t.end
        if depth:  # only the silent element's own name counts in it
            if t.name == hushed and (t.closing or i in silent):
                depth += -1 if t.closing else 1
            continue
        if i in silent:
            depth, hushed = 1, t.name
        elif t.name == "a":
            links = 0 if t.closing else 1
        elif t.name == "br":
            parts.append("\n")
        elif t.name in BLOCKS:
            close()
            if t.closing:
                open_.close(t.name)
                continue
            if open_.stack and open_.stack[-1][0] == "p":
                open_.pop()
            if t.name in ENDS:
                _end_same(open_, *ENDS[t.name])
            if t.name not in VOID and not t.attributes.endswith("/"):
                open_.push(t.name, _names(t.name, t.attributes))
    if not depth:
        parts.append(page[at:])
    close()
    return found


def _end_same(open_: Open, same: set[str], outer: set[str]) -> None:
    """Closes an open element that a new one of its kind ends, if nothing encloses the new one."""
    if not any(open_.count.get(x) for x in same):
        return
    for i in range(len(open_.stack) - 1, max(-1, len(open_.stack) - 1 - NEAR), -1):
        if open_.stack[i][0] in outer:
            return
        if open_.stack[i][0] in same:
            while len(open_.stack) > i:
                open_.pop()
            return


class Words(dict):
    """Buckets of words, kept by word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = b = PATHS + _bucket(word.lower().strip(".,;:!?()\"'"), WORDS)
        return b


@dataclass
class Features:
    """All blocks of some pages: sparse inputs (block, bucket, weight) and counts."""

    sizes: list[int] = field(default_factory=list)
    buckets: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    counts: list[tuple[float, ...]] = field(default_factory=list)

    def add(self, page: list[Block], words: Words) -> None:
        self.sizes.append(len(page))
        for i, b in enumerate(page):
            tokens = b.text.split(" ")
            n, chars = len(tokens), len(b.text)
            self.starts.append(len(self.buckets))
            self.buckets += b.path
            self.weights += [1.0] * len(b.path)
            self.buckets += map(words.__getitem__, tokens)
            self.weights += [1 / n] * n
            stops = b.text.count(". ") + b.text.count("! ") + b.text.count("? ") + (b.text[-1] in ".!?")
            self.counts.append((np.log1p(chars) / 6, b.linked / chars, min(1.0, 5 * stops / n), i / len(page), min(1.0, n / 20), 1.0))


HIDDEN, INPUT = 20, 32


def initial(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"e": r.normal(0, 0.05, (PATHS + WORDS, INPUT)), "c": r.normal(0, 0.3, (COUNTS, INPUT)), "o": r.normal(0, 0.2, (2 * HIDDEN + INPUT, 1)), "ob": np.zeros(1)}
    for way in "fb":
        p |= {f"w{way}": r.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN)), f"u{way}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"b{way}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scan(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """An LSTM over x (time, page, input); padded steps leave the state as it is."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out, cache = np.empty((steps, n, HIDDEN)), []
    a = x.reshape(-1, x.shape[2]) @ w + b
    a = a.reshape(steps, n, -1)
    for t in range(steps):
        z = a[t] + h @ u
        s = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        new = f * c + i * g
        tanh = np.tanh(new)
        m = mask[t][:, None]
        if keep:
            cache.append((i, f, o, g, c, tanh, h))
        c, h = np.where(m, new, c), np.where(m, o * tanh, h)
        out[t] = h
    return out, cache


def _scan_back(d_out: np.ndarray, x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, cache: list):
    steps, n, _ = x.shape
    dh, dc, du = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros_like(u)
    da = np.zeros((steps, n, 4 * HIDDEN))
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, tanh, h = cache[t]
        m = mask[t][:, None]
        dh = dh + d_out[t]
        live = np.where(m, dh, 0)
        dnew = np.where(m, dc, 0) + live * o * (1 - tanh**2)
        z = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
        da[t] = z
        du += h.T @ z
        dh, dc = np.where(m, 0, dh) + z @ u.T, np.where(m, 0, dc) + dnew * f
    flat = da.reshape(-1, 4 * HIDDEN)
    return flat @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _inputs(p: dict[str, np.ndarray], f: Features) -> np.ndarray:
    if not f.starts:
        return np.zeros((0, INPUT))
    out = np.empty((len(f.starts), INPUT))
    ends = [*f.starts[1:], len(f.buckets)]
    buckets, weights = np.array(f.buckets), np.array(f.weights)
    s = 0
    while s < len(f.starts):  # a bounded number of gathered rows at a time
        e = s + 1
        while e < len(f.starts) and ends[e] - f.starts[s] <= 1 << 18:
            e += 1
        at, to = f.starts[s], ends[e - 1]
        out[s:e] = np.add.reduceat(p["e"][buckets[at:to]] * weights[at:to, None], np.array(f.starts[s:e]) - at)
        s = e
    return np.tanh(out + np.array(f.counts) @ p["c"])


def _padded(f: Features) -> tuple[np.ndarray, np.ndarray]:
    """(time, page) places of blocks, and which of them are real; and the same read backwards by the caller."""
    steps, starts = max(f.sizes), np.concatenate(([0], np.cumsum(f.sizes)[:-1]))
    t = np.arange(steps)[:, None]
    mask = t < np.array(f.sizes)[None, :]
    return np.where(mask, starts[None, :] + t, 0), mask


def _forward(p: dict[str, np.ndarray], f: Features, keep: bool = False):
    x = _inputs(p, f)
    place, mask = _padded(f)
    xs = x[place] * mask[:, :, None]
    hf, cf = _scan(xs, mask, p["wf"], p["uf"], p["bf"], keep)
    hb, cb = _scan(xs[::-1], mask[::-1], p["wb"], p["ub"], p["bb"], keep)
    both = np.concatenate([hf, hb[::-1], xs], axis=2)
    return (both @ p["o"])[:, :, 0] + p["ob"], (x, place, mask, xs, cf, cb, both)


def predict(p: dict[str, np.ndarray], pages: list[list[Block]], words: Words) -> list[list[bool]]:
    """For each page which blocks are main text. Pages of like length are read together."""
    out: list[list[bool]] = [[] for _ in pages]
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    s = 0
    while s < len(order):
        e = s + 1
        while e < len(order) and len(pages[order[e]]) * (e + 1 - s) <= 1 << 14:
            e += 1
        f = Features()
        for i in order[s:e]:
            f.add(pages[i], words)
        logits, (_, _, mask, *_) = _forward(p, f)
        for k, i in enumerate(order[s:e]):
            out[i] = (logits[: len(pages[i]), k] > 0).tolist()
        s = e
    return out


def train(pages: int = 2000, rounds: int = 6, seed: int = 7, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Adam on composed pages."""
    p, words = initial(seed), Words()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    data = [training_page(np.random.default_rng([seed, i])) for i in range(pages)]
    step = 0
    for turn in range(rounds):
        order = np.random.default_rng([seed, 1, turn]).permutation(len(data))
        for s in range(0, len(order), 25):
            f, y = Features(), []
            for i in order[s : s + 25]:
                f.add(data[i][0], words)
                y += data[i][1]
            logits, (x, place, mask, xs, cf, cb, both) = _forward(p, f, keep=True)
            target = np.array(y, np.float64)[place]
            d = np.where(mask, _sigmoid(logits) - target, 0)[:, :, None] / mask.sum()
            g = {"o": both.reshape(-1, both.shape[2]).T @ d.reshape(-1, 1), "ob": d.sum(axis=(0, 1))}
            d_both = d @ p["o"].T
            dxf, g["wf"], g["uf"], g["bf"] = _scan_back(d_both[:, :, :HIDDEN], xs, mask, p["wf"], p["uf"], cf)
            dxb, g["wb"], g["ub"], g["bb"] = _scan_back(d_both[::-1, :, HIDDEN : 2 * HIDDEN], xs[::-1], mask[::-1], p["wb"], p["ub"], cb)
            dxs = d_both[:, :, 2 * HIDDEN :] + dxf.reshape(xs.shape) + dxb.reshape(xs.shape)[::-1]
            dx = np.zeros_like(x)
            np.add.at(dx, place[mask], dxs[mask])
            dx *= 1 - x**2
            g["c"] = np.array(f.counts).T @ dx
            g["e"] = np.zeros_like(p["e"])
            owner = np.repeat(np.arange(len(f.starts)), np.diff([*f.starts, len(f.buckets)]))
            np.add.at(g["e"], f.buckets, dx[owner] * np.array(f.weights)[:, None])
            step += 1
            for k, v in g.items():
                a, b = moments[k]
                a *= 0.9
                a += 0.1 * v
                b *= 0.999
                b += 0.001 * v**2
                p[k] = p[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return p


#: Words of page furniture in several languages, as pages commonly have them.
MENU = "home about contact news sports business login register search menu archive help privacy terms sitemap shop blog categories tags next previous accueil kontakt inicio impressum startseite recherche buscar".split()
NOTICE = "we use cookies to improve your experience accept all cookies settings privacy policy subscribe newsletter consent agree dismiss notice warning javascript enable browser updates notifications".split()
ADVERT = "sponsored advertisement buy now offer discount sale click here limited shop free shipping deal promo save today".split()
FOOTER = "copyright all rights reserved privacy policy terms of service contact imprint powered by company inc ltd".split()
COMMENT = "comment reply posted by says great post thanks for sharing i agree disagree lol wrote anonymous guest ago report like".split()
FORM = "name email password submit send message your first last phone address required subscribe sign up search".split()


def _composed_words(r: np.random.Generator, n: int) -> list[str]:
    parts = ("th er on an re in en at or es is it te ti ha st nd to ou ar le de la que un ver ich ung el os ción pa eau".split())
    return ["".join(r.choice(parts, r.integers(1, 4))) for _ in range(n)]


def _prose(r: np.random.Generator, low: int = 1, high: int = 120) -> str:
    words = _composed_words(r, int(np.exp(r.uniform(np.log(low), np.log(high)))) or 1)
    for i in range(len(words)):
        if i == 0 or words[i - 1].endswith("."):
            words[i] = words[i].capitalize()
        if r.random() < 0.1:
            words[i] += "."
        elif r.random() < 0.06:
            words[i] += r.choice([",", "###", "!!", ";"])
    return " ".join(words) + ("." if r.random() < 0.85 else "")


def _furniture(r: np.random.Generator, words: list[str], low: int, high: int) -> str:
    """Words of a kind, mixed with composed ones: not all sites speak a known language."""
    n, share = int(r.integers(low, high + 1)), r.choice([0.0, 0.5, 1.0])
    return " ".join(r.choice(words) if r.random() < share else _composed_words(r, 1)[0] for _ in range(n))


def training_page(r: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page of a random layout: its blocks and which of them are main text."""
    pick = lambda *x: str(r.choice(x))
    yes, no = "\x01", "\x02"  # marks of the two labels in the composed page
    named = lambda *x: f' {pick("class", "class", "id")}="{pick("", "", "site-", "page-", "js-")}{pick(*x)}{pick("", "", "-main", "-1", " clearfix")}"'
    link = lambda text: f'<a href="/{r.integers(99)}">{text}</a>'

    def menu() -> str:
        items = "".join(f"<li>{link(no + _furniture(r, MENU, 1, 3))}</li>" for _ in range(r.integers(2, 9)))
        return pick(f"<nav><ul>{items}</ul></nav>", f"<nav{named('navbar', 'menu')}><ul>{items}</ul></nav>", f"<div{named('menu', 'nav', 'navigation', 'breadcrumb', 'topbar')}><ul>{items}</ul></div>", f"<ul{named('menu', 'nav', 'links')}>{items}</ul>")

    def head() -> str:
        inner = f"<{(t := pick('div', 'h1', 'p', 'span'))}>{no}{link(_furniture(r, MENU, 1, 4))}</{t}>" + (f"<p>{no}{_furniture(r, MENU, 2, 8)}</p>" if r.random() < 0.5 else "")
        return pick(f"<header>{inner}</header>", f"<div{named('header', 'masthead', 'logo', 'banner')}>{inner}</div>")

    def advert() -> str:
        text = pick(_prose(r, 3, 40), _furniture(r, ADVERT, 3, 20))
        return pick(f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo')}>{no}{text}</div>", f"<aside{named('ad', 'promo', 'sponsor')}><p>{no}{text}</p></aside>", f"<div{named('ad', 'advert')}><p>{no}{link(text)}</p></div>", f'<div class="ad">{no}{text}</div>')

    def notice() -> str:
        text = pick(_prose(r, 5, 40), _furniture(r, NOTICE, 5, 30))
        return f"<{(t := pick('div', 'section', 'div'))}{named('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'newsletter', 'popup', 'modal')}><p>{no}{text}</p></{t}>"

    def form() -> str:
        rows = "".join(pick(f"<p>{no}<label>{_furniture(r, FORM, 1, 4)}</label><input></p>", f"<div>{no}{_furniture(r, FORM, 1, 4)}<input></div>") for _ in range(r.integers(1, 4)))
        return f"<form{named('search', 'signup', 'contact', 'login')}>{rows}</form>"

    def side() -> str:
        lines = "".join(pick(f"<li>{no}{link(_prose(r, 2, 12))}</li>", f"<p>{no}{_prose(r, 3, 50)}</p>") for _ in range(r.integers(1, 7)))
        return pick(f"<aside><h3>{no}{_furniture(r, MENU, 1, 3)}</h3>{lines}</aside>", f"<div{named('sidebar', 'widget', 'related', 'recommended', 'share', 'social', 'popular')}><h3>{no}{_furniture(r, MENU, 1, 3)}</h3>{lines}</div>", f"<aside>{lines}</aside>")

    def comments() -> str:
        each = "".join(f"<{(t := pick('li', 'div'))}{named('comment', 'comment-body', 'reply')}><p>{no}{pick(_furniture(r, COMMENT, 3, 20), _prose(r, 3, 60))}</p></{t}>" for _ in range(r.integers(1, 6)))
        return f"<{(t := pick('section', 'div', 'ol'))}{named('comments', 'comment-list', 'respond', 'discussion')}><h3>{no}{_furniture(r, COMMENT, 1, 3)}</h3>{each}</{t}>"

    def foot() -> str:
        text = pick(f"&copy; {_composed_words(r, 1)[0]}.example.net &middot; {_prose(r, 2, 15)}", _furniture(r, FOOTER, 3, 15), f"&copy; 20{r.integers(10, 25)} {_furniture(r, FOOTER, 2, 8)}")
        return pick(f"<footer>{no}{text}</footer>", f"<footer>{no}{text}</footer>", f"<footer><p>{no}{text}</p></footer>", f"<div{named('footer', 'copyright', 'bottom', 'colophon')}><p>{no}{text}</p></div>")

    def article() -> str:
        parts = [f"<{(t := pick('h1', 'h1', 'h2'))}>{yes}{_prose(r, 2, 24)}</{t}>"] if r.random() < 0.85 else []
        for i in range(int(r.integers(1, 14)) if r.random() < 0.8 else int(r.integers(14, 60))):
            kind = r.random()
            if kind < 0.72:
                parts.append(pick(f"<p>{yes}{_prose(r)}</p>", f"<p>{yes}{_prose(r)}", f"<p><b>{yes}{_prose(r)}<br>"))
            elif kind < 0.8:
                parts.append(f"<{(t := pick('h2', 'h3'))}>{yes}{_prose(r, 1, 8)}</{t}>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{yes}{_prose(r, 2, 30)}</li>" for _ in range(r.integers(2, 6))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{yes}{_prose(r, 5, 60)}</blockquote>")
            elif kind < 0.93:
                head = f"<tr><th>{yes}{_prose(r, 1, 3)}</th><th>{yes}{_prose(r, 1, 3)}</th></tr>" if r.random() < 0.5 else ""
                parts.append(f"<table>{head}" + "".join(f"<tr><td>{yes}{_prose(r, 1, 6)}</td><td>{yes}{_prose(r, 1, 9)}</td></tr>" for _ in range(r.integers(1, 4))) + "</table>")
            elif kind < 0.95:
                parts.append(pick(f"<pre>{yes}{_prose(r, 3, 30)}</pre>", f"<figure><img><figcaption>{yes}{_prose(r, 2, 20)}</figcaption></figure>", f"<section>{yes}{_prose(r, 5, 60)}</section>"))
            elif i:
                parts.append([advert, side, notice, form][int(r.integers(4))]())
        inner = "".join(parts)
        section = pick(f"<main><section{named('content', 'story', 'article', 'text')}>{inner}</section></main>", f"<section{named('content', 'story', 'post', 'body')}>{inner}</section>", f"<main>{inner}</main>", f"<section>{inner}</section>")
        left = f"<td>{link(no + _furniture(r, MENU, 1, 3))}<br>{link(_furniture(r, MENU, 1, 3))}</td>" if r.random() < 0.6 else ""
        cell = f"<table><tr><td>{no}{link(_furniture(r, MENU, 1, 4))}</td></tr><tr>{left}<td>{inner}</td></tr><tr><td>{no}{_furniture(r, FOOTER, 3, 10)}</td></tr></table>"
        return pick(f"<article>{inner}</article>", f"<article{named('post', 'entry', 'story')}>{inner}</article>", f"<main><div{named('content', 'text')}>{inner}</div></main>", f"<div{named('content', 'article', 'post', 'entry-content', 'story-body', 'main')}>{inner}</div>", f"<div>{inner}</div>", inner, f"<article>{inner}</article>", f"<article>{inner}</article>", section, section, cell)

    before = [f() for f in (head, menu, notice, advert, form) if r.random() < 0.5]
    often = r.choice([0.2, 0.6])  # some pages have little after the article
    after = [f() for f in (side, comments, advert, form, notice) if r.random() < often] + ([foot()] if r.random() < 0.7 else [])
    r.shuffle(before)
    page = "".join([*before, article() if r.random() < 0.97 else "", *after])
    if r.random() < 0.3:
        page = f"<div{named('wrapper', 'container', 'page')}>{page}</div>"
    found, labels = [], []
    for b in blocks(f"<html><head><title>x</title></head><body>{page}</body></html>"):
        labels.append(yes in b.text)
        b.text = b.text.replace(yes, "").replace(no, "").strip() or "x"
        found.append(b)
    return found, labels


#: The trained weights, and the SHA-256 of their bytes. `python -m sparkloom.llm.htmltext` trains them anew and prints it.
STORED, DIGEST = Path(__file__).with_name("html_model.npz"), "f7afaa3e230b8e97e99a9f944f5d358bbb53a0ff2c73fa845ce0e72506b9135c"


def digest(p: dict[str, np.ndarray]) -> str:
    found = hashlib.sha256()
    for name in sorted(p):
        found.update(f"{name} {p[name].shape} ".encode() + p[name].astype("<f4").tobytes())
    return found.hexdigest()


@functools.lru_cache(maxsize=1)
def model() -> dict[str, np.ndarray]:
    """The stored weights: the same on every machine, and no training in a query."""
    with np.load(STORED) as stored:
        p = {name: stored[name] for name in stored.files}
    if digest(p) != DIGEST:
        raise ValueError(f"{STORED.name} isn't the model this code was tested with")
    return {name: x.astype(np.float64) for name, x in p.items()}


def main_text(pages_: DataFrame, parameters: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id, url, html): blocks of main text in page order, joined by one \\n.

    Nulls: a null html is the empty page, whose text is empty; null page_id and url are kept. Repeated
    rows come back repeated; an empty table gives an empty result.
    """
    p = parameters or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            pages = [blocks(x) for x in text_list(batch, "html")]
            kept = predict(p, pages, words)
            texts = ["\n".join(b.text for b, k in zip(page, keep, strict=True) if k) for page, keep in zip(pages, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages_.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string")


if __name__ == "__main__":
    trained = {name: x.astype(np.float32) for name, x in train().items()}
    np.savez_compressed(STORED, **trained)
    print(digest(trained))
