"""HTML extraction: a recurrent labeller of a page's blocks.

A tolerant parser turns a page into its leaf blocks in page order.  Each block has the path of tags
above it (with classes and ids), its words and a few counts.  Tag-path tokens and words are hashed
into vector tables and averaged; a bidirectional LSTM, in numpy, reads the whole page's sequence and
gives each block the probability of being main text, so that every decision has the page as context.

The network is trained here, on the driver, on pages that ``synthetic_page`` makes: articles in many
kinds of containers among menus, headers, footers, sidebars, notices, adverts, forms and readers'
comments.  No given page and no label of one is used.  Training is seeded, so reruns agree.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import others, portions, small_batches

#: Elements by how the parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; without an end tag it goes on to the page's end.
RAW = frozenset("script style title textarea".split())
#: Their content is read apart from the block they stand in; without an end tag only the tag itself is passed over.
HIDDEN_PARTS = frozenset("noscript template iframe svg select button canvas audio video".split())
BLOCK = frozenset(
    "html body main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure "
    "figcaption table caption thead tbody tfoot tr td th form fieldset legend address details summary dialog menu center hr".split()
)
#: What an opening tag closes if it is open in the same container.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")

N_TAGS, N_WORDS, TAG_DIM, WORD_DIM, HIDDEN, COUNTS = 2048, 4096, 24, 12, 24, 8
#: Steps of all pages in one pass, and steps whose inputs are multiplied at once.
CELLS, STRETCH = 16_384, 4096


class Path:
    """The tags over a block: the innermost one's tokens (its name, classes and ids), and the path above it."""

    __slots__ = ("above", "tokens", "depth")

    def __init__(self, above: Path | None, tokens: tuple[str, ...]):
        self.above, self.tokens, self.depth = above, tokens, (above.depth if above else 0) + len(tokens)


@dataclass
class Block:
    """A leaf: its text, the path of tags over it, and how much of it stands in links."""

    text: str
    path: Path | None
    linked: int


class _Finder:
    """``str.find`` for places that only move on: each part of the page is searched once for each string."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def __call__(self, what: str, at: int) -> int:
        found = self.known.get(what, -2)
        if found != -1 and found < at:
            found = self.known[what] = self.page.find(what, at)
        return found

    def end_tag(self, name: str, at: int) -> tuple[int, int]:
        """Where the next end tag of this name begins and is over; -1 if there is none."""
        key = "</" + name
        start, stop = self.known.get(key, (-2, -2))
        if start != -1 and start < at:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
            start, stop = self.known[key] = m.span() if m else (-1, -1)
        return start, stop


class _Tags:
    """Where tags end: behind the first ``>`` outside quotes, or behind the first of all if a quote is not closed.

    What follows an opening quote does not depend on the tag, so it is found out once for each.
    """

    def __init__(self, page: str, find: _Finder):
        self.page, self.find, self.last, self.known = page, find, {q: page.rfind(q) for q in "\"'"}, {}

    def end(self, at: int) -> int:
        """For the tag whose name ends at ``at``; -1 if it is not over."""
        first, k, passed, end = self.find(">", at), at, [], -1
        while first >= 0:
            m = _STOP.search(self.page, k)
            if not m:
                break
            if m[0] == ">":
                end = m.end()
                break
            if m.start() in self.known:
                end = self.known[m.start()]
                break
            passed.append(m.start())
            if self.last[m[0]] < m.end():
                break
            k = self.page.find(m[0], m.end()) + 1
        self.known |= dict.fromkeys(passed, end)
        return end if end >= 0 else first + 1 if first >= 0 else -1


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in the order in which they begin.  White space inside one is a single blank; ``br`` counts as white space.

    Time and memory grow with the page's length, however its tags are nested, left open or cut off.
    """
    out: list[tuple[int, Block]] = []
    _read(page, None, out, count())
    return [b for _, b in sorted(out, key=lambda x: x[0])]


def _tokens(name: str, rest: str) -> tuple[str, ...]:
    return (name, *(x.lower() for _, *v in _NAMED.findall(rest) for x in _PART.findall("".join(v))))


def _read(page: str, above: Path | None, out: list[tuple[int, Block]], order: Iterator[int]) -> None:
    """Add the blocks of a page, or of a part that is read apart, with the place where each begins."""
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    find = _Finder(page)
    tags = _Tags(page, find)
    at, links, linked, began = 0, 0, 0, -1

    def path() -> Path | None:
        return stack[-1][1] if stack else above

    def close_block() -> None:
        nonlocal linked, began
        if began >= 0:
            out.append((began, Block(_SPACE.sub(" ", "".join(held)).strip(), path(), linked)))
        held.clear()
        linked, began = 0, -1

    def leave(k: int) -> None:
        close_block()
        opened.subtract(x for x, _ in stack[k:])
        del stack[k:]

    def say(text: str) -> None:
        nonlocal linked, began
        held.append(text)
        linked += len(text) if links else 0
        if began < 0 and text and not text.isspace():
            began = next(order)

    while at < len(page):
        cut = find("<", at)
        stop = cut if cut >= 0 else len(page)
        if stop > at:
            say(html.unescape(page[at:stop]))
        if cut < 0:
            break
        if page.startswith("<!--", cut):
            end = find("-->", cut + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", cut):
            end = find("]]>", cut + 9)
            say(page[cut + 9 : end if end >= 0 else len(page)])
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), cut):
            end = find(">", cut)
            if end < 0:
                say("<")
            at = end + 1 if end >= 0 else cut + 1
            continue
        closing = page.startswith("</", cut)
        named = _NAME.match(page, cut + 1 + closing)
        end = tags.end(named.end()) if named else 0
        if end <= 0:
            say("<")
            at = cut + 1
            continue
        at, name, rest = end, named[0].lower(), page[named.end() : end - 1]
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif opened[name]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name == "p":
                close_block()
            continue
        if name in RAW or name in HIDDEN_PARTS:
            if not rest.endswith("/"):
                start, end = find.end_tag(name, at)
                if name in HIDDEN_PARTS and end >= 0:
                    # Up to the first end tag of its name, so parts of one name are not nested, and others few times.
                    _read(page[at:start], Path(path(), _tokens(name, rest)), out, order)
                at = end if end >= 0 else len(page) if name in RAW else at
            continue
        if name == "a":
            links = 1
        elif name == "br":
            held.append(" ")
        elif name in BLOCK:
            if stack and stack[-1][0] == "p":
                leave(len(stack) - 1)
            closes, k = CLOSES.get(name, ()), len(stack) - 1
            while k >= 0 and any(opened[x] for x in closes):
                if stack[k][0] in closes:
                    leave(k)
                elif stack[k][0] in _SCOPE.get(name, BLOCK):
                    break
                k -= 1
            close_block()
            links = 0
            if name not in VOID:
                stack.append((name, Path(path(), _tokens(name, rest))))
                opened[name] += 1
    close_block()


_hashed: dict[str, int] = {}


def _number(token: str) -> int:
    """A token's CRC-32; recent ones are remembered."""
    if token not in _hashed:
        if len(_hashed) > 200_000:
            _hashed.clear()
        _hashed[token] = crc32(token.encode())
    return _hashed[token]


@dataclass
class Page:
    """What the network reads of a page: rows of the tag table for each part of a path, under the part above it; each block's part; rows of the word table and counts for each block."""

    above: list[int]
    parts: list[list[int]]
    at: list[int]
    depths: np.ndarray
    words: list[np.ndarray]
    counts: np.ndarray

    def tags(self, k: int) -> np.ndarray:
        """Rows of the tag table of the whole path of a block: a mark, every token, and the last of them apart."""
        rows, part = [], self.at[k]
        last = [_last(self.parts[part][-1])] if part >= 0 else []
        while part >= 0:
            rows.append(self.parts[part])
            part = self.above[part]
        return np.array([_MARK, *(x for r in reversed(rows) for x in r), *last])


_MARK = crc32(b"t:") % N_TAGS


def _last(row: int) -> int:
    """The row that stands for a token as the last one of its path."""
    return (row * 0x9E3779B1 + 0x85EBCA6B & 0xFFFFFFFF) >> 21


def encode(found: list[Block]) -> Page:
    """A page's blocks as rows of the tables and counts; every part of a path is looked up once."""
    numbers: dict[int, int] = {}
    page = Page([], [], [], np.array([b.path.depth if b.path else 0 for b in found]), [], np.zeros((len(found), COUNTS)))
    for k, b in enumerate(found):
        new, part = [], b.path
        while part and id(part) not in numbers:
            new.append(part)
            part = part.above
        for part in reversed(new):
            page.above.append(numbers[id(part.above)] if part.above else -1)
            page.parts.append([_number("t:" + x) % N_TAGS for x in part.tokens])
            numbers[id(part)] = len(numbers)
        page.at.append(numbers[id(b.path)] if b.path else -1)
        own = b.text.lower().split()
        page.words.append(np.array([_number(w) for w in own], np.int64) % N_WORDS)
        n = len(b.text)
        page.counts[k] = (
            np.log1p(n) / 8, np.log1p(len(own)) / 6, min(1.0, b.linked / n), b.text[-1] in ".!?:…\"'”’", k / len(found),
            sum(map(b.text.count, ".,;")) / n * 10, page.depths[k] / 20, 1.0,
        )
    return page


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Vector tables, an LSTM in each direction and a logistic output, with their gradients."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = TAG_DIM + WORD_DIM + COUNTS
        self.p = {"tags": rng.normal(0, 0.3, (N_TAGS, TAG_DIM)), "words": rng.normal(0, 0.1, (N_WORDS, WORD_DIM))}
        for way in "fb":
            self.p |= {f"{way}x": rng.normal(0, d**-0.5, (d, 4 * HIDDEN)), f"{way}h": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"{way}b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p |= {"out": rng.normal(0, 0.3, 2 * HIDDEN), "skip": np.zeros(d), "bias": np.zeros(1)}

    def _tag_means(self, page: Page) -> np.ndarray:
        """The mean vector of each block's whole path, as a running sum along the paths."""
        table, at = self.p["tags"], np.array(page.at)
        mean = np.tile(table[_MARK], (len(at), 1))
        if page.parts:
            n = np.array([len(r) for r in page.parts])
            sums = np.add.reduceat(table[np.concatenate(page.parts)], np.cumsum(n) - n, axis=0)
            for k, above in enumerate(page.above):
                if above >= 0:
                    sums[k] += sums[above]
            last = table[[_last(r[-1]) for r in page.parts]]
            mean[at >= 0] += (sums + last)[at[at >= 0]]
        return mean / (page.depths + 1 + (at >= 0))[:, None]

    def _inputs(self, pages: list[Page], learn: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """Input vectors (steps, pages, d), which steps exist, and what the gradient needs of the tables."""
        lengths = np.array([len(p.counts) for p in pages])
        x = np.zeros((lengths.max(), len(pages), TAG_DIM + WORD_DIM + COUNTS))
        at = np.arange(lengths.max())[:, None] < lengths
        step = np.concatenate([np.arange(n) for n in lengths])
        page = np.repeat(np.arange(len(pages)), lengths)
        kept = []
        for name, lo, hi in (("tags", 0, TAG_DIM), ("words", TAG_DIM, TAG_DIM + WORD_DIM)):
            if name == "tags" and not learn:
                x[step, page, lo:hi] = np.concatenate([self._tag_means(p) for p in pages])
                continue
            rows = [p.tags(k) if name == "tags" else p.words[k] for p in pages for k in range(len(p.counts))]
            n = np.array([len(r) for r in rows])
            flat, block = np.concatenate(rows), np.repeat(np.arange(len(rows)), n)
            mean = np.zeros((len(rows), hi - lo))
            some = n > 0
            starts = (np.cumsum(n) - n)[some]
            mean[some] = np.add.reduceat(self.p[name][flat], starts, axis=0) / n[some, None]
            x[step, page, lo:hi] = mean
            kept.append((name, flat, block, n, lo, hi))
        x[step, page, TAG_DIM + WORD_DIM :] = np.concatenate([p.counts for p in pages])
        return x, at, [step, page, kept]

    def _pass(self, way: str, x: np.ndarray, at: np.ndarray, learn: bool = True) -> tuple[np.ndarray, list]:
        """Outputs of one direction and, to learn from, what every step was made of."""
        steps, n, _ = x.shape
        h, c, hs, memory = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((steps, n, HIDDEN)), []
        lo = hi = -1
        full, own, bias, back = at.all(1), self.p[f"{way}x"], self.p[f"{way}b"], self.p[f"{way}h"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            if not lo <= t < hi:
                lo = t // STRETCH * STRETCH
                hi = lo + STRETCH
                given = x[lo:hi] @ own + bias
            z = given[t - lo] + h @ back
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            live = None if full[t] else at[t][:, None]
            new = f * c + i * g if live is None else np.where(live, f * c + i * g, c)
            th = np.tanh(new)
            if learn:
                memory.append((t, h, c, i, f, o, g, th, at[t][:, None]))
            h, c = o * th if live is None else np.where(live, o * th, h), new
            hs[t] = h
        return hs, memory

    def forward(self, pages: list[Page], learn: bool = True) -> tuple[np.ndarray, tuple]:
        x, at, where = self._inputs(pages, learn)
        f, fm = self._pass("f", x, at, learn)
        b, bm = self._pass("b", x, at, learn)
        p = _sigmoid(f @ self.p["out"][:HIDDEN] + b @ self.p["out"][HIDDEN:] + x @ self.p["skip"] + self.p["bias"])
        return p, (x, at, where, f, b, fm, bm)

    def gradient(self, pages: list, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; ``labels`` (steps, pages) are ignored where no step exists."""
        p, (x, at, (step, page, kept), f, b, fm, bm) = self.forward(pages)
        d = (p - labels) * at / at.sum()
        g = {"out": np.concatenate([d.ravel() @ a.reshape(-1, HIDDEN) for a in (f, b)]), "skip": d.ravel() @ x.reshape(-1, x.shape[2]), "bias": d.sum(keepdims=True).ravel()}
        dx = d[..., None] * self.p["skip"]
        for way, memory, out in (("f", fm, self.p["out"][:HIDDEN]), ("b", bm, self.p["out"][HIDDEN:])):
            wh, dz_all = self.p[f"{way}h"], np.zeros((*at.shape, 4 * HIDDEN))
            g[f"{way}h"] = np.zeros_like(wh)
            dh, dc = np.zeros((at.shape[1], HIDDEN)), np.zeros((at.shape[1], HIDDEN))
            for t, h, c, i, fo, o, gg, th, live in reversed(memory):
                dh = dh + d[t][:, None] * out
                dn = (dc + dh * o * (1 - th**2)) * live
                dz = np.concatenate([dn * gg * i * (1 - i), dn * c * fo * (1 - fo), dh * th * o * (1 - o) * live, dn * i * (1 - gg**2)], 1)
                g[f"{way}h"] += h.T @ dz
                dz_all[t] = dz
                dh = np.where(live, dz @ wh.T, dh)
                dc = np.where(live, dn * fo, dc)
            g[f"{way}x"] = x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * HIDDEN)
            g[f"{way}b"] = dz_all.sum((0, 1))
            dx += dz_all @ self.p[f"{way}x"].T
        for name, flat, block, n, lo, hi in kept:
            own = dx[step, page, lo:hi] / np.maximum(n, 1)[:, None]
            g[name] = np.zeros_like(self.p[name])
            order = np.argsort(flat, kind="stable")
            rows, starts = np.unique(flat[order], return_index=True)
            g[name][rows] = np.add.reduceat(own[block][order], starts, axis=0)
        return g

    def predict(self, pages: list) -> list[np.ndarray]:
        """Probabilities of main text for each page's blocks.

        Pages of like length go together, at most 64 and ``CELLS`` steps of all in a pass.
        """
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        size = [len(p.counts) for p in pages]
        order = sorted((k for k in range(len(pages)) if size[k]), key=lambda k: size[k])
        while order:
            n = 1
            while n < min(64, len(order)) and size[order[n]] * (n + 1) <= CELLS:
                n += 1
            part, order = order[:n], order[n:]
            p, _ = self.forward([pages[k] for k in part], learn=False)
            for col, k in enumerate(part):
                out[k] = p[: size[k], col]
        return out


#: Names that sites give to what stands around an article, and to the article.
AROUND = {
    "menu": ("nav", "navbar", "menu", "main-menu", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "links", "tabs"),
    "header": ("header", "site-header", "masthead", "top", "topbar", "banner", "branding", "logo", "tagline"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "foot"),
    "sidebar": ("sidebar", "side", "widget", "widgets", "related", "aside", "recent", "popular", "trending", "more", "tags", "author-box", "recommended", "rail"),
    "notice": ("cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "banner-notice", "newsletter", "popup", "modal", "warning", "paywall"),
    "advert": ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "promotion", "sponsor", "adbox", "adsense"),
    "form": ("form", "search", "login", "signup", "subscribe", "contact-form", "subscription"),
    "share": ("share", "social", "sharing", "share-bar", "follow"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "responses", "comment-body", "disqus", "respond", "reader-comments", "feedback"),
}
INSIDE = ("article", "content", "main", "post", "entry", "entry-content", "post-content", "article-body", "story", "body-text", "text", "main-content", "page-content", "article-content", "blog-post", "post-body", "story-body")
ELEMENT = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section", "advert": "aside", "notice": "div", "share": "div"}
STOCK = {
    "menu": ("Home", "About", "Contact", "News", "Products", "Blog", "Next", "Previous", "Archive", "Sports", "Help", "Login"),
    "header": ("Welcome to our site", "The daily news", "Skip to content", "Your source for news"),
    "footer": ("© 2024 All rights reserved", "Privacy policy", "Terms of use", "Powered by our engine", "Contact us", "Imprint"),
    "sidebar": ("Related articles", "Recent posts", "Popular", "Tags", "You may also like", "About the author", "Read more"),
    "notice": ("We use cookies to improve your experience.", "By using this site you accept our cookie policy.", "Accept all", "Sign up for our newsletter."),
    "advert": ("Advertisement", "Sponsored content", "Buy now and save 20%", "Limited offer", "Click here"),
    "form": ("Your email", "Subscribe", "Search", "Name", "Send", "Password", "Leave this field empty"),
    "share": ("Share this", "Tweet", "Share on Facebook", "Print", "Email this"),
    "part": ("Please enable JavaScript to view this page.", "Your browser does not support this element.", "Choose a language", "English", "Loading", "Submit", "OK", "Play", "Close menu", "Icon"),
    "comments": ("Comments", "Leave a reply", "Great article!", "Thanks for sharing.", "says:", "3 comments", "Reply", "I do not agree with this."),
}


def synthetic_page(rnd: random.Random) -> tuple[str, list[int]]:
    """A made-up page and, for each of its leaf blocks, whether it is main text."""
    syllables = [rnd.choice("bcdfghklmnprstvwz") * rnd.randint(0, 1) + rnd.choice("aeiouéöñ") + rnd.choice(["", "n", "r", "s", "nd", "t"]) for _ in range(40)]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    mark = rnd.choice(["", "", "", "***", "%%%", "!!"])

    def sentence(lo: int = 3, hi: int = 18) -> str:
        text = " ".join(word() + mark for _ in range(rnd.randint(lo, hi))).capitalize()
        return text + rnd.choice([".", ".", ".", "!", "?", ""])

    prose = lambda lo=1, hi=6: " ".join(sentence() for _ in range(rnd.choice([1, rnd.randint(lo, hi)])))
    named = rnd.random() < 0.85
    semantic = rnd.random() < 0.6 or not named
    labels: list[int] = []
    loose = rnd.random() < 0.4

    def attribute(names: tuple[str, ...]) -> str:
        if not named:
            return ""
        return f' {rnd.choice(["class", "class", "id"])}="{rnd.choice(names)}{rnd.choice(["", "", " wide", "-1", " col-8"])}"'

    def leaf(tag: str, text: str, label: int, link: bool = False) -> str:
        labels.append(label)
        body = f'<a href="/{word()}">{text}</a>' if link else text
        style = rnd.random()
        if label and loose and tag == "p" and style < 0.2:
            return f"<p><b>{body}<br>"
        return f"<{tag}>{body}</{tag}>" if style < 0.8 or tag != "p" else f"<p>{body}"

    def part() -> str:
        # Of what stands in elements that are no text flow, now and then prose.
        tag = rnd.choice(sorted(HIDDEN_PARTS))
        labels.append(0)
        text = rnd.choice(STOCK["part"]) if rnd.random() < 0.7 else sentence(1, 12)
        inner = f"<p>{text}</p>" if tag in ("noscript", "template", "iframe") and rnd.random() < 0.5 else text
        return f"<{tag}{attribute(('fallback', 'btn', 'icon', 'picker', 'player'))}>{inner}</{tag}>"

    def main_part() -> str:
        parts = [leaf("h1", sentence(2, 10), 1)] if rnd.random() < 0.85 else []
        for _ in range(rnd.choice([1, 2, 4, 8, 14, 25])):
            kind = rnd.random()
            if kind < 0.82:
                parts.append(leaf("p", prose() if rnd.random() < 0.85 else word().capitalize() + ".", 1))
                if rnd.random() < 0.04:
                    labels.append(1)
                    parts.append(f"<p>{sentence()} {part()} {sentence()}</p>")
            elif kind < 0.88:
                parts.append(leaf("h2", sentence(1, 7), 1))
            elif kind < 0.92:
                parts.append("<ul>" + "".join(leaf("li", sentence(), 1) for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                parts.append("<blockquote>" + leaf("p", prose(), 1) + "</blockquote>")
            else:
                parts.append(around(rnd.choice(["advert", "share", "notice", "sidebar", "form"])) if rnd.random() < 0.8 else part())
        return "".join(parts)

    def around(kind: str) -> str:
        tag = ELEMENT[kind] if semantic and rnd.random() < 0.8 else "div"
        # Without a name only an element of its own tells these from prose.
        name = attribute(AROUND[kind]) or (' class="ad"' if kind in ("advert", "notice") and tag == "div" else "")
        say = lambda: rnd.choice(STOCK[kind]) if rnd.random() < 0.5 else sentence(1, 4)
        if kind == "menu":
            inner = "<ul>" + "".join(leaf("li", say() if rnd.random() < 0.5 else word(), 0, True) for _ in range(rnd.randint(3, 9))) + "</ul>"
        elif kind == "comments":
            inner = "".join(f'<div{attribute(("comment", "comment-body", "reply"))}>' + leaf("p", prose() if rnd.random() < 0.7 else say(), 0) + "</div>" for _ in range(rnd.randint(1, 6)))
            inner = (leaf("h3", rnd.choice(STOCK[kind]), 0) if rnd.random() < 0.7 else "") + inner
        elif kind == "sidebar":
            inner = leaf("h3", say(), 0) + "<ul>" + "".join(leaf("li", sentence(2, 9), 0, rnd.random() < 0.8) for _ in range(rnd.randint(1, 6))) + "</ul>"
            if rnd.random() < 0.4:
                inner += leaf("p", prose(1, 3), 0)
        elif kind in ("advert", "notice", "footer", "header"):
            if rnd.random() < 0.5:
                labels.append(0)
                inner = rnd.choice(["", "&copy; " if kind == "footer" else ""]) + (prose(1, 2) if rnd.random() < 0.7 else say())
            else:
                inner = "".join(leaf(rnd.choice(["p", "p", "div"]), prose(1, 2) if rnd.random() < 0.6 else say(), 0, rnd.random() < 0.3) for _ in range(rnd.randint(1, 3)))
        else:
            inner = "".join(leaf(rnd.choice(["p", "div", "li"]), say(), 0, kind == "share") for _ in range(rnd.randint(1, 4)))
        return f"<{tag}{name}>{inner}</{tag}>"

    html_parts = []
    if rnd.random() < 0.6:
        html_parts.append(around("header"))
    for kind in rnd.sample(["menu", "menu", "advert", "notice", "form", "share", "sidebar"], rnd.randint(1, 4)):
        html_parts.append(around(kind))
    if rnd.random() < 0.3:
        html_parts.append(part())
    if semantic:
        tag = rnd.choice(["article", "article", "article", "main", "section"])
    else:
        tag = "div"
    # Half of the articles stand inside further containers.
    name = attribute(INSIDE) if tag in ("div", "section") or rnd.random() < 0.5 else ""
    outer = rnd.random() < 0.5
    body = f"<{tag}{name}>" + main_part()
    if rnd.random() < 0.15:
        body += around("comments")
    body += f"</{tag}>"
    # Some articles stand in what browsers show without scripts.
    shell = rnd.choice(["noscript", "template"]) if rnd.random() < 0.06 else ""
    if shell and f"</{shell}" not in body:
        body = f"<{shell}>{body}</{shell}>"
    html_parts.append((f"<div{attribute(('container', 'wrapper', 'page', 'row', 'site'))}>" if outer else "") + body)
    if rnd.random() < 0.3:
        html_parts.append(part())
    for kind in rnd.sample(["comments", "comments", "comments", "share", "sidebar", "advert", "form", "notice", "menu"], rnd.randint(0, 4)):
        html_parts.append(around(kind))
    html_parts.append("</div>" if outer else "")
    if rnd.random() < 0.9:
        html_parts.append(around("footer"))
    return f"<!DOCTYPE html><html><head><title>{sentence()}</title></head><body>{''.join(html_parts)}</body></html>", labels


@lru_cache(2)
def trained(pages: int = 3000, rounds: int = 5, seed: int = 5, batch: int = 30, rate: float = 0.01) -> Network:
    """A network fitted by Adam to made-up pages; once per process."""
    rnd, net = random.Random(seed), Network(seed)
    made = []
    while len(made) < pages:
        page, labels = synthetic_page(rnd)
        found = blocks(page)
        if len(found) == len(labels):
            made.append((encode(found), np.array(labels, float)))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    k = 0
    for turn in range(rounds):
        order = sorted(range(pages), key=lambda n: (len(made[n][1]) // 6, rnd.random()))
        parts = [order[n : n + batch] for n in range(0, pages, batch)]
        rnd.shuffle(parts)
        for part in parts:
            k += 1
            own = [made[n][0] for n in part]
            labels = np.zeros((max(len(made[n][1]) for n in part), len(part)))
            for col, n in enumerate(part):
                labels[: len(made[n][1]), col] = made[n][1]
            step = rate * (1 - turn / (rounds + 1))
            for name, g in net.gradient(own, labels).items():
                m, v = state[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[name] -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return net


def main_text(net: Network, pages: list[str], threshold: float = 0.5) -> list[str]:
    """Main text of each page: its accepted blocks in page order, joined by one line feed."""
    found = [blocks(p) for p in pages]
    kept = net.predict([encode(b) for b in found])
    return ["\n".join(b.text for b, p in zip(bs, ps) if p >= threshold) for bs, ps in zip(found, kept)]


def extracted(pages: DataFrame, html_col: str = "html", out: str = "main") -> DataFrame:
    """All columns of ``pages`` and ``out``, the main text (empty if none), in place of a column of that name.

    Null and empty pages have no text; a page without markup is one block; unclosed and stray tags,
    comments and cut-off pages are read as browsers do, near enough.  Repeated rows repeat.
    """
    small_batches(pages.sparkSession)
    net = pages.sparkSession.sparkContext.broadcast(trained())
    names = [f"_{k}" for k in range(len(pages.columns))]
    own = dict(zip(pages.columns, names))
    rows = pages.toDF(*names)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = list(s)
            yield pd.Series([x for part in portions(texts, 256) for x in main_text(net.value, part)], dtype=object)

    done = rows.withColumn("main", run(F.coalesce(F.col(own[html_col]).cast("string"), F.lit(""))))
    return done.select(*[F.col(own[c]).alias(c) for c in others(pages.columns, out)], F.col("main").alias(out))
