"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each
with the tags and class words on its path.  A bidirectional LSTM in numpy reads
the sequence of a page's blocks (hashed path, hashed words, a few sizes) and
labels every block as main text or not, in the context of the whole page.

The labeller is trained here.  Its training pages are a bounded sample of the
given pages, whose blocks are labelled by what semantic tags say about them,
and pages composed from the sample's blocks in random layouts (other wrappers,
class names, sidebars, notices, forms, adverts and comments inside and outside
the article), whose labels are known by construction.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, tmp

#: Bounds of the training sample: pages, their size in characters, blocks of each label that pages are composed of; composed pages.
MAX_PAGES = 200
MAX_CHARS = 200_000
MAX_BLOCKS = 5000
COMPOSED = 1000
#: Blocks of a page that are labelled in one matrix; longer pages go chunk by chunk.
LONG = 20_000
EPOCHS = 8
HIDDEN = 24
PATH_DIM, WORD_DIM, SIZES = 128, 32, 6
SEED = 10

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option
p pre section select summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style title textarea noscript template iframe svg math xmp noembed noframes object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the value that is not further up than its parent list or table.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table menu dir select".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    """An open element: its tag, class words and parent, and what its path says (``_weak``)."""

    __slots__ = ("depth", "inside", "names", "parent", "said", "tag", "vector")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None) -> None:
        self.tag, self.names, self.parent, self.vector = tag, names, parent, None
        self.depth = parent.depth + 1 if parent else 1
        self.inside, self.said = (parent.inside, parent.said) if parent else (False, None)
        for w in (tag, *names):
            if w in _ON:
                self.inside, self.said = self.inside or w in ("article", "main"), 1
            elif w in _OFF and not (w == "header" and self.inside):
                self.said = 0


@dataclass
class Block:
    element: Element | None
    vector: np.ndarray  #: how many distinct words of the path fall into each bucket
    text: str
    linked: int = 0  #: characters inside links

    @property
    def path(self) -> list[str]:
        out: list[str] = []
        e = self.element
        while e is not None:
            out += [*reversed(e.names), e.tag]
            e = e.parent
        return out[::-1]


class _Open:
    """The open elements, with the places of each tag, of blocks and of lists and
    tables, and the hashed words of the path: pushing, popping and finding take constant time."""

    def __init__(self) -> None:
        self.top: Element | None = None
        self.items: list[Element] = []
        self.at: dict[str, list[int]] = {}
        self.block_at: list[int] = []
        self.scope_at: list[int] = []
        self.words: dict[str, int] = {}
        self.vector = np.zeros(PATH_DIM, np.int64)

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.top = Element(tag, names, self.top)
        k = len(self.items)
        self.items.append(self.top)
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCK:
            self.block_at.append(k)
        if tag in _SCOPE:
            self.scope_at.append(k)
        for w in (tag, *names):
            n = self.words.get(w, 0)
            self.words[w] = n + 1
            if not n:
                self.vector[_bucket(w, PATH_DIM)] += 1

    def pop(self) -> Element:
        e = self.items.pop()
        self.at[e.tag].pop()
        if e.tag in BLOCK:
            self.block_at.pop()
        if e.tag in _SCOPE:
            self.scope_at.pop()
        for w in (e.tag, *e.names):
            self.words[w] -= 1
            if not self.words[w]:
                del self.words[w]
                self.vector[_bucket(w, PATH_DIM)] -= 1
        self.top = e.parent
        return e

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def path_vector(self) -> np.ndarray:
        if self.top is None:
            return np.zeros(PATH_DIM, np.uint8)
        if self.top.vector is None:
            self.top.vector = np.minimum(self.vector, 255).astype(np.uint8)
        return self.top.vector


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page, in order; text is decoded and its
    white space folded.  Takes time in proportion to the page, however deep it nests."""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    place: tuple[Element | None, np.ndarray] | None = None
    linked = links = 0

    def flush() -> None:
        nonlocal place, linked
        if place is not None:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(*place, text, linked))
        parts.clear()
        place, linked = None, 0

    def pop_to(k: int) -> None:
        nonlocal links
        while len(opened.items) > k:
            if opened.pop().tag == "a":
                links = max(0, links - 1)

    def add(text: str) -> None:
        nonlocal place, linked
        if place is None:
            if text.isspace():
                return
            place = (opened.top, opened.path_vector())
        parts.append(text)
        if links:
            linked += len(text)

    page, at = page or "", 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                add(m[0])
            elif m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name, attrs = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:  # end tag
            if name in BLOCK:
                flush()
            elif name == "br":
                add(" ")
            k = opened.last((name,))
            # an inline end tag does not close blocks
            if k >= 0 and (name in BLOCK or not opened.block_at or opened.block_at[-1] < k):
                pop_to(k)
            continue
        if name in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            k = opened.last(("p",))
            if k >= 0 and opened.block_at[-1] == k:
                pop_to(k)  # a block ends an open paragraph
            while name in CLOSES:
                k = opened.last(CLOSES[name])
                if k < 0 or (opened.scope_at and opened.scope_at[-1] > k):
                    break
                pop_to(k)
                if name != "tr":
                    break
        if name in VOID:
            if name in ("br", "wbr", "hr"):
                add(" " if name != "wbr" else "")
            continue
        names = [w.lower() for g in _NAMES.findall(attrs) for w in _SPLIT.findall("".join(g))] if attrs else []
        opened.push(name, tuple("." + w for w in names))
        links += name == "a"
    flush()
    return out


@functools.lru_cache(50_000)
def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % n


def vectors(page: list[Block]) -> np.ndarray:
    """The labeller's input, a row per block, from the whole path and all words."""
    x = np.zeros((len(page), PATH_DIM + WORD_DIM + SIZES), np.float32)
    for row, b in zip(x, page, strict=True):
        row[:PATH_DIM] = b.vector
        row[_bucket("last " + (b.element.tag if b.element else ""), PATH_DIM)] += 1
        hits = [_bucket(w, WORD_DIM) for w in b.text.lower().split()]
        row[PATH_DIM:PATH_DIM + WORD_DIM] = np.log1p(np.bincount(hits, minlength=WORD_DIM)) / 4
        n = len(b.text)
        row[-SIZES:] = (np.log1p(n) / 6, min(1.0, b.linked / n), sum(map(b.text.count, ".,;:!?")) * 10 / (n + 20),
                        (b.element.depth if b.element else 0) / 8, b.text[-1:] in ".!?", "©" in b.text)
    return x


@dataclass
class Labeller:
    """Forward and backward LSTM of HIDDEN cells each, and a logistic output."""
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, dim: int, rng: np.random.Generator) -> Labeller:
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 1 / np.sqrt(dim), (dim, 4 * HIDDEN))
            w["h" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            w["c" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        w["o"], w["k"] = rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None,
             state: list[np.ndarray] | None = None) -> np.ndarray:
        """x [time, pages, dim] in reading order; cells outside a page's mask stay.
        ``state`` holds (h, c) to go on from and is left at those of the end."""
        z = x @ self.w["x" + d] + self.w["c" + d]
        h, c = state or [np.zeros((x.shape[1], HIDDEN), np.float32)] * 2
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            a = z[t] + h @ self.w["h" + d]
            s = 1 / (1 + np.exp(-np.clip(a[:, :3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            g = np.tanh(a[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            y = np.tanh(c2)
            h2 = m * (o * y) + (1 - m) * h
            if keep is not None:
                keep.append((i, f, o, g, c, y, h))
            h, c = h2, c2
            out[t] = h
        if state is not None:
            state[:] = [h, c]
        return out

    def odds(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple:
        f = self._run("f", x, mask, keep and keep[0])
        b = self._run("b", x[::-1], mask[::-1], keep and keep[1])[::-1]
        y = np.concatenate([f, b], axis=2)
        return y @ self.w["o"] + self.w["k"][0], y

    def long_odds(self, page: list[Block], chunk: int = 0) -> np.ndarray:
        """``odds`` of one page of any length, its input made a chunk at a time, forward and then backward."""
        chunk = chunk or LONG
        z = np.full(len(page), self.w["k"][0])
        cuts = range(0, len(page), chunk)
        for d, starts, o in (("f", cuts, self.w["o"][:HIDDEN]), ("b", reversed(cuts), self.w["o"][HIDDEN:])):
            state = [np.zeros((1, HIDDEN), np.float32)] * 2
            for k in starts:
                x = vectors(page[k:k + chunk])[:, None]
                ones = np.ones(x.shape[:2], np.float32)
                if d == "f":
                    z[k:k + chunk] += self._run(d, x, ones, state=state)[:, 0] @ o
                else:
                    z[k:k + chunk] += (self._run(d, x[::-1], ones, state=state)[:, 0] @ o)[::-1]
        return z

    def gradient(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        keep: tuple[list, list] = ([], [])
        z, y = self.odds(x, mask, keep)
        e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * mask / mask.sum()).astype(np.float32)
        g = {"o": np.einsum("tp,tph->h", e, y), "k": np.array([e.sum()], np.float32)}
        dy = e[:, :, None] * self.w["o"]
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            xs, ms, ds = (x, mask, dy[:, :, part]) if d == "f" else (x[::-1], mask[::-1], dy[::-1, :, part])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc, da = dh.copy(), np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
            hs = np.empty((*x.shape[:2], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1):
                i, f, o, gg, c, th, h = keep["fb".index(d)][t]
                m = ms[t][:, None]
                dh = dh + ds[t]
                do = dh * m * th
                dc2 = dc + dh * m * o * (1 - th * th)
                on = dc2 * m
                da[t] = np.concatenate([on * gg * i * (1 - i), on * c * f * (1 - f), do * o * (1 - o),
                                        on * i * (1 - gg * gg)], axis=1)
                dc = on * f + dc2 * (1 - m)
                dh = da[t] @ self.w["h" + d].T + dh * (1 - m)
                hs[t] = h
            g["x" + d] = np.einsum("tpd,tpk->dk", xs, da, optimize=True)
            g["h" + d] = np.einsum("tph,tpk->hk", hs, da, optimize=True)
            g["c" + d] = da.sum(axis=(0, 1))
        return g

    def labels(self, pages: list[list[Block]], group: int = 64) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])  # so few pages at a time that the group's cells are bounded
            if longest > LONG:
                k = order.pop()
                out[k] = self.long_odds(pages[k]) >= 0
                continue
            n = max(1, min(group, 10 * LONG // longest))
            mine, order = order[-n:], order[:-n]
            x, mask = _pad([vectors(pages[k]) for k in mine])
            z, _ = self.odds(x, mask)
            for j, k in enumerate(mine):
                out[k] = z[:len(pages[k]), j] >= 0
        return out


def _pad(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, xs)), len(xs), xs[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, a in enumerate(xs):
        x[:len(a), k], mask[:len(a), k] = a, 1
    return x, mask


#: What semantic tags and class words say about a block: the training labels of given pages.
_OFF = frozenset("""nav footer aside form header menu .ad .ads .advert .advertisement .banner .nav .navbar .navigation
.menu .footer .header .sidebar .comment .comments .cookie .notice .consent .related .share .social .promo .sponsor
.sponsored .newsletter .subscribe .popup .modal .breadcrumb .breadcrumbs .copyright .legal""".split())
_ON = frozenset("article main .article .content .post .entry .story .main".split())


def _weak(b: Block) -> int | None:
    """1, 0 or None (nothing said); the innermost hint counts, and an article's own header is part of it."""
    return b.element.said if b.element else None


_OPEN = ["<article>", "<article class=\"{on}\">", "<main>", "<main id=\"{on}\">", "<div class=\"{on}\">",
         "<div id=\"{on}\">", "<section class=\"{on}\">", "<main><article>", "<div id=\"main\"><article class=\"{on}\">",
         "<div class=\"container\"><div class=\"{on}\">", "<main><div class=\"{on}\">", "<div id=\"wrapper\"><article>"]
_ON_NAMES = ["content", "main-content", "article-body", "post", "post-content", "entry-content", "story", "articleBody",
             "story-body", "main", "article", "text", "post-body", "page-content"]
_OFF_KINDS = {
    "menu": ["<nav>{l}</nav>", "<ul class=\"menu\">{l}</ul>", "<div id=\"nav\">{l}</div>", "<div class=\"navbar\">{l}</div>",
             "<nav class=\"breadcrumbs\">{l}</nav>", "<div role=\"navigation\">{l}</div>", "<div class=\"main-menu\">{l}</div>",
             "<div class=\"navigation\">{l}</div>", "<ul id=\"topmenu\">{l}</ul>", "<menu>{l}</menu>"],
    "header": ["<header>{t}</header>", "<div class=\"header\">{t}</div>", "<div id=\"site-header\">{t}</div>",
               "<header class=\"masthead\">{h}</header>", "<div class=\"top-bar\">{t}</div>", "<div id=\"banner\">{h}</div>",
               "<header><h1>{s}</h1><p>{s}</p></header>", "<div class=\"page-header\">{h}</div>"],
    "footer": ["<footer>{s}</footer>", "<footer><p>{s}</p><p>&copy; {s}</p></footer>", "<div class=\"footer\">{t}</div>",
               "<div id=\"footer\"><p>{s}</p></div>", "<div class=\"copyright\">&copy; {s}</div>",
               "<div class=\"site-footer\">{l}{t}</div>", "<div class=\"legal\">{t}</div>"],
    "side": ["<aside>{t}</aside>", "<div class=\"sidebar\">{l}</div>", "<div id=\"sidebar\"><h3>{s}</h3>{t}</div>",
             "<aside class=\"related\"><h2>{s}</h2>{l}</aside>", "<div class=\"related-posts\">{l}</div>",
             "<div class=\"widget\">{t}</div>", "<section class=\"recommended\">{h}{l}</section>",
             "<div id=\"right-column\">{t}</div>", "<div class=\"trending\">{l}</div>", "<div class=\"tags\">{l}</div>"],
    "notice": ["<div class=\"cookie-notice\">{t}</div>", "<div class=\"notice\">{s}</div>", "<div id=\"cookie-banner\">{s}</div>",
               "<div class=\"consent\"><p>{s}</p><button>{w}</button></div>", "<div class=\"alert\">{s}</div>",
               "<dialog><p>{s}</p></dialog>", "<div class=\"popup\">{t}</div>", "<div class=\"gdpr\">{s}</div>",
               "<div role=\"alert\">{t}</div>", "<div class=\"paywall-notice\">{t}</div>"],
    "advert": ["<div class=\"ad\">{s}</div>", "<div class=\"advert\">{t}</div>", "<div class=\"ads\"><p>{s}</p></div>",
               "<div id=\"ad-slot\">{s}</div>", "<div class=\"sponsored\">{t}</div>", "<div class=\"promo\">{s}</div>",
               "<section class=\"advertisement\">{t}</section>", "<p class=\"ad\">{s}</p>", "<div class=\"banner-ad\">{s}</div>",
               "<aside class=\"ad\">{t}</aside>"],
    "form": ["<form><label>{s}</label><input><button>{w}</button></form>", "<form class=\"search\">{s}</form>",
             "<form class=\"newsletter\"><p>{s}</p><input></form>", "<form><p>{s}</p><select><option>{w}<option>{w}</select></form>",
             "<div class=\"newsletter\"><h3>{s}</h3><p>{s}</p></div>", "<form id=\"subscribe\"><fieldset><legend>{w}</legend>{t}</fieldset></form>"],
    "comments": ["<section class=\"comments\"><h2>{s}</h2>{c}</section>", "<div id=\"comments\">{c}</div>",
                 "<div class=\"comment-list\">{c}{c}</div>", "<ol class=\"commentlist\"><li>{s}</li><li>{s}</li></ol>",
                 "<div class=\"reader-comments\"><h3>{w}</h3>{c}</div>", "<div class=\"comment\"><p>{p}</p></div>",
                 "<section id=\"discussion\">{c}</section>", "<div class=\"replies\">{c}</div>", "<div class=\"responses\">{c}</div>"],
    "share": ["<div class=\"share\">{l}</div>", "<ul class=\"social\">{l}</ul>", "<div class=\"share-buttons\">{w} {w}</div>"],
}


def compose(rng: np.random.Generator, main: list[str], other: list[str]) -> tuple[str, list[str]]:
    """A page in a random layout, and the texts of its main blocks."""
    def short() -> str:
        s = other[rng.integers(len(other))] if other and rng.random() < 0.7 else main[rng.integers(len(main))]
        words = s.split()
        k = rng.integers(0, len(words))
        return " ".join(words[k:k + rng.integers(1, 14)])

    def fill(t: str) -> str:
        while (m := re.search(r"\{(\w)\}", t)):
            kind = m[1]
            if kind == "s":
                new = entities.escape(short())
            elif kind == "w":
                new = entities.escape(short().split()[0])
            elif kind == "p":
                new = entities.escape(main[rng.integers(len(main))])
            elif kind == "h":
                new = f"<h{rng.integers(1, 5)}>" + entities.escape(short()) + "</h2>"
            elif kind == "t":
                new = "".join("<p>" + entities.escape(short()) + "</p>" for _ in range(rng.integers(1, 4)))
            elif kind == "l":
                items = ["<a href=\"/x\">" + entities.escape(short()) + "</a>" for _ in range(rng.integers(2, 7))]
                new = " | ".join(items) if rng.random() < 0.2 else "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
            else:
                new = "".join("<div class=\"comment\"><b>" + entities.escape(short().split()[0]) + "</b><p>" + entities.escape(
                    main[rng.integers(len(main))] if rng.random() < 0.5 else short()) + "</p></div>"
                    for _ in range(rng.integers(1, 4)))
            t = t[:m.start()] + new + t[m.end():]
        return t

    def extra(*kinds: str) -> str:
        kind = kinds[rng.integers(len(kinds))]
        return fill(_OFF_KINDS[kind][rng.integers(len(_OFF_KINDS[kind]))])

    body, wanted = [], []
    for _ in range(rng.integers(1, 10)):
        text = main[rng.integers(len(main))]
        if rng.random() < 0.25:
            text = " ".join(text.split()[:rng.integers(1, 12)])
        r = rng.random()
        e = entities.escape(text)
        tag = "p" if r < 0.7 else "h2" if r < 0.78 else "div" if r < 0.84 else "blockquote" if r < 0.9 else "li"
        body.append(f"<ul><li>{e}</li></ul>" if tag == "li" else f"<{tag}>{e}" + ("" if tag == "p" and r < 0.1 else f"</{tag}>"))
        wanted.append(" ".join(text.split()))
        if rng.random() < 0.12:
            body.append(extra("advert", "notice", "form", "side", "share"))
    opened = _OPEN[rng.integers(len(_OPEN))].replace("{on}", _ON_NAMES[rng.integers(len(_ON_NAMES))])
    closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))
    if rng.random() < 0.8:
        title = short()
        head = f"<h1>{entities.escape(title)}</h1>"
        body.insert(0, f"<header>{head}</header>" if rng.random() < 0.15 and "<article" in opened else head)
        wanted.insert(0, title)
    tail = extra("comments") if rng.random() < 0.3 else ""
    inner = "".join(body)
    page = [extra("notice", "advert", "header", "menu", "form") for _ in range(rng.integers(0, 4))]
    page.append(opened + inner + (tail if rng.random() < 0.5 else "") + closing)
    page += [extra("comments", "side", "footer", "share", "notice", "form", "advert") for _ in range(rng.integers(0, 4))]
    if rng.random() < 0.15:  # a sidebar that comes first
        page.insert(0, extra("side"))
    return "<html><body>" + "".join(page) + ("</body></html>" if rng.random() < 0.8 else ""), wanted


def _marked(page: str, wanted: list[str]) -> tuple[list[Block], list[int]]:
    """Blocks of a composed page with their labels: wanted texts occur in order, inside the main element."""
    found, at = blocks(page), 0
    labels = []
    for b in found:
        hit = at < len(wanted) and b.text == wanted[at] and not (set(b.path) & _OFF_TAGS)
        labels.append(int(hit))
        at += hit
    return found, labels


_OFF_TAGS = frozenset("nav footer aside form menu dialog .comment .comments .ad".split())


def fit(sample: list[str | None], composed: int = COMPOSED, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Train on given pages (weak labels) and on pages composed of their blocks."""
    rng = np.random.default_rng(seed)
    data: list[tuple[np.ndarray, np.ndarray]] = []
    main, other = [], []
    for page in sample:
        found = blocks(page)
        said = [_weak(b) for b in found]
        for b, y in zip(found, said, strict=True):
            if y is not None and len(main if y else other) < MAX_BLOCKS:
                (main if y else other).append(b.text)
        if found and all(y is not None for y in said):
            data.append((vectors(found), np.array(said, np.float32)))
    main = main or ["A sentence of an article that says something, and then some more of it."]
    while len(data) < len(sample) + composed:
        page, wanted = compose(rng, main, other)
        found, y = _marked(page, wanted)
        if sum(y) == len(wanted):
            data.append((vectors(found), np.array(y, np.float32)))
        else:
            composed -= 1  # a text that came out otherwise, such as markup in it
    model = Labeller.new(PATH_DIM + WORD_DIM + SIZES, rng)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, batch = 0, 16
    total = epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][0]) // 4)
        groups = [order[k:k + batch] for k in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            x, mask = _pad([data[k][0] for k in groups[g]])
            y, _ = _pad([data[k][1][:, None] for k in groups[g]])
            step += 1
            rate = 0.01 * (1 - 0.9 * step / (total + 1))
            for k, d in model.gradient(x, mask, y[:, :, 0]).items():
                d = np.clip(d, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                model.w[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)
                               ).astype(np.float32)
    return model


def train(pages: DataFrame, html: str = "html", key: str = "page_id", max_pages: int = MAX_PAGES) -> Labeller:
    """``fit`` on at most ``max_pages`` pages (by expectation), drawn by the hash of their key and html."""
    n = pages.count()
    drawn = F.pmod(F.xxhash64(F.lit(SEED), column(pages, key)), F.lit(1 << 30))
    share = min(1.0, max_pages / max(1, n))
    d = pages.where(drawn < int(share * (1 << 30))).select(column(pages, html).alias("html"))
    d = d.where(F.coalesce(F.length("html"), F.lit(0)) <= MAX_CHARS)
    return fit(sorted(r.html for r in d.limit(4 * max_pages).collect() if r.html))


def extract(pages: DataFrame, model: Labeller, html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` plus ``text`` (main blocks in page
    order, joined by two line feeds; empty if none) and ``n_chars``.

    Null and empty pages have an empty text.  Whole pages are read.  Input
    columns of these names are replaced.
    """
    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            out: list[str] = []
            found: list[list[Block]] = []

            def done(found: list[list[Block]], out: list[str]) -> None:
                for b, y in zip(found, model.labels(found), strict=True):
                    out.append("\n\n".join(x.text for x, on in zip(b, y, strict=True) if on))
                found.clear()

            for p in a:  # one page at a time leaves the Arrow batch
                found.append(blocks(p.as_py()))
                if len(found) >= 64 or sum(map(len, found)) >= LONG:
                    done(found, out)
            done(found, out)
            yield pa.array(out, pa.string())

    t = tmp("text")
    d = pages.select(*[column(pages, c) for c in pages.columns if c not in ("text", "n_chars")],
                     of(column(pages, html)).alias(t))
    return d.select(*[column(d, c) for c in d.columns if c != t], F.col(t).alias("text"),
                    F.length(t).cast("long").alias("n_chars"))
