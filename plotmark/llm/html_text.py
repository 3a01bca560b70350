"""Main text of HTML pages: a recurrent block labeller. A bidirectional LSTM in numpy reads the tag path and the hashed
words of a page's blocks in order and decides for every block whether it is part of the article."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmark.llm.common import thinned

PATH_DIM, WORD_DIM, MORE = 64, 48, 8  # hashed tag path, hashed words, plain numbers
HIDDEN = 20  # of each direction
SAMPLE = 240  # pages that the fit sees at most
WINDOW = 120  # blocks in a row, from anywhere in such a page, that it sees at most
GENERATED = 160  # pages of made-up words that it sees where no page marks its article
EPOCHS, RATE, BATCH = 8, 0.01, 32
ROWS, BYTES = 500, 8_000_000  # pages that a task reads together
CELLS = 60_000  # blocks, with padding, that are labelled together

#: Elements that HTML lays out inside a line, and elements without content or end.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text, those among them that may close themselves, and those that run to the end of the page.
OPAQUE = frozenset("script style noscript template svg math iframe object canvas".split())
FOREIGN = frozenset("svg math".split())
RAW = frozenset("script style".split())
#: Elements that end an open one of the same kind when they begin.
ENDS_OWN = frozenset("p li dt dd tr td th option".split())

_OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Open:
    """An open element: its name and the words of its class, id and role, inside its parent. Depth and hashed path are
    those of its chain without inline elements, computed once, so that deep pages cost no more than flat ones."""

    __slots__ = ("element", "parent", "inline", "linked", "depth", "block", "above", "_hashed")

    def __init__(self, element: tuple[str, ...], parent: Open | None) -> None:
        self.element, self.parent, self.inline = element, parent, element[0] in INLINE
        self.linked = element[0] == "a" or (parent is not None and parent.linked)
        self.depth = (parent.depth if parent else 0) + (not self.inline)
        self.above: Open | None = parent.block if parent else None  # the nearest element around it that is not inline
        self.block: Open | None = self.above if self.inline else self
        self._hashed: np.ndarray | None = None

    def hashed(self) -> np.ndarray:
        chain, x = [], self
        while x is not None and x._hashed is None:
            chain.append(x)
            x = x.parent
        for own in reversed(chain):
            total = own.parent._hashed if own.parent else np.zeros(PATH_DIM, dtype=np.float32)
            if not own.inline:
                total = total.copy()
                for i, word in enumerate(own.element):
                    at, sign = _slot(("name " if i else "tag ") + word, PATH_DIM)
                    total[at] += sign
            own._hashed = total
        return self._hashed


def opened(path: tuple[tuple[str, ...], ...]) -> Open | None:
    """The innermost element of a path from the outermost on."""
    at = None
    for element in path:
        at = Open(element, at)
    return at


def parsed(blocks: list[tuple[tuple[tuple[str, ...], ...], str, int]]) -> list[Block]:
    """Blocks of (path, text, linked) whose neighbours share the elements that their paths begin with, but for the innermost. An element
    is one tuple: equal tuples that are not the same object are two elements."""
    out: list[Block] = []
    chain: list[Open] = []
    for path, text, linked in blocks:
        same = 0
        while same < min(len(chain) - 1, len(path) - 1) and chain[same].element is path[same]:
            same += 1
        del chain[same:]
        for element in path[same:]:
            chain.append(Open(element, chain[-1] if chain else None))
        out.append(Block(text, chain[-1], linked))
    return out


@dataclass
class Block:
    """A run of text between block elements: its whole text, the element that it is in and how many of its characters are
    in links."""

    text: str
    within: Open | None
    linked: int

    @property
    def path(self) -> tuple[tuple[str, ...], ...]:
        """Element and names of each open element that is not inline, from the outermost on."""
        out, x = [], self.within
        while x is not None:
            if not x.inline:
                out.append(x.element)
            x = x.parent
        return tuple(reversed(out))


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order, with character references decoded and white space as single spaces.

    The time is linear in the page's length, whatever it holds. A tag runs to its ``>`` outside quotes; where quotes never
    close, they count for nothing from there on. A comment, declaration or tag without an end is no text, nor what
    follows; the same holds for scripts and styles, while other elements without text that have no end are skipped
    alone.
    """
    out: list[Block] = []
    top: Open | None = None
    count: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    endless: set[str] = set()
    quotes = True
    start = 0

    def flush() -> None:
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            out.append(Block(text, top, sum(len(p.strip()) for p, link in parts if link)))
        parts.clear()

    def take(raw: str) -> None:
        if raw:
            parts.append((html.unescape(raw), top is not None and top.linked))

    page = page or ""
    while m := _OPENS.search(page, start):
        take(page[start : m.start()])
        name = (m[4] or "").lower()
        if m[1]:
            end = page.find("-->", m.end())
            start = end + 3 if end >= 0 else len(page)
            continue
        rest = _REST.match(page, m.end()) if name and quotes else None
        if rest:
            start = rest.end()
        else:
            quotes = quotes and not name
            end = page.find(">", m.end())
            start = end + 1 if end >= 0 else len(page)
            if end < 0:
                break
        if not name:
            continue
        held = page[m.end() : start - 1]
        if name in OPAQUE and not m[3]:
            if name in FOREIGN and held.endswith("/") or name in endless:
                continue
            if end := re.compile(rf"</{name}\s*>", re.I).search(page, start):
                start = end.end()
            elif name in RAW:
                start = len(page)
            else:
                endless.add(name)
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name not in INLINE:
            flush()
        if m[3]:
            while count.get(name):
                count[top.element[0]] -= 1
                done, top = top.element[0] == name, top.parent
                if done:
                    break
        elif name not in VOID and not held.rstrip().endswith("/"):
            if name in ENDS_OWN:
                own, over = top, []
                while own is not None and own.inline:
                    over.append(own)
                    own = own.parent
                if own is not None and own.element[0] == name:
                    for x in (*over, own):
                        count[x.element[0]] -= 1
                    top = own.parent
            names = [w.lower() for g in _NAMED.findall(held) for w in re.split(r"[\s_-]+", "".join(g[1:])) if w]
            top = Open((name, *names), top)
            count[name] = count.get(name, 0) + 1
    take(page[start:])
    flush()
    return out


@lru_cache(maxsize=200_000)
def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return (h >> 1) % size, 1.0 if h & 1 else -1.0


def _moves(a: Open | None, b: Open | None) -> tuple[int, int]:
    """How many elements end and begin between two blocks; what all blocks of a page cost is linear in its elements."""
    ended = begun = 0
    while a is not b:
        x, y = a.depth if a else 0, b.depth if b else 0
        if x >= y:
            a, ended = a.above if a else None, ended + 1
        if y >= x:
            b, begun = b.above if b else None, begun + 1
    return ended, begun


def features(blocks: list[Block]) -> np.ndarray:
    """A row a block: its hashed tag path and words, its length, links and depth, how many elements end and begin before it, and the
    words and links of all blocks with the same element around them."""
    around: dict[int, list[int]] = {}
    block = [b.within.block if b.within else None for b in blocks]
    holders = [around.setdefault(id(o.above if o else None), [0, 0, 0]) for o in block]
    for held, b in zip(holders, blocks, strict=True):
        held[0] += len(b.text.split())
        held[1] += b.linked
        held[2] += len(b.text)
    last = None
    x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + MORE), dtype=np.float32)
    for row, b, own_block, held in zip(x, blocks, block, holders, strict=True):
        if b.within is not None:
            row[:PATH_DIM] = b.within.hashed()
        words = b.text.lower().split()
        for w in words:
            at, sign = _slot(w, WORD_DIM)
            row[PATH_DIM + at] += sign
        own = row[PATH_DIM : PATH_DIM + WORD_DIM]
        own /= max(1.0, float(np.sqrt((own * own).sum())))
        ended, begun = _moves(last, own_block)
        last = own_block
        row[-MORE:-4] = min(ended, 8) / 4, min(begun, 8) / 4, np.log1p(held[0]) / 5, min(1.0, held[1] / held[2])
        row[-4:] = np.log1p(len(words)) / 5, min(1.0, b.linked / len(b.text)), (b.within.depth if b.within else 0) / 10, 1.0
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM over a page's blocks with a logistic output for each."""

    def __init__(self, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + MORE + HIDDEN
        self.weights = {d: (draw.normal(size=(size, 4 * HIDDEN)) / np.sqrt(size)).astype(np.float32) for d in ("on", "back")}
        self.weights["out"] = (draw.normal(size=(2 * HIDDEN + 1, 1)) / np.sqrt(HIDDEN)).astype(np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, trace: list | None = None) -> np.ndarray:
        """Hidden states (pages, blocks, HIDDEN); padding leaves the state as it is."""
        pages, length, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((pages, length, HIDDEN), np.float32)
        for t in range(length) if way == "on" else range(length - 1, -1, -1):
            joined = np.concatenate([x[:, t], h], axis=1)
            z = joined @ self.weights[way]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN] + 1), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = f * c + i * g
            if trace is not None:
                trace.append((t, joined, i, f, o, g, c, new, m))
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[:, t] = h
        return out

    def _back(self, way: str, trace: list, grad: np.ndarray) -> np.ndarray:
        """Gradient of the weights of one direction, given that of its hidden states."""
        total = np.zeros_like(self.weights[way])
        dh, dc = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
        for t, joined, i, f, o, g, c, new, m in reversed(trace):
            dh = dh + grad[:, t]
            th = np.tanh(new)
            dn = np.where(m, dc + dh * o * (1 - th * th), 0)
            dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), np.where(m, dh * th * o * (1 - o), 0), dn * i * (1 - g * g)], axis=1)
            total += joined.T @ dz
            dh = np.where(m, (dz @ self.weights[way].T)[:, -HIDDEN:], dh)
            dc = np.where(m, dn * f, dc)
        return total

    def _pad(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        length = max(len(p) for p in pages)
        x, mask = np.zeros((len(pages), length, pages[0].shape[1]), np.float32), np.zeros((len(pages), length), bool)
        for i, p in enumerate(pages):
            x[i, : len(p)], mask[i, : len(p)] = p, True
        return x, mask

    def _logits(self, hidden: np.ndarray) -> np.ndarray:
        return (hidden @ self.weights["out"][:-1])[..., 0] + self.weights["out"][-1, 0]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, whether each block is part of the article; pages of alike lengths are labelled together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        while order:
            some = order[-max(1, CELLS // len(pages[order[-1]])) :]
            del order[-len(some) :]
            x, mask = self._pad([pages[i] for i in some])
            z = self._logits(np.concatenate([self._run(x, mask, "on"), self._run(x, mask, "back")], axis=2))
            for i, row in zip(some, z, strict=True):
                out[i] = row[: len(pages[i])] > 0
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 3) -> None:
        """Minimise the log loss over all blocks with Adam."""
        draw = np.random.default_rng(seed)
        mean = {k: np.zeros_like(w) for k, w in self.weights.items()}
        square = {k: np.zeros_like(w) for k, w in self.weights.items()}
        step = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                some = [pages[i] for i in order[at : at + BATCH]]
                x, mask = self._pad([p for p, _ in some])
                y = np.zeros(mask.shape, np.float32)
                for row, (_, label) in zip(y, some, strict=True):
                    row[: len(label)] = label
                traces: dict[str, list] = {"on": [], "back": []}
                hidden = np.concatenate([self._run(x, mask, d, traces[d]) for d in ("on", "back")], axis=2)
                dz = np.where(mask, _sigmoid(self._logits(hidden)) - y, 0).astype(np.float32) / mask.sum()
                flat = np.concatenate([hidden, np.ones((*hidden.shape[:2], 1), np.float32)], axis=2)
                grads = {"out": np.einsum("ptk,pt->k", flat, dz)[:, None]}
                dh = dz[..., None] * self.weights["out"][:-1, 0]
                grads["on"] = self._back("on", traces["on"], dh[..., :HIDDEN])
                grads["back"] = self._back("back", traces["back"], dh[..., HIDDEN:])
                step += 1
                for k, g in grads.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.weights[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)


#: Names by which pages commonly mark their article, and what is not part of it.
ARTICLES = ("article", "main", "div.content", "div.post", "div.entry", "section.article", "div.main", "div.story")
OTHERS = (
    "nav ul li", "div.menu ul li", "header", "div.header", "footer", "div.footer", "aside", "div.sidebar", "div.ad", "div.advert",
    "div.banner", "div.promo", "div.cookie.notice", "div.notice", "div.alert", "div.popup", "form label", "form", "div.newsletter form",
    "section.comments div.comment p", "div.comments p", "ul.comments li", "div.related ul li", "div.share", "div.breadcrumb", "div.social", "button",
)
_NOT_ARTICLE = frozenset("head nav header footer aside form button select option label dialog menu".split())
_NOT_NAMES = frozenset("ad ads advert advertisement banner comment comments cookie footer header menu nav navbar newsletter notice popup promo related share sidebar social sponsored".split())


def teacher(path: tuple[tuple[str, ...], ...]) -> bool:
    """The weak label of a block, from markup that states its purpose: inside an article or main element and in
    nothing, from there inwards, that names another purpose."""
    at = next((i for i, x in enumerate(path) if x[0] in ("article", "main") or "articlebody" in x[1:]), None)
    return at is not None and all(x[0] not in _NOT_ARTICLE and _NOT_NAMES.isdisjoint(x[1:]) for x in path[at:])


def _element(name: str) -> tuple[str, ...]:
    return tuple(name.split("."))


def varied(blocks: list[Block], labels: list[bool], draw: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """The page in other dress: its article under another element that is common for it, and runs of other pages'
    furniture before, in and after it, worded by its own blocks."""
    root = (("html",), ("body",))
    article = _element(str(draw.choice(ARTICLES)))
    out: list[tuple[Block, bool]] = []

    def furniture(n: int, inside: bool) -> None:
        for _ in range(n):
            path = tuple(_element(x) for x in str(draw.choice(OTHERS)).split())
            path = (*root, *((article,) if inside else ()), *path)
            for _ in range(int(draw.integers(1, 4))):
                words = blocks[int(draw.integers(len(blocks)))].text.split()
                first = int(draw.integers(len(words)))
                text = " ".join(words[first : first + int(draw.integers(1, 30))])
                out.append((Block(text, opened(path), len(text) * int(draw.integers(2))), False))

    furniture(int(draw.integers(0, 4)), False)
    for b, label in zip(blocks, labels, strict=True):
        if label:
            path = b.path
            inner = path[max((i + 1 for i, x in enumerate(path) if x[0] in ("article", "main")), default=len(path) - 1) :]
            out.append((Block(b.text, opened((*root, article, *inner)), b.linked), True))
            if draw.random() < 0.08:
                furniture(1, True)
        elif draw.random() < 0.5:
            out.append((b, False))
    furniture(int(draw.integers(0, 4)), False)
    return parsed([(b.path, b.text, b.linked) for b, _ in out]), [label for _, label in out]


def unnamed(blocks: list[Block], labels: list[bool], draw: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """The page in a dress that no name gives away: containers have made-up class names or none, the page may be laid out as
    a table, and only words, links, headings, order and where a container ends tell the article from menus before it and
    reader comments and notices after it."""

    def container(*kinds: str) -> tuple[str, ...]:
        name = "".join(draw.choice(list("aeiourstlnmdkpb"), int(draw.integers(3, 9))))
        return (str(draw.choice(kinds)), *((name,) if draw.random() < 0.8 else ()))

    def some(least: int, most: int) -> str:
        words = blocks[int(draw.integers(len(blocks)))].text.split()
        first = int(draw.integers(max(1, len(words) - most)))
        return " ".join(words[first : first + int(draw.integers(least, most + 1))]) or words[0]

    tabular = draw.random() < 0.3
    root: tuple[tuple[str, ...], ...] = (("html",), ("body",))
    if draw.random() < 0.4:
        root = (*root, container("div"))
    if tabular:
        root = (*root, ("table",), *((("tbody",),) if draw.random() < 0.5 else ()), ("tr",))
    inside = lambda: (*root, container("td")) if tabular else (*root, container("div", "div", "section"))
    out: list[tuple[Block, bool]] = []

    def add(path: tuple[tuple[str, ...], ...], text: str, linked: bool) -> None:
        out.append((Block(text, opened(path), len(text) if linked else 0), False))

    def menu() -> None:
        own, item = inside(), str(draw.choice(["li", "li", "div", "td", "span"]))
        for _ in range(int(draw.integers(2, 8))):
            add((*own, ("ul",), ("li",)) if item == "li" else own if item == "span" else (*own, (item,)), some(1, 3), draw.random() < 0.9)

    def notice() -> None:
        own = inside()
        for _ in range(int(draw.integers(1, 3))):
            add((*own, ("p",)) if draw.random() < 0.5 else own, some(3, 18), draw.random() < 0.2)

    def comments() -> None:
        own, each = inside(), container("div", "div", "li", "section")
        if draw.random() < 0.6:
            add((*own, (str(draw.choice(["h2", "h3", "h4"])),)), some(1, 3), False)
        for _ in range(int(draw.integers(1, 6))):
            one = tuple(list(each))  # each comment is an element of its own
            if draw.random() < 0.6:
                add((*own, one, (str(draw.choice(["div", "h4", "p", "cite"])),)), f"{some(1, 2)} {draw.choice(['says', 'wrote', 'replied', ''])} {int(draw.integers(1, 60))}".strip(), draw.random() < 0.3)
            add((*own, one, ("p",)) if draw.random() < 0.8 else (*own, one), some(3, 40), False)

    for part in (menu, notice, menu):
        if draw.random() < 0.6:
            part()
    article, cell = inside(), tabular and draw.random() < 0.5
    for b, label in zip(blocks, labels, strict=True):
        if label:
            path = b.path
            inner = path[max((i + 1 for i, x in enumerate(path) if x[0] in ("article", "main")), default=len(path) - 1) :]
            out.append((Block(b.text, opened((*article, *(() if cell and inner and inner[-1][0] == "p" else inner))), b.linked), True))
    for part in (comments, notice, menu, notice):
        if draw.random() < 0.5:
            part()
    return parsed([(b.path, b.text, b.linked) for b, _ in out]), [label for _, label in out]


def generated(draw: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page of made-up words in a common dress."""

    def words(n: int) -> str:
        return " ".join("".join(draw.choice(list("aeiourstlnmd"), int(draw.integers(2, 10)))) for _ in range(n))

    text = [words(int(draw.integers(2, 9)))] + [words(int(draw.integers(8, 60))) for _ in range(int(draw.integers(1, 8)))]
    kinds = ["h1", *str(draw.choice(["p", "p", "p", "div", "li"])).split() * (len(text) - 1)]
    blocks = [Block(t, opened((("html",), ("body",), ("article",), (k,))), 0) for t, k in zip(text, kinds, strict=True)]
    return (varied if draw.random() < 0.6 else unnamed)(blocks, [True] * len(blocks), draw)


def fit_labeller(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> BlockLabeller:
    """Fit the labeller to at most ``sample`` pages (by the hash of their ids) that mark their article, each as it is
    and in two other dresses, one of common names and one of made-up ones; the weak labels come from that markup. Of a page of more than ``WINDOW`` blocks it sees so
    many in a row, from anywhere in it: at most 3 times ``sample`` times ``WINDOW`` labelled blocks and the furniture of
    the dresses.

    Where no page marks its article (or there is no page at all) it learns from dresses alone: ``GENERATED`` pages of
    made-up words, and the paragraphs of the sampled pages (eight words or more, mostly outside links), put into elements
    that are common for articles and surrounded by common furniture, or into those of made-up names.
    """
    low = F.lower(html_col)
    shows = F.contains(low, F.lit("<article")) | F.contains(low, F.lit("<main")) | F.contains(low, F.lit("articlebody"))

    def drawn(some: DataFrame) -> list:
        own = thinned(some, id_col, sample).select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html"))
        return own.orderBy(F.xxhash64("id"), "id").limit(sample).collect()

    draw = np.random.default_rng(11)
    known: list[tuple[list[Block], list[bool]]] = []

    def some_of(html_text: str | None) -> list[Block]:
        blocks = blocks_of(html_text)
        first = int(draw.integers(max(1, len(blocks) - WINDOW + 1)))
        return blocks[first : first + WINDOW]

    for r in drawn(pages.filter(shows)):
        if blocks := some_of(r["html"]):
            labels = [teacher(b.path) for b in blocks]
            known += [(blocks, labels), varied(blocks, labels, draw), unnamed(blocks, labels, draw)]
    if not any(any(labels) for _, labels in known):
        known = [generated(draw) for _ in range(GENERATED)]
        for r in drawn(pages):
            prose = [b for b in some_of(r["html"]) if len(b.text.split()) >= 8 and b.linked < 0.3 * len(b.text)]
            if prose:
                known += [dress(prose, [True] * len(prose), draw) for dress in (varied, unnamed)]
    labeller = BlockLabeller()
    labeller.fit([(features(blocks), np.array(labels)) for blocks, labels in known if blocks])
    return labeller


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows that together hold at most ``ROWS`` pages and ``BYTES`` bytes, or one page."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and (i - first == ROWS or held + n > BYTES):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if sizes:
        yield batch.slice(first)


def main_text(pages: DataFrame, labeller: BlockLabeller, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: page_id, n_blocks, n_kept and text: the blocks that are labelled as the article, in page order, joined by
    one space. Every block of the whole page is read, however long or malformed it is (see ``blocks_of``); null html is
    empty and gives an empty text, as does a page without an article. Rows stay as they are, with null or repeated ids; an
    empty table gives an empty result; other columns are ignored."""
    held = pages.sparkSession.sparkContext.broadcast(labeller)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                blocks = [blocks_of(h) for h in b.column(1).to_pylist()]
                labels = held.value.label([features(x) for x in blocks])
                kept = [[x.text for x, y in zip(own, label, strict=True) if y] for own, label in zip(blocks, labels, strict=True)]
                counts = [pa.array([len(x) for x in y], pa.int32()) for y in (blocks, kept)]
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([" ".join(x) for x in kept], pa.string())], ["page_id", "n_blocks", "n_kept", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extract, f"page_id {kind}, n_blocks int, n_kept int, text string")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labeller = fit_labeller(pages)
    rows = pages.select(F.struct("page_id", "url").alias("key"), "html")
    got = main_text(rows, labeller, id_col="key")
    return got.select("page_id.page_id", "page_id.url", "text", F.char_length("text").cast("long").alias("n_chars"))
