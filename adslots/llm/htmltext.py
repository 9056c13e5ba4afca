"""Main text of web pages by a recurrent block labeller.

A page is read into its sequence of leaf blocks: text between block-level tags, with inline tags, comments,
scripts and styles gone. Every block becomes a vector: hashed tag names, classes and ids on its path, hashed
words, and a few shape numbers (length, share of link text, place). A bidirectional LSTM in numpy reads the whole
sequence in both directions and labels each block as article text or not; article blocks are joined.

The labeller is trained on the driver, from a bounded sample: of SAMPLE_PAGES pages (by hash of page_id and page), at
most SAMPLE_BLOCKS block texts each, cut at SAMPLE_CHARS characters, come there. They are laid out in pages of random
structure whose block labels are known; half of these name their containers by the word lists below, the others have
generated names, names of layout, wrong names, or none. Names that no training page has count as one, so that a page of
generated names is read by its structure. Training has a fixed size and seed; labelling reads whole pages, runs in tasks and needs no shuffle.

Defined cases: a null or empty page has empty text; unclosed and omitted tags, truncated pages and pages of any length
are read to their end; an unclosed comment, script or style runs to the end; other elements whose content isn't text
end with their parent or where a block begins, if their end tag is missing; repeated rows are labelled each; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_CHARS = 200, 64, 2000
TRAIN_PAGES, EPOCHS, HIDDEN = 1600, 10, 24
TAG_DIM, WORD_DIM, SHAPE_DIM = 128, 32, 8
DIM = TAG_DIM + WORD_DIM + SHAPE_DIM

#: Fixed values of HTML: elements without content; whose content is no markup; whose content isn't shown as text, and of
#: these the ones that can't hold blocks, so that a block's start ends them if their end tag is missing; inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
HIDDEN_IN = frozenset("noscript template svg math iframe object canvas select option textarea button".split())
BREAKS = frozenset("svg math iframe select option textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+", re.I)
_RAW_END = {t: re.compile(f"</{t}\\b[^>]*(?:>|\\Z)", re.I) for t in RAW}
_TITLE_END = re.compile(r"</title\b", re.I)
_NEXT = {t: re.compile(f"<(/?){t}\\b", re.I) for t in HIDDEN_IN}


class Node:
    """A place in a page: an element's names and the place around it. Elements of like names in one place share it, and it
    holds the sum of its path's vectors once asked, so a path costs what its last element costs, however deep."""

    __slots__ = ("around", "names", "depth", "inside", "_sum")

    def __init__(self, around: Node | None, names: str):
        self.around, self.names, self.depth = around, names, around.depth + 1 if around else 0
        self.inside: dict[str, Node] = {}
        self._sum: np.ndarray | None = None if around else np.zeros(TAG_DIM, np.float32)

    def within(self, names: str) -> Node:
        found = self.inside.get(names)
        if found is None:
            found = self.inside[names] = Node(self, names)
        return found

    def vector(self) -> np.ndarray:
        todo, node = [], self
        while node._sum is None:
            todo.append(node)
            node = node.around
        for n in reversed(todo):
            n._sum = n.around._sum + _names_vector(n.names)
        return np.clip(self._sum, -2, 2)


class Block:
    __slots__ = ("place", "text", "linked")

    def __init__(self, place: Node, text: str, linked: int):
        self.place, self.text, self.linked = place, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        """The names on the way to the block, outermost first."""
        out, node = [], self.place
        while node.around:
            out.append(node.names)
            node = node.around
        return tuple(reversed(out))


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order."""
    page = page or ""
    out: list[Block] = []
    root = Node(None, "")
    stack: list[tuple[str, Node, bool]] = []  # tag, place, and whether an element that isn't shown has its own end tag
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = links = hidden = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(stack[-1][1] if stack else root, text, linked))
        pieces.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links, hidden
        links -= sum(x[0] == "a" for x in stack[at:])
        hidden -= sum(x[0] in HIDDEN_IN for x in stack[at:])
        opened.subtract(x[0] for x in stack[at:])
        del stack[at:]

    def push(tag: str, names: str, ends: bool) -> None:
        around = stack[-1][1] if stack else root
        stack.append((tag, around if tag in INLINE else around.within(names), ends))
        opened[tag] += 1

    def break_out() -> None:
        """A block begins: elements that can't hold it and have no end tag of their own are over."""
        while hidden:
            k = max(k for k, x in enumerate(stack) if x[0] in HIDDEN_IN)
            if stack[k][0] not in BREAKS or stack[k][2]:
                break
            close(k)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        data = page[at : m.start() if m else n]
        if data and not hidden:
            data = html.unescape(data) if "&" in data else data
            pieces.append(data)
            if links:
                linked += len(data)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "head":  # what a head holds is no text, or already the body's
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    if tag in INLINE or not any(x[0] in ("article", "body") for x in stack[k + 1 :]):
                        close(k)
                    break
            continue
        if tag in RAW:
            flush()
            end = None if m[3].endswith("/") else _RAW_END[tag].search(page, at)
            at = end.end() if end else at if m[3].endswith("/") else n
            continue
        if tag == "br":
            pieces.append(" " * (not hidden))
            continue
        if tag not in INLINE:
            flush()
            if hidden and (tag in CLOSES_P or tag in SAME):
                break_out()
            if hidden and tag in ("option", "optgroup") and stack[-1][0] == "option":
                close(len(stack) - 1)
            if tag in CLOSES_P or tag in SAME:
                shut = SAME.get(tag, ("p",))
                for k in range(len(stack) - 1, -1, -1):
                    name = stack[k][0]
                    if name in shut:
                        close(k)
                        break
                    if name not in INLINE and name != "p":
                        break
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in HIDDEN_IN:
            same = None if tag in ("svg", "math", "option") else _NEXT[tag].search(page, at)
            if same is None and tag not in BREAKS:
                continue  # never ended: as if it weren't there
            push(tag, tag, same is not None and same[1] == "/")
            hidden += 1
            continue
        names = " ".join([tag, *(" ".join(f"{k[0].lower()}_{p.lower()}" for p in _PART.findall(a or b or c)) for k, a, b, c in _NAMES.findall(m[3]))]) if m[3] else tag
        if tag == "title":  # holds text only
            end = _TITLE_END.search(page, at)
            end = end.start() if end else page.find("<", at)
            at = n if end < 0 else end
            continue
        push(tag, names, False)
        links += tag == "a"
    flush()
    return out


_seen: dict[str, tuple[int, float]] = {}


def _slot(token: str) -> tuple[int, float]:
    found = _seen.get(token)
    if found is None:
        h = crc32(token.encode())
        found = (h >> 1, 1.0 if h & 1 else -1.0)
        if len(_seen) < 200_000:
            _seen[token] = found
    return found


_known: dict[str, np.ndarray] = {}


def _names_vector(names: str) -> np.ndarray:
    found = _known.get(names)
    if found is None:
        found = np.zeros(TAG_DIM, np.float32)
        tag, *others = names.split()
        others = [n.removeprefix("c_").removeprefix("i_").removeprefix("r_") for n in others]
        for name in (tag, *(n if n in KNOWN else UNKNOWN for n in others)):  # names that no training page has tell nothing
            h, sign = _slot(name)
            found[h % TAG_DIM] += sign
        if len(_known) < 50_000:
            _known[names] = found
    return found


def features(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), DIM), np.float32)
    for k, b in enumerate(page):
        out[k, :TAG_DIM] = b.place.vector()
        words = b.text.split(" ")
        slots = [_slot(w) for w in words]
        v = np.bincount(np.fromiter((h for h, _ in slots), np.int64, len(slots)) % WORD_DIM, np.fromiter((s for _, s in slots), np.float64, len(slots)), WORD_DIM)
        out[k, TAG_DIM : TAG_DIM + WORD_DIM] = 0.3 * v / max(np.sqrt((v * v).sum()), 1.0)
        n = len(b.text)
        out[k, TAG_DIM + WORD_DIM :] = (min(1.5, np.log1p(len(words)) / 4), min(1.5, np.log1p(n) / 6), min(1.0, b.linked / n), b.text[-1] in ".!?\"'", n < 20, min(b.place.depth / 8, 3.0), k / len(page), np.log1p(len(page)) / 5)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """A bidirectional LSTM over vectors, and a logistic output for each."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for way in "fb":
            self.p[f"W{way}"] = (rng.standard_normal((DIM + hidden, 4 * hidden)) * 0.1).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # forget gates start open
            self.p[f"b{way}"] = bias
        self.p["V"] = (rng.standard_normal((2 * hidden + DIM, 1)) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray):
        steps, n, _ = x.shape
        H, W = self.h, self.p[f"W{way}"]
        inputs = x @ W[:DIM] + self.p[f"b{way}"]
        h, c = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
        hs, cache = np.zeros((steps, n, H), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ W[DIM:]
            i, f, o, g = _sigmoid(z[:, :H]), _sigmoid(z[:, H : 2 * H]), _sigmoid(z[:, 2 * H : 3 * H]), np.tanh(z[:, 3 * H :])
            new = f * c + i * g
            m = mask[t][:, None]
            tc = np.tanh(new)
            cache.append((t, h, c, i, f, o, g, tc, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            hs[t] = h
        return hs, cache

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, cf = self._run("f", x, mask)
        hb, cb = self._run("b", x, mask)
        every = np.concatenate([hf, hb, x], axis=2)
        out = (every @ self.p["V"])[:, :, 0] + self.p["c"]
        return (out, every, cf, cb) if keep else out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        out, every, cf, cb = self.logits(x, mask, keep=True)
        p = _sigmoid(out)
        total = mask.sum()
        loss = -(np.log(np.where(y, p, 1 - p) + 1e-9) * mask).sum() / total
        d = ((p - y) * mask / total).astype(np.float32)[:, :, None]
        g = {"V": np.tensordot(every, d, ([0, 1], [0, 1])), "c": d.sum(axis=(0, 1))}
        for way, cache, dh_all in (("f", cf, d @ self.p["V"][: self.h].T), ("b", cb, d @ self.p["V"][self.h : 2 * self.h].T)):
            H, W = self.h, self.p[f"W{way}"]
            dz_all = np.zeros((*x.shape[:2], 4 * H), np.float32)
            dW_h = np.zeros((H, 4 * H), np.float32)
            dh, dc = np.zeros_like(cache[0][1]), np.zeros_like(cache[0][1])
            for t, h0, c0, i, f, o, gg, tc, m in reversed(cache):
                up = dh + dh_all[t]
                live = up * m
                dcell = dc * m + live * o * (1 - tc * tc)
                dz = np.concatenate([dcell * gg * i * (1 - i), dcell * c0 * f * (1 - f), live * tc * o * (1 - o), dcell * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                dW_h += h0.T @ dz
                dh = dz @ W[DIM:].T + up * ~m
                dc = dcell * f + dc * ~m
            g[f"W{way}"] = np.concatenate([np.tensordot(x, dz_all, ([0, 1], [0, 1])), dW_h])
            g[f"b{way}"] = dz_all.sum(axis=(0, 1))
        return float(loss), g


def pack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x, mask = np.zeros((longest, len(pages), DIM), np.float32), np.zeros((longest, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """Adam over batches of pages of like length."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
    batches = [pages[a : a + 24] for a in range(0, len(pages), 24)]
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for k in rng.permutation(len(batches)):
            x, mask = pack([p for p, _ in batches[k]])
            y = np.zeros(mask.shape, bool)
            for j, (_, labels) in enumerate(batches[k]):
                y[: len(labels), j] = labels
            _, g = model.gradients(x, mask, y)
            step += 1
            for name, d in g.items():
                first[name] = 0.9 * first[name] + 0.1 * d
                second[name] = 0.999 * second[name] + 0.001 * d * d
                model.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


#: Word lists for the containers of training pages.
ARTICLE = "article content main post story entry body text article-body post-content entry-content main-content story-body page-content article-text".split()
MENU = "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs pagination pager tabs toc skip-links".split()
HEADER = "header masthead site-header banner top-bar branding logo page-header".split()
FOOTER = "footer site-footer copyright bottom legal colophon footer-links imprint".split()
SIDEBAR = "sidebar aside side-bar related widget popular recommended trending right-rail secondary more-stories tags author-box".split()
NOTICE = "notice cookie cookie-banner consent alert gdpr popup modal message-bar subscribe-banner disclaimer cookie-notice privacy-notice".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo banner-ad ad-slot promotion teaser ad-container".split()
FORM = "form newsletter search login signup subscribe contact-form search-box".split()
COMMENT = "comments comment comment-list discussion replies respond reader-comments user-comments disqus feedback responses".split()
SOCIAL = "share social sharing social-links follow share-buttons".split()
NEUTRAL = "wrapper container row col inner block box section grid module clearfix site page layout region panel".split()


#: How a training page names its containers: by the lists, by generated names, by layout, wrongly, or not at all.
STYLES = ("plain",) * 6 + ("opaque",) * 3 + ("utility", "none", "misleading")
UTILITY = "flex grid p-4 mt-2 mb-8 text-sm w-full md:w-1/2 items-center rounded bg-white shadow px-6 gap-4 max-w-prose mx-auto leading-relaxed border hidden-xs col-md-8".split()
#: The parts of names that training pages may have; all others, generated ones among them, are one.
KNOWN = frozenset(p for names in (ARTICLE, MENU, HEADER, FOOTER, SIDEBAR, NOTICE, ADVERT, FORM, COMMENT, SOCIAL, NEUTRAL, UTILITY, ["comment reply media body"]) for n in names for p in _PART.findall(n))
UNKNOWN = "?"


class Writer:
    """Writes a page of random structure from given texts; `labels` says which of its blocks are article text."""

    def __init__(self, texts: list[str], rng: random.Random, style: str | None = None):
        self.texts, self.r, self.html, self.labels = texts, rng, [], []
        self.style = style or rng.choice(STYLES)
        self.opaque: dict[str, str] = {}

    def named(self, names: list[str]) -> str | None:
        """A container's class or id, in the page's style: like ones are named alike."""
        kind = self.r.choice(names)
        if self.style == "plain":
            return kind
        if self.style == "none":
            return None
        if self.style == "utility":
            return " ".join(self.r.sample(UTILITY, self.r.randint(1, 4)))
        if self.style == "misleading":
            return self.r.choice(ARTICLE + MENU + SIDEBAR + COMMENT + NEUTRAL)
        prefix = self.opaque.setdefault("", self.r.choice(("css-", "sc-", "x", "_", "c")))
        return self.opaque.setdefault(kind, prefix + "".join(self.r.choice("0123456789abcdefghijklmnop") for _ in range(6)))

    def words(self, low: int, high: int) -> str:
        words = self.r.choice(self.texts).split()
        n = self.r.randint(low, high)
        at = self.r.randrange(max(1, len(words) - n))
        words = words[at : at + n] or ["more"]
        odd = self.r.random()  # articles of odd texts are articles too
        if odd < 0.1:
            return self.r.choice((" | ".join(words), "!! ".join(words).upper(), " ".join([words[0]] * len(words)), " ".join(w + self.r.choice(("***", "$$$", "&amp;&amp;", "###")) for w in words)))
        return html.escape(" ".join(words))

    def open(self, tag: str, names: list[str] | None) -> None:
        attr = ""
        name = self.named(names) if names else None
        if name:
            attr = f' {self.r.choice(("class", "class", "id"))}="{name}"'
        self.html.append(f"<{tag}{attr}>")

    def leaf(self, tag: str, text: str, good: bool, names: list[str] | None = None) -> None:
        self.open(tag, names)
        self.html.append(text)
        if tag not in ("p", "li") or self.r.random() < 0.8:
            self.html.append(f"</{tag}>")
        self.labels.append(good)

    def links(self, good: bool = False) -> None:
        self.html.append("<ul>")
        for _ in range(self.r.randint(2, 8)):
            self.leaf("li", f'<a href="/x">{self.words(1, 4)}</a>', good)
        self.html.append("</ul>")

    def junk(self, kind: list[str], tags: tuple[str, ...]) -> None:
        tag = self.r.choice(tags)
        self.open(tag, None if tag not in ("div", "section", "p", "ul") and self.r.random() < 0.5 else kind)
        what = self.r.random()
        if kind is MENU or what < 0.2:
            self.links()
        elif kind is COMMENT:
            for _ in range(self.r.randint(1, 5)):
                self.open("div", ["comment", "reply", "comment-body", "media"])
                if self.r.random() < 0.5:
                    self.leaf("h4", self.words(1, 3), False)
                for _ in range(self.r.randint(1, 2)):
                    self.leaf("p", self.words(4, 80), False)
                self.html.append("</div>")
        elif kind is FORM:
            self.leaf(self.r.choice(("p", "div", "h3")), f"<label>{self.words(1, 8)}</label>", False)
            self.html.append('<input name="q"><button>ok</button>')
        else:
            if self.r.random() < 0.4:
                self.leaf(self.r.choice(("h2", "h3", "h4")), self.words(1, 5), False)
            if self.r.random() < 0.4:
                self.html.append((f"&copy; {self.words(2, 12)} &middot; " if kind is FOOTER else "") + self.words(3, 40))
                self.labels.append(False)
            else:
                for _ in range(self.r.randint(1, 3)):
                    self.leaf(self.r.choice(("p", "div", "p", "li")), self.words(2, 50), False)
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        tag = self.r.choice(("article", "article", "main", "div", "section", "div"))
        self.open(tag, ARTICLE if tag in ("div", "section") or self.r.random() < 0.3 else None)
        inner = self.r.random() < 0.3
        if inner:
            self.open("div", ARTICLE + NEUTRAL)
        if self.r.random() < 0.85:
            head = tag == "article" and self.r.random() < 0.15
            self.html.append("<header>" * head)
            self.leaf("h1", self.words(3, 12), True)
            self.html.append("</header>" * head)
        for _ in range(self.r.randint(1, 14)):
            what = self.r.random()
            if what < 0.62:
                text = self.words(1, 150)
                if self.r.random() < 0.25:
                    text = f"<b>{self.words(1, 20)}<br>" if self.r.random() < 0.5 else f'{text} <a href="/y">{self.words(1, 4)}</a> {self.words(1, 20)}'
                self.leaf("p", text, True)
            elif what < 0.72:
                self.leaf(self.r.choice(("h2", "h3")), self.words(1, 8), True)
            elif what < 0.78:
                self.leaf("blockquote", self.words(4, 40), True)
            elif what < 0.84:
                self.html.append("<ul>")
                for _ in range(self.r.randint(2, 5)):
                    self.leaf("li", self.words(2, 25), True)
                self.html.append("</ul>")
            elif what < 0.88:
                self.html.append("<table>")
                for _ in range(self.r.randint(1, 3)):
                    self.html.append("<tr>")
                    for _ in range(self.r.randint(1, 3)):
                        self.leaf("td", self.words(1, 4), True)
                    self.html.append("</tr>")
                self.html.append("</table>")
            elif what < 0.91:
                self.leaf("pre", self.words(3, 30), True)
            elif what < 0.96:
                self.junk(self.r.choice((ADVERT, SOCIAL, SIDEBAR)), ("div", "aside", "div"))
            else:
                self.leaf("div", self.words(5, 60), True)
        if self.r.random() < 0.15:
            self.junk(COMMENT, ("section", "div"))
        self.html.append("</div>" * inner + f"</{tag}>")

    def page(self) -> tuple[str, list[bool]]:
        r = self.r
        self.html.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        wrap = r.random() < 0.4
        if wrap:
            self.open("div", NEUTRAL)
        before = [(HEADER, ("header", "div")), (MENU, ("nav", "div", "ul")), (NOTICE, ("div", "section", "aside")), (ADVERT, ("div", "aside", "section")), (FORM, ("form", "div")), (SIDEBAR, ("aside", "div"))]
        after = [(COMMENT, ("section", "div", "ol")), (SIDEBAR, ("aside", "div", "section")), (ADVERT, ("div", "aside")), (FORM, ("form", "div")), (NOTICE, ("div", "section")), (MENU, ("nav", "div")), (SOCIAL, ("div", "ul"))]
        for kind, tags in before:
            if r.random() < 0.45:
                self.junk(kind, tags)
        column = r.random() < 0.3
        if column:
            self.open("div", NEUTRAL)
        self.article()
        for kind, tags in r.sample(after, len(after)):
            if r.random() < 0.35:
                self.junk(kind, tags)
        self.html.append("</div>" * column)
        if r.random() < 0.7:
            self.junk(FOOTER, ("footer", "div", "footer"))
        self.html.append("</div>" * wrap + "</body></html>")
        return "".join(self.html), self.labels


def training_pages(texts: list[str], n: int, seed: int = 11) -> Iterator[tuple[str, list[bool]]]:
    rng = random.Random(seed)
    for _ in range(n):
        yield Writer(texts, rng).page()


def labelled(texts: list[str], n: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for page, labels in training_pages(texts, n, seed):
        found = blocks(page)
        if len(found) == len(labels):  # so it is but for texts that hold markup
            out.append((features(found), np.array(labels, bool)))
    return out


def without_words(pages: list[tuple[np.ndarray, np.ndarray]], share: float = 0.7, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training pages with the words of a share of their blocks left out, so that places weigh more than words."""
    rng = np.random.default_rng(seed)
    for x, _ in pages:
        x[rng.random(len(x)) < share, TAG_DIM : TAG_DIM + WORD_DIM] = 0
    return pages


def sample_texts(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> list[str]:
    """The block texts of a sample of pages; keys come to the driver first, then the texts, both bounded."""
    keyed = pages.where("html IS NOT NULL").select(F.xxhash64(F.col("page_id"), F.md5("html")).alias("key"), F.col("html").cast("string").alias("html"))
    keys = [r[0] for r in keyed.select("key").distinct().orderBy("key").limit(sample_pages).collect()]

    def read(batches):
        for b in batches:
            found = [(k, x.text[:SAMPLE_CHARS]) for k, h in zip(b.column("key").to_pylist(), b.column("html").to_pylist(), strict=True) for x in blocks(h)[:SAMPLE_BLOCKS]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["key", "text"])

    texts = keyed.where(F.col("key").isin(keys)).mapInArrow(read, "key bigint, text string").select("text").distinct()
    return sorted(r[0] for r in texts.toLocalIterator())


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, train_pages: int = TRAIN_PAGES) -> Labeller:
    return fit(without_words(labelled(sample_texts(pages, sample_pages) or ["a few words to lay out"], train_pages)))


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks are article text; pages of like length are read together. A block's
    score is averaged with the mean score of the page's blocks on the same path."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        size = max(1, min(64, 20_000 // len(pages[order[min(at + 63, len(order) - 1)]])))
        part = order[at : at + size]
        at += size
        x, mask = pack([features(pages[k]) for k in part])
        logits = model.logits(x, mask)
        for j, k in enumerate(part):
            own = logits[: len(pages[k]), j]
            kinds: dict[Node, int] = {}
            kind = np.array([kinds.setdefault(b.place, len(kinds)) for b in pages[k]])
            mean = np.bincount(kind, own) / np.bincount(kind)
            out[k] = own + mean[kind] > 0
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_blocks, n_article of every row of pages(page_id, url, html)."""
    trained = model or train(pages)
    shared = pages.sparkSession.sparkContext.broadcast(trained)

    def run(batches):
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 128):
                part = b.slice(at, 128)
                found = [blocks(h) for h in part.column("html").to_pylist()]
                good = label(shared.value, found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(["\n".join(x.text for x, ok in zip(p, g, strict=True) if ok) for p, g in zip(found, good, strict=True)], pa.string()),
                     pa.array([len(p) for p in found], pa.int64()), pa.array([int(g.sum()) for g in good], pa.int64())],
                    names=["page_id", "url", "text", "n_blocks", "n_article"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_blocks bigint, n_article bigint")
