"""HTML extraction with a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags). Each block becomes a vector: its tag
path with class, id and role words (hashed), its words (hashed), and a few numbers such as length and
link share. A bidirectional LSTM in numpy reads the page's whole sequence of blocks and labels each
one main text or not. All pages of a slice step through the network together; a page too long for
that is read in stretches, over which each direction takes its state along, so every label depends on
the whole page.

There are no labelled pages, so the network learns from weak labels: in a bounded, documented sample
(``SAMPLE`` pages by a hash of the id, pages over ``MAX_HTML`` characters left out of training only)
blocks inside an article or main element are main text, others are not; and each sampled page is also
taken in ``VARIANTS`` rebuilt forms in which menus, side bars, notices, forms, adverts, related links
and reader comments made of other pages' words stand around and inside the article, and the
article's own element varies. The weights have a fixed size and are broadcast.

Character references are decoded, white space in a block (a br too) becomes one space, and the main
blocks are joined by a newline in page order. Script, style, template and noscript content and
comments are no blocks. Null or empty html gives an empty text. Unclosed or misplaced tags are
tolerated. Repeated rows are extracted one by one. With no page to learn from, the weak labels' own
rule is used.
"""

from __future__ import annotations

import html as html_module
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, hash_sample, map_texts

SAMPLE = 300
MAX_HTML = 200_000
VARIANTS = 3
LONG_WORDS = 12  # of a block that counts as main text if no sampled page has an article or main element
PATH_DIM, WORD_DIM, NUMBERS = 128, 32, 6
INPUT = PATH_DIM + WORD_DIM + NUMBERS
HIDDEN = 16
EPOCHS = 11
TRAIN_BLOCKS = 64  # blocks of a page that one training step reads; longer pages are cut into pieces
PATH_ENDS = 24
# GROUP blocks are scored at a time; a page with more is read in stretches of CORE blocks.
CORE, GROUP = 16384, 32768

# Element names.
BLOCK = set("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol option p pre search section
select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = "script|style|noscript|template"
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"p": set("body article aside blockquote div footer form header li main nav section td th".split()),
          "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}}
ENDS_P = BLOCK - {"body", "html", "head", "title", "button", "label", "option", "caption", "legend"}
MAIN = {"article", "main"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "head", "title", "button", "select", "label", "textarea",
         "fieldset", "dialog", "search"}

TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<({HIDDEN_TEXT})\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
                   r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int


class _Open:
    """The open elements: the nearest one of a tag, the path of block elements, and whether a link is
    open are known without a walk."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []  # tag, and how much of the path it added
        self.where: dict[str, list[int]] = {}
        self.names: list[str] = []
        self.paths: dict[tuple[str, ...], tuple[str, ...]] = {}

    def push(self, tag: str, attributes: str) -> None:
        added = 0
        if tag in BLOCK:
            found = [n for a in ATTRIBUTE.finditer(attributes) for n in NAME.findall((a.group(2) or a.group(3) or a.group(4) or "").lower())]
            self.names += (tag, *found)
            added = 1 + len(found)
        self.where.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, added))

    def nearest(self, tags) -> int:
        """Place of the innermost open element with one of the tags; -1 if there is none."""
        best, where = -1, self.where
        for t in tags:
            found = where.get(t)
            if found and found[-1] > best:
                best = found[-1]
        return best

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            tag, added = self.stack.pop()
            self.where[tag].pop()
            if added:
                del self.names[-added:]

    def path(self) -> tuple[str, ...]:
        names = self.names
        found = tuple(names) if len(names) <= 2 * PATH_ENDS else (*names[:PATH_ENDS], *names[-PATH_ENDS:])
        return self.paths.setdefault(found, found)


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order, with their decoded text in single spaces. Time is linear in the
    page; a path keeps its outermost and innermost ``PATH_ENDS`` names."""
    html = html or ""
    out: list[Block] = []
    opened = _Open()
    path: tuple[str, ...] = ()
    blank = True  # no part has more than white space yet
    parts: list[str] = []
    links: list[str] = []

    def flush() -> None:
        nonlocal blank
        if not blank:
            out.append(Block(path, " ".join("".join(parts).split()), len(" ".join("".join(links).split())) if links else 0))
        blank = True
        parts.clear()
        links.clear()

    def add(raw: str) -> None:
        nonlocal path, blank
        text = html_module.unescape(raw)
        if blank and text.strip():
            path, blank = opened.path(), False
        if blank:  # white space before a block's text is none of it
            return
        parts.append(text)
        if opened.where.get("a"):
            links.append(text)

    def close(tags: set[str], scope: set[str]) -> None:
        at = opened.nearest(tags)
        if at >= 0 and at > opened.nearest(scope):
            flush()
            opened.pop_to(at)

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        if not m.group(3):
            continue
        tag = m.group(3).lower()
        if tag == "br":
            if not blank:
                parts.append(" ")
            continue
        if m.group(2):
            if tag in BLOCK:
                flush()
            found = opened.where.get(tag)
            if found:
                opened.pop_to(found[-1])
            continue
        if tag in BLOCK:
            flush()
        if tag in ENDS_P:
            close({"p"}, SCOPES["p"])
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES[tag])
        if tag not in VOID and not m.group(4).rstrip().endswith("/"):
            opened.push(tag, m.group(4))
    if at < len(html):
        add(html[at:])
    flush()
    return out


def weak_label(b: Block) -> int:
    """Main text: inside an article or main element and in no other element with a role of its own."""
    inside = [i for i, t in enumerate(b.path) if t in MAIN]
    return int(bool(inside) and not any(t in ASIDE for t in b.path[inside[0]:]))


def long_label(b: Block) -> int:
    """For tables without such elements: a long block with few links, in no element with a role of its own."""
    return int(len(b.text.split()) >= LONG_WORDS and 5 * b.link_chars < len(b.text) and not any(t in ASIDE for t in b.path))


# -- features --------------------------------------------------------------------------------

_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed path parts; each part counts once wherever it stands, the last two parts also by place."""
    if path not in _PATHS:
        v = np.zeros(PATH_DIM)
        for part in {*path, *(f"{i}:{t}" for i, t in enumerate(reversed(path[-2:])))}:
            h = zlib.crc32(part.encode())
            v[h % PATH_DIM] += 1 if h >> 16 & 1 else -1
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        _PATHS[path] = v
    return _PATHS[path]


def features(found: list[Block], start: int = 0, total: int | None = None) -> np.ndarray:
    """Vectors of blocks that stand from place ``start`` of a page of ``total`` blocks."""
    x = np.zeros((len(found), INPUT))
    if not found:
        return x
    t = Texts(pa.array([b.text for b in found], pa.string()))
    starts, ends, first = t.words()
    h = t.hashes(starts, ends)
    row = np.repeat(np.arange(len(found)), np.diff(first))
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    words = np.bincount(row * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64), weights=sign,
                        minlength=len(found) * WORD_DIM).reshape(-1, WORD_DIM)
    n = np.diff(first)
    x[:, PATH_DIM:PATH_DIM + WORD_DIM] = 0.5 * words / np.sqrt(np.maximum(n, 1))[:, None]
    paths = {p: k for k, p in enumerate(dict.fromkeys(b.path for b in found))}
    x[:, :PATH_DIM] = np.array([path_vector(p) for p in paths])[[paths[b.path] for b in found]]
    size = np.array([len(b.text) for b in found])
    numbers = x[:, -NUMBERS:]
    numbers[:, 0] = np.log1p(n) / 5
    numbers[:, 1] = np.array([b.link_chars for b in found]) / size
    numbers[:, 2] = size / np.maximum(n, 1) / 10
    numbers[:, 3] = [b.text[-1] in ".!?" for b in found]
    numbers[:, 4] = (start + np.arange(len(found))) / (total or len(found))
    numbers[:, 5] = 1
    return x


# -- the network -----------------------------------------------------------------------------

def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":  # forward, backward
        w[f"x{d}"] = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
    w["o"] = rng.normal(0, 0.1, 2 * HIDDEN)
    w["c"] = np.zeros(1)
    return w


def _steps(size: np.ndarray, back: bool):
    """Row numbers that advance together: pages are ordered longest first; yields (step, pages)."""
    longest = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(longest), side="left").tolist()
    return [(t, going[t]) for t in (range(longest - 1, -1, -1) if back else range(longest))]


def run_direction(z: np.ndarray, wh: np.ndarray, start: np.ndarray, size: np.ndarray, back: bool):
    """LSTM over all pages at once (longest first). z: input projections by block. Keeps what
    training needs."""
    n = len(z)
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    gates = np.zeros((n, 4 * HIDDEN))
    hp, cp = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for t, k in _steps(size, back):
        at = start[:k] + t
        has = (size[:k] > t + 1) if back else np.full(k, t > 0)
        prev = np.where(has, at + (1 if back else -1), at)
        hp[at], cp[at] = h[prev] * has[:, None], c[prev] * has[:, None]
        a = z[at] + hp[at] @ wh
        g = np.empty_like(a)
        g[:, :3 * HIDDEN] = _sigmoid(a[:, :3 * HIDDEN])  # input, forget, output
        g[:, 3 * HIDDEN:] = np.tanh(a[:, 3 * HIDDEN:])
        i, f, o, u = np.split(g, 4, axis=1)
        c[at] = f * cp[at] + i * u
        h[at] = o * np.tanh(c[at])
        gates[at] = g
    return h, c, gates, hp, cp


def back_direction(dh_out, h, c, gates, hp, cp, wh, start, size, back):
    """Gradient of the input projections and of the recurrent weights."""
    n = len(h)
    dz, dh, dc = np.zeros((n, 4 * HIDDEN)), dh_out.copy(), np.zeros((n, HIDDEN))
    dw = np.zeros_like(wh)
    for t, k in reversed(_steps(size, back)):
        at = start[:k] + t
        i, f, o, u = np.split(gates[at], 4, axis=1)
        tc = np.tanh(c[at])
        dcell = dc[at] + dh[at] * o * (1 - tc * tc)
        d = np.concatenate([dcell * u * i * (1 - i), dcell * cp[at] * f * (1 - f), dh[at] * tc * o * (1 - o),
                            dcell * i * (1 - u * u)], axis=1)
        dz[at] = d
        dw += hp[at].T @ d
        has = (size[:k] > t + 1) if back else np.full(k, t > 0)
        prev = (at + (1 if back else -1))[has]
        dh[prev] += (d @ wh.T)[has]
        dc[prev] += (dcell * f)[has]
    return dz, dw


def _order(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    return first[:-1][order], size[order]


def score_direction(z: np.ndarray, wh: np.ndarray, wo: np.ndarray, start: np.ndarray, size: np.ndarray, back: bool) -> np.ndarray:
    """What one direction adds to every block's score; only the running states are kept."""
    h, c = np.zeros((len(start), HIDDEN)), np.zeros((len(start), HIDDEN))
    out = np.zeros(len(z))
    for t, k in _steps(size, back):
        a = z[start[:k] + t] + h[:k] @ wh
        g = _sigmoid(a[:, :3 * HIDDEN])
        c[:k] = g[:, HIDDEN:2 * HIDDEN] * c[:k] + g[:, :HIDDEN] * np.tanh(a[:, 3 * HIDDEN:])
        h[:k] = g[:, 2 * HIDDEN:] * np.tanh(c[:k])
        out[start[:k] + t] = h[:k] @ wo
    return out


def label(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of main text for every block of some sequences."""
    start, size = _order(first)
    score = sum(score_direction(x @ w[f"x{d}"], w[f"h{d}"], w["o"][k * HIDDEN:(k + 1) * HIDDEN], start, size, d == "b")
                for k, d in enumerate("fb"))
    return _sigmoid(score + w["c"])


def windows(total: int) -> list[tuple[int, int, int, int]]:
    """The stretches of a page: start, first and last of the labelled blocks, and end. All blocks of a stretch are
    labelled, as the states come from the stretches beside it."""
    return [(s, s, min(s + CORE, total), min(s + CORE, total)) for s in range(0, total, CORE)]


def both_directions(f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns of the two directions side by side, gate by gate; halved for the gates that are a sigmoid, which
    is 0.5 + 0.5 * tanh(half)."""
    out = np.stack([f.reshape(-1, 4, HIDDEN), b.reshape(-1, 4, HIDDEN)], axis=2)
    out[:, :3] *= 0.5
    return out.reshape(-1, 8 * HIDDEN)


def labelled_long(w: dict[str, np.ndarray], page: list[Block]) -> np.ndarray:
    """Probability of main text for every block of one page from its whole sequence. Both directions step at once,
    from the page's two ends, as one network of twice the size; a stretch's vectors are in memory."""
    total, nothing = len(page), np.zeros((HIDDEN, 4 * HIDDEN))
    wh = both_directions(np.concatenate([w["hf"], nothing]), np.concatenate([nothing, w["hb"]]))
    score, h, c = np.zeros(total), np.zeros(2 * HIDDEN), np.zeros(2 * HIDDEN)
    i, f, o = (slice(2 * k * HIDDEN, 2 * (k + 1) * HIDDEN) for k in range(3))
    for a, _, _, e in windows(total):
        z = both_directions(features(page[a:e], a, total) @ w["xf"],
                            features(page[total - e:total - a], total - e, total)[::-1] @ w["xb"])
        states = np.empty((e - a, 2 * HIDDEN))
        for t in range(e - a):
            g = np.tanh(z[t] + h @ wh)
            s = 0.5 + 0.5 * g[:6 * HIDDEN]
            c = s[f] * c + s[i] * g[6 * HIDDEN:]
            states[t] = h = s[o] * np.tanh(c)
        score[a:e] += states[:, :HIDDEN] @ w["o"][:HIDDEN]
        score[total - e:total - a] += (states[:, HIDDEN:] @ w["o"][HIDDEN:])[::-1]
    return _sigmoid(score + w["c"])


def labelled(w: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability of main text for every block of every page, about ``GROUP`` blocks or a longer page at a time."""
    out = [np.zeros(len(p)) for p in pages]
    held: list[int] = []

    def run() -> None:
        x = [features(pages[i]) for i in held]
        first = np.concatenate([[0], np.cumsum([len(v) for v in x])])
        got = label(w, np.concatenate(x), first)
        for i, s, e in zip(held, first, first[1:]):
            out[i] = got[s:e]
        held.clear()

    size = 0
    for i, page in enumerate(pages):
        if len(page) > GROUP:
            out[i] = labelled_long(w, page)
        elif page:
            if held and size + len(page) > GROUP:
                run()
                size = 0
            held.append(i)
            size += len(page)
    if held:
        run()
    return out


def fit(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 11, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam on the mean log-loss of all blocks, a few dozen pages at a time."""
    rng = np.random.default_rng(seed)
    pieces = [(x[i:i + TRAIN_BLOCKS], y[i:i + TRAIN_BLOCKS]) for x, y in pages for i in range(0, len(x), TRAIN_BLOCKS)]
    w = new_weights(rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for b in range(0, len(pieces), 64):
            some = [pieces[i] for i in order[b:b + 64]]
            x, y = np.concatenate([p[0] for p in some]), np.concatenate([p[1] for p in some])
            first = np.concatenate([[0], np.cumsum([len(p[0]) for p in some])])
            start, size = _order(first)
            ran = {d: run_direction(x @ w[f"x{d}"], w[f"h{d}"], start, size, d == "b") for d in "fb"}
            h = np.concatenate([ran["f"][0], ran["b"][0]], axis=1)
            err = (_sigmoid(h @ w["o"] + w["c"]) - y) / len(y)
            grad = {"o": h.T @ err, "c": np.array([err.sum()])}
            dh = np.outer(err, w["o"])
            for k, d in enumerate("fb"):
                dz, grad[f"h{d}"] = back_direction(dh[:, k * HIDDEN:(k + 1) * HIDDEN], *ran[d], w[f"h{d}"], start, size, d == "b")
                grad[f"x{d}"] = x.T @ dz
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)
    return w


# -- weakly labelled and rebuilt pages -----------------------------------------------------------

# Elements that stand around (or inside) an article; "*" marks where text goes, "+" repeats it.
AROUND = (
    ("nav",), ("nav", "ul", "li+"), ("div.menu", "ul", "li+"), ("div.navbar.navigation", "li+"), ("header",), ("header", "h1"),
    ("header", "p"), ("div.header", "p"), ("footer",), ("footer", "p"), ("div.footer", "p"), ("aside",), ("aside", "p+"),
    ("aside.sidebar", "div.widget", "ul", "li+"), ("div.sidebar", "p+"), ("div.ad",), ("div.ads.advert", "p"),
    ("div.banner.promo", "p"), ("div.sponsored", "p"), ("div.cookie.notice", "p"), ("div.notice",), ("div.alert.message", "p"),
    ("div.consent.banner", "p"), ("form",), ("form", "label"), ("form", "p"), ("form.search", "button"),
    ("form.newsletter.subscribe", "p"), ("div.newsletter", "p"), ("section.comments", "div.comment", "p+"),
    ("div.comments", "ol", "li.comment", "p+"), ("div.comments", "h3"), ("section.comments", "article.comment", "p+"),
    ("ol.commentlist", "li.comment", "p+"), ("div.comment.reply", "p+"), ("div.responses.discussion", "div.comment", "p+"),
    ("div.related", "ul", "li+"), ("section.related", "h2"), ("div.share.social", "ul", "li+"), ("div.tags", "li+"),
    ("div.breadcrumb", "li+"), ("div.copyright",), ("div.popup.modal", "p"), ("div.disclaimer", "p"),
)
INSIDE = (
    ("div.ad",), ("div.ads.advert", "p"), ("aside",), ("aside", "p+"), ("div.share.social", "ul", "li+"), ("div.related", "li+"),
    ("section.comments", "div.comment", "p+"), ("div.comments", "p+"), ("form", "p"), ("div.notice",), ("header", "p"),
    ("footer", "p"), ("nav", "li+"), ("div.sponsored", "p"), ("div.newsletter.subscribe", "p"),
)
HOLDERS = (
    ("article",), ("main",), ("main", "article"), ("div.content",), ("div.main.content",), ("div.post.body",),
    ("article", "div.entry.content"), ("section.article",), ("main", "section"), ("div.article.text",), ("article.post", "section"),
)
OWN = (("p",), ("p",), ("h2",), ("h3",), ("blockquote",), ("blockquote", "p"), ("ul", "li"), ("ul", "li"), ("ol", "li"),
       ("pre",), ("div",), ("table", "tr", "td"), ("figure", "figcaption"))


def _path(*parts: str) -> tuple[str, ...]:
    return tuple(n for p in parts for n in p.rstrip("+").split("."))


def rebuilt(body: list[str], other: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page with this article text and other pages' words around it."""
    def pick(options):
        return options[rng.integers(len(options))]

    def extra(options, base: tuple[str, ...]) -> list[Block]:
        shape = pick(options)
        many = int(rng.integers(2, 7)) if shape[-1].endswith("+") else 1
        out = []
        for _ in range(many):
            words = pick(other).split()
            n = int(rng.integers(1, 40)) if shape[-1].startswith("p") or len(shape) == 1 else int(rng.integers(1, 6))
            s = int(rng.integers(0, max(1, len(words) - n)))
            text = " ".join(words[s:s + n])
            linked = shape[-1].startswith("li") and "comment" not in shape[-1]
            out.append(Block(base + _path(*shape), text, len(text) if linked else 0))
        return out

    base, holder = ("html", "body"), _path(*pick(HOLDERS))
    if rng.random() < 0.4:
        base += pick((("div", "container"), ("div", "wrapper"), ("div",), ("div", "page")))
    found = [Block(("html", "head", "title"), body[0][:60], 0)] if rng.random() < 0.8 else []
    y = [0] * len(found)

    def put(more: list[Block], value: int) -> None:
        found.extend(more)
        y.extend([value] * len(more))

    for _ in range(rng.integers(0, 4)):
        put(extra(AROUND, base), 0)
    if rng.random() < 0.6:
        put([Block(base + holder + ("h1",), body[0][:60], 0)], 1)
    for text in body:
        shape = pick(OWN) if rng.random() < 0.4 else ("p",)
        pieces = [text]
        if shape[-1] in ("li", "td", "h2", "h3"):  # short blocks are main text too
            words = text.split()
            size = int(rng.integers(1, 9))
            pieces = [" ".join(words[i:i + size]) for i in range(0, min(len(words), 4 * size), size)]
        put([Block(base + holder + _path(*shape), piece, 0) for piece in pieces], 1)
        if rng.random() < 0.15:
            put(extra(INSIDE, base + holder), 0)
    if rng.random() < 0.3:
        put(extra(INSIDE, base + holder), 0)
    for _ in range(rng.integers(0, 4)):
        put(extra(AROUND, base), 0)
    return found, y


def training_pages(htmls: list[str], seed: int = 5, variants: int = VARIANTS) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    out, bodies = [], []
    pages = [blocks(html) for html in htmls]
    judge = weak_label if any(weak_label(b) for found in pages for b in found) else long_label
    for found in pages:
        y = [judge(b) for b in found]
        if any(y):
            out.append((features(found), np.array(y, dtype=float)))
            bodies.append([b.text for b, k in zip(found, y) if k][:TRAIN_BLOCKS])
    words = [" ".join(b) for b in bodies]
    for body in bodies:
        for _ in range(variants):
            found, y = rebuilt(body, words, rng)
            out.append((features(found), np.array(y, dtype=float)))
    return out


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    rows = hash_sample(pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")), sample, "page_id")
    found = training_pages([r["html"] for r in rows.filter(F.length("html") <= MAX_HTML).collect()])
    return fit(found) if found else None


def main_texts(column, weights: dict[str, np.ndarray] | None) -> list[str]:
    pages = [blocks(h) for h in column.to_pylist()]
    if weights is None:
        keep = [[bool(weak_label(b)) for b in p] for p in pages]
    else:
        keep = [v >= 0.5 for v in labelled(weights, pages)]
    return ["\n".join(b.text for b, k in zip(p, kept) if k) for p, kept in zip(pages, keep)]


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(weights)

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(part.column(2), held.value)
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return map_texts(rows, fn, "page_id long, url string, text string, n_chars long", text="html")
