"""Main text of web pages by a recurrent block labeller (operator 4).

A page is cut into blocks, the leaf sequence: runs of text between block-level tags. Each block is
described by its tag path (hashed names of the tags above it and of their class, id and role
words), by its hashed words (all of them), and by a few figures (length, share of linked text,
punctuation, place). A bidirectional LSTM in numpy reads the sequence of a whole page in both
directions and gives every block the odds of being main text, so a block is judged in the context
of the document. Blocks that win are the text, in page order.

The labeller is trained at the start of a job, by back-propagation through time, on pages drawn
from a grammar of page layouts (menus, headers, sidebars, adverts, notices, forms, comments,
footers around articles of many shapes), and on a bounded sample of the job's own pages, at most
``sample`` (default 300) that mark their article or main element, labelled by that mark. Marks mustn't
decide alone, as many pages have none: most pages are learnt from a second time in a disguise, in which
article and main, all elements that speak of their content, paragraphs, or all class, id and role words
are lost, while the labels stay; and the paths, words or figures of some blocks are left out.

The fit reads own pages of at most ``most_chars`` characters and ``most_blocks`` blocks (60,000 and 400
by default). All pages are labelled whole; pages are read together up to ``GROUP_BLOCKS`` blocks, so
the memory of a task is bounded by these or by its longest page.
"""

from __future__ import annotations

import html as _html
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm.common import small_batches

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page.
HIDDEN = frozenset("head script style noscript template textarea iframe object svg math canvas audio video select".split())
#: A start tag closes an open element of these names, unless one of the others stands between.
CLOSES = {
    **{t: ({"p"}, {"article", "section", "div", "td", "th", "li", "body"}) for t in BLOCK - {"body", "html", "li", "td", "th", "tr", "option"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}),
    "th": ({"td", "th", "p"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S
)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
GROUP_BLOCKS = 20_000
PATHS, WORDS, FIGURES = 4096, 256, 6
D_PATH, D_WORD, HIDDEN_SIZE = 16, 8, 16


class Block:
    __slots__ = ("text", "path", "tags", "linked", "words")

    def __init__(self, text: str, path: tuple[int, ...], tags: tuple[str, ...], linked: int, words: frozenset[str]):
        self.text, self.path, self.tags, self.linked, self.words = text, path, tags, linked, words


_BUCKETS: dict[str, int] = {}


def _bucket(name: str) -> int:
    if name not in _BUCKETS:
        if len(_BUCKETS) > 50_000:
            _BUCKETS.clear()
        _BUCKETS[name] = zlib.crc32(name.encode()) % PATHS
    return _BUCKETS[name]


def blocks(page: str) -> list[Block]:
    """The leaf sequence of a page."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], tuple[str, ...], frozenset[str]]] = [("", (), (), frozenset())]
    text: list[str] = []
    linked = hidden = anchors = 0
    where: tuple[str, tuple[int, ...], tuple[str, ...], frozenset[str]] | None = None

    def flush() -> None:
        nonlocal linked, where
        if text and where is not None:
            joined = " ".join(_html.unescape("".join(text)).split())
            if joined:
                leaf = where[2][-1] if where[2] else "text"
                out.append(Block(joined, (*where[1], _bucket("leaf:" + leaf)), where[2], linked, where[3]))
        text.clear()
        linked, where = 0, None

    def add(s: str) -> None:
        nonlocal linked, where
        if hidden or not s:
            return
        if where is None and not s.isspace():
            where = next((f for f in reversed(stack) if f[0] in BLOCK or not f[0]), stack[0])
            text.append(s)
        elif where is not None:
            text.append(s)
        if anchors:
            linked += len(s)

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        slash, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if any(f[0] == name for f in stack):
                if name in BLOCK:
                    flush()
                while stack[-1][0] != name:
                    gone = stack.pop()[0]
                    hidden -= gone in HIDDEN
                    anchors -= gone == "a"
                stack.pop()
                hidden -= name in HIDDEN
                anchors -= name == "a"
            elif name == "p":
                flush()
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES:
                close, stop = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in close:
                        for gone, *_ in stack[k:]:
                            hidden -= gone in HIDDEN
                            anchors -= gone == "a"
                        del stack[k:]
                    elif stack[k][0] in stop:
                        break
        if name == "body":  # an unclosed head ends here
            for gone, *_ in stack[1:]:
                hidden -= gone in HIDDEN
                anchors -= gone == "a"
            del stack[1:]
        if name in VOID or attrs.endswith("/") and name in HIDDEN:
            continue
        if name in RAW_END:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        parent = stack[-1]
        own, said = [] if name in ("html", "body") else ["tag:" + name], parent[3]
        if attrs and "=" in attrs:
            for a in ATTR.finditer(attrs):
                found = [w for w in re.split(r"[^a-z0-9]+", (a[2] or a[3] or a[4] or "").lower()) if w]
                own += ["word:" + w for w in found]
                said = said | set(found)
        tags = parent[2] if name in ("html", "body") else (*parent[2], name)
        stack.append((name, (*parent[1], *map(_bucket, own)), tags, said))
        hidden += name in HIDDEN
        anchors += name == "a"
    flush()
    return out


def describe(page: list[Block]) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Path buckets, words and figures of each block; a block of few different words has a short word vector."""
    words = np.zeros((len(page), WORDS), dtype=np.float32)
    figures = np.zeros((len(page), FIGURES), dtype=np.float32)
    for k, b in enumerate(page):
        w = b.text.lower().split()
        got = np.bincount([zlib.crc32(x.encode()) & (WORDS - 1) for x in w], minlength=WORDS)
        seen = got > 0
        words[k] = seen / (seen.sum() + 20)
        n = len(b.text)
        marks = sum(map(b.text.count, ".,;:!?"))
        figures[k] = (np.log1p(n) / 6, np.log1p(len(w)) / 4, min(1.0, b.linked / n), min(1.0, 10 * marks / n), k / len(page), len(b.tags) / 10)
    return [b.path or (0,) for b in page], words, figures


class Labeller:
    """Bidirectional LSTM; p maps names to float32 arrays."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d, h = D_PATH + D_WORD + FIGURES, HIDDEN_SIZE
        self.p = {"path": g(PATHS, D_PATH) * 5, "word": g(WORDS, D_WORD) * 4, "out": g(2 * h, 1), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {way + "x": g(d, 4 * h), way + "h": g(h, 4 * h), way + "b": np.zeros(4 * h, np.float32)}
            self.p[way + "b"][h : 2 * h] = 1

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(pages, steps, features), mask, and what the way back needs."""
        steps = max(len(x[0]) for x in pages)
        paths = [p for x in pages for p in x[0]]
        flat = np.concatenate([np.array(p) for p in paths])
        lens = np.array([len(p) for p in paths])
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        a = np.add.reduceat(self.p["path"][flat], first) / np.sqrt(lens)[:, None].astype(np.float32)
        words = np.concatenate([x[1] for x in pages])
        x = np.concatenate([a, words @ self.p["word"], np.concatenate([x[2] for x in pages])], axis=1)
        row = np.repeat(np.arange(len(pages)), [len(q[0]) for q in pages])
        col = np.concatenate([np.arange(len(q[0])) for q in pages])
        full = np.zeros((len(pages), steps, x.shape[1]), dtype=np.float32)
        full[row, col] = x
        mask = np.zeros((len(pages), steps), dtype=np.float32)
        mask[row, col] = 1
        return full, mask, (row, col, flat, lens, words)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        n, steps, _ = x.shape
        hs = HIDDEN_SIZE
        pre = x @ self.p[way + "x"] + self.p[way + "b"]
        h, c = np.zeros((n, hs), np.float32), np.zeros((n, hs), np.float32)
        out, tape = np.zeros((n, steps, hs), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p[way + "h"]
            i, f, o = (1 / (1 + np.exp(-z[:, k * hs : (k + 1) * hs])) for k in range(3))
            u = np.tanh(z[:, 3 * hs :])
            m = mask[:, t, None]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            if keep:
                tape.append((t, i, f, o, u, c, h, tc))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, t] = h
        return out, tape

    def logits(self, pages: list, keep: bool = False):
        x, mask, extra = self.inputs(pages)
        f, tf = self._run(x, mask, "f", keep)
        b, tb = self._run(x, mask, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return (both @ self.p["out"])[:, :, 0] + self.p["bias"], (x, mask, extra, both, tf, tb)

    def gradients(self, pages: list, y: list[np.ndarray]) -> dict[str, np.ndarray]:
        z, (x, mask, extra, both, tf, tb) = self.logits(pages, keep=True)
        row, col, flat, lens, words = extra
        goal = np.zeros_like(mask)
        goal[row, col] = np.concatenate(y)
        dz = (1 / (1 + np.exp(-z)) - goal) * mask / mask.sum()
        g = {"out": np.einsum("nth,nt->h", both, dz)[:, None], "bias": np.array([dz.sum()], np.float32)}
        dboth, hs = dz[:, :, None] * self.p["out"][:, 0], HIDDEN_SIZE
        dx = np.zeros_like(x)
        for way, tape, dout in (("f", tf, dboth[:, :, :hs]), ("b", tb, dboth[:, :, hs:])):
            wh, wx = self.p[way + "h"], self.p[way + "x"]
            g |= {way + "h": np.zeros_like(wh), way + "x": np.zeros_like(wx), way + "b": np.zeros(4 * hs, np.float32)}
            dh, dc = np.zeros((len(x), hs), np.float32), np.zeros((len(x), hs), np.float32)
            for t, i, f, o, u, c, h, tc in reversed(tape):
                m = mask[:, t, None]
                dh = dh + dout[:, t]
                a = dh * m
                dc2 = a * o * (1 - tc * tc) + dc * m
                dzz = np.concatenate([dc2 * u * i * (1 - i), dc2 * c * f * (1 - f), a * tc * o * (1 - o), dc2 * i * (1 - u * u)], axis=1)
                g[way + "h"] += h.T @ dzz
                g[way + "x"] += x[:, t].T @ dzz
                g[way + "b"] += dzz.sum(axis=0)
                dx[:, t] += dzz @ wx.T
                dh, dc = dzz @ wh.T + dh * (1 - m), dc2 * f + dc * (1 - m)
        flat_dx = dx[row, col]
        da = flat_dx[:, :D_PATH] / np.sqrt(lens)[:, None]
        g["path"] = np.zeros_like(self.p["path"])
        np.add.at(g["path"], flat, np.repeat(da, lens, axis=0))
        g["word"] = words.T @ flat_dx[:, D_PATH : D_PATH + D_WORD]
        return g

    def fit(self, pages: list, y: list[np.ndarray], epochs: int = 8, batch: int = 64, rate: float = 0.01) -> None:
        r, m, v, t = np.random.default_rng(9), {}, {}, 0
        sizes = np.array([len(p[0]) for p in pages])
        for _ in range(epochs):
            order = np.argsort(sizes + r.random(len(sizes)) * 6, kind="stable")
            for k in r.permutation(range(0, len(order), batch)):
                at = order[k : k + batch]
                t += 1
                for name, g in self.gradients([pages[i] for i in at], [y[i] for i in at]).items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                    if name == "word":  # words are the weaker evidence; page layouts carry over, vocabularies don't
                        g = g + 2e-4 * self.p[name]
                    step = rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
                    self.p[name] = (self.p[name] - step).astype(np.float32)

    def main_blocks(self, pages: list[list[Block]]) -> list[list[bool]]:
        """For each page which of its blocks are main text; pages of like length are read together."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            longest, end, held = len(pages[order[at]]), at, 0
            while end < len(order) and end - at < 256 and len(pages[order[end]]) <= longest * 1.3 + 4:
                held = (end - at + 1) * len(pages[order[end]])
                if end > at and held > GROUP_BLOCKS:
                    break
                end += 1
            z, _ = self.logits([describe(pages[k]) for k in order[at:end]])
            for i, k in enumerate(order[at:end]):
                out[k] = (z[i, : len(pages[k])] > 0).tolist()
            at = end
        return out


# --- pages to learn from -------------------------------------------------------------------------------------------

_MARK = "\ue000"
_MAIN = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>',
    '<div class="post-content entry">{}</div>', '<div id="main"><div class="article-body">{}</div></div>', '<section class="story">{}</section>',
    '<div id="content" class="post">{}</div>', '<div class="page"><div class="text">{}</div></div>', '<div itemprop="articleBody" class="body">{}</div>',
)
_MENU = ('<nav><ul>{}</ul></nav>', '<div class="menu"><ul>{}</ul></div>', '<ul id="navigation">{}</ul>', '<div class="breadcrumbs">{}</div>', '<header><nav>{}</nav></header>')
_PROSE = (
    '<div class="ad">{}</div>', '<div class="advert banner">{}</div>', '<div id="ad-top">{}</div>', '<aside class="sponsored">{}</aside>',
    '<div class="cookie-notice">{}</div>', '<div class="notice alert">{}</div>', '<div id="cookie-banner" role="dialog">{}</div>',
    '<div class="consent popup">{}</div>', '<aside>{}</aside>', '<div class="sidebar widget">{}</div>', '<div id="sidebar">{}</div>',
    '<div class="newsletter subscribe">{}</div>', '<div class="promo">{}</div>', '<div class="related">{}</div>', '<div class="share social">{}</div>',
    '<div class="disclaimer">{}</div>', '<div class="banner">{}</div>',
)
_HEAD = ('<header>{}</header>', '<div class="header">{}</div>', '<div id="masthead" class="site-header">{}</div>', '<header class="top"><div class="logo">{}</div></header>')
_FOOT = ('<footer>{}</footer>', '<div class="footer">{}</div>', '<div id="footer" class="site-footer">{}</div>', '<footer><p>{}</p></footer>')
_COMMENTS = (
    ('<div class="comments">{}</div>', '<div class="comment"><p>{}</p></div>'), ('<section id="comments"><h3>{}</h3></section>', '<p>{}</p>'),
    ('<ol class="comment-list">{}</ol>', '<li class="comment"><span>{}</span></li>'), ('<div id="disqus" class="discussion">{}</div>', '<div class="reply">{}</div>'),
    ('<section class="user-comments">{}</section>', '<article class="comment"><p>{}</p></article>'),
)
_FORM = ('<form action="/s"><label>{}</label><input name="q"><button>{}</button></form>', '<form class="login"><p>{}</p><label>{}</label></form>', '<div class="search"><form><input><button>{}</button></form>{}</div>')
_SAID = {
    "head": "home news site search welcome login".split(), "foot": "© copyright all rights reserved contact privacy terms imprint".split(),
    "notice": "cookies we use accept this site subscribe newsletter sign advertisement sponsored buy now offer share follow".split(),
}


def _invented(n: int = 6_000) -> list[str]:
    """Words of one to four syllables."""
    syl = ["an", "be", "chi", "do", "er", "fa", "gu", "ha", "in", "jo", "ka", "lu", "mé", "no", "ö", "pra", "qu", "re", "st", "tion", "ü", "ve", "wa", "y", "zu", "ñ"]
    r = np.random.default_rng(17)
    return ["".join(syl[k] for k in row[:size]) for row, size in zip(r.integers(0, len(syl), (n, 4)).tolist(), r.integers(1, 5, n).tolist())]


_WORDS = _invented()


def _prose(r: np.random.Generator, words: int, say: list[str] | None = None) -> str:
    w = [_WORDS[k] for k in r.integers(0, len(_WORDS), words).tolist()]
    manner = r.random()
    if manner < 0.05:  # signs between or behind the words, as in tables of figures and in junk
        signs = r.choice(list("%*#$/|=+~^"), size=int(r.integers(1, 4)))
        w = [x + "".join(r.choice(signs, size=int(r.integers(1, 4)))) for x in w]
    elif manner < 0.09:
        w = (w[: int(r.integers(1, 4))] * len(w))[: len(w)]
    elif manner < 0.12:
        w = [x.upper() for x in w]
    elif manner < 0.16:
        w = [str(int(r.integers(0, 10_000))) if r.random() < 0.5 else x for x in w]
    marks = (0.0, 0.12, 0.25)[int(r.integers(3))]
    drawn = r.random((len(w), 2))
    for k in np.flatnonzero(drawn[:, 0] < 0.25) if say else ():
        w[k] = say[int(r.integers(len(say)))]
    for k in np.flatnonzero(drawn[:, 1] < marks):
        w[k] += ",.;!?"[int(r.integers(5))]
    return (" ".join(w)).capitalize() + ("." if r.random() < 0.75 else "")


def sample_page(r: np.random.Generator) -> str:
    """A page from the layout grammar; main text begins with a mark."""
    pick = lambda s: s[int(r.integers(len(s)))]
    n = lambda lo, hi: int(r.integers(lo, hi + 1))
    links = lambda: "".join(f'<li><a href="/{k}">{_prose(r, n(1, 3))}</a></li>' for k in range(n(3, 9)))
    prose = lambda: pick(_PROSE).format(f"<p>{_prose(r, n(2, 40), _SAID['notice'] if r.random() < 0.6 else None)}</p>" if r.random() < 0.4 else _prose(r, n(2, 40), _SAID["notice"] if r.random() < 0.6 else None))
    body: list[str] = []
    if r.random() < 0.85:
        body.append(f"<h{n(1, 2)}>{_MARK}{_prose(r, n(2, 14))}</h1>")
    for k in range(n(1, 3) if r.random() < 0.3 else n(1, 16)):
        t = _MARK + _prose(r, n(1, 12) if r.random() < 0.25 else n(12, 90))
        shape = r.random()
        if shape < 0.60:
            body.append(f"<p>{t}</p>" if r.random() < 0.9 else f"<p>{t}")
        elif shape < 0.66:
            body.append(f"<p><{(b := pick(('b', 'i', 'em', 'strong', 'span')))}>{t}</{b}></p>")
        elif shape < 0.72:
            body.append(f"<h{n(2, 4)}>{_MARK}{_prose(r, n(1, 8))}</h2>")
        elif shape < 0.77:
            body.append(pick(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f"<li>{_MARK}{_prose(r, n(2, 20))}</li>" for _ in range(n(2, 7)))))
        elif shape < 0.80:
            body.append(f"<blockquote><p>{t}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{t}</blockquote>")
        elif shape < 0.85:
            body.append(f'<p>{t} <a href="/x">{_prose(r, n(1, 4))}</a> {_prose(r, n(2, 20))}</p>')
        elif shape < 0.89:
            cells = lambda tag: "".join(f"<{tag}>{_MARK}{_prose(r, n(1, 4))}</{tag}>" for _ in range(n(2, 4)))
            body.append("<table>" + f"<tr>{cells('th')}</tr>" * (r.random() < 0.6) + "".join(f"<tr>{cells('td')}</tr>" for _ in range(n(1, 5))) + "</table>")
        elif shape < 0.92:
            body.append(f"<pre>{t}</pre>" if r.random() < 0.6 else f"<pre><code>{t}</code></pre>")
        elif shape < 0.95:
            body.append(f"<figure><img src='x'><figcaption>{_MARK}{_prose(r, n(2, 14))}</figcaption></figure>")
        else:
            body.append(f"<div>{t}</div>")
        if r.random() < 0.04:
            body.append(prose())
    comments = ""
    if r.random() < 0.4:
        outer, one = pick(_COMMENTS)
        comments = outer.format("".join(one.format(_prose(r, n(3, 60))) for _ in range(n(1, 6))))
    inside = r.random() < 0.3
    main = pick(_MAIN).format("".join(body) + (comments if inside else ""))
    before, after = [], []
    if r.random() < 0.5:
        before.append(pick(_HEAD).format(_prose(r, n(1, 12), _SAID["head"])))
    if r.random() < 0.85:
        before.append(pick(_MENU).format(links()))
    for _ in range(n(0, 3)):
        (before if r.random() < 0.6 else after).append(prose())
    if r.random() < 0.3:
        (before if r.random() < 0.5 else after).append(pick(_FORM).format(_prose(r, n(1, 5)), _prose(r, n(1, 3))))
    if r.random() < 0.3:
        (before if r.random() < 0.3 else after).append(f'<aside><ul>{links()}</ul></aside>' if r.random() < 0.5 else f'<div class="sidebar"><ul>{links()}</ul></div>')
    if comments and not inside:
        after.append(comments)
    if r.random() < 0.85:
        after.append(pick(_FOOT).format(_prose(r, n(2, 30), _SAID["foot"])))
    wrap = "<div class=\"wrapper\">{}</div>" if r.random() < 0.3 else "{}"
    return f"<!DOCTYPE html><html><head><title>{_prose(r, 5)}</title></head><body>{wrap.format(''.join([*before, main, *after]))}</body></html>"


#: Tags and class words that mark what isn't main text inside an article or main element.
_OTHER_TAGS = frozenset("nav aside footer form button header".split())
_OTHER_WORDS = frozenset(
    "ad ads advert advertisement banner cookie notice comment comments comments reply sidebar menu nav newsletter promo related share social sponsored widget".split()
)


def own_labels(page: list[Block]) -> np.ndarray | None:
    """Labels from the page's own article or main element; None where it has none."""
    if not any("article" in b.tags or "main" in b.tags for b in page):
        return None
    return np.array(
        [("article" in b.tags or "main" in b.tags) and not _OTHER_TAGS & set(b.tags) and not _OTHER_WORDS & b.words for b in page], dtype=np.float32
    )


_MAIN_TAG = re.compile(r"<(/?)(?:article|main)(?=[\s>])", re.I)
_SPEAKING_TAG = re.compile(r"<(/?)(?:article|main|nav|aside|header|footer|section)(?=[\s>])", re.I)
_SAID_WORDS = re.compile(r"\s(?:class|id|role|itemprop)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PARAGRAPH = re.compile(r"<(/?)p(?=[\s>])", re.I)
_NAMES = ("", "", "", ' class="c1"', ' class="col"', ' id="b"', ' class="box wide"', ' class="x7 y2"')


def disguised(page: str, r: np.random.Generator) -> str:
    """A page with the same blocks that says less of what they are."""
    div = lambda m: f"<{m[1]}div" + ("" if m[1] else _NAMES[int(r.integers(len(_NAMES)))])
    if r.random() < 0.35:
        page = _PARAGRAPH.sub(div, page)
    way = r.random()
    if way < 0.45:
        return _MAIN_TAG.sub(div, page)
    if way < 0.60:
        return _SPEAKING_TAG.sub(div, page)
    if way < 0.80:
        return _SAID_WORDS.sub("", page)
    return _SAID_WORDS.sub("", _SPEAKING_TAG.sub(div, page))


def _run_of_blocks(html: str, page: list[Block], most: int) -> bytes | None:
    """At most ``most`` consecutive blocks of a long page as a lesson, from a place that the page's hash gives."""
    labels = own_labels(page)
    if labels is None:
        return None
    begin = zlib.crc32(html.encode("utf-8", "surrogatepass")) % max(1, len(page) - most + 1)
    paths, words, figures = describe(page[begin : begin + most])
    figures[:, 4] = (begin + np.arange(len(paths))) / len(page)  # their places in the whole page
    return pickle.dumps((paths, np.packbits(words > 0, axis=1), figures, labels[begin : begin + most]))


def _lessons(most_chars: int, most_blocks: int):
    """Pages to learn from: html where it is short, a run of blocks where it isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, runs = [], []
            for h in b.column("html").to_pylist():
                page = blocks(h)
                short = len(h) <= most_chars and len(page) <= most_blocks
                whole.append(h if short else None)
                runs.append(None if short else _run_of_blocks(h, page, most_blocks))
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(whole, pa.string()), pa.array(runs, pa.binary())], names=["at", "html", "run"])

    return run


def train(own_pages: list[str], drawn: int = 500, seed: int = 3, runs: Iterable[bytes] = ()) -> Labeller:
    r = np.random.default_rng(seed)
    x, y = [], []

    def learn(page: list[Block], labels: np.ndarray, html: str) -> None:
        x.append(describe(page))
        y.append(labels)
        if r.random() < 0.8:
            other = blocks(disguised(html, r).replace(_MARK, ""))
            if [b.text for b in other] == [b.text for b in page]:
                x.append(describe(other))
                y.append(labels)

    for _ in range(drawn):
        html = sample_page(r)
        page = blocks(html)
        labels = np.array([_MARK in b.text for b in page], dtype=np.float32)
        for b in page:
            b.text = b.text.replace(_MARK, "")
        if page and all(b.text for b in page):
            learn(page, labels, html)
    for h in own_pages:
        page = blocks(h)
        labels = own_labels(page)
        if labels is not None:
            learn(page, labels, h)
    for lesson in runs:
        paths, bits, figures, labels = pickle.loads(lesson)
        seen = np.unpackbits(bits, axis=1, count=WORDS).astype(np.float32)
        x.append((paths, seen / (seen.sum(axis=1, keepdims=True) + 20), figures))
        y.append(labels)
    for k, (paths, words, figures) in enumerate(x):  # some blocks without words, figures or path: the rest and the context must do
        words[r.random(len(words)) < 0.3] = 0
        figures[r.random(len(figures)) < 0.15] = 0
        lost = r.random(len(paths)) < 0.1
        x[k] = ([p[-1:] if gone else p for p, gone in zip(paths, lost)], words, figures)
    model = Labeller()
    model.fit(x, y)
    return model


def _extract(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller()
        model.p = weights
        for b in batches:
            pages = [blocks(h) for h in b.column("html").to_pylist()]
            texts = ["\n".join(x.text for x, k in zip(p, keep) if k) for p, keep in zip(pages, model.main_blocks(pages))]
            cols = [b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "n_chars"])

    return run


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = 300, most_chars: int = 60_000,
    most_blocks: int = 400,
) -> DataFrame:
    """One row for each row of ``pages``: id, url, text, n_chars.

    The labeller learns from ``sample`` own pages, drawn by a hash from all that have an article or
    main element; of a page of more than ``most_chars`` characters or ``most_blocks`` blocks it learns from
    a run of ``most_blocks`` blocks, cut where the page lies. The text is extracted from every page, whole.

    Defined cases: null or empty HTML gives empty text; so does a page without main text. Broken
    markup is read as it stands (unclosed tags end with their parents). A very long page is read
    whole. Null ids and urls, repeated ids and repeated rows are carried on. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    small_batches(spark, 300)
    base = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    n = base.count()
    share = min(1.0, 4 * sample / max(n, 1))
    at = F.pmod(F.xxhash64("html"), F.lit(1 << 30)) / float(1 << 30)
    marked = base.filter(F.col("html").rlike("(?i)<(article|main)[ >]")).select(at.alias("at"), "html").filter(F.col("at") <= share)
    lessons = marked.mapInArrow(_lessons(most_chars, most_blocks), "at double, html string, run binary").filter("html is not null or run is not null")
    own = lessons.orderBy("at", "html", "run").limit(sample).collect()
    weights = train([r.html for r in own if r.html is not None], runs=[bytes(r.run) for r in own if r.run is not None]).p
    out = base.mapInArrow(_extract(weights), "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
