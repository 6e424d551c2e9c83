"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags, each with its chain of open elements.  Features are the ancestors' tags
and the words of their class, id and role, and the text's length, links,
punctuation and place.  The model has two labels, main text and the rest;
it is trained by maximum likelihood on labelled pages and decoded by Viterbi.

Labelled pages are composed: layouts with articles, menus, adverts, notices,
forms, sidebars, comments and footers in many spellings are filled with blocks of
text from at most TRAIN_PAGES pages of the given table, so every label is known.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import adam, hashed_head
from .textkit import documents

TRAIN_PAGES = 200
LAYOUTS = 500
#: Blocks of a training page and characters of a block that layouts are composed of.
TRAIN_BLOCKS, TRAIN_CHARS = 40, 2000
STEPS, RATE, DECAY = 120, 0.15, 1e-3
REST, MAIN = 0, 1

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td tfoot th thead title tr ul button textarea label".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
DARK_TAGS = frozenset("script style template noscript iframe svg math object canvas audio video head title textarea select noframes".split())
#: Dark elements whose content is not markup either, up to their end tag.
RAW_TAGS = frozenset("script style textarea title iframe noframes noscript".split())
#: A start tag closes these open elements (up to the nearest list, table or section).
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol dl table div section article main body select menu aside nav header footer form".split())
#: Block elements that a head cannot hold.
BODY_TAGS = BLOCK_TAGS - {"head", "title", "html"}
CLOSES_P = BLOCK_TAGS - {"button", "label", "option", "select", "textarea", "optgroup", "title", "head", "caption", "legend"}

#: A tag without any '<' inside, the usual case; a failed match reads no further than the next '<'.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)([^<>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+)*+)>""")
_NAME_END = re.compile(r"[\s/>]")
_STOP = re.compile(r"[>\"']")
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW_TAGS}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Numbers of a character reference that are longer than any code point's.
_ZEROS, _LARGE = re.compile(r"&#0{9,}+"), re.compile(r"&#(0*[1-9][0-9]{7})[0-9]++")


@dataclass(eq=False, slots=True)
class Path:
    """An open element that counts (a block element, or one with class, id or role),
    below ``parent``: what it adds to the features of the elements around it, and the
    tags of the nearest two block elements.  Paths share their parents."""

    parent: Path | None = None
    fresh: tuple[str, ...] = ()
    leaf: str = ""
    above: str = ""

    def own(self) -> tuple[str, str]:
        return f"leaf={self.leaf}", f"above={self.above}"


@dataclass
class Block:
    text: str
    path: Path
    linked: int = 0  # characters inside links


class _Scanner:
    """Finds the markup of a page from left to right in linear time.

    Whether a tag that starts at some place ends, and where, depends only on the next
    quote or '>' outside quotes.  A quote from which no end was found is remembered, so
    no stretch of the page is read again for each '<' before it."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.near = {_STOP: (0, -1), _NAME_END: (0, -1)}  # place searched from, place found

    def _next(self, what: re.Pattern, at: int) -> int:
        start, found = self.near[what]
        if not start <= at <= found:
            m = what.search(self.page, at)
            found = m.start() if m else len(self.page)
            self.near[what] = at, found
        return found

    def _end(self, at: int) -> int:
        """Place of the '>' that ends a tag whose attributes start at ``at``, or -1."""
        page, size, trail = self.page, len(self.page), []
        stop = self._next(_STOP, at)
        while stop < size and page[stop] != ">":
            close = -1 if stop in self.dead else page.find(page[stop], stop + 1)
            trail.append(stop)
            if close < 0:
                stop = size
                break
            m = _STOP.search(page, close + 1)
            stop = m.start() if m else size
        if stop < size:
            return stop
        self.dead.update(trail)
        return -1

    def markup(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """The next markup from ``at`` on: its start and end, and of a tag the name,
        whether it is an end tag, and the attributes.  A '<' that starts nothing is text."""
        page, size = self.page, len(self.page)
        start = page.find("<", at)
        while 0 <= start < size - 1:
            m = _TAG.match(page, start)
            if m:
                return start, m.end(), m[2].lower(), m[1] != "", m[3]
            if page[start + 1] in "!?":
                for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                    if page.startswith(opening, start):
                        end = page.find(ending, start + len(opening))
                        return start, size if end < 0 else end + len(ending), None, False, ""
                # quotes do not count here: the next '>' ends it
                end = page.find(">", start) if start < self.last else -1
                if end >= 0:
                    return start, end + 1, None, False, ""
            else:
                name = start + 1 + (page[start + 1] == "/")
                if page[name : name + 1].isascii() and page[name : name + 1].isalpha():
                    after = self._next(_NAME_END, name + 1)
                    end = self._end(after)
                    if end >= 0:
                        return start, end + 1, page[name:after].lower(), name > start + 1, page[after:end]
            start = page.find("<", start + 1)
        return size, size, None, False, ""

    @cached_property
    def last(self) -> int:
        return self.page.rfind(">")


def _plain(text: str) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    if len(text) > 4000:  # Python refuses to read numbers of that many digits
        text = _LARGE.sub(r"&#\1", _ZEROS.sub("&#0", text))
    return " ".join(html.unescape(text).split())


class _Open:
    """The open elements, with the places of each tag, of scopes and of dark elements."""

    def __init__(self):
        self.stack: list[tuple[str, Path]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes, self.dark = [-1], [-1]
        self.root, self.present = Path(), set()

    def path(self) -> Path:
        return self.stack[-1][1] if self.stack else self.root

    def nearest(self, tags) -> int:
        found = -1
        for tag in tags:
            places = self.places.get(tag)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        above, at = self.path(), len(self.stack)
        path, block = above, tag in BLOCK_TAGS
        if block or names:
            fresh = tuple([f for f in dict.fromkeys([f"in={tag}", *[f"name={w}" for w in names]]) if f not in self.present])
            self.present.update(fresh)
            path = Path(above, fresh, tag, above.leaf) if block else Path(above, fresh, above.leaf, above.above)
        self.stack.append((tag, path))
        self.places.setdefault(tag, []).append(at)
        if tag in SCOPES:
            self.scopes.append(at)
        if tag in DARK_TAGS:
            self.dark.append(at)

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, path = self.stack.pop()
            if path is not self.path():
                self.present.difference_update(path.fresh)
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            if tag in DARK_TAGS:
                self.dark.pop()


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space normalised, without empty ones.  Time
    and memory are linear in the page's length, whatever it holds."""
    out: list[Block] = []
    opened, scanner = _Open(), _Scanner(page)
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = _plain("".join(parts))
            if text:
                out.append(Block(text, opened.path(), linked))
            parts.clear()
        linked = 0

    def pop(to: int):
        if any(opened.stack[i][0] in BLOCK_TAGS for i in range(to, len(opened.stack))):
            flush()
        opened.pop(to)

    at, size = 0, len(page)
    while at < size:
        start, end, tag, ending, attributes = scanner.markup(at)
        if start > at and opened.dark[-1] < 0:
            parts.append(page[at:start])
            if opened.places.get("a"):
                linked += start - at
        at = end
        if tag is None:
            continue
        if ending:
            if opened.places.get(tag):
                pop(opened.places[tag][-1])
            continue
        if tag in VOID_TAGS:
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag == "body" or tag in BODY_TAGS:  # </head> may be left out
            near = opened.dark[-1]
            if near >= 0 and opened.stack[near][0] == "head":
                pop(near)
        if tag in BLOCK_TAGS:
            flush()
            near = opened.nearest(("p",))
            if tag in CLOSES_P and near > opened.scopes[-1]:
                pop(near)
            if tag in CLOSES:
                near = opened.nearest(CLOSES[tag])
                if near > (opened.nearest(("table",)) if tag in ("tr", "td", "th") else opened.scopes[-1]):
                    pop(near)
        if attributes.rstrip().endswith("/"):
            continue
        if tag in RAW_TAGS:
            m = _RAW_END[tag].search(page, at)
            at = m.end() if m else size
            continue
        opened.push(tag, () if not attributes else tuple(w for g in _NAMES.findall(attributes) for w in _NAME_PART.findall(_CAMEL.sub(" ", g[0] or g[1] or g[2]).lower())))
    flush()
    return out


def path_features(path: Path) -> list[str]:
    """Ancestors' tags and name words; the nearest block element counts apart."""
    found, at = [], path
    while at is not None:
        found.extend(at.fresh)
        at = at.parent
    return [*sorted(found), *path.own()]


def text_features(block: Block, place: int, total: int) -> list[str]:
    t = block.text
    n = len(t)
    words = t.count(" ") + 1
    share = min(1.0, block.linked / n)
    return [
        "bias", f"words={min(8, words.bit_length())}", f"links={int(4 * share)}", f"stops={min(4, t.count('.') + t.count('!') + t.count('?'))}",
        f"ends={t[-1] in '.!?:'}", f"commas={min(3, t.count(','))}", f"upper={t[0].isupper()}", f"copyright={'©' in t}", f"digits={min(3, 10 * sum(map(str.isdigit, t)) // n)}",
        f"marks={any(c in t for c in '|»›•')}", f"first={place < 2}", f"last={place >= total - 2}",
    ]


@dataclass(frozen=True)
class Model:
    weights: dict[str, tuple[float, float]]
    start: tuple[float, float]
    step: tuple[tuple[float, float], tuple[float, float]]


def _path_sums(weights: dict[str, tuple[float, float]], path: Path, known: dict[Path, tuple[float, float]]) -> tuple[float, float]:
    """Weights of the tags and names of a path, added to the sums of its parent."""
    chain = []
    while path is not None and path not in known:
        chain.append(path)
        path = path.parent
    x, y = known[path] if path is not None else (0.0, 0.0)
    for path in reversed(chain):
        for f in path.fresh:
            a, b = weights.get(f, (0.0, 0.0))
            x, y = x + a, y + b
        known[path] = x, y
    return x, y


def decode(model: Model, blocks: list[Block]) -> list[int]:
    """The likeliest labels of a page's blocks."""
    weights, none, known = model.weights, (0.0, 0.0), {}
    total, back = len(blocks), []
    (a0, a1), ((s00, s01), (s10, s11)) = model.start, model.step
    for i, block in enumerate(blocks):
        e0, e1 = _path_sums(weights, block.path, known)
        for f in block.path.own():
            x, y = weights.get(f, none)
            e0, e1 = e0 + x, e1 + y
        for f in text_features(block, i, total):
            x, y = weights.get(f, none)
            e0, e1 = e0 + x, e1 + y
        if i:
            from0, from1 = a0 + s00 >= a1 + s10, a0 + s01 > a1 + s11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a0, a1 = max(a0 + s00, a1 + s10) + e0, max(a0 + s01, a1 + s11) + e1
        else:
            a0, a1 = a0 + e0, a1 + e1
    if not total:
        return []
    labels = [int(a1 > a0)]
    for pair in reversed(back):
        labels.append(pair[labels[-1]])
    return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Maximum likelihood with an L2 term; forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows, cols, size = [], [], [len(b) for b, _ in pages]
    places = np.cumsum([0, *size])
    for (blocks, _), at in zip(pages, places, strict=False):
        for i, b in enumerate(blocks):
            for f in {*path_features(b.path), *text_features(b, i, len(blocks))}:
                rows.append(at + i)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    n, k, most, count = int(places[-1]), len(names), max(size), len(pages)
    gold = np.concatenate([np.array(y) for _, y in pages])
    where = np.full((count, most), -1)
    for i, s in enumerate(size):
        where[i, :s] = np.arange(places[i], places[i + 1])
    live = where >= 0
    first, gold_step = np.zeros(2), np.zeros((2, 2))
    np.add.at(first, gold[places[:-1]], 1)
    both = np.setdiff1d(np.arange(1, n), places[1:-1])
    np.add.at(gold_step, (gold[both - 1], gold[both]), 1)
    one_hot = np.eye(2)[gold]

    def gradient(v):
        w, start, step = v[: 2 * k].reshape(k, 2), v[2 * k : 2 * k + 2], v[2 * k + 2 :].reshape(2, 2)
        emit = np.stack([np.bincount(rows, w[cols, c], n) for c in (0, 1)], 1)
        e = np.where(live[..., None], emit[where], 0.0)
        alpha = np.zeros((count, most, 2))
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, most):
            x = alpha[:, t - 1, :, None] + step
            alpha[:, t] = np.where(live[:, t, None], np.logaddexp(x[:, 0], x[:, 1]) + e[:, t], alpha[:, t - 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta = np.zeros((count, most, 2))
        expect_step = np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            x = step + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            on = live[:, t + 1]
            beta[:, t] = np.where(on[:, None], np.logaddexp(x[..., 0], x[..., 1]), beta[:, t + 1])
            expect_step += np.exp(alpha[on, t, :, None] + x[on] - total[on, None, None]).sum(0)
        chance = np.exp(alpha + beta - total[:, None, None])
        miss = np.zeros((n, 2))
        miss[where[live]] = chance[live]
        miss -= one_hot
        g = np.stack([np.bincount(cols, miss[rows, c], k) for c in (0, 1)], 1) / count + decay * w
        return np.concatenate([g.ravel(), (chance[:, 0].sum(0) - first) / count, ((expect_step - gold_step) / count).ravel()])

    v = adam(gradient, np.zeros(2 * k + 6), steps, rate)
    w = v[: 2 * k].reshape(k, 2).tolist()
    step = v[2 * k + 2 :].reshape(2, 2).tolist()
    return Model({f: tuple(w[i]) for f, i in names.items()}, tuple(v[2 * k : 2 * k + 2].tolist()), (tuple(step[0]), tuple(step[1])))


# Layouts: wrappers as (tag, attributes), to be filled with blocks of text.
_MAIN = [("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="post-content"'), ("div", 'class="entry-content"'),
         ("div", 'class="article-body"'), ("section", 'class="post"'), ("div", 'class="story"'), ("div", 'role="main"'), ("article", 'class="post"'), ("div", 'class="text"'),
         ("div", ""), ("section", ""), ("td", ""), ("article", 'id="article"'), ("div", 'itemprop="articleBody"')]
_MENU = [("nav", ""), ("div", 'class="menu"'), ("div", 'id="navbar"'), ("div", 'class="navigation"'), ("ul", 'class="nav"'), ("div", 'class="breadcrumbs"'), ("div", 'role="navigation"'),
         ("div", 'class="pagination"'), ("div", 'class="tags"'), ("div", 'class="share social"')]
_HEAD = [("header", ""), ("div", 'class="header"'), ("div", 'id="masthead"'), ("div", 'role="banner"'), ("div", 'class="top-bar"'), ("header", 'class="site-header"')]
_FOOT = [("footer", ""), ("div", 'class="footer"'), ("div", 'id="footer"'), ("div", 'class="site-footer copyright"'), ("div", 'role="contentinfo"')]
_AD = [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="advertisement"'), ("div", 'id="ad-banner"'), ("aside", 'class="promo"'), ("div", 'class="sponsored"'),
       ("section", 'class="promotion"'), ("ins", 'class="adsense ad-slot"')]
_SIDE = [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="related"'), ("section", 'class="related-posts"'), ("div", 'class="widget"'), ("aside", 'class="side"'),
         ("div", 'role="complementary"'), ("div", 'class="recommended"')]
_NOTICE = [("div", 'class="cookie-notice"'), ("div", 'id="cookie-banner"'), ("div", 'class="consent"'), ("div", 'class="notice"'), ("div", 'class="alert"'), ("div", 'role="alert"'),
           ("div", 'role="dialog"'), ("div", 'class="popup modal"'), ("div", 'class="gdpr"'), ("section", 'class="notification"'), ("dialog", ""), ("div", 'class="disclaimer"')]
_FORM = [("form", ""), ("form", 'class="subscribe"'), ("div", 'class="newsletter"'), ("form", 'class="search"'), ("div", 'class="login"'), ("form", 'id="contact"')]
_COMMENT = [("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment-list"'), ("ol", 'class="commentlist"'), ("section", 'id="discussion"'), ("div", 'class="responses replies"'),
            ("section", 'class="reader-comments"'), ("div", 'class="user-comments"'), ("div", 'class="reviews"')]


def labelled_pages(texts: list[str], layouts: int = LAYOUTS, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Composed pages: blocks and labels.  ``texts`` are blocks of running text."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["A plain sentence of some length, for want of a better one.", "And another one."]
    pick = lambda of: of[int(rng.integers(len(of)))]
    mark = {MAIN: "\ue001", REST: "\ue000"}  # carried in the text to give each block its label, then taken out

    def say(label, short=False):
        t = pick(texts)
        if short:
            w = t.split()
            t = " ".join(w[: int(rng.integers(1, 9))])
        return mark[label] + html.escape(t)

    def wrap(kind, inner):
        tag, attributes = kind
        return f"<{tag}{' ' * bool(attributes)}{attributes}>{inner}</{tag}>"

    def items(n, linked=True):
        link = (lambda x: f'<a href="/x">{x}</a>') if linked else (lambda x: x)
        return "<ul>" + "".join(f"<li>{link(say(REST, True))}</li>" for _ in range(n)) + "</ul>"

    def paragraph(label, short=False):
        t = say(label, short)
        if rng.random() < 0.2:
            t = f"{t[0]}<b>{t[1:]}</b>" if rng.random() < 0.5 else f"{t}<br>"
        elif rng.random() < 0.15:
            t = f'{t[0]}<a href="/y">{t[1:9]}</a>{t[9:]}'
        return f"<p>{t}" if rng.random() < 0.08 else f"<p>{t}</p>"

    def aside(kinds):
        kind = pick(kinds)
        if kinds is _COMMENT:
            each = pick([("div", 'class="comment"'), ("li", ""), ("article", 'class="comment"'), ("div", "")])
            body = "".join(wrap(each, (f"<h4>{say(REST, True)}</h4>" if rng.random() < 0.5 else "") + paragraph(REST)) for _ in range(int(rng.integers(1, 6))))
            return wrap(kind, (f"<h3>{say(REST, True)}</h3>" if rng.random() < 0.6 else "") + body)
        if kinds is _FORM:
            return wrap(kind, f"<label>{say(REST, True)}</label><input name='q'><button>{say(REST, True)}</button>" + (paragraph(REST, True) if rng.random() < 0.5 else ""))
        if kinds is _MENU:
            return wrap(kind, items(int(rng.integers(2, 8))))
        if kinds is _FOOT:
            return wrap(kind, (mark[REST] + "&copy; example.com &middot; " + html.escape(pick(texts)[:60])) if rng.random() < 0.6 else paragraph(REST, rng.random() < 0.6) + items(3))
        if kinds is _HEAD:
            return wrap(kind, (f"<div>{say(REST, True)}</div>" if rng.random() < 0.5 else paragraph(REST, True)) + (aside(_MENU) if rng.random() < 0.5 else ""))
        if kinds is _SIDE and rng.random() < 0.6:
            return wrap(kind, f"<h3>{say(REST, True)}</h3>" + items(int(rng.integers(2, 6))))
        return wrap(kind, say(REST, rng.random() < 0.4) if rng.random() < 0.5 else paragraph(REST, rng.random() < 0.4))

    def article():
        parts = [f"<h1>{say(MAIN, rng.random() < 0.7)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            if r < 0.78:
                parts.append(paragraph(MAIN, rng.random() < 0.15))
            elif r < 0.84:
                parts.append(f"<h2>{say(MAIN, True)}</h2>")
            elif r < 0.88:
                parts.append("<ul>" + "".join(f"<li>{say(MAIN, rng.random() < 0.5)}</li>" for _ in range(3)) + "</ul>")
            elif r < 0.91:
                parts.append(f"<blockquote>{say(MAIN)}</blockquote>")
            elif r < 0.93:
                parts.append(f"<table><tr><td>{say(MAIN, True)}</td><td>{say(MAIN, True)}</td></tr></table>")
            elif r < 0.95:
                parts.append(f"<figure><img src='a'><figcaption>{say(MAIN, True)}</figcaption></figure>")
            else:
                parts.append(aside(pick([_AD, _SIDE, _NOTICE, _FORM, _MENU])))
        return "".join(parts)

    out = []
    for _ in range(layouts):
        before = [aside(k) for k in (_HEAD, _MENU, _NOTICE, _AD, _FORM) if rng.random() < 0.5]
        after = [aside(k) for k in (_SIDE, _COMMENT, _AD, _FORM, _MENU, _NOTICE) if rng.random() < 0.4]
        rng.shuffle(before)
        rng.shuffle(after)
        body = article()
        if rng.random() < 0.25:  # comments or a sidebar inside the main element
            body += aside(pick([_COMMENT, _SIDE, _MENU]))
        body = wrap(pick(_MAIN), body)
        if rng.random() < 0.3:
            body = wrap(pick([("div", 'class="container"'), ("div", 'id="wrapper"'), ("main", ""), ("div", 'class="row"')]), body + (after.pop() if after else ""))
        page = f"<html><body>{''.join(before)}{body}{''.join(after)}{aside(_FOOT) if rng.random() < 0.8 else ''}</body></html>"
        blocks, labels = [], []
        for b in leaf_blocks(page):
            label = MAIN if "\ue001" in b.text else REST
            b.text = " ".join(b.text.replace("\ue001", " ").replace("\ue000", " ").split())
            if b.text:
                blocks.append(b)
                labels.append(label)
        out.append((blocks, labels))
    return out


def fit(pages: DataFrame, max_pages: int = TRAIN_PAGES, layouts: int = LAYOUTS, max_blocks: int = TRAIN_BLOCKS,
        max_chars: int = TRAIN_CHARS) -> Model:
    """A model trained on composed pages with text of at most ``max_pages`` pages of
    ``pages`` (page_id, html), the first by a seeded hash of the id, and of these of the
    first ``max_chars`` characters of the first ``max_blocks`` blocks.  Without any
    page, a plain sentence stands in."""
    chosen = pages.where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id").distinct()
    chosen = hashed_head(chosen, max_pages, 3, "page_id")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def some(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[b.text[:max_chars] for b in leaf_blocks(x or "")[:max_blocks]] for x in batch.to_pylist()], pa.list_(pa.string()))

    # max_pages ids: a proven bound
    rows = pages.join(F.broadcast(chosen), "page_id").select("page_id", some(F.col("html").cast("string")).alias("t")).orderBy("page_id").collect()
    return train(labelled_pages([t for r in rows for t in r["t"]], layouts))


def main_text(model: Model, page: Column) -> Column:
    """Main text of each page: its main blocks joined by line feeds, empty if there are none.

    A null or empty page has an empty text.  Each row is taken by itself, so repeated rows
    get equal texts, null ids and further columns of any name change nothing, and no rows
    give no rows.  Pages of any length and any broken markup take time in proportion to
    their length.  Labels of equal likelihood count as not main."""

    @F.arrow_udf(T.StringType())
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                blocks = leaf_blocks(x or "")
                out.append("\n".join(b.text for b, y in zip(blocks, decode(model, blocks), strict=True) if y == MAIN))
            yield pa.array(out, pa.string())

    return extract(F.coalesce(page.cast("string"), F.lit("")))


def op7_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", main_text(fit(pages), F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
