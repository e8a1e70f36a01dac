"""The main text of web pages: a tree-structured graphical model over the block elements of a page.

Each block element is content or not. Its own features (tag, words of class, id and role, length, share of
links, punctuation, place, what the headings before it and the elements around it are called) score either label; parent-child potentials connect it to the element around it.
Sum-product messages, first up then down the tree, give the exact marginal of every element; a block
of text is kept if its element's marginal says content. The weights are trained by exact gradients on labelled
pages that `labelled_pages` makes by rule from a seed. All pages of a batch pass their messages together."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievemill.llm.shared import own_columns

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|/[^>]*(?:>|\Z))", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in ("script", "style", "textarea", "title", "iframe", "template", "noembed", "noframes")}
#: Elements within a block that hold text, and may hold blocks; an unclosed one ends with the element around it.
_WITHIN = {"noscript", "object", "svg", "math"}
#: What a head may hold; any other start tag, and text, ends it.
_IN_HEAD = {"head", "html", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}
_BLOCK = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset legend address details summary dialog menu center hgroup search button label head select xmp plaintext".split())
_VOID_BREAK = {"hr"}
#: A new element of the first kind ends an open one of the others.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tbody": {"thead", "tbody", "tr", "td", "th", "p"}}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "main", "nav", "aside", "footer", "header", "form", "blockquote"}
_TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "table", "td", "blockquote", "pre", "figure", "button", "address", "dialog", "body")
_SAME = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "dl": "ul", "menu": "nav", "dt": "li", "dd": "li", "th": "td", "tr": "table", "tbody": "table", "thead": "table", "figcaption": "figure", "label": "button", "fieldset": "form", "legend": "form", "search": "form", "html": "body", "hgroup": "section", "details": "section", "summary": "p", "center": "div", "caption": "p", "tfoot": "table", "select": "button", "xmp": "pre", "plaintext": "pre"}
_HINTS = (
    ("ad", "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner doubleclick adsense commercial"),
    ("menu", "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar pagination pager toc tabs skip links"),
    ("head", "header masthead top head branding logo sitehead"),
    ("foot", "footer foot copyright contentinfo colophon legal bottom"),
    ("side", "sidebar side aside widget widgets related recommended recommendations complementary rail trending popular more tags"),
    ("comment", "comment comments reply replies respond discussion disqus thread reader readers responses feedback kommentar kommentare commentaire commentaires comentario comentarios"),
    ("notice", "cookie cookies consent notice notices alert gdpr popup modal overlay dialog warning paywall subscribe subscription newsletter signup"),
    ("form", "form search login signin register input field survey"),
    ("share", "share sharing social follow buttons toolbox byline meta"),
    ("main", "content article post entry story main body text maincontent articlebody prose page"),
)
_WORD_HINT = {w: i for i, (_, ws) in enumerate(_HINTS) for w in ws.split()}
_ATTR = re.compile(r"(?:\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_XMP = re.compile("</xmp", re.I)
_LABEL = re.compile(r"\by=([01])")


@dataclass
class Page:
    """The block elements of one page in page order, and its blocks of text."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    within: list[int] = field(default_factory=list)
    heading: list[bool] = field(default_factory=list)
    #: element, text with white space settled, characters inside links
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


_TAG_ID = {t: i for i, t in enumerate(_TAGS)}
_TAG_ID |= {t: _TAG_ID[s] for t, s in _SAME.items()} | {"head": -1}
ARTICLE, MAIN = _TAG_ID["article"], _TAG_ID["main"]


def parse(html: str) -> Page:
    """Read a page as browsers do in the main: what is not closed is closed by what follows."""
    page = Page()
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}  # how many of each tag the stack holds, so that no tag searches a deep stack in vain
    pending: list[str] = []
    links = link_chars = 0

    def cut(k: int) -> None:
        for t, _ in stack[k:]:
            open_[t] -= 1
        del stack[k:]

    def put(tag: str, element: int) -> None:
        stack.append((tag, element))
        open_[tag] = open_.get(tag, 0) + 1

    def end_head() -> None:
        if len(stack) > 1 and stack[1][0] == "head":
            cut(1)

    def flush() -> None:
        nonlocal link_chars
        if pending:
            text = "".join(pending)
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.split())
            if text:
                end_head()
                page.blocks.append((stack[-1][1], text, min(link_chars, len(text))))
            pending.clear()
        link_chars = 0

    def add(tag: str, attrs: str) -> None:
        up = stack[-1][1] if stack else -1
        kind = _TAG_ID[tag]
        page.within.append((page.within[up] if up >= 0 else 0) | (kind in (ARTICLE, MAIN)))
        page.tag.append(kind)
        page.heading.append(tag in _HEADINGS)
        page.parent.append(up)
        page.depth.append(page.depth[up] + 1 if up >= 0 else 0)
        page.attrs.append(attrs)
        put(tag, len(page.tag) - 1)

    add("body", "")
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            pending.append(html[at:])
            break
        if m.start() > at:
            pending.append(html[at : m.start()])
            if links:
                link_chars += m.start() - at
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, close, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if not close and tag not in _IN_HEAD:
            end_head()
        if tag in _RAW and not close:
            foreign = open_.get("svg") or open_.get("math")
            if not (foreign and attrs.endswith("/")):
                end = _RAW[tag].search(html, at)
                at = end.end()
                if at < n:
                    gt = html.find(">", at)
                    at = n if gt < 0 else gt + 1
            pending.append(" ")
        elif tag in _WITHIN:
            pending.append(" ")
            if not close:
                if not (attrs.endswith("/") and tag in ("svg", "math")):
                    put(tag, stack[-1][1])
                continue
            for k in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[k][0] == tag:
                    if stack[-1][1] != stack[k][1]:
                        flush()
                    cut(k)
                    break
                if stack[k][0] in ("td", "th"):
                    break
        elif tag in ("option", "optgroup"):
            pending.append(" ")
        elif tag == "head" and not close and (len(stack) > 1 or len(page.tag) > 1 or page.blocks or any(map(str.strip, pending))):
            pass  # browsers ignore a head once the body has begun
        elif tag == "a":
            links = 0 if close else 1
        elif tag in ("br", "img", "input", "wbr"):
            if tag != "wbr":
                pending.append(" ")
        elif tag in _VOID_BREAK:
            flush()
        elif tag in _BLOCK and tag != "html":
            flush()
            if tag in _HEADINGS and stack[-1][0] in _HEADINGS:  # any heading's end, or a new one, ends a heading
                cut(len(stack) - 1)
                if close:
                    continue
            if close:
                if open_.get(tag, 0) > (tag == "body"):
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    cut(k)
                continue
            if open_.get("select"):  # an unclosed one holds no blocks
                cut(next(k for k, (t, _) in enumerate(stack) if t == "select"))
            if tag == "body":
                cut(1)
                page.attrs[0] = attrs
                continue
            ends = _CLOSES.get(tag, {"p"})
            for k in range(len(stack) - 1, 0, -1) if any(open_.get(t) for t in ends) else ():
                if stack[k][0] in ends:
                    cut(k)
                    if tag not in ("tr", "tbody", "dt", "dd", "li", "td", "th"):
                        break
                elif stack[k][0] in _SCOPE and stack[k][0] not in ends:
                    break
            add(tag, attrs)
            if tag in ("xmp", "plaintext"):
                # shown as it is, tags and all
                m = _XMP.search(html, at) if tag == "xmp" else None
                end = m.start() if m else n
                pending.append(html[at:end].replace("&", "&amp;"))
                at = end
    flush()
    return page


def hints(attrs: str) -> set[int]:
    found: set[int] = set()
    if attrs:
        for m in _ATTR.finditer(attrs):
            for w in _PIECES.findall(m[2] or m[3] or m[4] or ""):
                i = _WORD_HINT.get(w.lower())
                if i is not None:
                    found.add(i)
            if m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
                found.add(len(_HINTS))
        if _HIDDEN.search(attrs):
            found.add(len(_HINTS) + 1)
    return found


_STOPS = re.compile(r"[.,;:!?]")
_RIGHTS = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)
N_TAGS, N_HINTS = len(_TAGS), len(_HINTS) + 2
#: Where an element lies: on a page without an article or main element; within one; around one; before or after the first.
ZONES = 5
_FRAMES = ("nav", "header", "footer", "aside", "form", "dialog")
N_FEATURES = 1 + 2 * N_TAGS + 2 * N_HINTS + 2 * N_HINTS + N_HINTS + len(_FRAMES) + 2 * ZONES + 17
N_EDGES = 3


@dataclass
class Trees:
    """Elements of many pages: features, parents (-1 at a root), levels from the root and kinds of edge."""

    x: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    edge: np.ndarray

    @cached_property
    def levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)


def _announced(page: Page) -> dict[int, set[int]]:
    """What a short heading says of the elements after it, up to the next heading beside it: hints by element."""
    said = {e: {_WORD_HINT[w.lower()] for w in _PIECES.findall(t) if w.lower() in _WORD_HINT} for e, t, _ in page.blocks if page.heading[e] and len(t) < 40 and t.count(" ") < 3}
    if not any(said.values()):
        return {}
    found: dict[int, set[int]] = {}
    now: dict[int, set[int]] = {}
    for e, up in enumerate(page.parent):
        if page.heading[e]:
            now[up] = said.get(e, set())
        if now.get(up):
            found[e] = now[up]
    return found


def trees(pages: list[Page]) -> Trees:
    sizes = np.array([len(p.tag) for p in pages])
    base = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(pages)), sizes)
    tag = np.concatenate([p.tag for p in pages]).astype(int)
    parent = np.concatenate([np.array(p.parent) + np.where(np.array(p.parent) >= 0, b, 0) for p, b in zip(pages, base)])
    depth, within = np.concatenate([p.depth for p in pages]), np.concatenate([p.within for p in pages]).astype(bool)
    n = len(tag)
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    known = np.flatnonzero(tag >= 0)
    x[known, 1 + tag[known] + N_TAGS * within[known]] = 1
    h = 1 + 2 * N_TAGS
    cache: dict[str, set[int]] = {}
    row = 0
    for p in pages:
        for a in p.attrs:
            if a:
                found = cache.get(a)
                if found is None:
                    found = cache[a] = hints(a)
                for i in found:
                    x[row, h + i + N_HINTS * within[row]] = 1
            row += 1
    hinted = x[:, h : h + 2 * N_HINTS].any(1)
    a = h + 2 * N_HINTS
    for p, b in zip(pages, base.tolist()):
        for e, found in _announced(p).items():
            x[b + e, [a + i + N_HINTS * within[b + e] for i in found]] = 1
    own, link, stops, blocks, prose, rights = (np.zeros(n) for _ in range(6))
    at = np.array([b + e for p, b in zip(pages, base.tolist()) for e, _, _ in p.blocks], np.int64)
    total = np.zeros(len(pages))
    if len(at):
        size = np.array([len(t) for p in pages for _, t, _ in p.blocks], float)
        np.add.at(own, at, size)
        np.add.at(link, at, [k for p in pages for _, _, k in p.blocks])
        np.add.at(stops, at, [len(_STOPS.findall(t)) for p in pages for _, t, _ in p.blocks])
        np.add.at(blocks, at, 1)
        np.add.at(rights, at, [len(t) < 200 and _RIGHTS.search(t) is not None for p in pages for _, t, _ in p.blocks])
        np.add.at(total, of[at], size)
        done = np.cumsum(size) - size
        first = np.full(n, np.inf)
        np.minimum.at(first, at, done)
        first -= (np.cumsum(total) - total)[of]
    else:
        first = np.full(n, np.inf)
    prose[tag == _TAG_ID["p"]] = own[tag == _TAG_ID["p"]]
    has = own > 0
    share = link / np.maximum(own, 1)
    whole, whole_link, whole_blocks, whole_prose = own.copy(), link.copy(), blocks.copy(), prose.copy()
    holds = np.isin(tag, (ARTICLE, MAIN))
    levels = np.split(o := np.argsort(depth, kind="stable"), np.flatnonzero(np.diff(depth[o])) + 1)
    around = holds.copy()
    for level in levels[:0:-1]:
        up = parent[level]
        for v in (whole, whole_link, whole_blocks, whole_prose):
            np.add.at(v, up, v[level])
        np.minimum.at(first, up, first[level])
        np.logical_or.at(around, up, around[level])
    place = np.arange(n)
    opened = np.full(len(pages), n)
    np.minimum.at(opened, of[holds], place[holds])
    zone = np.where(within, 1, np.where(opened[of] == n, 0, np.where(around, 2, np.where(place < opened[of], 3, 4))))
    # names and frames around an element; a name of the text itself, or its header, is none
    frame = np.column_stack([(tag == _TAG_ID[t]) & ~within for t in _FRAMES])
    around_it = np.hstack([x[:, h : h + N_HINTS] + x[:, h + N_HINTS : h + 2 * N_HINTS], frame]) > 0
    around_it[:, [i for i, (name, _) in enumerate(_HINTS) if name in ("main", "head")]] = False
    for level in levels[1:]:
        around_it[level] |= around_it[parent[level]]
    z = a + 2 * N_HINTS
    x[:, z : z + around_it.shape[1]] = around_it
    z += around_it.shape[1]
    x[place, z + zone] = 1
    x[place[has], z + ZONES + zone[has]] = 1
    c = z + 2 * ZONES
    page_total = np.maximum(total[of], 1)
    x[:, c] = has & (own < 25)
    x[:, c + 1] = has & (own >= 25) & (own < 100)
    x[:, c + 2] = own >= 100
    x[:, c + 3] = has * share * ~within
    x[:, c + 4] = whole_link / np.maximum(whole, 1) * ~within
    x[:, c + 5] = np.minimum(np.log1p(whole) / 10, 1)
    x[:, c + 6] = np.minimum(stops / np.maximum(own, 1) * 20, 1)
    x[:, c + 7] = has & (stops == 0)
    x[:, c + 8] = whole / page_total * (zone == 0)
    x[:, c + 9] = np.where(np.isfinite(first), first / page_total, 1) * (zone == 0)
    x[:, c + 10] = whole_prose / np.maximum(whole, 1)
    x[:, c + 11] = np.minimum(np.log1p(whole_blocks) / 5, 1)
    x[:, c + 12] = np.minimum(whole / np.maximum(whole_blocks, 1) / 200, 1)
    x[:, c + 13] = has * share * within
    x[:, c + 14] = whole_link / np.maximum(whole, 1) * within
    x[:, c + 15] = whole == 0
    x[:, c + 16] = (rights > 0) & ~within
    framing = np.isin(tag, [_TAG_ID[t] for t in _FRAMES])
    edge = np.where(framing, 1, np.where(hinted, 2, 0))
    return Trees(x, parent, depth, edge)


@dataclass
class Model:
    unary: np.ndarray  # features x 2
    pair: np.ndarray  # kinds of edge x parent's label x child's label

    def marginals(self, t: Trees) -> tuple[np.ndarray, np.ndarray]:
        """Log marginals of elements, and of (parent, child) labels of each element that has a parent."""
        belief, both, z = self.messages(t)
        return belief - z[:, None], both - z[:, None, None]

    def messages(self, t: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same before normalization, and the log normalizer of each element's page."""
        u = t.x @ self.unary
        levels = t.levels
        up, message = u.copy(), np.zeros_like(u)
        for level in levels[:0:-1]:
            m = np.logaddexp(up[level, None, 0] + self.pair[t.edge[level], :, 0], up[level, None, 1] + self.pair[t.edge[level], :, 1])
            message[level] = m
            np.add.at(up, t.parent[level], m)
        belief = up.copy()
        both = np.zeros((len(u), 2, 2))
        for level in levels[1:]:
            above = belief[t.parent[level]] - message[level]
            joint = above[:, :, None] + self.pair[t.edge[level]] + up[level][:, None, :]
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            both[level] = joint
        return belief, both, np.logaddexp(belief[:, 0], belief[:, 1])


def labelled_pages(seed: int = 21, n: int = 800) -> list[str]:
    """The labelled table: pages whose elements carry y=1 (content) or y=0; what carries none is as its parent."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[rng.integers(len(xs))]
    syllables = "the on er in ti re es or ea nd ung sch ein que oi eau ción os ra".split()
    stock = ["".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 4))) for _ in range(3000)]
    word = lambda: stock[rng.integers(len(stock))]

    def words(k: int) -> str:
        marks = ".,.,;:"
        return " ".join(stock[i] + (marks[int(u * 40)] if u < 0.15 else "") for i, u in zip(rng.integers(0, len(stock), k).tolist(), rng.random(k).tolist()))

    def prose(lo: int = 1, hi: int = 90) -> str:
        inner = words(int(rng.integers(lo, hi)))
        if rng.random() < 0.15:
            inner += f' <a href="/{word()}">{words(2)}</a> ' + words(5)
        if rng.random() < 0.1:
            inner = f"<b>{inner}" + pick(["</b>", ""])
        return inner.capitalize() + pick([".", ".", ".", "", "!"])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(k))

    def attr(*names: str) -> str:
        return pick(["class", "id", "class"]) + f'="{pick(names)}"' if rng.random() < 0.85 else ""

    def junk(kind: int) -> str:
        k = int(rng.integers(2, 8))
        if kind == 0:
            return pick([f"<nav y=0><ul>{links(k)}</ul></nav>", f"<div y=0 {attr('menu', 'nav', 'navbar', 'breadcrumbs', 'main-menu')}><ul>{links(k)}</ul></div>", f"<ul y=0 class='menu'>{links(k)}</ul>", f'<div y=0 role="navigation">{links(k)}</div>'])
        if kind == 1:
            inner = pick([f"<h1>{words(3)}</h1><p>{words(6)}</p>", f"<h1>{words(2)}</h1><p>{words(3)}</p>", f"<h1>{words(2)}</h1><p>{prose(2, 12)}</p>", f"<a href='/'>{words(2)}</a>", f"<p>{words(9)}</p>", f"<div class='logo'>{words(2)}</div><ul>{links(3)}</ul>", f"<h1>{words(2)}</h1>"])
            return pick([f"<header y=0>{inner}</header>", f"<div y=0 {attr('header', 'site-header', 'masthead')}>{inner}</div>", f"<header y=0 {attr('top', 'header')}>{inner}</header>"])
        if kind == 2:
            inner = pick([f"&copy; {words(2)} &middot; {prose(3, 14)}", f"<p>{words(8)}</p><ul>{links(3)}</ul>", f"<p>Copyright {words(3)}</p>", prose(4, 40)])
            return pick([f"<footer y=0>{inner}</footer>", f"<div y=0 {attr('footer', 'site-footer', 'copyright')}>{inner}</div>"])
        if kind == 3:
            inner = pick([f"<h2>{words(2)}</h2><ul>{links(k)}</ul>", f"<p>{prose(3, 30)}</p>", f"<h3>{words(2)}</h3><p>{prose(5, 70)}</p><p>{prose(5, 70)}</p>", prose(4, 30)])
            return pick([f"<aside y=0>{inner}</aside>", f"<div y=0 {attr('sidebar', 'widget', 'related', 'side-bar', 'right-rail')}>{inner}</div>", f"<section y=0 class='related'>{inner}</section>"])
        if kind == 4:
            inner = pick([prose(3, 90), prose(2, 20), f"<p>{prose(3, 60)}</p>", f"<p>{prose(2, 12)}</p>", f"<p>{prose(2, 30)}</p><p>{prose(2, 30)}</p>", f"<p>{words(5)}</p><a href='#'>{words(2)}</a>", f"{words(8)}<br>{words(4)}"])
            return f"<div y=0 {pick(['class', 'id'])}=\"{pick(['ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'ad-box', 'advertisement', 'ad_slot'])}\">{inner}</div>"
        if kind == 5:
            inner = "".join(f"<{t} {attr('comment', 'reply')}><p>{prose(3, 45)}</p></{t}>" for t in [pick(["div", "li", "article"])] * k)
            return pick([f"<section y=0 {pick(['class', 'id'])}=\"comments\"><h2>{words(1)}</h2>{inner}</section>", f"<div y=0 id=\"comments\">{inner}</div>", f"<ol y=0 class=\"comment-list\">{inner}</ol>", f"<div y=0 class=\"reader-comments\">{inner}</div>"])
        if kind == 6:
            inner = pick([prose(5, 80), f"<p>{prose(5, 60)}</p><button>{words(1)}</button>", f"<p>{words(9)} <a href='/p'>{words(1)}</a></p>"])
            return pick([f"<div y=0 {pick(['class', 'id'])}=\"{pick(['cookie', 'cookie-notice', 'consent', 'notice', 'gdpr', 'popup', 'modal', 'newsletter', 'alert'])}\">{inner}</div>", f"<dialog y=0>{inner}</dialog>", f"<div y=0 role=\"{pick(['alert', 'dialog'])}\">{inner}</div>", f"<section y=0 class=\"notice\">{inner}</section>"])
        if kind == 7:
            return f"<form y=0 action='/s'><label>{words(2)}</label><input name=q><p>{words(int(rng.integers(1, 12)))}</p><select><option>{words(2)}</option></select><button>{words(1)}</button></form>"
        return pick([f"<div y=0 class=\"{pick(['share', 'social', 'social-share'])}\">{''.join(f'<a href=#>{word()}</a> ' for _ in range(k))}</div>", f"<p y=0><a href='/m'>{words(3)}</a></p>", f"<div y=0 style='display:none'>{prose(2, 20)}</div>"])

    def paragraph(inside: bool = True) -> str:
        r = rng.random()
        if r < 0.62:
            return f"<p>{prose(1, int(pick((4, 30, 90))))}" + pick(["</p>", "</p>", "</p>", "", "<br>"])
        if r < 0.66 and inside:
            return f"<p><a href='/{word()}'>{words(int(rng.integers(1, 9)))}</a></p>"
        if r < 0.74:
            return f"<{pick(['h2', 'h3'])}>{words(int(rng.integers(1, 7)))}</{pick(['h2', 'h3'])}>"
        if r < 0.80:
            return f"<ul>{''.join(f'<li>{prose(1, 20)}</li>' for _ in range(rng.integers(1, 6)))}</ul>"
        if r < 0.82:
            return f"<ol>{''.join(f'<li><p>{prose(1, 20)}</p></li>' for _ in range(rng.integers(1, 6)))}</ol>"
        if r < 0.85:
            return f"<blockquote>{pick(['', '<p>'])}{prose()}</blockquote>"
        if r < 0.89:
            return f"<table><tr><th>{words(1)}</th><td>{words(2)}</td></tr><tr><td>{words(1)}<td>{words(3)}</table>"
        if r < 0.93:
            return f"<pre>{words(12)}</pre>"
        if r < 0.97:
            return f"<div {attr('text', 'paragraph', 'note', 'box', 'lead') if rng.random() < 0.4 else ''}>{prose()}</div>"
        return f"<figure><img src=x><figcaption>{words(6)}</figcaption></figure>"

    def comments() -> str:
        """Comments that no name gives away but a heading, a place after the text and many short pieces."""
        one = pick([lambda: f"<li><p>{prose(3, 40)}</p></li>", lambda: f"<li>{word()}: {prose(2, 30)}</li>", lambda: f"<li><b>{word()}</b><p>{prose(2, 30)}</p></li>"])
        listed = "".join(one() for _ in range(rng.integers(1, 7)))
        heading = pick(["Comments", "2 comments", "Reader comments", "Kommentare", "Commentaires", "Comentarios", "Discussion", "Responses", "Replies"])
        inner = f"<{pick(['h2', 'h3'])} y=0>{heading}</h3><{pick(['ul', 'ol'])} y=0>{listed}</ul>"
        return pick([inner, f"<div y=0>{inner}</div>", f"<section y=0>{inner}</section>", f"<div y=0>{heading}</div><ul y=0>{listed}</ul>" if rng.random() < 0.3 else inner])

    def more() -> str:
        """Links to other pages under a heading."""
        heading = pick(["Related", "More", "Popular", "Recommended", "Tags", "Trending", "Share", "Follow"])
        return f"<h3 y=0>{heading}</h3><ul y=0>{links(int(rng.integers(2, 7)))}</ul>"

    def side() -> str:
        return pick([f"<ul>{links(int(rng.integers(2, 9)))}</ul>", f"<h3>{words(2)}</h3><ul>{links(4)}</ul>", "".join(f"<p><a href='/{word()}'>{words(3)}</a></p>" for _ in range(rng.integers(2, 6))), " ".join(f"<a href='/{word()}'>{word()}</a>" for _ in range(rng.integers(2, 9)))])

    out = []
    for _ in range(n):
        h1 = f"<h1>{words(int(rng.integers(1, 10)))}</h1>"
        h1 = pick([h1, h1, f"<header>{h1}</header>", f"<header>{h1}<p>{words(4)}</p></header>", f"<div {attr('article-header', 'entry-header', 'post-header', 'page-header', 'content-header', 'article-title')}>{h1}</div>"])
        shape = rng.random()
        inner = [paragraph() for _ in range(int(rng.integers(0, 12)))]
        if rng.random() < 0.55:
            for _ in range(int(rng.integers(1, 3))):
                inner.insert(int(rng.integers(0, len(inner) + 1)), junk(int(rng.integers(3, 8))))
        if rng.random() < 0.3:
            inner = [pick([f"<section>{''.join(inner)}</section>", f"<div>{''.join(inner)}</div>", f"<div {attr('article-body', 'entry-content', 'post-body', 'story-text', 'content-body', 'body-text')}>{''.join(inner)}</div>", f"<div {attr('article-body', 'entry-content')}><div>{''.join(inner)}</div></div>"])]
        end = pick(["", "", comments(), more(), comments() + more()]) if shape < 0.9 else ""
        main = h1 + "".join(inner)
        if shape < 0.12:  # columns whose names say nothing
            main = h1 + "".join([paragraph() for _ in range(rng.integers(2, 10))])
            cols = [f'<div y=1 class="{pick(["col-8", "span9", "left", "column", "grid-9", "cell"])}">{main}</div>', f'<div y=0 class="{pick(["col-4", "span3", "right", "column", "grid-3", "cell"])}">{side()}</div>']
            body = f'<div y=1 class="{pick(["wrap", "outer", "site", "layout"])}"><div y=1 class="{pick(["row", "grid", "inner"])}">{"".join(cols if rng.random() < 0.6 else cols[::-1])}</div>{end}</div>'
        elif shape < 0.22:  # a table for the layout
            main = h1 + "".join([paragraph() for _ in range(rng.integers(2, 10))])
            cells = [f"<td y=0>{side()}</td>", f"<td y=1>{main}</td>", *([f"<td y=0>{side()}</td>"] if rng.random() < 0.4 else [])]
            top = f"<tr y=0><td colspan=2>{pick([words(2), side()])}</td></tr>" if rng.random() < 0.4 else ""
            low = f"<tr y=0><td colspan=2>{pick(['&copy; ' + words(3), 'Copyright ' + words(2), side()])}</td></tr>" if rng.random() < 0.4 else ""
            body = f"<table y=1 {pick(['', 'width=100%', 'border=0'])}>{top}<tr y=1>{''.join(cells)}</tr>{low}</table>{end}"
        elif shape < 0.28:  # bare text
            body = pick([main, f"<div y=1>{main}</div>", "".join(paragraph(False) for _ in range(rng.integers(1, 6))), prose()]) + end
        else:
            open_, close = pick([("<article y=1>", "</article>"), ("<article y=1>", "</article>"), ("<main y=1>", "</main>"), ("<main y=1><article>", "</article></main>"), ("<div y=1 class=\"content\">", "</div>"), ("<div y=1 id=\"article-body\">", "</div>"), ("<div y=1 class=\"post entry\">", "</div>"), ("<div y=1>", "</div>"), ("<div y=1 id=main><article>", "</article></div>"), ("<article y=1 class=\"post\"><div>", "</div></article>")])
            before = "".join(junk(int(k)) for k in rng.permutation([0, 1, 4, 6, 7, 8, 3])[: rng.integers(0, 5)])
            after = "".join(junk(int(k)) for k in rng.permutation([2, 2, 3, 4, 5, 6, 7, 8])[: rng.integers(0, 5)])
            body = before + open_ + main + (end if rng.random() < 0.15 else "") + close + end + after
            if rng.random() < 0.35:
                body = f"<div y=1 {attr('page', 'wrapper', 'container', 'site', 'root')}>{body}</div>"
        out.append(f"<html><head><title>{words(3)}</title></head><body y=1>{body}</body></html>")
    return out


def _least(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Where a convex function with its gradient is least: L-BFGS with halved steps."""
    value, grad = f(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, scales = grad.copy(), []
        for s, y in reversed(moves):
            scales.append(s @ d / (s @ y))
            d -= scales[-1] * y
        d *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(np.abs(grad).sum(), 1e-12)
        for (s, y), a in zip(moves, reversed(scales)):
            d += (a - y @ d / (s @ y)) * s
        length = 1.0
        while True:
            new_value, new_grad = f(w - length * d)
            if new_value <= value - 1e-4 * length * (grad @ d) or length < 1e-6:
                break
            length /= 2
        s, y = -length * d, new_grad - grad
        if s @ y > 1e-12:
            moves = [*moves[-memory + 1 :], (s, y)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        w, value, grad = w + s, new_value, new_grad
        if done:
            break
    return w


@lru_cache(1)
def trained(steps: int = 120, penalty: float = 1e-4) -> Model:
    """The model of greatest penalized likelihood; the labelled pages are fixed, so every fit gives the same one."""
    pages = [parse(h) for h in labelled_pages()]
    t = trees(pages)
    y = np.ones(len(t.x), int)
    row = 0
    for p in pages:
        for k, a in enumerate(p.attrs):
            m = _LABEL.search(a)
            y[row] = int(m[1]) if m else (y[row - k + p.parent[k]] if p.parent[k] >= 0 else 1)
            row += 1
    child, root = np.flatnonzero(t.parent >= 0), np.flatnonzero(t.parent < 0)
    seen = np.zeros((N_FEATURES, 2))
    np.add.at(seen.T, y, t.x)
    seen_pair = np.zeros((N_EDGES, 2, 2))
    np.add.at(seen_pair, (t.edge[child], y[t.parent[child]], y[child]), 1)
    seen = np.concatenate([seen.ravel(), seen_pair.ravel()])
    model = lambda w: Model(w[: 2 * N_FEATURES].reshape(-1, 2), w[2 * N_FEATURES :].reshape(N_EDGES, 2, 2))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        one, two, z = model(w).messages(t)
        pair = np.zeros((N_EDGES, 2, 2))
        np.add.at(pair, t.edge[child], np.exp(two[child] - z[child, None, None]))
        expected = np.concatenate([(t.x.T @ np.exp(one - z[:, None])).ravel(), pair.ravel()])
        return (z[root].sum() - seen @ w) / len(pages) + penalty / 2 * (w @ w), (expected - seen) / len(pages) + penalty * w

    return model(_least(loss, np.zeros(len(seen)), steps))


def main_texts(htmls: list[str], model: Model) -> list[str]:
    """The main text of each page: content blocks in page order, one a line."""
    pages = [parse(h or "") for h in htmls]
    if not pages:
        return []
    keep = np.diff(model.marginals(trees(pages))[0], axis=1)[:, 0] >= 0
    out, base = [], 0
    for p in pages:
        out.append("\n".join(t for e, t, _ in p.blocks if keep[base + e]))
        base += len(p.tag)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_once: int = 256) -> DataFrame:
    """The main text of every page.

    Returns id_col, url_col, text (empty if the page has none). A null or empty html gives an empty text; null and
    repeated ids are read row by row, equal pages have equal texts; other columns are ignored, whatever their names; an empty table gives an
    empty one. No text is capped, and the time grows with the page's length, however deep its elements lie. Ids may be of any type."""
    model = trained()
    d = own_columns(pages, id_col, url_col, html_col).toDF("id", "url", "html")
    kinds = dict(d.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(main_texts(part.column("html").to_pylist(), model), pa.string())], ["id", "url", "text"])

    return d.mapInArrow(rows, f"id {kinds['id']}, url {kinds['url']}, text string").withColumnsRenamed({"id": id_col, "url": url_col})
