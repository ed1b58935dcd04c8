"""Main text of web pages by a tree-structured graphical model.

The elements of a page form a tree; each has a binary label, whether it holds main text. A node's potential comes from its
tag, the words of its class, id and role, its link density, its length and where it stands; an edge's potential from the
labels of parent and child and the kind of the child. Sum-product messages go up from the leaves and down from the root
and give every node's exact marginal; text belongs to the article if its element's marginal is at least one half. Weights are
fitted by gradient ascent on the exact likelihood of labelled pages, whose gradient is those same marginals. The
labelled pages (TRAINING_PAGES of them, a documented bound) are written by ``labelled_page`` from layouts with known answers.

Scripts, styles, templates and heads hold no text whatever the model says. Blocks end at block elements; a line break or any
white space inside a block, no-break spaces included, becomes one space; blocks are joined by an empty line.

Null and empty html give an empty text. Repeated rows give repeated results, an empty table gives no rows. Unclosed elements
end where HTML's rules for p, li, table parts and options end them, or with the page. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

TRAINING_PAGES, STEPS = 240, 120

#: Element kinds, fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr input".split())
#: Start tags that end an open element, and where the search for it stops.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tr"), ("table",))}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)",
    re.S,
)
_UNQUOTED = re.compile(r"[^>\"']*+")
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Page:
    """The elements of a page in document order, and its text in pieces (element, text); a piece None ends a block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attrs, self.depths = ["#root"], [-1], [""], [0]
        self.pieces: list[tuple[int, str] | None] = []
        self._dead: set[int] = set()
        stack, at, end = [0], 0, len(source)
        silent = 0
        while at < end:
            m = _TAG.search(source, at)
            if not silent:
                text = source[at : m.start() if m else end]
                if text and not text.isspace():
                    self.pieces.append((stack[-1], text))
                elif text:
                    self.pieces.append((stack[-1], " "))
            if m is None:
                break
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag, closing = tag.lower(), bool(m["end"])
            close, at = self._tag_end(source, at)
            if tag == "br":
                self.pieces.append((stack[-1], " "))
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        for node in stack[k:]:
                            silent -= self.tags[node] in SILENT
                        del stack[k:]
                        break
                if tag not in INLINE:
                    self.pieces.append(None)
                continue
            if tag == "body" or tag in ENDS_P and "head" in [self.tags[x] for x in stack[:4]] and not any(self.tags[x] in SILENT - {"head"} for x in stack):
                # an unclosed head ends where content begins
                for k in range(1, len(stack)):
                    if self.tags[stack[k]] == "head":
                        del stack[k:]
                        silent = 0
                        break
            if tag in ENDS_P:
                self._end(stack, ("p",), ("table", "td", "th", "button", "object", "template"))
            if tag in CLOSES:
                self._end(stack, *CLOSES[tag])
            if tag not in INLINE:
                self.pieces.append(None)
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.depths.append(self.depths[stack[-1]] + 1)
            attrs = source[m.end() : close]
            self.attrs.append(attrs)
            if tag in VOID:
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if tag == "textarea" and not silent:
                    self.pieces.append((node, source[at : close.start() if close else end]))
                at = close.end() if close else end
                continue
            if not attrs.endswith("/") or tag in ("p", "div", "span", "a", "li"):
                stack.append(node)
                silent += tag in SILENT

    def _tag_end(self, source: str, start: int) -> tuple[int, int]:
        """Where the attributes from ``start`` on end, and the tag: at the first > outside quotes, or at the first at all if there is none.
        Quotes from which no such > was found are remembered, so a page is looked through once however many tags lack one."""
        at, opened = start, []
        while (at := _UNQUOTED.match(source, at).end()) < len(source):
            if source[at] == ">":
                return at, at + 1
            if at in self._dead:
                break
            opened.append(at)
            at = source.find(source[at], at + 1) + 1
            if not at:
                break
        self._dead.update(opened)
        at = source.find(">", start)
        return (at, at + 1) if at >= 0 else (len(source), len(source))

    def _end(self, stack: list[int], what, stop) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in what:
                del stack[k:]
                if tag != what[-1] or len(what) == 1:
                    return
            elif tag in stop:
                return


def _bucket(value: float, edges) -> int:
    return sum(value >= e for e in edges)


def node_features(page: Page) -> list[list[str]]:
    """The names of every node's features."""
    n = len(page.tags)
    length, linked, blocks = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[page.parents[k]] or page.tags[k] == "a"
        blocks[page.parents[k]] += page.tags[k] not in INLINE
    for piece in page.pieces:
        if piece:
            size = len(piece[1].strip())
            length[piece[0]] += size
            linked[piece[0]] += size * in_link[piece[0]]
    for k in range(n - 1, 0, -1):
        length[page.parents[k]] += length[k]
        linked[page.parents[k]] += linked[k]
    total, out = max(1, length[0]), []
    for k in range(n):
        tag = page.tags[k]
        inline = tag in INLINE
        names = [f"tag {tag}", f"inline {inline}"]
        parent = page.tags[page.parents[k]] if k else ""
        if not inline:
            density = _bucket(linked[k] / length[k], (0.05, 0.3, 0.6, 0.95)) if length[k] else 9
            size = _bucket(length[k], (1, 20, 60, 150, 500))
            names += [f"links {density}", f"size {size}", f"size {size} links {density}", f"share {_bucket(length[k] / total, (0.1, 0.3, 0.6))}", f"in {parent} {tag}", f"leaf {blocks[k] == 0} size {size}"]
        if page.attrs[k]:
            found = {}
            for m in _ATTR.finditer(page.attrs[k]):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            words = {w.lower() for a in ("class", "id", "role", "itemprop", "aria-label") for w in _WORDS.findall(found.get(a, ""))}
            names += [f"word {w[:-1] if len(w) > 4 and w.endswith('s') else w}" for w in sorted(words)]
            if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
                names.append("hidden")
        out.append(names)
    return out


#: Kinds of child whose edges have potentials of their own.
_KINDS = 3


def _kind(tag: str) -> int:
    return 0 if tag in INLINE else 1 if tag in ("p", "li", "td", "th", "tr", "tbody", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "blockquote", "pre", "figcaption") else 2


class Forest:
    """The nodes of many pages, for message passing by levels."""

    def __init__(self, pages: list[Page], index: dict[str, int]):
        sizes = [len(p.tags) for p in pages]
        self.first = np.cumsum([0, *sizes])
        self.parent = np.concatenate([np.array(p.parents, np.int64) + b for p, b in zip(pages, self.first, strict=False)]) if pages else np.zeros(0, np.int64)
        depth = np.concatenate([np.array(p.depths, np.int64) for p in pages]) if pages else np.zeros(0, np.int64)
        self.kind = np.array([_kind(t) for p in pages for t in p.tags], np.int64)
        rows, columns, at = [], [], 0
        for p in pages:
            for names in node_features(p):
                for name in names:
                    f = index.get(name)
                    if f is not None:
                        rows.append(at)
                        columns.append(f)
                at += 1
        self.rows, self.columns, self.n = np.array(rows, np.int64), np.array(columns, np.int64), at
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.nonzero(np.diff(depth[order]))[0] + 1) if at else []

    def marginals(self, weights: np.ndarray, edges: np.ndarray):
        """(log Z, P(label) of each node, P(parent label, label) of each node): sum-product in log space.

        weights: per feature, for label 1 (label 0 is the reference); edges: (kind, parent label, label)."""
        score = np.zeros((self.n, 2))
        score[:, 1] = np.bincount(self.rows, weights[self.columns], self.n)
        up = score.copy()
        message = np.zeros((self.n, 2))
        for level in reversed(self.levels[1:]):
            message[level] = np.logaddexp(edges[self.kind[level], :, 0] + up[level, None, 0], edges[self.kind[level], :, 1] + up[level, None, 1])
            np.add.at(up, self.parent[level], message[level])
        down = np.zeros((self.n, 2))
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            parent = self.parent[level]
            rest = down[parent] + up[parent] - message[level]
            both = rest[:, :, None] + edges[self.kind[level]]
            down[level] = np.logaddexp(both[:, 0], both[:, 1])
            both = both + up[level][:, None, :]
            joint[level] = np.exp(both - np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None])
        belief = up + down
        roots = self.levels[0]
        z = float(np.logaddexp(belief[roots, 0], belief[roots, 1]).sum())
        return z, np.exp(belief - np.logaddexp(belief[:, 0], belief[:, 1])[:, None]), joint


class Model:
    def __init__(self, index: dict[str, int], weights: np.ndarray, edges: np.ndarray):
        self.index, self.weights, self.edges = index, weights, edges

    def keep(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        """(whether each node holds main text, first node of each page and the end)."""
        forest = Forest(pages, self.index)
        if not forest.n:
            return np.zeros(0, bool), forest.first
        return forest.marginals(self.weights, self.edges)[1][:, 1] >= 0.5, forest.first


def text_of(page: Page, keep) -> str:
    blocks, current = [], []

    def end() -> None:
        if current:
            text = " ".join("".join(current).split())
            if text:
                blocks.append(text)
            current.clear()

    for piece in page.pieces:
        if piece is None:
            end()
        elif keep[piece[0]]:
            current.append(entities.unescape(piece[1]) if "&" in piece[1] else piece[1])
    end()
    return "\n\n".join(blocks)


def labelled_page(rng: random.Random) -> str:
    """A page of invented words; elements of main text carry y=1, all others y=0 (a wrapper of main text counts as such)."""

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choices("abcdefghilmnoprstuvé", k=rng.randint(1, 9))) for _ in range(rng.randint(a, b)))

    def links(a: int, b: int, tag: str = "li") -> str:
        items = "".join(f'<{tag} y=0><a y=0 href="#">{words(1, 4)}</a></{tag}>' for _ in range(rng.randint(a, b)))
        return f"<ul y=0>{items}</ul>" if tag == "li" else items

    def attr(*names: str) -> str:
        name = rng.choice(names)
        return f'{rng.choice(["class", "id", "class"])}="{rng.choice(["", "", "site-", "main-", "page-", "js-", "block "])}{name}{rng.choice(["", "", "-wrap", "-1", " clearfix", "Box"])}"'

    def inline(y: int) -> str:
        kind = rng.choice(["a", "b", "em", "span", "code", "strong", "i"])
        return f'<{kind} y={y}{" href=#" if kind == "a" else ""}>{words(1, 5)}</{kind}>'

    def paragraph(y: int = 1, a: int = 1, b: int = 80) -> str:
        body = words(a, b)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            body += " " + inline(y) + " " + words(1, 12)
        if rng.random() < 0.15:
            return f"<p y={y}><b y={y}>{words(2, 10)}<br>"  # never closed
        return f"<p y={y}>{body}" + rng.choice(["</p>", "</p>", ""])

    def body_part() -> str:
        k = rng.random()
        if k < 0.66:
            return paragraph()
        if k < 0.74:
            return f"<h{(h := rng.randint(2, 4))} y=1>{words(1, 8)}</h{h}>"
        if k < 0.82:
            return "<ul y=1>" + "".join(f"<li y=1>{words(2, 20)}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(1, 5))) + "</ul>"
        if k < 0.87:
            return f"<blockquote y=1>{rng.choice([words(5, 30), paragraph()])}</blockquote>"
        if k < 0.91:
            return f"<pre y=1>{words(3, 20)}</pre>"
        if k < 0.95:
            return "<table y=1>" + "".join(f"<tr y=1><td y=1>{words(1, 5)}</td><td y=1>{words(1, 9)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return f"<figure y=1><img y=1><figcaption y=1>{words(2, 10)}</figcaption></figure>"

    def noise() -> str:
        inner = rng.choice([lambda: links(2, 8), lambda: links(1, 4, "span"), lambda: f"<p y=0>{words(2, 30)}</p>", lambda: words(3, 30), lambda: f"<div y=0>{words(2, 20)}</div>"])
        kind = rng.choice(["nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "share", "related", "crumbs", "hidden"])
        if kind in ("nav", "header", "footer", "aside") and rng.random() < 0.6:
            return f"<{kind} y=0>{inner()}</{kind}>"
        names = {
            "nav": ("nav", "menu", "navbar", "navigation", "topmenu"), "header": ("header", "masthead", "banner", "topbar", "branding"), "footer": ("footer", "copyright", "colophon", "bottom", "legal"),
            "aside": ("sidebar", "aside", "widget", "rail", "side"), "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsense", "ad-slot"), "notice": ("cookie", "notice", "consent", "gdpr", "popup", "modal", "alert", "cookie-banner", "paywall", "disclaimer"),
            "form": ("newsletter", "subscribe", "signup", "search", "login", "contact-form"), "comments": ("comments", "comment", "comment-list", "disqus", "respond", "replies", "discussion"), "share": ("share", "social", "sharing", "follow", "toolbar"),
            "related": ("related", "recommended", "more-stories", "trending", "popular", "teasers", "pagination", "tags"), "crumbs": ("breadcrumb", "breadcrumbs", "skip", "pager", "print"), "hidden": ("",),
        }[kind]
        if kind == "form":
            shape = f"<form y=0 {attr(*names)}><label y=0>{words(1, 4)}</label><input y=0>{rng.choice(['', paragraph(0, 2, 15)])}<button y=0>{words(1, 2)}</button></form>"
            return rng.choice([shape, f"<div y=0 {attr(*names)}>{inner()}{shape}</div>", f"<form y=0>{words(1, 6)}<select y=0><option y=0>{words(1, 2)}<option y=0>{words(1, 2)}</select><textarea y=0>{words(1, 3)}</textarea></form>"])
        if kind == "comments":
            one = lambda: f"<{(t := rng.choice(['li', 'div', 'article']))} y=0 {attr('comment', 'reply')}><p y=0>{words(2, 60)}</p></{t}>"
            t = rng.choice(["section", "div", "ol", "aside"])
            return f"<{t} y=0 {attr(*names)}><h3 y=0>{words(1, 3)}</h3>{''.join(one() for _ in range(rng.randint(1, 5)))}</{t}>"
        if kind == "hidden":
            return f"<div y=0 {rng.choice(['hidden', 'style=\"display:none\"', 'aria-hidden=\"true\"'])}>{inner()}</div>"
        role = {"nav": ' role="navigation"', "header": ' role="banner"', "footer": ' role="contentinfo"', "aside": ' role="complementary"', "notice": rng.choice([' role="dialog"', ' role="alert"'])}.get(kind, "")
        t = rng.choice(["div", "div", "section", "ul" if kind in ("nav", "crumbs", "share") else "div", "aside" if kind in ("ad", "related", "notice") else "div"])
        return f"<{t} y=0 {rng.choice([attr(*names), attr(*names), attr(*names) + role, role or attr(*names)])}>{inner() if t != 'ul' else links(1, 6)[8:-5]}</{t}>"

    parts = [f"<h1 y=1>{words(2, 12)}</h1>"] * (rng.random() < 0.8) + [body_part() for _ in range(rng.randint(1, 9))]
    for _ in range(rng.choice([0, 0, 1, 2])):
        parts.insert(rng.randint(1, len(parts)), noise())
    shape = rng.random()
    content = ("article", "content", "post", "entry", "story", "post-body", "entry-content", "article-body", "main", "text", "post-content", "story-body")
    if shape < 0.4:
        middle = f"<article y=1 {rng.choice(['', '', attr(*content)])}>{''.join(parts)}</article>"
    elif shape < 0.7:
        middle = f"<div y=1 {attr(*content)}>{''.join(parts)}</div>"
    elif shape < 0.85:
        middle = f'<{(t := rng.choice(["main", "section", "div"]))} y=1 {rng.choice(["role=\"main\"", attr(*content), ""])}>{"".join(parts)}</{t}>'
    else:
        middle = "".join(parts)
    for _ in range(rng.choice([0, 0, 1])):
        middle = f"<{(t := rng.choice(['div', 'main', 'section']))} y=1 {rng.choice(['', attr('container', 'wrapper', 'main', 'page', 'content', 'row', 'layout'), attr('wrap', 'site', 'body', 'column')])}>{rng.choice(['', noise()])}{middle}{rng.choice(['', noise()])}</{t}>"
    if rng.random() < 0.04:
        return f"<html y=0><body y=0>{''.join(noise() for _ in range(rng.randint(1, 4)))}</body></html>"
    before, after = ("".join(noise() for _ in range(rng.randint(0, 4))) for _ in range(2))
    return f"<html y=1><head y=0><title y=0>{words(1, 6)}</title></head><body y=1 {rng.choice(['', attr('home', 'page', 'single')])}>{before}{middle}{after}</body></html>"


@functools.cache
def train(pages: int = TRAINING_PAGES, steps: int = STEPS, seed: int = 1) -> Model:
    """Adam on the likelihood of labelled pages, with an L2 prior. The same weights every time."""
    rng = random.Random(seed)
    parsed = [Page(labelled_page(rng)) for _ in range(pages)]
    labels = []
    for p in parsed:
        for k in range(len(p.tags)):
            m = re.search(r"\by=([01])", p.attrs[k])
            labels.append(int(m[1]) if m else int("y=1" in "".join(p.attrs[:3])))
            p.attrs[k] = re.sub(r"\s*\by=[01]\s*", " ", p.attrs[k]).strip()
    names = sorted({f for p in parsed for fs in node_features(p) for f in fs})
    index = {f: k for k, f in enumerate(names)}
    forest, y = Forest(parsed, index), np.array(labels)
    theta = np.zeros(len(index) + _KINDS * 4)
    inner = np.concatenate(forest.levels[1:])
    seen = np.bincount(forest.columns, y[forest.rows].astype(float), len(index))
    edges_seen = np.zeros((_KINDS, 2, 2))
    np.add.at(edges_seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, edges = theta[: len(index)], theta[len(index) :].reshape(_KINDS, 2, 2)
        _, node, joint = forest.marginals(weights, edges)
        expected = np.zeros((_KINDS, 2, 2))
        np.add.at(expected, forest.kind[inner], joint[inner])
        gradient = np.r_[seen - np.bincount(forest.columns, node[forest.rows, 1], len(index)), (edges_seen - expected).ravel()] - 0.5 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(index, theta[: len(index)], theta[len(index) :].reshape(_KINDS, 2, 2))


_OUT = "page_id long, url string, text string, n_chars long"


def _extract(shared):
    def run(batches):
        model = shared.value
        names = [x.split()[0] for x in _OUT.split(", ")]
        for batch in batches:
            ids, urls, sources = (batch.column(k).to_pylist() for k in ("page_id", "url", "html"))
            for at in range(0, len(ids), 256):
                part = slice(at, at + 256)
                parsed = [Page(x or "") for x in sources[part]]
                keep, first = model.keep(parsed)
                out = [text_of(p, keep[a:b]) for p, a, b in zip(parsed, first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(urls[part], pa.string()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names)

    return run


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    return pages.select("page_id", "url", "html").mapInArrow(_extract(shared), _OUT)


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
