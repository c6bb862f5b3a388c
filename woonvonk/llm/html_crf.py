"""Main text of web pages: a linear-chain conditional random field over the blocks of a page.

A page is cut into its leaf blocks in page order. Each block has features of the tags, classes and ids around it and of
its text; the chain has two states, article and rest, and Viterbi picks the best path. The field is trained on labelled
pages, which ``labelled_pages`` writes from a seed: articles among menus, headers, footers, side bars, notices, adverts,
forms and reader comments in many mark-ups, with made-up words, so that nothing is learnt from the words themselves.
Other labelled pages can be given instead. Training is of bounded size; pages are read one by one in their scan task,
whole, without a shuffle.

Null, empty or text-less pages give an empty text. Unclosed tags, comments and scripts end with the page. Repeated rows
are read each. Other columns are left out of the result.
"""

from __future__ import annotations

import html
import json
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from woonvonk.llm.common import table

TRAINING_PAGES = 600
SEED = 20

# Elements whose inside isn't text of the page. Those whose inside isn't even mark-up run to the end of the page when they are
# never closed, as in a browser; of the others only the start tag is passed over then. What objects, players and the
# like hold for browsers that can't show them is text, and the field decides about it.
RAW = set("script style title iframe textarea".split())
SKIPPED = RAW | set("template svg annotation annotation-xml".split())
VOID = set("br img hr input meta link area base col embed source track wbr param".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong "
    "sub sup time tt u var picture map ruby rt rp math semantics mrow mi mo mn ms mtext mspace msqrt mroot mfrac msub msup "
    "msubsup munder mover munderover mmultiscripts mtable mtr mtd mfenced mstyle mpadded mphantom merror menclose".split()
)
# A start tag of the key ends an open element of the values.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
# Elements that keep their inside to themselves when a start or end tag looks for what it ends.
FENCES = set("table ul ol dl div article section main aside nav header footer form body td th blockquote select".split())

TAG = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|$))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def attribute_features(attributes: str) -> list[str]:
    found = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("hidden", "aria-hidden"):
            found += ["hidden"] if value.lower() != "false" else []
        elif name == "style":
            found += ["hidden"] if re.search(r"display\s*:\s*none", value, re.I) else []
        else:
            found += ["in:" + p.lower() for p in PART.findall(value)]
    return found


@dataclass
class Node:
    """An open element; ``features`` are those of all elements around and of itself."""

    tag: str
    features: frozenset
    inner: dict = field(default_factory=dict)
    score: float | None = None

    def child(self, tag: str, attributes: str) -> Node:
        key = (tag, attributes)
        node = self.inner.get(key)
        if node is None:
            if len(self.inner) > 10_000:
                self.inner.clear()
            node = Node(tag, self.features | {"tag:" + tag, *attribute_features(attributes)})
            self.inner[key] = node
        return node


@dataclass
class Block:
    node: Node
    text: str
    linked: int  # characters inside links


def blocks(page: str | None, root: Node) -> list[Block]:
    """The leaf blocks with text, in page order: references decoded, white space runs one blank."""
    page = page or ""
    out: list[Block] = []
    stack = [root]
    parts: list[str] = []
    links: list[str] = []
    in_link = False
    unclosed: set[str] = set()  # elements that have no end tag from here on
    at, n = 0, len(page)

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1], text, sum(map(len, links))))
            parts.clear()
            links.clear()

    def text_of(piece: str):
        if piece:
            parts.append(piece)
            if in_link:
                links.append(piece.strip())

    def close(tags: set, fences: set):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in fences:
                return

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text_of(page[at:])
            break
        text_of(page[at : m.start()])
        if m[2] is None:
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, m.end())
            at = n if end < 0 else end + len(mark)
            continue
        tag = m[2].lower()
        rest = REST.match(page, m.end())
        end = rest.end() if rest else (page.find(">", m.end()) + 1 or n)
        attributes = page[m.end() : end - 1]
        at = end
        if tag == "br":
            text_of(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = not m[1]
        elif m[1]:
            flush()
            in_link = False
            close({tag}, FENCES - {tag} if tag not in FENCES else set())
        else:
            flush()
            in_link = False
            if tag in SKIPPED:
                if tag not in unclosed and not (tag == "svg" and attributes.endswith("/")):
                    stop = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
                    if stop:
                        at = stop.end()
                    elif tag in RAW:
                        at = n
                    else:
                        unclosed.add(tag)
                continue
            if stack[-1].tag == "p" or any(x.tag == "p" for x in stack[-3:]):
                close({"p"}, FENCES)
            if tag in ENDS:
                close(ENDS[tag], FENCES - ENDS[tag])
            if tag not in VOID:
                stack.append(stack[-1].child(tag, attributes))
    flush()
    return out


def text_features(block: Block, previous: Block | None) -> list[str]:
    words = block.text.count(" ") + 1
    share = block.linked / len(block.text)
    return [
        "words:" + ("1" if words < 3 else "3" if words < 6 else "6" if words < 12 else "12" if words < 30 else "30"),
        "links:" + ("0" if share == 0 else "some" if share < 0.5 else "most"),
        "end:" + ("stop" if block.text[-1] in ".!?:;…\"”»" else "other"),
        "leaf:" + block.node.tag,
        "sign:" + ("c" if "©" in block.text else "none"),
        "first" if previous is None else "same" if previous.node.tag == block.node.tag else "other",
    ]


@dataclass
class Field:
    """Weights of features for the state "article", and of the chain: from state to state, at the start, at the end."""

    weights: dict[str, float]
    chain: list[list[float]]
    start: list[float]
    end: list[float]

    def __post_init__(self):
        self.root = Node("", frozenset())

    def emission(self, block: Block, previous: Block | None) -> float:
        node, w = block.node, self.weights
        if node.score is None:
            node.score = sum(w.get(f, 0.0) for f in node.features)
        return node.score + sum(w.get(f, 0.0) for f in text_features(block, previous))

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi over the blocks of a page."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.chain
        back, previous, best0, best1 = [], None, 0.0, 0.0
        for k, block in enumerate(page):
            e = self.emission(block, previous)
            if k == 0:
                best0, best1 = self.start[0], self.start[1] + e
            else:
                a0, b0, a1, b1 = best0 + s00, best1 + s10, best0 + s01, best1 + s11
                back.append((b0 > a0, b1 > a1))
                best0, best1 = max(a0, b0), max(a1, b1) + e
            previous = block
        state, path = best1 + self.end[1] > best0 + self.end[0], []
        for from0, from1 in reversed(back):
            path.append(state)
            state = from1 if state else from0
        path.append(state)
        return path[::-1]

    def main_text(self, page: str | None) -> str:
        found = blocks(page, self.root)
        return "\n".join(b.text for b, keep in zip(found, self.decode(found)) if keep)


def train(pages: list[tuple[str, str]], epochs: int = 250, ridge: float = 1e-3) -> Field:
    """Fit a field to labelled pages (html, main text): blocks whose text is a line of the main text, in order, are article.

    All pages go through forward and backward sums together, padded to the longest; full-batch Adam on the likelihood.
    """
    root, cut, labels, names = Node("", frozenset()), [], [], {}
    for page, main in pages:
        found, lines, at = blocks(page, root), main.split("\n"), 0
        mine = []
        for b in found:
            hit = at < len(lines) and b.text == lines[at]
            at += hit
            mine.append(int(hit))
        if not found:
            continue
        labels.append(mine)
        rows = []
        for k, b in enumerate(found):
            own = [*b.node.features, *text_features(b, found[k - 1] if k else None)]
            rows.append([names.setdefault(f, len(names)) for f in own])
        cut.append(rows)
    n, length, d = len(cut), max(map(len, cut)), len(names)
    where = [(i, t, f) for i, rows in enumerate(cut) for t, row in enumerate(rows) for f in row]
    i, t, f = (np.array(x) for x in zip(*where))
    flat = i * length + t
    there, y = np.zeros((n, length), bool), np.zeros((n, length), int)
    for k, mine in enumerate(labels):
        there[k, : len(mine)], y[k, : len(mine)] = True, mine
    last = there.sum(axis=1) - 1
    w, chain, start, end = np.zeros(d), np.zeros((2, 2)), np.zeros(2), np.zeros(2)
    theta = lambda: np.concatenate([w, chain.ravel(), start, end])
    m, v = np.zeros(d + 8), np.zeros(d + 8)
    rows = np.arange(n)
    sums = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for epoch in range(1, epochs + 1):
        e = np.zeros((n, length, 2))
        e[:, :, 1] = np.bincount(flat, w[f], n * length).reshape(n, length)
        fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        fwd[:, 0] = start + e[:, 0]
        for k in range(1, length):
            fwd[:, k] = np.where(there[:, k, None], sums(fwd[:, k - 1, :, None] + chain, 1) + e[:, k], 0)
        bwd[rows, last] = end
        for k in range(length - 2, -1, -1):
            step = sums(chain + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
            bwd[:, k] = np.where((k < last)[:, None], step, bwd[:, k])
        z = sums(fwd[rows, last] + end, 1)
        p = np.where(there[:, :, None], np.exp(fwd + bwd - z[:, None, None]), 0)
        pairs = np.exp(fwd[:, :-1, :, None] + chain + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        pairs = np.where(there[:, 1:, None, None], pairs, 0).sum(axis=(0, 1))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
        miss = (p[:, :, 1] - y * there).ravel()
        g = np.concatenate([
            np.bincount(f, miss[flat], d), (pairs - seen).ravel(),
            p[:, 0].sum(axis=0) - np.bincount(y[:, 0], minlength=2),
            p[rows, last].sum(axis=0) - np.bincount(y[rows, last], minlength=2),
        ]) / n + ridge * theta()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * np.sqrt(1 - 0.99**epoch) / (1 - 0.9**epoch) * m / (np.sqrt(v) + 1e-8)
        w, chain, start, end = w - step[:d], chain - step[d : d + 4].reshape(2, 2), start - step[d + 4 : d + 6], end - step[d + 6 :]
    return Field({k: float(w[j]) for k, j in names.items() if abs(w[j]) > 1e-4}, chain.tolist(), start.tolist(), end.tolist())


class PageWriter:
    """Writes one labelled page after another, all from one seed."""

    BOX = "div section div div".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice(x) for x in ("bcdfghklmnprstvz", "aeiouéöä", "nrstlm")) for _ in range(150)]

    def some(self, *items):
        return self.r.choice(items)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 3)))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 14).capitalize() + self.some(".", ".", ".", "!", "?") for _ in range(self.r.randint(low, high)))

    def marked(self, tag: str, inner: str, *names: str) -> str:
        name = self.some(*names) if names else ""
        kind = self.some("class", "class", "id")
        near = f' {kind}="{name}"' if name else ""
        if self.chance(0.1) and name:
            near = f" {kind}='{name} {self.words(1, 1)}'"
        return f"<{tag}{near}>{inner}" + ("" if tag == "p" and self.chance(0.2) else f"</{tag}>")

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        how = self.r.random()
        if how < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if how < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def odd(self) -> str:
        """Text of an article that looks little like prose: columns, shouting, signs, a single word."""
        row = lambda: " | ".join(self.words(1, 1) for _ in range(self.r.randint(2, 9)))
        return self.some(row() + ".", row(), self.words(3, 20).upper() + "!!", self.words(4, 20).replace(" ", "%%% "), self.words(1, 1), self.words(1, 2).capitalize() + ".")

    def prose(self, paragraphs: int) -> str:
        return "".join(self.some("<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "{}").format(self.sentences(1, 4)) for _ in range(paragraphs))

    def menu(self) -> str:
        if self.chance(0.5):
            return self.marked("nav", self.links(3, 8))
        return self.marked(self.some("div", "ul", "nav"), self.links(3, 8), "menu", "nav", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "top-nav", "topmenu", "pagination", "toc")

    def header(self) -> str:
        inner = self.some(f"<h1>{self.words(1, 3)}</h1>", f"<h2>{self.words(1, 4)}</h2>", f"<div>{self.words(1, 4)}</div>", f"<a href='/'>{self.words(1, 2)}</a>", f"<p>{self.sentences(1, 1)}</p>") + (self.menu() if self.chance(0.3) else "")
        return self.marked("header", inner) if self.chance(0.5) else self.marked("div", inner, "header", "site-header", "masthead", "topbar", "top", "branding", "logo", "page-header", "tagline")

    def footer(self) -> str:
        inner = self.some("&copy; {}", "&copy; 2024 {} &middot; all", "<p>{}</p>", "{} &middot; {}", "<div>{}</div>").format(self.words(1, 4), self.sentences(1, 3)) + (self.links(2, 5) if self.chance(0.4) else "")
        return self.marked("footer", inner) if self.chance(0.6) else self.marked("div", inner, "footer", "site-footer", "copyright", "colophon", "legal", "bottom", "page-footer", "imprint")

    def sidebar(self) -> str:
        inner = self.marked(self.some("div", "section"), f"<h3>{self.words(1, 3)}</h3>" + self.some(self.links(3, 7), self.prose(2), self.prose(1)), "widget", "box", "module", "", "teaser", "related", "popular")
        return self.marked("aside", inner) if self.chance(0.5) else self.marked("div", inner, "sidebar", "side", "right-col", "sidebar-right", "rail", "related-posts", "widgets", "secondary", "recommended", "trending", "teasers")

    def notice(self) -> str:
        inner = self.some("{}", "<p>{}</p>").format(self.sentences(1, 3)) + (f"<button>{self.words(1, 2)}</button>" if self.chance(0.5) else "")
        return self.marked(self.some("div", "section", "p"), inner if self.chance(0.5) else self.sentences(1, 2), "cookie", "cookie-notice", "notice", "consent", "banner", "alert", "gdpr", "message", "warning", "privacy-notice", "paywall", "cookie-banner", "disclaimer", "popup", "modal")

    def advert(self) -> str:
        inner = self.some(self.sentences(1, 2), self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", f"<a href='#'>{self.words(2, 6)}</a>")
        return self.marked(self.some("div", "div", "aside", "section"), inner, "ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner-ad", "adsense", "ad-slot", "sponsor", "adbox", "commercial")

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input type=text>" + self.some("", f"<p>{self.sentences(1, 2)}</p>", f"<select><option>{self.words(1, 1)}<option>{self.words(1, 1)}</select>") + f"<button>{self.words(1, 2)}</button>"
        made = f"<form action='/x'>{inner}</form>"
        return made if self.chance(0.5) else self.marked("div", made, "search", "newsletter", "subscribe", "login", "signup", "contact", "subscription")

    def share(self) -> str:
        return self.marked(self.some("div", "ul", "p"), self.links(2, 4), "share", "social", "tags", "share-bar", "sharing", "meta-links", "toolbar", "follow")

    def comments(self) -> str:
        one = lambda: self.marked(self.some("li", "div", "div", "article"), self.some("", f"<b>{self.words(1, 2)}</b> ", f"<div>{self.words(1, 2)}</div>", f"<h4>{self.words(1, 2)}</h4>") + self.prose(self.r.randint(1, 3)), "comment", "comment", "reply", "comment-body", "response", "review", "")
        inner = self.some("", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 2)}</h3>") + "".join(one() for _ in range(self.r.randint(1, 5))) + (self.form() if self.chance(0.3) else "")
        return self.marked(self.some("div", "section", "ol", "ul"), inner, "comments", "comments", "comment-list", "discussion", "responses", "reader-comments", "commentlist", "replies", "disqus-thread", "feedback", "user-comments", "reviews")

    def article(self, lines: list[str]) -> str:
        def kept(text: str) -> str:
            lines.append(text)
            if self.chance(0.15):
                k = text.find(" ")
                return f"<b>{text}" if k < 0 else self.some(f"<em>{text[:k]}</em>{text[k:]}", f"<b>{text}<br>", f"<a href='#'>{text[:k]}</a>{text[k:]}", text.replace(" ", "\n", 1))
            return text

        out = []
        if self.chance(0.85):
            headline = f"<{(h := self.some('h1', 'h1', 'h2'))}>{kept(self.words(2, 9).capitalize())}</{h}>"
            if self.chance(0.1):
                headline = f'<{h}><a href="/x">{lines[-1]}</a></{h}>'
            out.append(self.marked("header", headline) if self.chance(0.1) else headline)
        for _ in range(self.r.choice((1, 2, 3, 4, 6, 9, 14))):
            how = self.r.random()
            if how < 0.72:
                out.append(self.marked("p", kept(self.odd() if self.chance(0.15) else self.sentences(1, 6)), "", "", "", "", "text", "lead", "intro"))
            elif how < 0.8:
                out.append(f"<{(h := self.some('h2', 'h3', 'h4'))}>{kept(self.words(1, 6))}</{h}>")
            elif how < 0.86:
                out.append(f"<{(u := self.some('ul', 'ol'))}>" + "".join(f"<li>{kept(self.words(1, 12))}</li>" for _ in range(self.r.randint(2, 5))) + f"</{u}>")
            elif how < 0.9:
                out.append(f"<blockquote><p>{kept(self.sentences(1, 2))}</p></blockquote>")
            elif how < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{kept(self.words(1, 2))}</td><td>{kept(self.words(1, 3))}</td></tr>" for _ in range(2)) + "</table>")
            elif how < 0.95:
                out.append(f"<pre>{kept(self.words(3, 9))}</pre>")
            else:
                out.append(f"<div>{kept(self.sentences(1, 4))}</div>")
            if self.chance(0.1):
                out.append(self.some(self.advert, self.advert, self.share, self.form, self.notice, self.sidebar, self.menu)())
        return "".join(out)

    def bare(self) -> tuple[str, str]:
        """A page that is its article and little else."""
        lines = [self.sentences(1, 3) for _ in range(self.some(1, 1, 2, 3))]
        inner = "".join(f"<p>{x}</p>" for x in lines)
        around = self.some("<article>{}</article>", "<article>{}</article>", "{}", "<main>{}</main>", "<div class='content'>{}</div>").format(inner)
        return self.some("{}", "<html><body>{}</body></html>").format(around + (self.footer() if self.chance(0.3) else "")), "\n".join(lines)

    def page(self) -> tuple[str, str]:
        if self.chance(0.08):
            return self.bare()
        lines: list[str] = []
        body = self.article(lines)
        tail = "".join(x() for x, p in ((self.share, 0.2), (self.advert, 0.1), (self.comments, 0.25), (self.form, 0.1)) if self.chance(p))
        inside = self.chance(0.5)
        inner = body + (tail if inside else "")
        how = self.r.random()
        if how < 0.45:
            main = self.marked("article", inner, "", "", "", "post", "entry", "h-entry")
        elif how < 0.85:
            main = self.marked(self.some("div", "div", "section", "main"), inner, "post", "entry-content", "article", "article-body", "story", "content", "main-text", "post-content", "body-text", "main", "story-body", "page-content", "text")
        elif how < 0.92:
            main = f"<main>{inner}</main>"
        else:
            main = f"<table><tr><td>{inner}</td></tr></table>" if self.chance(0.3) else f"<div>{inner}</div>"
        main += "" if inside else tail
        side = self.sidebar() if self.chance(0.35) else ""
        middle = self.some(side + main, main + side, main + side)
        if self.chance(0.4):
            middle = self.marked(self.some("div", "main", "div"), middle, "container", "wrapper", "row", "content", "main", "page", "layout", "")
        top = [x() for x, p in ((self.notice, 0.25), (self.header, 0.45), (self.menu, 0.75), (self.form, 0.15), (self.advert, 0.5)) if self.chance(p)]
        if self.chance(0.3):
            self.r.shuffle(top)
        bottom = [x() for x, p in ((self.advert, 0.1), (self.menu, 0.1), (self.notice, 0.1), (self.footer, 0.85)) if self.chance(p)]
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title><style>p{{margin:0}}</style></head><body>" + "".join(top)
        page += self.some("", "<!-- x -->", '<script>var a="</p>";</script>') + middle + "".join(bottom) + "</body></html>"
        return page, "\n".join(lines)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, str]]:
    writer = PageWriter(seed)
    return [writer.page() for _ in range(n)]


_FIELDS: dict[str, Field] = {}


def _field(settings: str) -> Field:
    if settings not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[settings] = Field(**json.loads(settings))
    return _FIELDS[settings]


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html)."""
    model = model or train(labelled_pages())
    settings = json.dumps({"weights": model.weights, "chain": model.chain, "start": model.start, "end": model.end})
    shared = pages.sparkSession.sparkContext.broadcast(settings)

    def run(batches):
        own = _field(shared.value)
        for batch in batches:
            if len(own.root.inner) > 1_000:
                own.root.inner.clear()
            texts = [own.main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
