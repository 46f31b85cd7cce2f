"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has features of its
ancestors (tags, words of class, id and role attributes) and of its text; the field labels the blocks of
a page, in order, as main text or boilerplate, and Viterbi decoding gives the most probable labelling.
The field is trained once by gradient ascent of the regularised likelihood on ``TRAINING_PAGES`` labelled
pages, which are drawn from a grammar of layouts (see ``labelled_page``), a documented, fixed bound.

Character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by one space. Text of scripts, styles and other raw elements is no block; what a script, style or
other element of ``RAW_TEXT`` holds is not read as markup, and only its own end tag ends it.

Cases: a null or empty page, and one without main blocks, gives the empty text. Broken markup is read
as far as it goes: open elements end with the page, unknown end tags are ignored, a tag that never
closes ends with the text. Repeated rows are kept. Only the named columns are read.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 600
ROUNDS = 160
MAIN = 1

#: From "<": a comment or the like, or a tag's name. What follows a name up to ">" outside quotation marks; a mark without its fellow is a character.
OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)", re.S)
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
#: Elements nested deeper than this are read as siblings of the innermost ones.
DEPTH = 512
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Element names of the markup language by their role here.
RAW = frozenset("script style noscript template textarea title svg iframe select head".split())
RAW_TEXT = frozenset("script style noscript textarea title iframe".split())
END_TAG = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])[^>]*>?", re.I | re.A) for name in RAW_TEXT}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow mtext msup msub msubsup mfrac msqrt mroot mover munder munderover semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Drawings and menus of choices that are left open end where such an element starts.
LEFT_OPEN = frozenset(("svg", "select"))
LIST_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Tags:
    """The tags of a page from left to right, in time that grows with the page."""

    def __init__(self, page: str):
        self.page, self.quoted = page, True

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the first tag from a place on; comments have no name. A tag that never closes ends with the page."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if m := OPEN.match(page, at):
                if not m[2]:
                    return at, m.end(), False, "", ""
                if self.quoted and (rest := REST.match(page, m.end())):
                    return at, rest.end(), bool(m[1]), m[2].lower(), rest[1]
                # Marks that hide every ">" up to the end of the page are taken for characters, here and from now on.
                self.quoted = False
                end = page.find(">", m.end())
                return at, end + 1 if end >= 0 else len(page), bool(m[1]), m[2].lower() if end >= 0 else "", page[m.end() : max(end, m.end())]
            at += 1
        return None


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path, characters inside links) of each leaf block; the path has the ancestors' features."""
    out, stack, parts, links, at, raw, nested = [], [], [], 0, 0, "", 0
    linked, deep = 0, Counter()
    tags = Tags(page)

    def flush() -> None:
        nonlocal links
        text = "".join(parts)
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append((text, tuple(f for _, own in stack for f in own), links))
        parts.clear()
        links = 0

    def pop(to: int) -> None:
        nonlocal linked
        if any(name not in INLINE for name, _ in stack[to:]):
            flush()
        linked -= sum(name == "a" for name, _ in stack[to:])
        del stack[to:]

    while tag := tags.next(at):
        start, end, closing, name, rest = tag
        if not raw and start > at:
            text = page[at:start]
            parts.append(text)
            if linked:
                links += len(text)
        at = end
        if not name:
            continue
        if name in RAW_TEXT and not closing and not rest.endswith("/"):
            found = END_TAG[name].search(page, at)
            at = found.end() if found else len(page)
            continue
        if raw in LEFT_OPEN and not closing and name in CLOSES_P:
            raw = ""
        if raw:
            if name == raw and (closing or not rest.endswith("/")):
                nested += -1 if closing else 1
                raw = raw if nested else ""
            continue
        if name in RAW:
            if not closing and not rest.endswith("/"):
                if name == "head":
                    continue
                raw, nested = name, 1
            continue
        if closing:
            if deep[name]:
                deep[name] -= 1
                if name not in INLINE:
                    flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            else:
                if name == "p":
                    flush()
            continue
        if name not in INLINE:
            flush()
            scope, ends = (LIST_ITEMS[name], name) if name in LIST_ITEMS else (("article", "body", "div", "section", "td", "li", "blockquote"), "p") if name in CLOSES_P else ((), "")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == ends:
                    pop(i)
                    break
                if stack[i][0] in scope:
                    break
        elif name == "br":
            parts.append(" ")
        if name in VOID or rest.endswith("/"):
            continue
        if len(stack) >= DEPTH:
            deep[name] += 1
            continue
        own = [] if name in INLINE else ["t=" + name]
        for x in ATTRIBUTE.finditer(rest):
            own += ["w=" + w for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", x[2] or x[3] or x[4] or "").lower())]
        stack.append((name, tuple(own)))
        linked += name == "a"
    if not raw and at < len(page):
        parts.append(re.sub(r"<[A-Za-z/!?][^>]*\Z", "", page[at:]))
    flush()
    return out


SECTIONS = frozenset("t=" + x for x in "article main section nav header footer aside form blockquote ul ol table".split())
PHRASES = re.compile(r"©|\b(cookies?|copyright|all rights|privacy|subscribe|sign up|log ?in|share|newsletter|advert\w*|sponsored|repl(?:y|ies)|comments?|read more|related|menu|terms)\b", re.I)


def features(blocks: list[tuple[str, tuple[str, ...], int]]) -> list[list[str]]:
    out = []
    for text, path, links in blocks:
        words = text.count(" ") + 1
        own = next((f for f in reversed(path) if f[0] == "t"), "t=")
        f = ["1", "o" + own, f"n{min(6, words.bit_length())}", "l" + ("0" if not links else "1" if 2 * links < len(text) else "2"), "." if text[-1] in ".!?…:\"'”»)" else "-"]
        f += {*path}
        # The nearest section and whether anything between it and the block is named.
        near = next((i for i in range(len(path) - 1, -1, -1) if path[i] in SECTIONS), -1)
        section = path[near] if near >= 0 else ""
        f += ["s" + section, "s" + section + own, "s" + section + ("+named" if any(x[0] == "w" for x in path[near + 1 :]) else "")]
        if not ("t=article" in path or "t=main" in path):
            f.append("no-article")
        if words < 60 and (m := PHRASES.search(text)):
            f.append("p=" + m.group().lower())
        out.append(f)
    return out


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """A page of a random layout and the labels of its leaf blocks."""
    labels: list[int] = []

    gap = r.choice((" ", " ", " ", " | ", "%%% ", "### ", " - "))

    def words(n: int) -> str:
        return gap.join("".join(r.choice("bcdfglmnprstv") + r.choice("aeiouéü") for _ in range(r.randint(1, 4))) for _ in range(n))

    def say(lo: int, hi: int, label: int, end: str = ".") -> str:
        labels.append(label)
        return (words(r.randint(lo, hi)) + end).capitalize()

    def attr(*names: str) -> str:
        x = r.random()
        value = r.choice(names)
        return "" if not names or x < 0.15 else f' class="{value}"' if x < 0.65 else f' id="{value}"' if x < 0.9 else f' class="{words(1)} {value}"'

    def menu(label: int = 0) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3, label, "")}</a></li>' for i in range(r.randint(3, 7))) + "</ul>"

    def extra(*kinds: str) -> str:
        kind = r.choice(kinds)
        if kind == "ad":
            names = ("ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "ad-slot")
            return r.choice(('<div class="{}">{}</div>', '<div id="{}"><p>{}</p></div>', '<aside class="{}">{}</aside>')).format(r.choice(names), say(3, 20, 0))
        if kind == "notice":
            names = ("notice", "cookie-notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "popup", "message")
            return f'<div class="{r.choice(names)}"><p>{say(5, 25, 0)}</p>' + (f"<button>{say(1, 2, 0, '')}</button>" if r.random() < 0.5 else "") + "</div>"
        if kind == "sidebar":
            names = ("sidebar", "related", "widget", "side", "recommended", "popular", "more")
            tag = r.choice(("aside", "aside", "div", "section"))
            open_ = f'<{tag} class="{r.choice(names)}">' if tag != "aside" or r.random() < 0.5 else "<aside>"
            return open_ + (f"<h3>{say(1, 3, 0, '')}</h3>" if r.random() < 0.6 else "") + (menu() if r.random() < 0.5 else f"<p>{say(4, 40, 0)}</p>") + f"</{tag}>"
        if kind == "form":
            return f'<form{attr("search", "newsletter", "login", "signup", "subscribe")}>' + (f"<label>{say(1, 4, 0, '')}</label>" if r.random() < 0.7 else "") + f'<input type="text"><button>{say(1, 2, 0, "")}</button>' + (f"<p>{say(4, 15, 0)}</p>" if r.random() < 0.3 else "") + "</form>"
        if kind == "comments":
            tag, names = r.choice(("div", "section", "ol", "aside")), ("comments", "comment-list", "responses", "discussion", "replies", "disqus")
            item = "li" if tag == "ol" else "div"
            body = "".join(f'<{item} class="{r.choice(("comment", "reply", "response"))}">' + r.choice(("<p>{}</p>", "{}", "<p><b>x</b> {}</p>", "<span>x</span> {}")).format(say(3, 50, 0)) + f"</{item}>" for _ in range(r.randint(1, 4)))
            return f'<{tag} {r.choice(("class", "id"))}="{r.choice(names)}">' + (f"<h3>{say(1, 2, 0, '')}</h3>" if r.random() < 0.5 and tag != "ol" else "") + body + f"</{tag}>"
        if kind == "share":
            return f'<div class="{r.choice(("share", "social", "tags", "breadcrumb", "breadcrumbs", "pagination", "toolbar"))}">' + " ".join(f'<a href="#">{words(1)}</a>' for _ in range(3)) + "</div>" if labels.append(0) is None else ""
        return ""

    def paragraphs() -> str:
        out = ""
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.7:
                body = say(1, r.choice((3, 8, 30, 120)), 1, r.choice((".", ".", "!", "?", "", "###", "&amp;")))
                if r.random() < 0.2:
                    body = body.replace(" ", f' <a href="/x">{words(1)}</a> ', 1)
                out += r.choice(("<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<p class=\"text\">{}</p>")).format(body)
            elif x < 0.78:
                out += f"<h{(n := r.randint(2, 4))}>{say(1, 8, 1, '')}</h{n}>"
            elif x < 0.84:
                out += "<ul>" + "".join(f"<li>{say(2, 25, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            elif x < 0.9:
                out += f"<blockquote><p>{say(4, 40, 1)}</p></blockquote>"
            elif x < 0.94:
                out += f"<div>{say(5, 60, 1)}</div>"
            elif x < 0.97:
                out += "<table>" + "".join(f"<tr><td>{say(1, 4, 1, '')}</td><td>{say(1, 4, 1, '')}</td></tr>" for _ in range(2)) + "</table>"
            else:
                out += f"<pre>{say(3, 20, 1, ';')}</pre>"
            if r.random() < 0.12:
                out += extra("ad", "notice", "sidebar", "form", "share")
        return out

    page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"
    if r.random() < 0.3:
        page += extra("notice")
    if r.random() < 0.6:
        page += r.choice(("<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>')).format((f"<h1>{say(1, 3, 0, '')}</h1>" if r.random() < 0.4 else f"<p>{say(1, 8, 0, '')}</p>") + (f"<nav>{menu()}</nav>" if r.random() < 0.4 else ""))
    if r.random() < 0.75:
        page += r.choice(("<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="navigation">{}</div>', '<div role="navigation">{}</div>')).format(menu())
    for _ in range(r.randint(0, 2)):
        page += extra("ad", "sidebar", "form", "notice", "share")
    open_, close = r.choice((("<article>", "</article>"),) * 4 + (("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post-body">', "</div>"), ('<section class="entry-content">', "</section>"), ('<div id="main"><div class="article">', "</div></div>"), ('<div class="story">', "</div>"), ('<div role="main">', "</div>")))
    if r.random() < 0.3:
        # Articles in elements that say nothing, or in none.
        open_, close = r.choice((("<section>", "</section>"), ("<div>", "</div>"), ("<div>", "</div>"), ("", ""), ("", ""), ("<table><tr><td>", "</td></tr></table>"), ('<div class="wrapper">', "</div>"), ('<div class="container"><div class="row">', "</div></div>"), ('<div id="page"><div>', "</div></div>")))
    page += open_
    if r.random() < 0.8:
        title = f"<h1>{say(1, 12, 1, r.choice(('', '.')))}</h1>"
        page += title if r.random() < 0.85 else f"<header>{title}</header>"
    page += paragraphs()
    if r.random() < 0.2:
        page += extra("comments", "share", "form", "sidebar")
    page += close
    for _ in range(r.randint(0, 3)):
        page += extra("comments", "ad", "sidebar", "form", "notice", "share")
    if r.random() < 0.85:
        body = (f"<p>{say(2, 14, 0)}</p>" if r.random() < 0.4 else f"&copy; {say(2, 14, 0)}") + (menu() if r.random() < 0.25 else "")
        page += r.choice(("<footer>{}</footer>", "<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>')).format(body)
    if r.random() < 0.9:
        page += "</body></html>"
    return page, labels


class Field:
    """Feature weights of boilerplate and main text, and the weights of neighbouring labels."""

    def __init__(self, weights: dict[str, tuple[float, float]], steps: list[list[float]]):
        self.weights, self.steps = weights, steps

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """The most probable labels of a page (Viterbi)."""
        (a00, a01), (a10, a11) = self.steps
        get, none = self.weights.get, (0.0, 0.0)
        back, s0, s1 = [], 0.0, 0.0
        for t, fs in enumerate(blocks):
            e0 = e1 = 0.0
            for f in fs:
                w = get(f, none)
                e0 += w[0]
                e1 += w[1]
            if t:
                p0, p1 = s0 + a00 < s1 + a10, s0 + a01 < s1 + a11
                back.append((p0, p1))
                s0, s1 = e0 + (s1 + a10 if p0 else s0 + a00), e1 + (s1 + a11 if p1 else s0 + a01)
            else:
                s0, s1 = e0, e1
        out = [int(s1 > s0)]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1] if blocks else []


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, penalty: float = 0.3) -> Field:
    """Fit by Adam steps on the penalised negative log likelihood of all pages at once."""
    pages = [p for p in pages if p[1]]
    names = {f: i for i, f in enumerate(sorted({f for p, _ in pages for fs in p for f in fs}))}
    n, most = len(pages), max(len(y) for _, y in pages)
    size = np.array([len(y) for _, y in pages])
    live = np.arange(most) < size[:, None]
    gold = np.zeros((n, most), np.int64)
    gold[live] = np.concatenate([y for _, y in pages])
    rows = [fs for p, _ in pages for fs in p]
    owner, feat = np.repeat(np.arange(len(rows)), [len(f) for f in rows]), np.array([names[f] for fs in rows for f in fs])
    begin = np.concatenate([[0], np.cumsum([len(f) for f in rows])[:-1]])
    both = live[:, 1:]
    w, a = np.zeros((len(names), 2)), np.zeros((2, 2))
    want_a = np.zeros((2, 2))
    np.add.at(want_a, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, a)]
    lse = lambda x, axis: np.logaddexp(*np.moveaxis(x, axis, 0))
    for k in range(1, rounds + 1):
        e = np.zeros((n, most, 2))
        e[live] = np.add.reduceat(w[feat], begin)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, most):
            fwd[:, t] = np.where(live[:, t, None], e[:, t] + lse(fwd[:, t - 1, :, None] + a, 1), fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            bwd[:, t] = np.where(live[:, t + 1, None], lse(a + (e + bwd)[:, t + 1, None, :], 2), 0)
        z = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])[live]
        pair = np.exp(fwd[:, :-1, :, None] + a + (e + bwd)[:, 1:, None, :] - z[:, None, None, None])[both].sum(axis=0)
        miss = p - np.eye(2)[gold[live]]
        grad_w = np.stack([np.bincount(feat, miss[owner, y], len(names)) for y in (0, 1)], axis=1) + penalty * w
        for x, g, (m1, m2) in ((w, grad_w, state[0]), (a, pair - want_a + penalty * a, state[1])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x -= 0.15 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return Field({f: tuple(w[i].tolist()) for f, i in names.items()}, a.tolist())


@functools.lru_cache(1)
def default_field() -> Field:
    """The field trained on the grammar's pages."""
    pages = []
    for seed in range(TRAINING_PAGES):
        page, labels = labelled_page(random.Random(seed))
        blocks = features(leaf_blocks(page))
        if len(blocks) == len(labels):
            pages.append((blocks, labels))
    return train(pages)


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join(b[0] for b, y in zip(blocks, field.decode(features(blocks))) if y == MAIN) if blocks else ""


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text", field: Field | None = None) -> DataFrame:
    """All columns, and the main text of the page."""
    field = field or default_field()

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda page: main_text(page, field))

    return pages.withColumn(out, F.pandas_udf(run, "string")(F.col(html_col)))
