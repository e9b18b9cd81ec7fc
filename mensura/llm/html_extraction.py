"""Main text of web pages: gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is read into a tree of block elements. Each node has features of its subtree (size, text
and link density), its tag and attribute tokens, its depth, its siblings and its ancestors.
Boosted trees give the probability that a node holds main text. Decoding then picks, by dynamic
programming over the tree, the likeliest labelling in which a kept node has only kept ancestors,
so no choice for a node contradicts the one for a node above or below it.

Pages come without labels, so the trees are trained on pages composed from a bounded sample of
the given pages' own text blocks: article and page furniture are set in many layouts, with known
roles.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import bounded_sample, strings

#: Pages sampled and whole blocks of text drawn from each (the documented bounds), and pages
#: composed from them.
SAMPLE_PAGES, SAMPLE_BLOCKS, COMPOSED = 300, 20, 2000
TREES, DEPTH, RATE, BINS = 80, 4, 0.25, 24

#: Elements that start a block of their own, never have content, or hold raw text (HTML's lists).
BLOCKS = frozenset(
    "html head body title article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset legend select option optgroup button textarea label details summary address hr script style noscript template iframe svg".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Controls of forms, whose texts are never part of a page's text.
CONTROLS = frozenset(("select", "option", "optgroup", "button"))
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript", "template"))
#: Elements whose start tag closes an open one of their group first, and what bounds the search.
GROUP = {"li": "item", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "option": "option", "p": "p", "thead": "rows", "tbody": "rows", "tfoot": "rows"}
BOUNDS = {
    "item": BLOCKS - {"address", "div", "p", "li"}, "term": BLOCKS - {"address", "div", "p", "dt", "dd"}, "row": frozenset(("table",)), "rows": frozenset(("table",)), "cell": frozenset(("table", "tr")),
    "option": frozenset(("select",)), "p": frozenset(("button", "caption", "table", "td", "th", "template")),
}
#: Start tags that close an open p.
ENDS_P = frozenset("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
_SCOPES = {tag: [(g, GROUP.get(tag) == g) for g in BOUNDS if GROUP.get(tag) == g or tag in BOUNDS[g]] for tag in BLOCKS}

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The next attribute: its name and, where a value follows, the equals sign. Quotes mean something only after it.
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(\s*=\s*)?)?")
UNQUOTED = re.compile(r"[^\s>]*")
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAMED = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>?", re.I) for t in RAW}


@dataclass
class Page:
    """A page's block elements in page order, the root first, as columns; and its blocks of text."""

    tags: list[str]
    parents: list[int]
    tokens: list[list[str]]
    links: list[int]
    texts: list[tuple[int, str]]  # (element, text of one block), in page order


def read_page(page: str) -> Page:
    """Reads a page in one pass; unclosed and stray tags, odd quotes and bare signs are borne.

    Tags are read as browsers do: a quote begins a value only after an equals sign, a comment or
    tag that never ends takes the rest. Character references are decoded in each run of text
    between tags. Every element is opened and closed once, so the time is linear in the page.
    """
    tags, parents, tokens, links = ["html"], [-1], [[]], [0]
    texts: list[tuple[int, str]] = []
    opened, counts = [0], dict.fromkeys(BLOCKS, 0)
    scopes: dict[str, list[int]] = {g: [] for g in BOUNDS}  # open elements of a group, -1 where a bound is
    pending: list[str] = []
    unquoted: set[str] = set()  # quotes that don't occur any more
    in_link, start, at, size = False, 0, 0, len(page)

    def close(element: int) -> None:
        while opened[-1] != element:
            close_last()
        close_last()

    def close_last() -> None:
        tag = tags[opened.pop()]
        counts[tag] -= 1
        for g, _ in _SCOPES[tag]:
            scopes[g].pop()

    def flush() -> None:
        text = " ".join("".join(pending).split())
        if text and tags[opened[-1]] not in CONTROLS:
            texts.append((opened[-1], text))
        pending.clear()

    def take(end: int) -> None:
        if end > start:
            piece = page[start:end]
            pending.append(html.unescape(piece) if "&" in piece else piece)
            if in_link:
                links[opened[-1]] += end - start

    while True:
        at = page.find("<", at)
        if at < 0:
            take(size)
            break
        m = OPEN.match(page, at)
        if not m:
            after = page[at + 1 : at + 2]
            if after not in ("!", "?", "/") or (after == "/" and at + 2 >= size):
                at += 1  # a bare sign
                continue
            take(at)
            whole = COMMENT.match(page, at)
            end = whole.end() if whole else page.find(">", at) + 1
            start = at = end or size
            continue
        take(at)
        tag, found, at = m[2].lower(), [], m.end()
        wanted = tag in BLOCKS and not m[1]
        while at < size and page[at] != ">":
            own = ATTRIBUTE.match(page, at)
            at = own.end()
            if own[2]:
                quote = page[at : at + 1]
                end = -1
                if quote in ("'", '"') and quote not in unquoted:
                    end = page.find(quote, at + 1)
                    if end < 0:
                        unquoted.add(quote)
                value, at = (page[at + 1 : end], end + 1) if end >= 0 else ((v := UNQUOTED.match(page, at))[0], v.end())
                if wanted and own[1].lower() in NAMED:
                    found += [w.lower() for w in WORD.findall(value)]
        empty = at < size and page[at - 1] == "/"
        start = at = min(at + 1, size)
        if tag == "a":
            in_link = not m[1]
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        in_link = False
        if m[1]:
            if counts[tag]:
                while tags[opened[-1]] != tag:
                    close_last()
                close_last()
            continue
        if tag in ("html", "hr"):
            if tag == "hr" and scopes["p"] and scopes["p"][-1] >= 0:
                close(scopes["p"][-1])
            continue
        for group in ("p" if tag in ENDS_P else None, GROUP.get(tag)):
            if group and scopes[group] and scopes[group][-1] >= 0:
                close(scopes[group][-1])
        element = len(tags)
        tags.append(tag), parents.append(opened[-1]), tokens.append(found), links.append(0)
        if empty:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            start = at = end.end() if end else size
            continue
        opened.append(element)
        counts[tag] += 1
        for g, member in _SCOPES[tag]:
            scopes[g].append(element if member else -1)
    flush()
    return Page(tags, parents, tokens, links, texts)


FEATURES = (
    "tag_odds", "token_odds", "token_least", "above_tag", "above_token", "above_least", "depth", "log_text", "log_own", "text_share", "link_share", "blocks", "words_per_block",
    "longest", "full_stops", "tags_per_text", "children", "siblings", "place", "same_tag", "parent_share", "before_log", "after_log", "page_place", "heading", "item", "inner_least",
    "same_count", "above_count", "beside_title",
)
_HEADINGS, _ITEMS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), frozenset(("li", "td", "dd", "option", "button", "label"))


class Odds:
    """Log odds of main text by token; an unknown token has those of its longest known beginning."""

    def __init__(self, known: dict[str, float]):
        self.known, self.seen = known, {}

    def __getitem__(self, token: str) -> float:
        if token not in self.seen:
            if len(self.seen) > 100_000:
                self.seen = {}
            beginning = next((token[:k] for k in range(min(len(token), 20), 3, -1) if token[:k] in self.known), token)
            self.seen[token] = self.known.get(beginning, 0.0)
        return self.seen[token]


def features(page: Page, tags: dict[str, float], tokens: Odds) -> np.ndarray:
    """A feature row for each element. tags, tokens: log odds of main text, learnt with the trees.

    Elements stand in page order, so a subtree is a range and its sums are differences of sums.
    """
    n = len(page.tags)
    parents = page.parents
    up = np.array(parents)
    up[0] = 0
    inner = [1] * n
    for i in range(n - 1, 0, -1):
        inner[parents[i]] += inner[i]
    owner = np.array([e for e, _ in page.texts], np.int64)
    sizes = np.array([len(t) for _, t in page.texts], np.int64)
    own = np.bincount(owner, sizes, n)
    columns = (own, np.minimum(page.links, own), np.bincount(owner, minlength=n), np.bincount(owner, [t.count(".") + t.count(",") for _, t in page.texts], n))
    ends = np.arange(n) + np.array(inner)
    text, links, blocks, stops = (c[ends] - c[:-1] for c in (np.concatenate([[0], np.cumsum(x)]) for x in columns))
    longest = [0] * n
    for e, t in page.texts:
        longest[e] = max(longest[e], len(t))
    odds = [[tokens[t] for t in own] if own else () for own in page.tokens]
    least = [min(o) if o else 0.0 for o in odds]
    inner_least = least.copy()
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if longest[i] > longest[p]:
            longest[p] = longest[i]
        if inner_least[i] < inner_least[p]:
            inner_least[p] = inner_least[i]
    above_least, depth, place, last, before, after, children = [0.0] * n, [0] * n, [0] * n, [-1] * n, [-1] * n, [-1] * n, [0] * n
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parents[i]
        above_least[i] = min(least[p], above_least[p])
        depth[i], place[i] = depth[p] + 1, children[p]
        children[p] += 1
        before[i] = last[p]
        if last[p] >= 0:
            after[last[p]] = i
        last[p] = i
        key = (p, page.tags[i])
        same[key] = same.get(key, 0) + 1
    children = np.array(children, float)
    siblings = children[up]
    siblings[0] = 1
    many = np.array([same.get((parents[i], page.tags[i]), 1) for i in range(n)])
    alike = many / siblings
    titled = [tag == "h1" for tag in page.tags]  # holds the page's title
    for i in range(n - 1, 0, -1):
        if titled[i]:
            titled[parents[i]] = True
    tag_odds, token_odds = np.array([tags.get(t, 0.0) for t in page.tags]), np.array([sum(o) for o in odds])
    log_text = np.append(np.log1p(text), 0.0)  # the last stands for no sibling
    whole, seen = max(1.0, text[0]), np.cumsum(own) - own
    inside = np.arange(n) > 0
    return np.column_stack((
        tag_odds, token_odds, least, tag_odds[up] * inside, token_odds[up] * inside, above_least, depth, log_text[:-1], np.log1p(own), text / whole, links / np.maximum(1, text),
        np.log1p(blocks), text / np.maximum(1, blocks), np.log1p(longest), stops / np.maximum(1, text), np.array(inner) / np.maximum(1, text), children, siblings,
        np.array(place) / siblings, alike, text / np.maximum(1, text[up]), log_text[before], log_text[after], seen / whole, [t in _HEADINGS for t in page.tags], [t in _ITEMS for t in page.tags], inner_least,
        np.log(many), np.log(many)[up], np.array(titled)[up],
    )).astype(float)


# ---- boosted trees -------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and cut of each inner node, value of each leaf."""

    bias: float
    feature: np.ndarray  # [trees, 2**depth - 1]
    cut: np.ndarray
    value: np.ndarray  # [trees, 2**depth]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = at < len(feature)
                if not inner.any():  # all trees are complete, so all rows end at the same depth
                    break
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += value[at - len(feature)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Logistic gradient boosting on binned features, trees grown level by level from histograms."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(d)]
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    z = np.full(n, bias)
    inner = 2**depth - 1
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best, gains = np.zeros((width, 2), np.int64), np.full(width, 1e-6)
            for k in range(d):
                if not len(cuts[k]):
                    continue
                m = len(cuts[k]) + 1
                key = local * m + bins[:, k]
                G = np.bincount(key, g, width * m).reshape(width, m)
                H = np.bincount(key, h, width * m).reshape(width, m)
                gl, hl = G.cumsum(1)[:, :-1], H.cumsum(1)[:, :-1]
                gt, ht = G.sum(1, keepdims=True), H.sum(1, keepdims=True)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                top = gain.argmax(1)
                value_of = gain[np.arange(width), top]
                better = value_of > gains
                gains[better], best[better, 0], best[better, 1] = value_of[better], k, top[better]
            for i in range(width):
                if gains[i] > 1e-6:
                    feature[t, first + i], cut[t, first + i] = best[i, 0], cuts[best[i, 0]][best[i, 1]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        z += value[t, leaf]
    return Trees(bias, feature, cut, value)


# ---- training pages ------------------------------------------------------------------------

#: Layouts to train on (fixed values): elements with attribute tokens, of main text and of what surrounds it.
MAIN = (
    ("article", ""), ("article", "post"), ("article", "entry"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post-content"), ("div", "entry-content"), ("div", "page-content"), ("section", "article-body"),
    ("div", "story text"), ("div", "main"), ("div", "article"), ("div", "body"), ("section", ""), ("div", ""),
    ("div", "inhalt"), ("main", "hauptinhalt"), ("div", "beitrag"), ("article", "artikel"), ("div", "contenu"), ("section", "texte"), ("div", "corps"), ("div", "contenido"), ("main", "cuerpo"), ("article", "articulo"),
)
MENUS = (
    ("nav", ""), ("nav", "navbar"), ("div", "menu"), ("ul", "nav navigation"), ("div", "breadcrumbs"), ("nav", "pagination"), ("div", "pager"), ("div", "tags links"), ("ul", "categories"), ("div", "toc"),
    ("div", "menue"), ("ul", "hauptmenue"), ("div", "seiten blaettern"), ("ul", "rubriken"), ("div", "schlagworte"), ("nav", "menu principal"), ("ul", "rubriques"), ("div", "fil ariane"), ("div", "navegacion"), ("ul", "categorias etiquetas"), ("div", "paginas"),
)
FURNITURE = (
    ("header", ""), ("div", "header masthead"), ("div", "site-header"), ("div", "topbar"), ("footer", ""), ("div", "footer copyright"), ("div", "site-footer legal"), ("div", "colophon"), ("aside", ""), ("div", "sidebar widget"),
    ("div", "rail secondary"), ("div", "ad"), ("div", "ads"), ("section", "advert"), ("div", "advertisement"), ("div", "banner sponsored"), ("div", "sponsor"), ("div", "promo"), ("div", "promotion"), ("div", "cookie notice consent"),
    ("div", "cookies gdpr"), ("div", "alert notice"), ("div", "notification"), ("div", "disclaimer"), ("div", "newsletter subscribe"), ("div", "signup subscription"), ("div", "related recommended"), ("section", "trending popular"),
    ("div", "social share"), ("div", "sharing follow"), ("form", ""), ("form", "search login"), ("div", "popup modal"), ("div", "overlay paywall"),
    ("div", "kopfzeile"), ("div", "fusszeile impressum"), ("div", "seitenleiste"), ("div", "werbung"), ("section", "anzeige"), ("div", "hinweis"), ("div", "datenschutz"), ("div", "anmeldung"), ("div", "verwandte empfehlungen"), ("div", "teilen"),
    ("div", "entete"), ("div", "pied mentions"), ("div", "barre laterale"), ("div", "publicite"), ("div", "avis"), ("div", "inscription lettre"), ("div", "similaires"), ("div", "partager"),
    ("div", "cabecera"), ("div", "pie legal"), ("div", "lateral"), ("div", "publicidad anuncio"), ("div", "aviso"), ("div", "suscripcion boletin"), ("div", "relacionados"), ("div", "compartir"),
)
COMMENTS = (
    ("section", "comments"), ("div", "comments"), ("div", "comment reply"), ("ol", "comment-list"), ("div", "responses"), ("section", "response"), ("div", "replies"), ("div", "disqus_thread"), ("div", "discussion"), ("ul", "respond"),
    ("div", "feedback"), ("div", "reactions"), ("section", "reader-comments"), ("div", "thread messages"), ("aside", "comments"), ("div", "reviews"),
    ("div", "kommentare"), ("section", "kommentar"), ("ol", "leserbriefe meinungen"), ("div", "antworten"), ("div", "commentaires"), ("section", "commentaire"), ("ul", "reponses"), ("div", "comentarios"), ("section", "comentario"), ("ol", "respuestas opiniones"),
)


def compose(blocks: list[str], rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page of the given blocks in a random layout, and the texts that are its main text.

    Main text comes from the first half of the blocks, all else from the second.
    """
    half = max(1, len(blocks) // 2)
    good, bad = ([html.escape(x) for x in own] or ["Word."] for own in (blocks[:half], blocks[half:]))
    pick = lambda own: own[rng.integers(len(own))]
    short = lambda text, low, high: " ".join(text.split()[: rng.integers(low, high)]) or "Word"
    kept: set[str] = set()

    def part(tag: str, tokens: str, inner: str) -> str:
        return f"<{tag}{f' {pick(("class", "id"))}="{tokens}"' if tokens else ''}>{inner}</{tag}>"

    def menu() -> str:
        tag, tokens = pick(MENUS)
        inner = "".join(f'<li><a href="/{i}">{short(pick(bad), 1, 4)}</a></li>' for i in range(rng.integers(2, 9)))
        return part(tag, tokens, inner if tag == "ul" else f"<ul>{inner}</ul>")

    def comments() -> str:
        tag, tokens = pick(COMMENTS)
        item = "li" if tag in ("ol", "ul") else pick(("div", "p", "article", "li"))
        name = pick(("", ' class="comment"', ' class="message"', ' class="item"'))
        one = lambda: pick((pick(bad), f"<p>{pick(bad)}</p>", f"<h4>{short(pick(bad), 1, 3)}</h4><p>{pick(bad)}</p>", f"<b>{short(pick(bad), 1, 3)}</b> {short(pick(bad), 3, 20)}"))
        inner = "".join(f"<{item}{name}>{one()}</{item}>" for _ in range(rng.integers(1, 6)))
        return part(tag, tokens, f"<h3>{short(pick(bad), 1, 4)}</h3>{inner}" if tag not in ("ol", "ul") and rng.random() < 0.5 else inner)

    def remarks() -> str:
        """Comments without a telling name: entries of an author and a text, alike one after the other."""
        who, when = lambda: short(pick(bad), 1, 3), lambda: pick(("", f"<span>{short(pick(bad), 1, 4)}</span>"))
        outer, item = pick((("ul", "li"), ("ol", "li"), ("div", "div"), ("section", "article"), ("dl", "")))
        head = pick(("", "", f"<h3>{short(pick(bad), 1, 4)}</h3>", f"<h2>{rng.integers(1, 90)} {short(pick(bad), 1, 3)}</h2>"))
        if not item:
            return f"{head}<dl>{''.join(f'<dt>{who()} {when()}</dt><dd><p>{pick(bad)}</p></dd>' for _ in range(rng.integers(2, 7)))}</dl>"
        form = pick(("<h4>{0}</h4><p>{1}</p>", "<div>{0}</div><div>{1}</div>", "<p>{0}</p><p>{1}</p>", "<header>{0}</header><p>{1}</p>", "<p>{0}</p><blockquote>{1}</blockquote>"))
        return f"{head}<{outer}>{''.join(f'<{item}>{form.format(f"<b>{who()}</b> {when()}", pick(bad))}</{item}>' for _ in range(rng.integers(2, 7)))}</{outer}>"

    def links() -> str:
        """Links and nothing else, without a telling name: pagers, trails, columns of links."""
        some = [f'<a href="/{i}">{short(pick(bad), 1, 5)}</a>' for i in range(rng.integers(1, 7))]
        listed = "".join(f"<li>{a}</li>" for a in some)
        return pick((f"<p>{pick((' | ', ' ', ' &raquo; ', ' &middot; ')).join(some)}</p>", f"<div>{pick((' | ', ' / ', ' ')).join(some)}</div>", f"<ul>{listed}</ul>", f"<div>{''.join(f'<div>{a}</div>' for a in some)}</div>", f"<table><tr>{''.join(f'<td>{a}</td>' for a in some)}</tr></table>"))

    def furniture() -> str:
        if rng.random() < 0.25:
            return comments()
        tag, tokens = pick(FURNITURE)
        if tag == "form":
            inner = f"<label>{short(pick(bad), 1, 4)}</label><input name=q><button>{short(pick(bad), 1, 2)}</button>"
        else:
            text = short(pick(bad), 3, 25)
            listed = "".join(f"<li>{short(pick(bad), 2, 9)}</li>" for _ in range(rng.integers(1, 5)))
            inner = pick((text, f"<p>{text}</p>", f"<p>{pick(bad)}</p>", f"<h3>{text}</h3><p>{pick(bad)}</p>", f'<a href="/x">{text}</a>', f"<ul>{listed}</ul>"))
        return part(tag, tokens, inner)

    def said(low: int = 0, high: int = 0) -> str:
        text = pick(good)
        text = short(text, low, high) if high else text
        kept.add(" ".join(html.unescape(text).split()))
        return text

    def block() -> str:
        kind = rng.random()
        if kind < 0.55:
            words = said().split(" ")
            if rng.random() < 0.2:
                k = rng.integers(len(words))
                words[k] = f'<a href="/{k}">{words[k]}</a>'
            return f"<p>{' '.join(words)}</p>"
        if kind < 0.62:
            return f"<p><b>{said()}<br>"
        if kind < 0.7:
            return f"<{(tag := pick(('h2', 'h3', 'h4')))}>{said(1, 8)}</{tag}>"
        if kind < 0.82:
            tag, many, high = pick(("ul", "ol")), rng.integers(1, 9), pick((4, 15, 0))
            return f"<{tag}>{''.join(f'<li>{said(1 if high else 0, high)}</li>' for _ in range(many))}</{tag}>"
        if kind < 0.87:
            rows = "".join(f"<tr>{''.join(f'<td>{said(1, 4)}</td>' for _ in range(3))}</tr>" for _ in range(rng.integers(1, 5)))
            return f"<table>{rows}</table>"
        if kind < 0.9:
            return f"<dl><dt>{said(1, 4)}</dt><dd>{said()}</dd></dl>"
        if kind < 0.94:
            return f"<blockquote>{pick((said(), f'<p>{said()}</p>'))}</blockquote>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption>{said(2, 12)}</figcaption></figure>"
        return pick((f"<div>{said()}</div>", f"<pre>{said()}</pre>", f"<section><h2>{said(1, 6)}</h2><p>{said()}</p></section>", f"<div><div><p>{said()}</p></div></div>"))

    def main() -> str:
        out = [f"<h1>{said(1, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.integers(0 if out else 1, 12)):
            out.append(block())
            if rng.random() < 0.07:
                out.append(furniture())
            if rng.random() < 0.03:
                out.append(links())
        if rng.random() < 0.1:
            out.append(links())
        if rng.random() < 0.2:
            out.append(pick((comments, comments, remarks))())
        tag, tokens = pick(MAIN)
        return part(tag, tokens, "".join(out))

    before = [pick((menu, menu, furniture, furniture, links))() for _ in range(rng.integers(0, 4))]
    after = [pick((menu, furniture, furniture, furniture, links, remarks))() for _ in range(rng.integers(0, 5))]
    if rng.random() < 0.12:  # columns of a table
        cells = [f"<td>{x}</td>" for x in (*before[:1], main(), *after[:1])]
        body = f"<table><tr>{''.join(cells)}</tr></table>{''.join(after[1:])}"
    else:
        body = "".join((*before, main(), *after))
    for _ in range(rng.integers(0, 3)):
        body = part("div", str(pick(("wrapper", "page", "container", "layout", ""))), body)
    return f"<!DOCTYPE html><html><head><title>{pick(bad)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body>{body}</body></html>", kept


@dataclass
class Model:
    tags: dict[str, float]
    tokens: dict[str, float]
    trees: Trees

    def probability(self, pages: list[Page]) -> list[np.ndarray]:
        """Of each page's elements, how likely they hold main text."""
        odds = Odds(self.tokens)
        p = self.trees.probability(np.concatenate([features(x, self.tags, odds) for x in pages])) if pages else np.zeros(0)
        return np.split(p, np.cumsum([len(x.tags) for x in pages])[:-1]) if pages else []


def main_elements(page: Page, kept: set[str]) -> np.ndarray:
    """Which elements have one of the kept texts in them."""
    good = np.zeros(len(page.tags), bool)
    good[[e for e, t in page.texts if t in kept]] = True
    for i in range(len(good) - 1, 0, -1):
        if good[i]:
            good[page.parents[i]] = True
    return good


def fit(blocks: list[str], pages: int = COMPOSED, seed: int = 7) -> Model:
    """Trains tag and token odds and the trees on composed pages; without blocks, on plain words."""
    rng = np.random.default_rng(seed)
    blocks = sorted(set(blocks)) or [f"Word {i}, and more of it here." for i in range(40)]
    made = []
    for _ in range(pages):
        page, kept = compose([blocks[i] for i in rng.permutation(len(blocks))[:60]], rng)
        made.append((read_page(page), kept))
    made = [(page, main_elements(page, kept)) for page, kept in made]
    counts: dict[str, dict[str, list[int]]] = {"tag": {}, "token": {}}
    for page, good in made:
        for tag, tokens, y in zip(page.tags, page.tokens, good.tolist()):
            for kind, names in (("tag", (tag,)), ("token", tokens)):
                for name in names:
                    counts[kind].setdefault(name, [0, 0])[y] += 1
    odds = {kind: {name: float(np.log((c[1] + 1) / (c[0] + 1))) for name, c in own.items()} for kind, own in counts.items()}
    tokens = Odds(odds["token"])
    x = np.concatenate([features(page, odds["tag"], tokens) for page, _ in made])
    y = np.concatenate([good for _, good in made]).astype(float)
    return Model(odds["tag"], odds["token"], boost(x, y))


def decode(page: Page, p: np.ndarray) -> list[str]:
    """Texts of the kept blocks in page order, by the likeliest labelling that is consistent."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop, parents = np.log(p).tolist(), np.log(1 - p).tolist(), page.parents
    for i in range(len(keep) - 1, 0, -1):
        up = parents[i]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    kept = [True] * len(keep)
    for i in range(1, len(keep)):
        tag = page.tags[i]
        kept[i] = kept[parents[i]] and (tag == "body" or (tag not in RAW and tag != "head" and keep[i] > drop[i]))
    return [t for e, t in page.texts if kept[e]]


def drawn(texts: list[str]) -> list[str]:
    """SAMPLE_BLOCKS of a page's blocks, whole ones, from anywhere in it, by a hash of place and text."""
    order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(f"{i} {texts[i]}".encode("utf-8", "replace")), i))
    return [texts[i] for i in sorted(order[:SAMPLE_BLOCKS])]


def train(pages: DataFrame, html_col: str = "html") -> Model:
    """Trains on blocks of a bounded sample of distinct pages (see the bounds above)."""
    few = bounded_sample(pages.select(F.coalesce(F.col(html_col), F.lit("")).alias("_html")), SAMPLE_PAGES)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(0).to_pylist():
                out += drawn([t for _, t in read_page(page).texts if len(t) >= 3])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["block"])

    return fit([r.block for r in few.select("_html").mapInArrow(blocks, "block string").collect()])


def extracted(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text and n_chars (code points).

    Text of a null or empty page, and of one without main text, is empty. White space inside a
    block is one space, blocks are joined by a line feed, nothing is cut. Pages are read one by
    one: repeated rows, null ids and an empty table need no care; other columns aren't read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for start in range(0, len(whole), 200):
                batch = whole.slice(start, 200)
                made = [read_page(p) for p in strings(batch.column(2)).to_pylist()]
                out = ["\n".join(decode(page, p)) for page, p in zip(made, own.probability(made))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
