"""Main text of HTML pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of block elements whose leaves are runs of inline content.  Every node has features of its own
(tag, tokens of class and id, text length, link density, punctuation), of its subtree (share of the page's text, density
of text per node), of its ancestors (depth, semantic tags and tokens on the way up) and of its siblings.  Boosted trees
give the log odds that a node holds main text.  Decoding chooses the nodes with the largest sum of log odds among all
choices in which a chosen node's parent is chosen too, so no text is kept inside a dropped part, nor a part kept whose
text is all dropped for a gain.  The trees are trained on labelled pages that a generator lays out at random.

A null or empty page has an empty text.  Character references are decoded; white space in a block becomes one space;
blocks are joined in page order by one space.  Comments, scripts and tags that nothing ends go on to the end of the page,
in time linear in the page.  Drawings, templates, lists of choices and annotations of formulas are left out with their
content where they are closed inside the element that holds them; a tag that nothing closes there, or that closes itself,
hides nothing.  Text for readers without scripts or players (``noscript``, ``audio``, ``video``, ``canvas``, ``object``)
is text like that around it.  Repeated rows are treated alike and an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_trees import Boosted

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)(?:((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*))|([^>]*))>)")
#: The same without regard to quotes, for what follows a quote that nothing closes.
LOOSE_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)()([^>]*)>)")
#: What begins a tag, a comment or the like.
CUT_OFF = re.compile(r"<[!?/a-zA-Z]")
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
TOKEN = re.compile(r"[a-z]+")
MARK = "\ue000"  # a private-use character

#: Content of these is no markup and no text of the page; without a closing tag it goes on to the end of the page.
RAW = set("script style textarea title iframe head".split())
#: Elements whose content is no text of the page, if they are closed.
UNSEEN = set("template svg select annotation annotation-xml".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img picture source input ruby rb rt rp output meter progress map area nobr object noscript audio video canvas math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose merror msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the left kind ends where one of the right kinds begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
ENDED = {tag: [name for name, tags in ENDS.items() if tag in tags] for tag in set().union(*ENDS.values())}
HOLDERS = set("ul ol dl table div article section body main td".split())

GROUPS = {name: i for i, names in enumerate(["nav", "header", "footer", "aside", "article main", "section", "div", "p", "h1 h2", "h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tbody thead tfoot tr td th caption", "form fieldset button", "figure figcaption", "blockquote pre address", "body html", "dialog details summary"]) for name in names.split()}
AGAINST = set("ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottom copyright sidebar side aside rail widget widgets related recommended recommend more popular trending share sharing social follow subscribe newsletter signup login cookie cookies consent notice gdpr popup modal overlay alert skip search form toolbar tags tag pagination pager links outbrain taboola legal disclaimer print meta".split())
REMARKS = set("comment comments commentlist reply replies discussion disqus respond reader readers feedback thread reviews".split())
FAVOUR = set("article content contents post entry story main body text articlebody maincontent page hentry prose markdown read".split())


def _tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of each tag; comments and RAW elements are one nameless tag each.

    The time is linear in the page: no tag is looked for behind the last ``>``, and quotes count only until one is found
    that nothing closes, so no part of the page is gone through again and again.  What begins like a tag or a comment
    behind the last ``>`` is one to the end of the page.
    """
    pattern, at, last, size, no_end, drawn = TAG, 0, source.rfind(">") + 1, len(source), set(), 0
    while (found := pattern.search(source, at, last)) is not None:
        start, at, tag = found.start(), found.end(), (found[4] or "").lower()
        closing = bool(found[3])
        if not tag:
            end = source.find("-->", start + 2) if found[1] else source.find(">", at)
            at = size if end < 0 else end + (3 if found[1] else 1)
        elif found[5] is None:
            pattern = LOOSE_TAG
        if tag in ("svg", "math"):
            drawn = max(0, drawn - 1) if closing else drawn + (not source.endswith("/>", start, at))
        if tag in RAW and not (drawn and source.endswith("/>", start, at)):
            if not closing and tag not in no_end:
                ends = rf"</{tag}\b[^>]*>" if tag != "head" else r"</head\b[^>]*>|<body\b"
                if (end := re.compile(ends, re.I).search(source, at, last)) is not None:
                    at = end.start() if end[0].lower() == "<body" else end.end()
                elif tag == "head":
                    no_end.add(tag)
                else:
                    at = size
            tag = ""
        yield start, at, closing, tag, found[5] or found[6] or ""
    if (found := CUT_OFF.search(source, max(at, last))) is not None:
        yield found.start(), size, False, "", ""


def _unseen(tags: list[tuple[int, int, bool, str, str]]) -> dict[int, int]:
    """Where the UNSEEN elements that begin at these places end; those that something else ends are not among them."""
    out: dict[int, int] = {}
    if not any(t[3] in UNSEEN for t in tags):
        return out
    stack, held = [], Counter()
    for start, end, closing, tag, attributes in tags:
        if not tag or tag in VOID:
            continue
        drawn = held["svg"] + held["math"] > 0 or tag in ("svg", "math")
        if drawn and not closing and attributes.endswith("/"):
            out[start] = end
        elif not closing:
            stack.append((tag, start))
            held[tag] += 1
        elif held[tag]:
            while True:
                name, begun = stack.pop()
                held[name] -= 1
                if name == tag:
                    break
            if tag in UNSEEN:
                out[begun] = end
    return out


class Page:
    """Nodes in page order: parent, tag, attribute text; leaves also their text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attributes, self.text, self.linked = [-1], ["body"], [""], [None], [0]
        # Of each open element, the place in the stack of the nearest one, itself included, that ends for others or holds them.
        stack, near, held, buffer, links, linked, at = [0], [0], Counter(), [], 0, 0, 0
        tags = list(_tags(source))
        unseen = _unseen(tags)

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = "".join(buffer)
                buffer.clear()
                words = " ".join((html.unescape(text) if "&" in text else text).split())
                if words:
                    self._add(stack[-1], "#", "", words, linked)
            linked = 0

        def close(i: int) -> None:
            """Ends the open elements from the i-th."""
            for node in stack[i:]:
                held[self.tag[node]] -= 1
            del stack[i:], near[i:]

        for start, end, closing, tag, attributes in tags:
            if start < at:  # inside an element that isn't seen
                continue
            if start > at:
                buffer.append(source[at:start])
                if links:
                    linked += start - at
            at = end
            if not closing and start in unseen:
                at = unseen[start]
                continue
            if not tag or tag in UNSEEN:
                continue
            if tag in INLINE:
                if tag == "a":
                    links = max(0, links - 1) if closing else 1
                continue
            flush()
            links = 0
            if tag in VOID:
                continue
            if tag in ("html", "body"):
                if not closing:
                    self.attributes[0] += attributes
                continue
            if closing:
                if held[tag]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == tag))
                continue
            if self.tag[stack[-1]] == "p":
                close(len(stack) - 1)
            if any(held[name] for name in ENDED.get(tag, ())):
                i = near[-1]
                while i:
                    name = self.tag[stack[i]]
                    if tag in ENDS.get(name, ()):
                        close(i)
                        break
                    if name in HOLDERS and name not in ENDS:
                        break
                    i = near[i - 1]
            stack.append(self._add(stack[-1], tag, attributes, None, 0))
            near.append(len(stack) - 1 if tag in ENDS or tag in HOLDERS else near[-1])
            held[tag] += 1
        if at < len(source):
            buffer.append(source[at:])
        flush()

    def _add(self, parent: int, tag: str, attributes: str, text: str | None, linked: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def _tokens(attributes: str) -> tuple[int, int, int]:
    if "=" not in attributes:
        return 0, 0, 0
    words = set()
    for value in ATTRIBUTE.findall(attributes):
        words.update(TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    return len(words & AGAINST) + (HIDDEN.search(attributes) is not None), len(words & REMARKS), len(words & FAVOUR)


def features(page: Page) -> np.ndarray:
    """A row for each node."""
    n = len(page.parent)
    parent = page.parent
    chars, linked, leaves, nodes, children = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
    points, words = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if (t := page.text[i]) is not None:
            chars[i], linked[i], leaves[i] = len(t), min(len(t), page.linked[i]), 1
            points[i], words[i] = t.count(".") + t.count(",") + t.count("?") + t.count("!"), t.count(" ") + 1
        if i:
            p = parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            leaves[p] += leaves[i]
            nodes[p] += nodes[i]
            points[p] += points[i]
            words[p] += words[i]
            children[p] += 1
    total = max(1, chars[0])
    own = [_tokens(a) for a in page.attributes]
    groups = len(set(GROUPS.values())) + 1
    alike: dict[tuple[int, str], int] = {}
    place, nth = [0] * n, [0] * n
    for i in range(1, n):
        place[i] = nth[parent[i]]
        nth[parent[i]] += 1
        alike[parent[i], page.tag[i]] = alike.get((parent[i], page.tag[i]), 0) + 1
    depth, up, out, before = [0] * n, [(0,) * 9] * n, [], 0
    for i in range(n):
        p = parent[i]
        tag = page.tag[i] if page.text[i] is None else page.tag[p]
        group = GROUPS.get(tag, groups - 1)
        if i:
            depth[i] = depth[p] + 1
            u = up[p]
            up[i] = (u[0] + own[i][0], u[1] + own[i][1], u[2] + own[i][2], u[3] or group == 0, u[4] or group == 2, u[5] or group == 3, u[6] or group == 4, u[7] or group == 1, u[8] or group == 13)
        kind = [0.0] * groups
        kind[group] = 1.0
        c = max(1, chars[i])
        out.append([
            *kind, page.text[i] is not None, *own[i], *up[i], depth[i], math.log1p(chars[i]), linked[i] / c, chars[i] / total, math.log1p(chars[i] / nodes[i]),
            points[i] / max(1, words[i]), chars[i] / max(1, words[i]), math.log1p(children[i]), math.log1p(leaves[i]), place[i] / max(1, nth[p] if i else 1),
            math.log1p(nth[p] if i else 0), alike.get((p, page.tag[i]), 1) / max(1, nth[p] if i else 1), chars[p] / total if i else 1.0, linked[p] / max(1, chars[p]) if i else 0.0, before,
        ])
        if page.text[i] is not None:
            before = math.log1p(chars[i])
    return np.array(out, np.float32)


def decode(page: Page, odds: np.ndarray) -> str:
    """Text of the leaves in the best choice that is closed under parents."""
    n = len(page.parent)
    best = odds.astype(float).tolist()
    best[0] = max(best[0], 0.0)  # the page itself is never against
    for i in range(n - 1, 0, -1):
        if page.tag[i] != "#" and best[i] < 0 and page.text[i] is None and not any_child(page, i):
            best[i] = 0.0
        if best[i] > 0:
            best[page.parent[i]] += best[i]
    kept, parts = [True] * n, []
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best[i] > 0
        if kept[i] and page.text[i] is not None:
            parts.append(page.text[i])
    return " ".join(parts)


def any_child(page: Page, i: int) -> bool:
    return i + 1 < len(page.parent) and page.parent[i + 1] == i


def _generated(rng: random.Random) -> str:
    """A page whose main blocks begin with MARK."""
    letters = "abcdefghijklmnoprstuvwz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(120)]

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(a, b)))

    def prose(a: int = 6, b: int = 90) -> str:
        return ". ".join(words(3, 18).capitalize() for _ in range(rng.randint(max(1, a // 6), max(2, b // 10)))) + "."

    def named(tag: str, names: str, inner: str, always: bool = False) -> str:
        name = rng.choice(names.split())
        extra = rng.choice(["", f" {rng.choice(letters)}{rng.randint(1, 99)}", f" {rng.choice(vocabulary)}"])
        form = rng.choice(['class="{}"', 'id="{}"', 'class="{}"']).format(name + extra) if always or rng.random() < 0.75 else ""
        return f"<{tag} {form}>{inner}</{tag}>"

    def links(a: int, b: int) -> str:
        items = [f'<a href="/{w}">{w}</a>' for w in (words(1, 3) for _ in range(rng.randint(a, b)))]
        return rng.choice([" | ".join(items), "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items)])

    def block() -> str:
        k = rng.random()
        body = f"{MARK}{prose()}"
        if rng.random() < 0.2:
            body = f"<b>{body}"
        elif rng.random() < 0.3:
            body += f' <a href="#">{words(1, 3)}</a> <em>{words(1, 4)}</em>.'
        if k < 0.66:
            return f"<p>{body}" + rng.choice(["</p>", "</p>", ""])
        if k < 0.74:
            return f"<h{rng.randint(2, 4)}>{MARK}{words(2, 8)}</h{2}>" if rng.random() < 0.1 else f"<h2>{MARK}{words(2, 8)}</h2>"
        if k < 0.82:
            return "<ul>" + "".join(f"<li>{MARK}{words(3, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if k < 0.87:
            return f"<blockquote><p>{body}</p></blockquote>"
        if k < 0.9:
            return f"<pre>{MARK}{words(5, 30)}</pre>"
        if k < 0.94:
            return "<table>" + "".join(f"<tr><td>{MARK}{words(1, 4)}</td><td>{MARK}{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if k < 0.97:
            return f"{body}<br>{MARK}{prose()}<br>"
        return f"<div>{body}</div>"

    def advert() -> str:
        return named(rng.choice(["div", "div", "aside", "section"]), "ad ads advert banner sponsored promo ad-box", rng.choice([prose(3, 40), f"<p>{prose(3, 30)}</p>", links(1, 3)]), True)

    def remarks() -> str:
        tag = rng.choice(["div", "section", "ol"])
        each = [rng.choice(["<li>{}</li>", '<div class="comment">{}</div>', '<article class="comment"><p>{}</p></article>']).format(f"{words(1, 2)} {prose(3, 60)}") for _ in range(rng.randint(1, 8))]
        return named(tag, "comments comment-list commentlist replies discussion reader-comments", f"<h3>{words(1, 3)}</h3>" + "".join(each), True)

    def form() -> str:
        return rng.choice(["<form>{}<input><button>ok</button></form>", '<div class="newsletter"><form><label>{}</label><input></form></div>', '<form class="search">{}</form>']).format(words(2, 14))

    def notice() -> str:
        return named(rng.choice(["div", "section", "aside"]), "cookie-notice consent notice alert popup modal gdpr", f"<p>{prose(4, 40)}</p>" + form() * (rng.random() < 0.2), True)

    def side() -> str:
        return named(rng.choice(["aside", "div", "aside"]), "sidebar rail widget related popular side", f"<h3>{words(1, 3)}</h3>" + rng.choice([links(3, 9), f"<p>{prose(3, 50)}</p>", links(2, 5) + f"<p>{prose(3, 30)}</p>"]), True)

    inner = [block() for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20]))]
    for extra in (advert, side, form, lambda: named("div", "share social tags related", links(2, 5), True), remarks):
        if rng.random() < 0.18:
            inner.insert(rng.randint(0, len(inner)), extra())
    title = f"<h1>{MARK}{words(2, 12)}</h1>"
    if rng.random() < 0.15:
        title = f"<header>{title}</header>"
    main = title * (rng.random() < 0.85) + "".join(inner)
    if rng.random() < 0.3:
        main = named("div", "entry-content article-body post-text content body", main)
    kind = rng.random()
    main = f"<article>{main}</article>" if kind < 0.4 else f"<main>{main}</main>" if kind < 0.55 else f"<main><article>{main}</article></main>" if kind < 0.65 else named(rng.choice(["div", "section"]), "content main post article story entry page", main, kind < 0.92)
    top = [f"<nav>{links(3, 9)}</nav>" if rng.random() < 0.7 else named("div", "menu nav navbar topbar", links(3, 9), True)]
    if rng.random() < 0.4:
        top.insert(0, rng.choice(["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead"><p>{}</p></div>']).format(words(1, 9)))
    for part, chance in ((advert, 0.5), (notice, 0.3), (side, 0.25), (form, 0.2)):
        if rng.random() < chance:
            top.insert(rng.randint(0, len(top)), part())
    after = [part() for part, chance in ((side, 0.35), (remarks, 0.35), (advert, 0.3), (form, 0.2), (notice, 0.2)) if rng.random() < chance]
    foot = rng.choice(["<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>']).format(rng.choice([f"&copy; {words(2, 10)}.", links(3, 8), f"&copy; {words(1, 3)} &middot; {prose(3, 30)}"]))
    body = "".join(top) + main + "".join(after) + foot
    if rng.random() < 0.3:
        body = named("div", "wrapper page container site", body)
    return f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title></head><body>{body}</body></html>"


@cache
def trained(pages: int = 400, seed: int = 3) -> Boosted:
    """Trees trained on generated pages; the same on every run."""
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        page = Page(_generated(rng))
        mine = [t is not None and MARK in t for t in page.text]
        page.text = [t if t is None else t.replace(MARK, "").strip() for t in page.text]
        for i in range(len(mine) - 1, 0, -1):
            mine[page.parent[i]] |= mine[i]
        rows.append(features(page))
        labels += mine
    return Boosted().fit(np.concatenate(rows).astype(float), np.array(labels, float))


def texts(sources: list[str | None], model: Boosted) -> list[str]:
    """Main text of each page; the nodes of some pages are scored together."""
    out: list[str] = []
    for at in range(0, len(sources), 64):
        pages = [Page(s or "") for s in sources[at : at + 64]]
        rows = [features(p) for p in pages]
        p = np.clip(model.probability(np.concatenate(rows)), 1e-6, 1 - 1e-6)
        odds, start = np.log(p / (1 - p)), 0
        for page in pages:
            out.append(decode(page, odds[start : start + len(page.parent)]))
            start += len(page.parent)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    model = trained()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = texts(list(pdf["html"]), model)
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": found, "n_chars": [len(t) for t in found]})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
