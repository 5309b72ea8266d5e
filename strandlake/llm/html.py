"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, a container's points are discounted by its link density, and
the best container is kept with those siblings that score like it. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts and reader comments are told by element, role, class and id, and are left out first. Nothing is recursive, so that
deeply nested pages are no trouble.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import common

#: Elements without content, with content that is no markup, that end a line of text, and that are never main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = set("script style noscript template iframe svg canvas object embed applet audio video head title nav menu aside footer form button select textarea input fieldset label dialog noembed noframes map".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of a class or id that mark what is no main text, and those that mark main text.
BAD = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbox adslot adunit sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead topbar footer foot sidebar sidebars sidenav aside rail widget widgets toolbar "
    "notice notices cookie cookies cookiebar consent gdpr alert alerts disclaimer paywall popup popover modal overlay toast newsletter subscribe subscription signup signin login "
    "share sharing social related recommended recommendations outbrain taboola comment comments commentlist disqus respond reply replies discussion "
    "form search searchbox skip hidden".split()
)
BAD_PARTS = re.compile("sidebar|navbar|advert|cookie|newsletter|breadcrumb|sponsor|footer|comment(?!ar)|disqus|masthead")
GOOD = set("article articlebody body content contents entry main maincontent hentry post story text blog".split())
#: What an opened block closes: an open element of one of these, up to the nearest of the scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
LEVELS = 4
#: Tags by the states of the HTML standard: a quote means something only right behind an equals sign; > ends a tag anywhere else.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"'][^\s>]*+))?+)?+""")
#: Words before and behind a name of boilerplate that say how a page is laid out, not what an element holds.
LAYOUT_BEFORE, LAYOUT_BEHIND = set("has no not with without hide show is".split()), set("open closed free enabled disabled on off".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@dataclass
class Tree:
    """Elements in page order, and pieces of text with their element and line of text."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)  # the first element that is not inside
    weight: list[int] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    link: list[bool] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    named: list[int] = field(default_factory=list)  # 1: a boilerplate name, 2: that of comments
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def judged(tag: str, attributes: str) -> tuple[int, bool, int]:
    """Points of an element's own marks, whether they leave it out, and whether its name is one of boilerplate (1) or comments (2)."""
    if not attributes.strip():
        return 0, False, 0
    got: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of several counts
    names = [[w.lower() for w in _PARTS.findall(x)] for x in unescape(f"{got.get('class', '')} {got.get('id', '')}").split()]
    words = {w for ws in names for w in ws if not (len(ws) > 1 and (ws[0] in LAYOUT_BEFORE or ws[-1] in LAYOUT_BEHIND))}
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I)
    bad = (bool(words & BAD) or any(BAD_PARTS.search(w) for w in words)) and tag not in ("html", "body", "article", "main") and not (words & {"article", "articlebody", "maincontent", "hentry"} and not words & {"comment", "comments", "ad", "ads", "sidebar", "nav", "footer", "related"})
    if hidden or got.get("role", "").lower() in DROPPED_ROLES:
        return -25, True, 0
    main = got.get("role", "").lower() in ("main", "article") or "articlebody" in got.get("itemprop", "").lower()
    return (25 if words & GOOD else 0) + (25 if main else 0), False, 0 if not (bad or tag == "article") else 2 if any(w.startswith("comment") and w != "commentary" for w in words) else int(bad)


def parse(page: str) -> Tree:
    t, stack, line, at, n = Tree(), [], 0, 0, len(page)
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag

    def push(tag: str, attributes: str) -> None:
        nonlocal line
        up = stack[-1] if stack else -1
        points, out, named = judged(tag, attributes)
        t.tag.append(tag), t.parent.append(up), t.end.append(-1), t.weight.append(points), t.attributes.append(attributes)
        t.dropped.append(tag in DROPPED or out)
        t.named.append(named)
        t.link.append(tag == "a" or (up >= 0 and t.link[up]))
        opened.setdefault(tag, []).append(len(stack))
        stack.append(len(t.tag) - 1)
        line += tag in BLOCKS

    def pop() -> None:
        nonlocal line
        i = stack.pop()
        opened[t.tag[i]].pop()
        t.end[i] = len(t.tag)
        line += t.tag[i] in BLOCKS

    def nearest(tags: set[str]) -> int:
        return max((opened[x][-1] for x in tags if opened.get(x)), default=-1)

    def close(tags: set[str], scope: set[str]) -> None:
        k = nearest(tags)
        if k > 0 and k >= nearest(scope):
            while len(stack) > k:
                pop()

    push("html", "")
    while at < n:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            t.pieces.append((stack[-1], line, page[at:begin]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "html":
                continue
            if tag == "br" or tag == "p" and not opened.get("p"):
                t.pieces.append((stack[-1], line, " "))
                line += tag == "p"
                continue
            limit = {"td", "th", "table"} if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "article", "main", "section", "div") else set()
            close({tag}, limit)
        elif tag in VOID:
            if tag == "hr":
                line += 1
            t.pieces.append((stack[-1], line, " ")) if tag in ("br", "hr") else None
        elif tag in RAW:
            push(tag, m[3])
            pop()
            done = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = done.end() if done else n
        elif tag != "html":
            if tag in BLOCKS:
                close({"p"}, {"td", "th", "table", "button", "object", "caption", "div", "section", "article", "main", "body", "li", "blockquote", "form"})
            if tag in CLOSES:
                close(CLOSES[tag], SCOPE[tag])
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and t.tag[stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                pop()
            if tag == "body":
                close({"head"}, set())
            push(tag, m[3])
            if m[3].rstrip().endswith("/") and tag in ("svg", "path", "rect", "circle", "use"):
                pop()
    while stack:
        pop()
    return t


def extract(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; null, empty and textless pages give the empty string."""
    if not page:
        return ""
    t = parse(page)
    marked = t.dropped
    names = by_name(t)
    settle(t, marked, names)
    text = main_text(t)
    found = text and any(tag in ("article", "main") and not x for tag, x in zip(t.tag, t.dropped))
    if any(names) and not found and len(text) < max(1, prose(t, marked) / 10):  # little is left: only names of comments count
        settle(t, marked, [x and k == 2 for x, k in zip(names, t.named)])
        text = max(text, main_text(t), key=len)
        if not text:
            settle(t, marked, [False] * len(names))
            text = main_text(t)
    return text


def prose(t: Tree, marked: list[bool]) -> int:
    """Characters of text outside links, headers and what is left out by tag, mark or as comments."""
    settle(t, marked, [k == 2 and tag != "article" for k, tag in zip(t.named, t.tag)])
    return sum(len(text.strip()) for i, _, text in t.pieces if not t.dropped[i] and not t.link[i])


def by_name(t: Tree) -> list[bool]:
    """Which elements their names leave out: not one that holds the main element, the largest article (the first h1, if there is
    neither) or most of the points of paragraphs."""
    n = len(t.tag)
    out = [k > 0 and tag != "article" for k, tag in zip(t.named, t.tag)]
    if not any(out):
        return out
    gone, comments, size, linked, said, commas = [False] * n, [False] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i, up in enumerate(t.parent):
        gone[i] = t.dropped[i] and t.tag[i] not in ("form", "header") or (up >= 0 and gone[up])
        comments[i] = t.named[i] == 2 or (up >= 0 and comments[up])
    for i, _, text in t.pieces:
        if not gone[i] and not comments[i]:
            size[i] += (k := len(text.strip()))
            linked[i] += k if t.link[i] else 0
            commas[i] += sum(map(text.count, ",،、，"))
    said, held, points = list(size), list(size), [0.0] * n
    for i in range(n - 1, -1, -1):
        p = t.parent[i]
        if t.tag[i] in BLOCKS and said[i] and t.tag[i] not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            points[i] += (1 + commas[i] + min(said[i] / 100, 3)) * (1 - min(1, linked[i] / said[i]))
        if p >= 0:
            held[p] += held[i]
            points[p] += points[i]
            if t.tag[i] not in BLOCKS:
                said[p], linked[p], commas[p] = said[p] + said[i], linked[p] + linked[i], commas[p] + commas[i]
    kept = [i for i in range(n) if t.tag[i] == "main" and not gone[i]]
    articles = [i for i in range(n) if t.tag[i] == "article" and held[i] and not gone[i]]
    kept += [max(articles, key=lambda i: held[i])] if articles else []
    at = kept or [i for i in range(n) if t.tag[i] == "h1" and not gone[i]][:1]
    for i in at:
        while i >= 0:
            out[i], i = False, t.parent[i]
    most = max((points[i] for i in kept), default=points[0]) / 2
    within = covered(n, [(a, t.end[a]) for a in kept])
    for i in range(n):
        if out[i] and t.named[i] == 1 and points[i] > most and (not kept or within[i]):
            out[i] = False
    return out


def covered(n: int, ranges: list[tuple[int, int]]) -> list[bool]:
    """Which of n elements lie in some of the ranges."""
    change = [0] * (n + 1)
    for a, b in ranges:
        change[a] += 1
        change[b] -= 1
    return [x > 0 for x in accumulate(change[:n])]


def main_text(t: Tree) -> str:
    n = len(t.tag)
    size, linked, commas, links = [0] * n, [0] * n, [0] * n, [0] * n
    for i, _, text in t.pieces:
        if not t.dropped[i]:
            k = len(text.strip())
            size[i] += k
            linked[i] += k if t.link[i] else 0
            commas[i] += sum(map(text.count, ",،、，"))
    own = list(size)
    # what a paragraph says: its own text and that of the inline elements in it
    said, said_commas = list(size), list(commas)
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        links[p] += links[i] + (t.tag[i] == "a" and not t.dropped[i])
        size[p] += size[i]
        linked[p] += linked[i]
        if t.tag[i] not in BLOCKS:
            said[p] += said[i]
            said_commas[p] += said_commas[i]
    points = [0.0] * n
    scored = [False] * n
    for i in range(n):
        if t.tag[i] not in BLOCKS or not said[i] or t.dropped[i] or t.tag[i] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        gain = 1 + said_commas[i] + min(said[i] / 100, 3)
        up = i if t.tag[i] in ("div", "section", "article", "main", "td", "body") else t.parent[i]
        for level in range(LEVELS):
            if up < 0:
                break
            points[up] += gain / (1, 2, 6, 9)[level]
            scored[up], up = True, t.parent[up]
    best, most = 0, float("-inf")
    total = [float("-inf")] * n
    for i in range(n):
        if scored[i] and not t.dropped[i]:
            extra = {"article": 25, "main": 20, "div": 5, "section": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3, "html": -50, "body": -5}.get(t.tag[i], 0)
            total[i] = (points[i] + extra + t.weight[i]) * (1 - linked[i] / max(1, size[i]))
            if total[i] > most:
                best, most = i, total[i]
    up = best  # the whole article, if the best container is a part of one
    while up >= 0:
        if t.tag[up] in ("article", "main"):
            best = up
            if t.tag[up] == "article":
                break
        up = t.parent[up]
    ranges = [(best, t.end[best])]
    if t.tag[best] not in ("article", "main", "body", "html"):
        ranges = siblings(t, best, total, said, size, linked, links)
    out: list[str] = []
    last, parts = -1, []
    skip, inside = menus(t, size, linked, links, own), covered(n, ranges)
    for i, line, text in t.pieces:
        if t.dropped[i] or skip[i] or not inside[i]:
            continue
        if line != last:
            out.append("".join(parts))
            last, parts = line, []
        parts.append(text)
    out.append("".join(parts))
    return "\n".join(x for x in (" ".join(unescape(b).split()) for b in out) if x)


def settle(t: Tree, marked: list[bool], names: list[bool]) -> None:
    """Leaves out what is marked or named so. Keeps a header of an article that holds its first-level title, and a form that wraps an article or a page's title; leaves
    out what is inside left-out elements."""
    t.dropped = [a or b for a, b in zip(marked, names)]
    holds: set[int] = set()  # elements with a title or an article inside
    for i, tag in enumerate(t.tag):
        up = t.parent[i] if tag in ("h1", "article", "main") else -1
        while up >= 0 and up not in holds:
            holds.add(up)
            up = t.parent[up]
    inside = [False] * len(t.tag)
    for i, tag in enumerate(t.tag):
        p = t.parent[i]
        inside[i] = tag in ("article", "main") or (p >= 0 and inside[p])
        if tag == "header":
            t.dropped[i] |= not (i in holds and p >= 0 and inside[p])
        elif tag == "form" and i in holds:
            t.dropped[i] = False
        t.dropped[i] |= p >= 0 and t.dropped[p]


def siblings(t: Tree, best: int, total: list[float], said: list[int], size: list[int], linked: list[int], links: list[int]) -> list[tuple[int, int]]:
    """The best container, and those children of its parent that are like it (a fifth of its points, and marked like it or
    without links), are paragraphs, or are titles."""
    out, up = [], t.parent[best]
    i = up + 1 if up >= 0 else best
    end = t.end[up] if up >= 0 else t.end[best]
    while i < end:
        density = linked[i] / max(1, size[i])
        like = total[i] >= max(10.0, total[best] / 5) and density < 0.5 and (not links[i] or t.attributes[i] == t.attributes[best] != "")
        leaf = said[i] == size[i] > 0 and t.tag[i] in BLOCKS
        prose = leaf and (size[i] > 80 and density < 0.25 or not linked[i] and (t.tag[i] in ("p", "blockquote", "pre") or said[i] > 15 and t.tag[best] == t.tag[i] and t.attributes[i] == t.attributes[best]))
        title = t.tag[i] in ("h1", "h2", "h3") and not linked[i]
        if i == best or not t.dropped[i] and (like or prose or title):
            out.append((i, t.end[i]))
        i = t.end[i]
    return out


def menus(t: Tree, size: list[int], linked: list[int], links: list[int], own: list[int]) -> list[bool]:
    """Marks what is inside lists or boxes of three or more links and nothing else."""
    out = [False] * len(t.tag)
    for i, tag in enumerate(t.tag):
        p = t.parent[i]
        out[i] = (p >= 0 and out[p]) or (tag in ("ul", "ol", "div", "section", "table", "p") and links[i] >= 3 and linked[i] == size[i] > 0)
    return out


def extracted(df: DataFrame, html: str = "html", keep: list[str] | None = None, into: str = "text") -> DataFrame:
    """Adds the main text of a column of pages to every row; a column of df named like the new one is replaced."""
    return common.map_text(df, lambda: lambda pages: [[extract(p) for p in pages.to_pylist()]], [T.StructField(into, T.StringType())], html, keep)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, keep=["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))
