"""Main text of HTML pages by tag-path ratios.

A page becomes blocks of text, each under a path of tags (with their first class) from the
root. For each path, text outside links and punctuation are aggregated over its blocks and
divided by their number. The ratios are smoothed down the tree: a path takes a quarter from
its own blocks and the rest from the path above it. An element that lays out the page (a
division, a section, an article) starts anew with the ratio of all that lies in it outside
other such elements; inside an article or main element nothing does, so that short
headings, items and cells lean on the paragraphs around them. Text and punctuation are
fused by the product of their logarithms, up to that of a full paragraph, times a prior: what an
element's tag, role and class say of it. A path is content from a quarter of the page's
level up, and every block whose path is content is kept, no other.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

_LAYOUT = frozenset("html body main article section div center nav header footer aside form".split())
_BLOCK = _LAYOUT | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hgroup fieldset dialog menu label noscript head title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg canvas object audio video select button math".split())
#: Tags that are never of the article, and tags that hardly are.
_NEVER, _HARDLY = frozenset("head nav footer aside dialog menu".split()), frozenset("header form fieldset label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form status".split())
#: Words of class and id that name what isn't the article.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored sponsors promo promos promotion banner sidebar sidebars sidenav rail nav navbar navigation topnav menu menus breadcrumb breadcrumbs crumbs "
    "header masthead topbar footer copyright cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations trending "
    "comment comments disqus discussion replies reply respond reactions widget widgets toolbar pagination pager skip hidden search form".split()
)
#: Priors of a named element and of an article or main element; the path's is the product.
NAMED, ARTICLE = 0.01, 3.0
#: A path's own part in its smoothed ratio; share of the page's level from which a path is content.
OWN, SHARE = 0.25, 0.25
#: Characters and marks of a full paragraph: beyond their score, more text says no more.
FULL = (200.0, 4.0)
#: Marks that any block counts as having, so that prose without marks still scores.
MARKS = 0.5

_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
_PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_HUGE = re.compile(r"&#(?:0*+\d{8,}+|[xX]0*+[\da-fA-F]{8,}+);?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw) if raw else ():
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ('"', "'") else value)
    return out


def _hidden(at: dict[str, str]) -> bool:
    return "hidden" in at or at.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(at.get("style", "")))


def _named(tag: str, at: dict[str, str]) -> bool:
    """Whether role, class or id say that an element isn't the article; of an article, only a word that says nothing else."""
    if at.get("role", "").lower() in _ROLES:
        return True
    for word in f"{at.get('class', '')} {at.get('id', '')}".split():
        parts = [p.lower() for p in _PART.findall(word)]
        if _NAMES & set(parts) and not {"has", "no", "with", "without"} & set(parts[:1]) and (tag not in ("article", "main") or len(parts) == 1):
            return True
    return False


class Page:
    """Paths of a page, each after the one above it, and its blocks in page order.

    above, prior: of each path the path above (-1 for the root, path 0) and the product of
    its priors; base: the path whose level it leans on first (itself if it starts anew);
    path, text, linked: of each block its path, its text and its characters in links, white
    space apart."""

    def __init__(self, html: str):
        self.above, self.prior, self.base, self.labels, self._ids = [-1], [1.0], [0], [""], {}
        self.path: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._read(html)

    def _enter(self, up: int, tag: str, raw: str, inside: bool) -> int:
        """The path of an element under path ``up``; ``inside`` an article or main element."""
        at = _attributes(raw)
        prior = 1.0
        if tag in _NEVER or _hidden(at):
            prior = 0.0
        elif tag in _HARDLY and not (tag == "header" and inside) or tag not in ("html", "body") and _named(tag, at):
            prior = NAMED
        if tag in ("article", "main") and not inside:
            prior *= ARTICLE
        cls = at.get("class", "").split()
        key = (up, f"{tag}.{cls[0]}" if cls else tag, prior)
        if key not in self._ids:
            n = self._ids[key] = len(self.above)
            self.above.append(up), self.prior.append(self.prior[up] * prior), self.labels.append(key[1])
            self.base.append(n if tag in _LAYOUT and not inside else self.base[up])
        return self._ids[key]

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, path, inside an article or main element
        opened: Counter[str] = Counter()
        closers: dict[str, int] = {}
        parts: list[str] = []
        hide: list = ["", 0]  # an inline tag that is hidden, and how often it is open
        link = linked = 0
        pattern = _TAG

        def flush():
            nonlocal link, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.path.append(stack[-1][1] if stack else 0), self.text.append(text), self.linked.append(linked)
                parts.clear()
            hide[1] = link = linked = 0

        def say(raw):
            nonlocal linked
            if hide[1]:
                return
            text = unescape(_HUGE.sub("�", raw)) if "&" in raw else raw
            parts.append(text)
            if link:
                linked += sum(map(len, text.split()))

        def pop():
            opened[stack.pop()[0]] -= 1

        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                say(html[at:])
                break
            if lt > at:
                say(html[at:lt])
            nxt = html[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                close, skip = ("-->", 3) if html.startswith("!--", lt + 1) else ("]]>", 3) if html.startswith("![CDATA[", lt + 1) else (">", 1)
                at = html.find(close, lt + (4 if close == "-->" else 2))
                at = end if at < 0 else at + skip
                if close == "-->" and html.startswith((">", "->"), lt + 4):  # an empty comment, abruptly closed
                    at = html.index(">", lt + 4) + 1
                continue
            if not (nxt == "/" or nxt.isascii() and nxt.isalpha()):
                say("<")
                at = lt + 1
                continue
            m = pattern.match(html, lt + 1)
            if m is None and nxt == "/" and not html[lt + 2 : lt + 3].isalpha():  # a comment, to a browser
                at = html.find(">", lt)
                at = end if at < 0 else at + 1
                continue
            if m is None and pattern is _TAG:
                pattern = _PLAIN_TAG  # quotes that don't close: from here on they count as any other sign
                m = pattern.match(html, lt + 1)
            if m is None:  # no tag ends any more
                break
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if tag == "a":
                    link = 0
                if tag == hide[0] and hide[1]:
                    hide[1] -= 1
                if tag in _BLOCK:
                    flush()
                    while opened[tag] and stack[-1][0] != tag:
                        pop()
                    if opened[tag]:
                        pop()
                continue
            if tag == "br":
                parts.append(" ")
            elif tag in _RAW:
                if not m[3].rstrip().endswith("/"):
                    if closers.get(tag, at - 1) < at and closers.get(tag) != -1:
                        found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                        closers[tag] = found.start() if found else -1
                    if closers[tag] >= 0:
                        at = html.find(">", closers[tag]) + 1 or end
                    elif tag in ("script", "style"):
                        at = end
                if tag in _BLOCK:
                    flush()
            elif tag in _VOID:
                if tag == "hr":
                    flush()
            elif tag in _BLOCK:
                flush()
                closes = _CLOSES.get(tag, ())
                while stack and (stack[-1][0] == "p" or stack[-1][0] in closes):  # a block ends an open paragraph; rows and items end each other
                    pop()
                while opened["head"] and tag != "head":
                    pop()
                up, inside = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                stack.append((tag, self._enter(up, tag, m[3], inside), inside or tag in ("article", "main")))
                opened[tag] += 1
            else:
                if tag == "a":
                    link = int("href" in m[3].lower())
                if hide[1]:
                    hide[1] += tag == hide[0]
                elif m[3] and ("hidden" in m[3].lower() or "none" in m[3].lower()) and not m[3].rstrip().endswith("/") and _hidden(_attributes(m[3])):
                    hide[:] = [tag, 1]
        flush()


def path_scores(page: Page) -> tuple[np.ndarray, float]:
    """The score of each path, and the least of a path that is content."""
    n = len(page.above)
    path = np.array(page.path, dtype=np.int64)
    size = np.array([len(t) - t.count(" ") for t in page.text], dtype=np.float64)
    plain = np.maximum(size - np.array(page.linked), 0)
    marks = np.array([len(_PUNCT.findall(t)) for t in page.text]) * plain / size
    base = np.array(page.base)
    sums = [np.bincount(path, w, minlength=n) for w in (plain, marks, np.ones(len(path)))]
    level = [np.bincount(base, s, minlength=n) for s in sums]  # of what leans on each path that starts anew
    below = [s.tolist() for s in sums]
    for k in range(n - 1, 0, -1):
        if page.base[k] != k:
            for s in below:
                s[page.above[k]] += s[k]
    smooth = [[0.0] * n, [0.0] * n]
    for k in range(n):
        for out, total, whole in zip(smooth, (below[0], below[1]), level):
            if page.base[k] == k:
                out[k] = whole[k] / level[2][k] if level[2][k] else 0.0
            else:
                own = total[k] / below[2][k] if below[2][k] else 0.0
                out[k] = OWN * own + (1 - OWN) * out[page.above[k]]
    text, punct = map(np.array, smooth)
    full = np.log1p(FULL[0]) * np.log1p(FULL[1])
    score = np.minimum(np.log1p(text) * np.log1p(punct + MARKS) / full, 1.0) * np.array(page.prior)
    of = score[path]
    weight = (plain * of).sum()
    return score, SHARE * float((plain * of * of).sum() / weight) if weight else 0.0


def main_text(html: str | None) -> str:
    """The article of a page: its content blocks in page order, joined by a space; empty without one."""
    page = Page(html or "")
    if not page.path:
        return ""
    score, least = path_scores(page)
    return " ".join(t for k, t in zip(page.path, page.text) if score[k] > 0 and score[k] >= least)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    Null and empty html, and pages without an article, have an empty text. Repeated rows
    come out as often; nulls in other columns pass through; further columns are ignored;
    pages of any length and depth are read in time proportional to their length; an empty
    table gives no rows."""

    def extracted(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(extracted, "page_id long, url string, text string, n_chars long")


def op10_tag_path_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_tag_path_text": op10_tag_path_text}
