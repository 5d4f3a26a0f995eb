"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser streams start, end and text events. Block-level
tags cut the page into lines; each line has a text-to-tag ratio (text outside links
over tags met). Tags and class words only weigh it: nothing inside menus, headers, adverts
and the like, more inside an article. The logarithms of the weighed ratios are smoothed by a
Gaussian kernel, and a threshold splits the lines into content and the rest. The content region
is the container that holds the content clusters, or the article around it; its clusters and
the lines between them are the text.

A class or id word and a form only suggest boilerplate: they may as well stand on a wrapper
round the article. What they suggest is weighed once the page is read (``_Lines.dropped``).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from speclab.llm.common import map_texts, type_of

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre
section summary table tbody tfoot thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""aside button datalist dialog footer form head iframe menu nav noscript object script select
style svg template textarea title canvas map""".split())
CONTAINERS = frozenset("article main section div td body center table tbody tr blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                  "toolbar".split())
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner banners billboard breadcrumb
breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus feedback footer gdpr
header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup
promo promos promotion promotions recommended related replies reply respond search share sharing sidebar sidebars signup social
sponsor sponsored sponsors subscribe subscription toolbar toc topbar widget widgets""".split())
TOKENS = re.compile(r"[a-z]+|[A-Z][a-z]*").findall
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden").search
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
HEADED = frozenset("article content entry post story".split())     # "entry-header" is the article's own
SIGMA = 1.0
NAMED_WEIGHT = 16.0      # of a line inside an article or main; 1 elsewhere, 0 for boilerplate
THRESHOLD = 0.15         # share of the highest smoothed score above which a line is content
CENTRE_SHARE = 0.7       # share of the content mass the region's container must hold


class _Lines(HTMLParser):
    """Lines of a page: ``(text, outside links, tags, boilerplate, node, owner)``; an owner is the page, a
    suggested drop or an article or main."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, node, boilerplate, owner, place of the innermost block (the page itself if there is none)
        self.stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, 0)]
        self.open: dict[str, list[int]] = {}                         # places of each tag's open elements
        self.owners: list[tuple[int, str | None]] = [(-1, None)]     # of each: parent, what suggested the drop
        self.parents: list[tuple[int, str]] = [(-1, "")]             # of each node: parent, tag
        self.lines: list[tuple[str, int, int, bool, int, int]] = []
        self.text: list[str] = []
        self.in_link = self.tags = 0

    def updatepos(self, i, j):
        return j                                     # line numbers are not used

    def _flush(self):
        words = " ".join("".join(self.text).split())
        if words:                                    # tags without text count for the next line
            _, _, drop, owner, _ = self._block()
            self.lines.append((words, max(0, len(words) - self.in_link), self.tags, drop, self.stack[-1][1], owner))
            self.tags = 0
        self.text, self.in_link = [], 0

    def _last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags (0: none)."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _pop(self, at: int):
        for tag, *_ in self.stack[at:]:
            self.open[tag].pop()
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append("\n")
            return
        if tag in BLOCKS and tag not in ("html", "body", "head"):
            if self._block()[0] == "p":                      # an open paragraph ends here
                self._pop(self.stack[-1][4])
        if tag in CLOSES:
            at = self._last(*CLOSES[tag].split())
            if at > self._last("ul", "ol", "dl", "table", "select", "menu"):
                self._pop(at)
        if tag in ("td", "th"):
            self.text.append(" ")
        if tag in ("article", "main", "body"):       # never inside these: they were left open
            at = min((self.open[t][0] for t in ("nav", "header", "head", "footer") if self.open.get(t)), default=0)
            if at:
                self._pop(at)
        own = dict(attrs)
        _, _, inside, owner, block = self.stack[-1]
        named = self._last("article", "main") > 0
        role = (own.get("role") or "").lower()
        drop = inside or tag in DROPPED and tag != "form" or tag == "header" and not named
        was = owner
        if tag in ("article", "main"):
            self.owners.append((owner, None))
            owner = len(self.owners) - 1
        elif not drop and tag not in ("html", "body"):
            drop = (role in ROLES and role != "form" or "hidden" in own or own.get("aria-hidden") == "true"
                    or bool(HIDDEN((own.get("style") or "").lower())))
            marks = f"{own.get('class') or ''} {own.get('id') or ''}"
            words = {t.lower() for t in TOKENS(marks)} if marks != " " else set()
            hints = words & HINTS
            if hints == {"header"} and (named or words & HEADED):
                hints = None
            if not drop and (tag == "form" or role == "form" or hints):
                self.owners.append((owner, f"{tag} {marks}"))
                owner = len(self.owners) - 1
        node = self.stack[-1][1]
        if tag in CONTAINERS:
            self.parents.append((node, tag))
            node = len(self.parents) - 1
        if (drop and not inside or owner != was) and tag not in BLOCKS:
            self.text.append(" ")                    # dropped inline element: its neighbours stay apart
        at = len(self.stack)
        self.stack.append((tag, node, drop, owner, at if tag in BLOCKS else block))
        self.open.setdefault(tag, []).append(at)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        if tag == "br":
            self.text.append("\n")
        self.tags += 1
        at = self._last(tag)
        if at and (tag in ("article", "main", "body", "html") or at > self._last("article", "main", "body")):
            self._pop(at)

    def handle_data(self, data):
        if self.stack[-1][2:4] != self._block()[2:4]:
            return                                   # a dropped inline element in a kept block
        self.text.append(data)
        if self.open.get("a"):
            self.in_link += len(data.strip())

    def _block(self) -> tuple[str, int, bool, int, int]:
        return self.stack[self.stack[-1][4]]

    def dropped(self) -> list[bool]:
        """Of each line whether it is boilerplate.

        Suggested drops of one tag, class and id that hold most of the page's text outside links are lifted, with
        the drops around them, unless an article or main stands under fewer drops; the ratios decide there. Where an
        article or main has text outside of drops, this goes for drops inside one only, and not while a fourth of the
        text lies outside of all. Failing that, where no article or main is left, the least deeply dropped ones end
        the drops around them; failing that, where no text is left, the heaviest suggested drops are lifted.
        """
        over, named = [0], [False]                   # of each owner: suggested drops from the page down, inside an article or main
        for parent, mark in self.owners[1:]:
            over.append(over[parent] + (mark is not None))
            named.append(named[parent] or mark is None)
        mass = [0] * len(self.owners)
        for x in self.lines:
            if not x[3]:
                mass[x[5]] += x[1]
        total = sum(mass)
        lifted = set()
        by_mark: dict[str, int] = {}
        inside: dict[int, int] = {}                  # suggested drop -> its text, without what further drops hold
        nearest = [0]                                # of each owner: the innermost suggested drop around it, itself included
        for i, (parent, mark) in enumerate(self.owners[1:], 1):
            nearest.append(nearest[parent] if mark is None else i)
        for i, m in enumerate(mass):
            if nearest[i] and m:
                inside[nearest[i]] = inside.get(nearest[i], 0) + m
        kept = sum(m for m, n, d in zip(mass, named, over) if n and not d)
        plain = sum(m for m, d in zip(mass, over) if not d)
        if kept:
            inside = {i: m for i, m in inside.items() if named[i]}
        for i, m in inside.items():
            by_mark[self.owners[i][1]] = by_mark.get(self.owners[i][1], 0) + m
        best = max(by_mark, key=by_mark.get, default=None)
        articles = [i for i, (_, mark) in enumerate(self.owners) if i and mark is None and mass[i] and over[i]]
        least = min((over[i] for i in articles), default=len(over))
        lift = (best is not None and (not kept or 4 * plain < total) and 2 * by_mark[best] > total
                and (kept or min(over[i] for i in inside if self.owners[i][1] == best) <= least))
        if not lift and not kept and articles:
            lifted |= {i for i in articles if over[i] == least}
        elif lift or best is not None and not plain:
            for i in inside:
                if self.owners[i][1] == best:
                    while i > 0 and i not in lifted:
                        lifted.add(i)
                        i = nearest[self.owners[i][0]]
        gone = [False]
        for i, (parent, mark) in enumerate(self.owners[1:], 1):
            gone.append(False if mark is None and i in lifted else gone[parent] or mark is not None and i not in lifted)
        return [x[3] or gone[x[5]] for x in self.lines]

    def close(self):
        super().close()
        self._flush()


def _smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article's blocks joined by an empty line (empty if the page has none)."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    lines, dropped = page.lines, page.dropped()
    live = np.array([not d for d in dropped], bool)
    if not live.any():
        return ""
    named = [False]                                  # of each node: inside an article or main
    for parent, tag in page.parents[1:]:
        named.append(named[parent] or tag in ("article", "main"))
    node = [x[4] for x in lines]
    weight = live * np.where([named[n] for n in node], NAMED_WEIGHT, 1.0)
    score = _smooth(np.log1p(weight * [x[1] / max(1, x[2]) for x in lines]), sigma)
    content = live & (score > THRESHOLD * score.max())
    # content mass of every container, its descendants' included (a node's number is above its parent's)
    mass = [0] * len(page.parents)
    for i in np.flatnonzero(content):
        mass[node[i]] += len(lines[i][0])
    for n in range(len(mass) - 1, 0, -1):
        mass[page.parents[n][0]] += mass[n]
    region = max(n for n, m in enumerate(mass) if m >= CENTRE_SHARE * mass[0])
    at = region
    while at > 0:                                    # an article or main around it is the region
        if page.parents[at][1] in ("article", "main"):
            region = at
        at = page.parents[at][0]
    within = [region == 0]
    for n, (parent, _) in enumerate(page.parents[1:], 1):
        within.append(n == region or within[parent])
    inside = live & [within[n] for n in node]
    chosen = np.flatnonzero(inside & content)
    if not len(chosen):
        return ""
    # clusters of one region are one text: what stands between them joins them
    joined = inside.copy()
    joined[:chosen[0]] = joined[chosen[-1] + 1:] = False
    return "\n\n".join(lines[i][0] for i in np.flatnonzero(joined))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",),
                 sigma: float = SIGMA) -> DataFrame:
    """``(id_col, *keep, text, n_chars)`` for every page.

    Null or empty html, and pages without text, give an empty text and 0. Broken
    markup (open tags, cut pages) is read as far as it goes; very long pages are parsed whole.
    Repeated rows stay; columns other than those named are not read; an empty table gives no rows.
    """
    def make(texts):
        out = [main_text(t, sigma) for t in texts]
        return {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}

    schema = ", ".join(f"`{c}` {type_of(pages, c)}" for c in (id_col, *keep)) + ", text string, n_chars long"
    return map_texts(pages, id_col, html_col, list(keep), schema, make)
