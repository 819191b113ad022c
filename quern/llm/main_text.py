"""Main text of web pages by composite text density.

A tolerant tag scan builds the element tree of a page. Subtrees whose element or whole class says that they
are not the article (menus, forms, adverts, comments and the like) are taken out; a class that only has such
a word in it takes out what is mostly links. Every other node
gets characters per tag, adjusted for links (composite text density); the sum of its children's
densities decides: the node of the largest sum sets a threshold, the least density on its path from
body, and below body every node that reaches the threshold gives the largest-sum node of its
subtree. The text is that of the smallest subtree that holds all nodes so found, widened to the
enclosing article or main element, so that short paragraphs between dense ones stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, slices, table

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body br html caption dd dt legend li option select tbody td tfoot th thead tr".split()) | {"hr", "li", "dd", "dt"}
SCOPE = frozenset("table td th caption html body button object template".split())
ENDS_OWN = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
# Fixed values of this operator: elements and class words that are not the article's text.
NEVER = frozenset("head script style noscript template textarea title iframe object svg math canvas audio video nav aside footer form button select input dialog menu".split())
REMARKS = frozenset("comment comments reply replies disqus respond responses".split())
APART = REMARKS | frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail menu nav navbar navigation"
    " breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup"
    " login share sharing social related recommended recommendations pagination pager toolbar widget widgets skip hidden".split()
)
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())

TAG = re.compile(r"<!--(?:.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/][^>]*>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _apart(attributes: str, tag: str = "") -> str:
    """What class, id, role and style say of an element.

    'sure': never shown; 'remarks' and 'set': every word of a class or of the id, or the role, says so;
    'doubt': some word of one does, as in has-sidebar or site-footer; '': nothing, as for all headings and paragraphs.
    """
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return "sure"
        if name == "role":
            if value.strip() in ROLES and found != "remarks":
                found = "set"
        elif name in ("class", "id") and tag not in PROSE:
            for token in value.split():
                words = {w for w in WORDS.split(token) if w}
                if words and words <= APART:
                    found = "remarks" if words & REMARKS or found == "remarks" else "set"
                elif words & APART:
                    found = found or "doubt"
    return found


class Page:
    """Element tree of a page: parallel lists by node, parents before children."""

    def __init__(self, html: str):
        self.tag, self.parent, self.apart = ["#root"], [-1], [""]
        self.texts: list[tuple[int, str]] = []  # (node, text); a block's edge is a space
        self._build(html)

    def _build(self, html: str) -> None:
        stack, at, texts = [0], 0, self.texts
        self.open: dict[str, int] = {}  # open elements by name, so that a search starts only if it can succeed
        tags, find, last = self.tag, TAG.search, html.rfind(">") + 1  # no tag ends after the last >
        while True:
            m = find(html, at, last)
            if m is None:
                texts.append((stack[-1], unescape(html[at:].partition("<!--")[0])))
                return
            if m.start() > at:
                piece = html[at : m.start()]
                texts.append((stack[-1], unescape(piece) if "&" in piece else piece))
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                    return  # a comment never closed holds the rest
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCK:
                    texts.append((stack[-1], " "))
                self._close(stack, name)
                continue
            self._imply(stack, name)
            node = len(tags)
            tags.append(name)
            self.parent.append(stack[-1])
            self.apart.append("sure" if name in NEVER else _apart(m[3], name) if m[3] else "")
            if name in BLOCK:
                texts.append((stack[-1], " "))
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
                if end is None:
                    return  # never closed: it holds the rest
                at = end.start()
                self._push(stack, node, name)
            elif name not in VOID and not m[3].endswith("/") or name in ("p", "div"):
                self._push(stack, node, name)

    def _push(self, stack: list[int], node: int, name: str) -> None:
        stack.append(node)
        self.open[name] = self.open.get(name, 0) + 1

    def _cut(self, stack: list[int], at: int) -> None:
        for node in stack[at:]:
            self.open[self.tag[node]] -= 1
        del stack[at:]

    def _close(self, stack: list[int], name: str) -> None:
        tags = self.tag
        if not self.open.get(name):
            return
        for i in range(len(stack) - 1, 0, -1):
            here = tags[stack[i]]
            if here == name:
                self._cut(stack, i)
                return
            if here in BLOCK and name not in BLOCK:
                return  # an inline end doesn't reach out of its block

    def _imply(self, stack: list[int], name: str) -> None:
        """Ends that a start implies: of a paragraph, of a list item, of a cell."""
        tags = self.tag
        own, bound = ENDS_OWN.get(name, (frozenset(), frozenset()))
        if any(self.open.get(x) for x in own):
            for i in range(len(stack) - 1, 0, -1):
                here = tags[stack[i]]
                if here in bound:
                    break
                if here in own:
                    self._cut(stack, i)
                    if name != "tr":
                        break
        if name in ENDS_P and self.open.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                here = tags[stack[i]]
                if here == "p":
                    self._cut(stack, i)
                    break
                if here in SCOPE or here == "li" and name != "li":
                    break

    def _shown(self) -> tuple[list[int], list[int]]:
        """Characters in the subtree of each node, and those of them in links, without what is never shown."""
        n, parent, tags = len(self.tag), self.parent, self.tag
        off, in_link, chars, link_chars = [False] * n, [False] * n, [0] * n, [0] * n
        for i in range(1, n):
            off[i] = off[parent[i]] or self.apart[i] == "sure"
            in_link[i] = in_link[parent[i]] or tags[i] == "a"
        for node, text in self.texts:
            if not off[node]:
                size = len(" ".join(text.split()))
                chars[node] += size
                if in_link[node]:
                    link_chars[node] += size
        for i in range(n - 1, 0, -1):
            chars[parent[i]] += chars[i]
            link_chars[parent[i]] += link_chars[i]
        return chars, link_chars

    def removed(self) -> list[bool]:
        """Whether a node stands in a subtree that is not the article's.

        A mark by name takes out no element that holds an article or, on a page with none, most of the text outside links;
        remarks go even if they hold articles of their own, unless those are the page's only ones and most of its
        text. Where the name leaves a doubt, only an element whose text is mostly links goes.
        """
        n, tags, parent = len(self.tag), self.tag, self.parent
        holds = [False] * n  # an article or main element below that isn't itself set apart
        articles = [0] * n
        for i in range(n - 1, 0, -1):
            own = tags[i] in ("article", "main") and self.apart[i] in ("", "doubt")
            articles[parent[i]] += articles[i] + own
            if holds[i] or own:
                holds[parent[i]] = True
        chars = link_chars = [0] * n
        if any(mark in ("remarks", "set", "doubt") for mark in self.apart):
            chars, link_chars = self._shown()
        plain = chars[0] - link_chars[0]
        out, inside = [False] * n, [False] * n
        for i in range(1, n):
            p, tag = parent[i], tags[i]
            inside[i] = inside[p] or tag in ("article", "main") and self.apart[i] in ("", "doubt")
            mark = self.apart[i]
            if tag == "header" and not inside[i] and not holds[i]:
                mark = "sure"
            if mark in ("remarks", "set", "doubt"):
                most = 2 * (chars[i] - link_chars[i]) > plain and articles[i] == articles[0]
                if tag in ("html", "body"):
                    mark = ""
                elif mark == "remarks":
                    if most and articles[0]:
                        mark = ""
                elif most or holds[i] or tag in ("article", "main"):
                    mark = ""
                elif mark == "doubt" and 2 * link_chars[i] <= chars[i]:
                    mark = ""
            out[i] = out[p] or mark != "" and tag not in ("html", "body")
        return out

    def main_text(self) -> str:
        n, parent, tags = len(self.tag), self.parent, self.tag
        gone = self.removed()
        chars, link_chars, count, links = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or tags[i] == "a"
        for node, text in self.texts:
            if not gone[node] and (size := len(text) if " " not in text else len(" ".join(text.split()))):
                chars[node] += size
                if in_link[node]:
                    link_chars[node] += size
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = parent[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                count[p] += count[i] + 1
                links[p] += links[i] + (tags[i] == "a")
        body = next((i for i in range(n) if tags[i] == "body"), 0)
        if not chars[body]:
            body = 0
        if not chars[body]:
            return ""
        ratio = link_chars[body] / chars[body]
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if not gone[i] and chars[i]:
                density[i] = _density(chars[i], link_chars[i], count[i], links[i], ratio)
                if i:
                    total[parent[i]] += density[i]
        below = [False] * n
        below[body] = True
        best = list(range(n))  # node of the largest sum in the subtree
        for i in range(body + 1, n):
            below[i] = below[parent[i]]
        for i in range(n - 1, body, -1):
            if below[i] and not gone[i] and total[best[i]] >= total[best[parent[i]]]:
                best[parent[i]] = best[i]
        top = best[body]
        threshold, at = density[top], top
        while at != body:
            at = parent[at]
            threshold = min(threshold, density[at])
        # Every node that reaches the threshold, below nodes that do, gives its largest-sum node.
        open_, chosen = [False] * n, {top}
        open_[body] = True
        for i in range(body + 1, n):
            if below[i] and not gone[i] and open_[parent[i]] and density[i] >= threshold:
                open_[i] = True
                chosen.add(best[i])
        holder = self._common(chosen)
        at = holder
        while at > 0:
            if tags[at] in ("article", "main"):
                holder = at
                break
            at = parent[at]
        within = [False] * n
        for i in range(n):
            within[i] = not gone[i] and (i == holder or i > holder and within[parent[i]])
        return " ".join("".join([t for node, t in self.texts if within[node]]).split())

    def _common(self, nodes: set[int]) -> int:
        """The last node that holds all ``nodes``."""
        order = [-x for x in nodes]
        heapify(order)
        while len(order) > 1:
            last = -heappop(order)
            if -order[0] != last:
                heappush(order, -self.parent[last])
        return -order[0]


def _density(chars: int, link_chars: int, tags: int, links: int, ratio: float) -> float:
    """Characters per tag, adjusted for links; ratio: the share of link characters in the whole body."""
    tags = tags or 1
    plain = chars / tags
    if not ratio:
        return plain
    base = math.log(chars / max(1, chars - link_chars) * link_chars + ratio * chars + math.e)
    return plain * math.log(chars / (link_chars or 1) * tags / (links or 1) + 1e-9, base) if base > 1 else plain


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, into: str = "text") -> DataFrame:
    """Columns ``keep`` (all but the html by default) and the main text, '' where there is none.

    A null page is empty. Rows are independent: ties, repeated rows, null keys and extra columns don't
    matter; a kept column named as ``into`` is replaced; an empty table gives no rows. A page of any
    length is worked through whole, in time that grows with its tags.
    """
    ship(pages.sparkSession)
    keep = [c for c in (keep or pages.columns) if c not in (html_col, into)]
    rows = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias(into))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, into)):
            texts = [main_text(h) for h in batch.column(into).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, into])

    return rows.mapInArrow(run, rows.schema)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return made.withColumn("n_chars", F.length("text").cast("long"))
