"""Main text of web pages by composite text density.

Each page becomes a tree. A node's density is its characters per tag, lowered by a logarithm
whose base grows with the share of its text that is links. The sum of its children's
densities is largest for the node that holds many dense parts side by side: the article.
The lowest density on the path from there to the body is the threshold that other parts
must reach to count as more of it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.arrow import mapped

# Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol
    p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
ENDS_P = BLOCKS - frozenset("body caption dd dt html legend li tbody td tfoot th thead tr".split())
BOUNDS = frozenset("html table td th caption button object template".split())
ENDED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
}
#: What holds the items above, so that lists and tables can nest.
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select".split())

#: What a head may hold; anything else ends one that was left open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video title".split())
AROUND = frozenset("nav footer aside button select textarea header menu dialog label search".split())
#: Names in class, id or role of what is not the article, alone or in compounds with each other and with _BESIDE.
HINTS = frozenset(
    """ad ads adv advert advertising adverts advertisement alert banner breadcrumb breadcrumbs comment
    comments complementary contentinfo cookie cookies consent disclaimer disqus dialog footer form gdpr
    login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination
    pager popup promo promoted promotion recommended related replies respond search share sharing
    sidebar signup social sponsor sponsored subscribe subscription toast toolbar widget""".split()
)
_BESIDE = frozenset(
    """area bar block bottom box button center column container content footer group head header inner
    item items left link links list main message notice outer page panel post posts primary right row
    secondary section site text title top wrap wrapper""".split()
)
_PART = re.compile(r"[a-z0-9]+")


def _names_other(named: str) -> bool:
    """Whether a whole name says so: ``cookie-notice`` does, ``has-sidebar`` or ``ad-free`` do not."""
    for name in named.split():
        parts = {p for p in _PART.findall(name) if not p.isdigit()}
        if not HINTS.isdisjoint(parts) and parts <= HINTS | _BESIDE:
            return True
    return False


#: Of these, what readers say; no page is wrapped in it.
COMMENTS = frozenset("comment comments disqus replies respond".split())
WRAPS = 0.5  # share of a page's text above which a form or an element with another name is a wrapper

_OPEN_TAG = re.compile("</?[A-Za-z]|<[!?]")
_COMMENT_OR_RAW = re.compile(r"<!--|<(script|style|textarea|title)\b", re.I)


def _closed(html: str) -> str:
    """The page up to a comment that nothing closes: all behind it is comment.

    What looks like one inside a script and the like is none. Every part is passed once.
    """
    at, open_ended = 0, set()
    while (m := _COMMENT_OR_RAW.search(html, at)) is not None:
        if m[1] is None:
            end = html.find("-->", m.start() + 2)
            if end < 0:
                return html[: m.start()]
            at = end + 3
            continue
        at, tag = m.end(), m[1].lower()
        if tag not in open_ended:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            if end is None:
                open_ended.add(tag)
            else:
                at = end.end()
    return html
LEAST = 1e-6  # weight of any text, however few its characters


class Tree(HTMLParser):
    """Nodes in page order with their parents, and the pieces of text in them.

    Left-open elements end where the standard lets them: a paragraph at the next block, an item
    at the next item, anything at the end of what holds it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.last, self.out = ["#page"], [-1], [0], [False]
        self.hinted: dict[int, float] = {}  # nodes that go unless they hold more than this share of the page
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # depths of open elements by tag
        self.bounds: list[int] = [0]
        self.block = 0
        self.texts: list[tuple[int, int, str]] = []  # node, block, text

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.stack.pop()
            tag = self.tags[node]
            self.last[node] = len(self.tags) - 1
            self.open[tag].pop()
            if self.bounds[-1] == len(self.stack):
                self.bounds.pop()
            if tag in BLOCKS:
                self.block += 1

    def _depth(self, tag: str) -> int:
        depths = self.open.get(tag)
        return depths[-1] if depths else 0

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and self._depth("head"):
            self._pop_to(self._depth("head"))
        if tag in ENDS_P and self._depth("p") > self.bounds[-1]:
            self._pop_to(self._depth("p"))
        if tag in ENDED_BY:
            holder = max(map(self._depth, HOLDERS))
            depth = min((d for d in map(self._depth, ENDED_BY[tag]) if d > holder), default=0)
            if depth:
                self._pop_to(depth)
        if tag in BLOCKS:
            self.block += 1
        elif tag == "br":
            self.texts.append((self.stack[-1], self.block, " "))
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.last.append(node)
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
        if named and tag not in ("body", "html", "main", "article") and _names_other(named):
            said = not COMMENTS.isdisjoint(_PART.findall(named))
            self.hinted[node] = 1.0 if said else WRAPS
        elif tag == "form":
            self.hinted[node] = WRAPS
        self.out.append(tag in UNSEEN or tag in AROUND)
        if tag not in VOID:
            if tag in BOUNDS:
                self.bounds.append(len(self.stack))
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        depth = self._depth(tag)
        if depth:
            self._pop_to(depth)
        elif tag in BLOCKS:
            self.block += 1

    def handle_data(self, data):
        if self.tags[self.stack[-1]] == "head" and not data.isspace():
            self._pop_to(len(self.stack) - 1)
        self.texts.append((self.stack[-1], self.block, data))

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # in a web page it is a comment up to the next bracket

    def close(self):
        if _OPEN_TAG.match(self.rawdata):  # the page ends inside a tag, which is no text
            self.rawdata = ""
        super().close()
        self._pop_to(1)
        self.last[0] = len(self.tags) - 1
        self._drop_hinted()

    def _drop_hinted(self) -> None:
        """Hinted nodes go, inner ones first, but not one with more of the text outside links that is left
        by then than its share (WRAPS; all of it for comments), unless the page's article, main and h1
        elements are all outside: that is a wrapper of the page."""
        if not self.hinted:
            return
        n = len(self.tags)
        skipped, chars = self.out[:], [0] * n
        for i in range(1, n):
            skipped[i] = skipped[i] or skipped[self.parents[i]] or self.tags[i] == "a"
        for node, _, text in self.texts:
            if not skipped[node]:
                chars[node] += sum(map(len, text.split()))
        left = sum(chars)
        marks = [tag in ("article", "main", "h1") and not gone for tag, gone in zip(self.tags, skipped)]
        marked = any(marks)
        for i in range(n - 1, 0, -1):
            least = self.hinted.get(i)
            if least is not None and (chars[i] <= least * left and (least < 1 or chars[i] < left) or (marked and not marks[i])):
                self.out[i] = True
                left -= chars[i]
            else:
                chars[self.parents[i]] += chars[i]
                marks[self.parents[i]] |= marks[i]


def _chosen(tree: Tree) -> list[tuple[int, int]]:
    """First and last node of each chosen part, in page order."""
    n = len(tree.tags)
    tags, parents = tree.tags, tree.parents
    gone = tree.out[:]
    linked = [False] * n
    for i in range(1, n):
        gone[i] = gone[i] or gone[parents[i]]
        linked[i] = tags[i] == "a" or linked[parents[i]]
    chars, link_chars, own = [0] * n, [0] * n, [0] * n
    for node, _, text in tree.texts:
        if not gone[node]:
            size = sum(map(len, text.split()))
            chars[node] += size
            own[node] += size
            if linked[node]:
                link_chars[node] += size
    count, link_tags = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            p = parents[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            count[p] += count[i] + 1
            link_tags[p] += link_tags[i] + linked[i]
            if tags[i] not in BLOCKS:
                own[p] += own[i]
    share = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if gone[i] or not chars[i]:
            continue
        c, t = chars[i], max(1, count[i])
        base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + math.e)
        links = c / max(1, link_chars[i]) * t / max(1, link_tags[i])
        density[i] = c / t * max(math.log(links) / (math.log(base) or 1.0), LEAST)
        if i and tags[i] in BLOCKS:
            total[parents[i]] += density[i]
        if own[i]:  # text right in the node is a part like its children
            total[i] += density[i] * own[i] / c
    blocks = [i for i in range(n) if total[i] > 0 and (tags[i] in BLOCKS or i == 0)]
    if not blocks:
        return []
    best = max(blocks, key=lambda i: (total[i], -i))
    least, up = density[best], best
    while up > 0 and tags[up] != "body":
        up = parents[up]
        if density[up] > 0:
            least = min(least, density[up])
    parts, end = [], -1
    for i in blocks:  # page order; other parts as dense as the path to the body
        if i > end and (i == best or (density[i] >= least and not i <= best <= tree.last[i])):
            parts.append((i, tree.last[i]))
            end = tree.last[i]
    return parts


def main_text(html: str | None) -> str:
    """Blocks of the article, white space in each as single spaces, one block per line."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(_closed(html))
    tree.close()
    gone = tree.out[:]
    for i in range(1, len(gone)):
        gone[i] = gone[i] or gone[tree.parents[i]]
    parts = _chosen(tree)
    firsts, blocks = [first for first, _ in parts], {}
    for node, block, text in tree.texts:
        part = bisect_right(firsts, node) - 1  # parts lie one after the other
        if not gone[node] and part >= 0 and node <= parts[part][1]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(texts).split()) for texts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html, anything else).

    Returns ``page_id``, ``url``, ``text`` (empty if there is none) and ``n_chars`` (its code points).
    A null page is empty. Null ids, null addresses and repeated rows go through as they are.
    Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    asked = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    return mapped(asked, run, "page_id bigint, url string, text string, n_chars bigint")
