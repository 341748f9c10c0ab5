"""Main text of web pages by composite text density.

A page is read into a tree with the usual repairs (open paragraphs, list items and cells end where the next begins; end tags
close what lies open in theirs; scripts and styles are skipped as raw text). Elements that say what they are by their tag or role -
menus, page headers and footers, sidebars, notices, adverts, forms, reader comments - are left out, and those that say so by a whole
class or id unless they hold a main heading, an article or half of a page's long text. For each other node the composite density is

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LC_body / C_body * C + e)

with C characters, T tags, LC and LT those of links, each 1 at least where it divides. A node's density sum adds its children's.
The node of the largest sum gives the threshold: the least density on its path to the body. From the body down, every node at
or above the threshold adds the node of the largest sum in its subtree. The main text is all that was so selected, each node
widened to the nearest article or main element around it where there is one that reaches the threshold and is not mostly links.

Text: references decoded, white space within a block is one space, blocks stand apart by an empty line. Nothing is capped.

Cases: null html is an empty page, an empty page has an empty text; repeated rows give equal rows; other columns pass through and
one of the output's name is replaced; work and memory grow with the page's length, nothing recurses.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import byte_slices, text_of

SLICE_BYTES = 4 << 20
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that end where one of the second set begins.
ENDS_AT = {
    "p": BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option", "optgroup"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "head": frozenset({"body"}),
}
ENDED_BY = {name: [x for x, at in ENDS_AT.items() if name in at] for name in frozenset().union(*ENDS_AT.values())}
#: Elements that an end tag or an implied end does not reach beyond.
WALLS = frozenset({"table", "ul", "ol", "dl", "article", "main", "section", "body", "html", "select"})
NOISE_TAGS = frozenset("nav footer aside form button select textarea iframe object svg canvas audio video dialog menu head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Names of classes and ids. A whole name speaks, never a part of it: it must be made of these words and of words for places, so
#: "site-header" is a page's header, while "post-header" and "related-work" are not.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs footer header masthead sidebar aside cookie cookies consent notice notices popup modal overlay newsletter subscribe signup share sharing social related comment comments disqus respond reply replies".split()
)
PLACE_WORDS = frozenset("site page global main top bottom left right box bar block area section widget wrapper wrap container inner content list item items links slot unit text body form thread user reader policy info message button buttons js".split())
#: Around an article, these are places for all but its header.
ARTICLE_WORDS = frozenset("post article entry story".split())
TITLE_WORDS = frozenset("header masthead banner".split())
#: Where length says nothing: readers' comments and adverts can be longer than the article.
LONG_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent comment comments disqus respond reply replies".split())
#: Characters from which on the half of a page's text is not taken for a menu or a sidebar by its name alone.
PROSE = 1_000
_TAG = regex.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What stands between a tag's name and its end. A quote counts after a = only; no choice is ever taken back, so this is linear.
_ATTRIBUTES = regex.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+>""")
#: The same without quotes, for pages with one that never ends.
_PLAIN = regex.compile("[^>]*+>")
_RAW = {name: regex.compile(rf"</{name}\s*+>", regex.I) for name in ("script", "style", "noscript", "template", "title")}
_ATTRIBUTE = regex.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", regex.I)
_NAME_PARTS = regex.compile("[^a-z]+")


def says_noise(name: str) -> str | None:
    """What a class or id says: "long" or "other" kinds of noise, or nothing."""
    words = [w for w in _NAME_PARTS.split(name) if w]
    said = NOISE_WORDS.intersection(words)
    rest = set(words) - NOISE_WORDS - PLACE_WORDS
    if not said or not rest <= ARTICLE_WORDS or (rest and said <= TITLE_WORDS):
        return None
    return "long" if said & LONG_WORDS else "other"


class Page:
    """Nodes in page order, parents before children, and the texts and block ends between them."""

    def __init__(self, html: str):
        self.tag, self.parent, self.noise = ["#page"], [-1], [False]
        self.events: list[tuple[int, str | None]] = []  # a node's text, or None where a block begins or ends
        self.stack = [0]  # open elements
        self.depths: dict[str, list[int]] = defaultdict(list)  # where those of each name stand in the stack
        self.walls: list[int] = []  # and where those that are walls do
        self.named: dict[int, str] = {}  # nodes whose class or id says that they are noise
        at = begin = 0  # where the text that is not yet taken begins, and where the next tag may
        quotes = True
        while (begin := html.find("<", begin)) >= 0:
            name, close = "", None
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                end = len(html) if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), begin):
                end = html.find(">", begin) + 1
            elif m := _TAG.match(html, begin):
                close, name = m[1], m[2].lower()
                rest = _ATTRIBUTES.match(html, m.end()) if quotes else None
                if rest is None:
                    quotes = False
                    rest = _PLAIN.match(html, m.end())
                end = rest.end() if rest else 0
            else:
                begin += 1
                continue
            if not end:  # no > is left, so the rest is text
                break
            if begin > at:
                self.text(html[at:begin])
            attributes = html[m.end() : end - 1] if name else ""
            if name in _RAW and not close:
                found = _RAW[name].search(html, end)
                end = found.end() if found else len(html)
            elif name:
                self.end(name) if close else self.start(name, attributes)
            at = begin = end
        if at < len(html):
            self.text(html[at:])
        self.mark_named()

    def text(self, raw: str) -> None:
        if raw and self.tag[self.stack[-1]] != "head":
            self.events.append((self.stack[-1], unescape(raw) if "&" in raw else raw))

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.events.append((self.stack[-1], " "))
        self.close(max((self.depths[x][-1] for x in ENDED_BY.get(name, ()) if self.depths[x]), default=0), walled=True)
        node, up = len(self.tag), self.stack[-1]
        self.tag.append(name)
        self.parent.append(up)
        self.noise.append(self.noise[up] or self.is_noise(node, name, attributes))
        if name in BLOCK:
            self.events.append((node, None))
        elif name in ("td", "th"):
            self.events.append((node, " "))
        if name not in VOID and not attributes.endswith("/"):
            self.depths[name].append(len(self.stack))
            if name in WALLS:
                self.walls.append(len(self.stack))
            self.stack.append(node)

    def close(self, depth: int, walled: bool) -> None:
        """Closes the open elements from a depth on, if there is one (0: none) and, where walls count, none stands deeper."""
        if not depth or (walled and self.walls and self.walls[-1] > depth):
            return
        while len(self.stack) > depth:
            self.depths[self.tag[self.stack.pop()]].pop()
        while self.walls and self.walls[-1] >= depth:
            self.walls.pop()

    def end(self, name: str) -> None:
        open_ = self.depths[name]
        self.close(open_[-1] if open_ else 0, walled=name not in BLOCK)
        if name in BLOCK:
            self.events.append((self.stack[-1], None))

    def is_noise(self, node: int, name: str, attributes: str) -> bool:
        """Whether the element itself or its role says so. What its class or id says is kept for mark_named."""
        if name in NOISE_TAGS:
            return True
        if name in ("html", "body", "main", "article", "#page"):
            return False
        if name == "header":  # an article's own header holds its title
            return not (self.depths["article"] or self.depths["main"])
        for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            words = value.strip("\"'").lower().split()
            if key.lower() == "role":
                if not NOISE_ROLES.isdisjoint(words):
                    return True
            else:
                for word in words:
                    if said := says_noise(word):
                        self.named[node] = said
        return False

    def mark_named(self) -> None:
        """Nodes that are noise by their class or id, unless what they hold speaks against it: a main heading or the main element;
        an article, or PROSE characters outside links and half of the page's (but not for LONG_WORDS)."""
        if not self.named:
            return
        n = len(self.tag)
        text, title, article = [0] * n, [False] * n, [False] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for i, t in self.events:
            if t and not self.noise[i] and not in_link[i]:
                text[i] += len(t.strip())
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not self.noise[i]:
                text[p] += text[i]
            title[p] |= title[i] or self.tag[i] in ("h1", "main")
            article[p] |= article[i] or self.tag[i] == "article"
        for i, said in self.named.items():
            self.noise[i] |= not (title[i] or (said == "other" and (article[i] or (text[i] >= PROSE and 2 * text[i] > text[0]))))
        for i in range(1, n):
            self.noise[i] |= self.noise[self.parent[i]]

    def densities(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """Composite density, density sum, characters and characters in links of each node."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for i, text in self.events:
            if text and not self.noise[i]:
                size = len(text.strip())
                chars[i] += size
                link_chars[i] += size * in_link[i]
        for i in range(n - 1, 0, -1):
            if not self.noise[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                tags[p] += tags[i] + 1
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        ratio = link_chars[body] / max(1, chars[body])
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c, t = chars[i], max(1, tags[i])
            if not c or self.noise[i]:
                continue
            lc, lt = link_chars[i], max(1, link_tags[i])
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            value = c / max(1, lc) * t / lt
            density[i] = c / t * (math.log(value) / math.log(base) if base > 1.0000001 and value > 0 else math.log(max(value, 1e-9)))
            if base <= 1.0000001:
                density[i] = c / t
        for i in range(1, n):
            sums[self.parent[i]] += density[i]
        for i in range(n):  # a leaf's sum is its own
            if not sums[i]:
                sums[i] = density[i]
        return density, sums, chars, link_chars

    def selected(self) -> list[bool]:
        n = len(self.tag)
        density, sums, chars, link_chars = self.densities()
        best = list(range(n))  # of each subtree
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if sums[best[i]] >= sums[best[p]] and not self.noise[i] and (sums[best[i]] > sums[best[p]] or best[p] != p):
                best[p] = best[i]
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        top = best[body]
        path, node = [], top
        while node >= 0:
            path.append(node)
            node = self.parent[node] if node != body else -1
        threshold = min(density[i] for i in path)
        chosen, open_ = [False] * n, [False] * n
        for i in range(body, n):
            up = self.parent[i]
            if i != body and (chosen[up] or not open_[up]):
                chosen[i] = chosen[i] or chosen[up]
                continue
            open_[i] = density[i] >= threshold and density[i] > 0 and not self.noise[i]
            if open_[i]:
                target = best[i]
                chosen[target] = True
            chosen[i] = chosen[i] or False
        # A chosen node takes the article around it along, which reached the threshold like all nodes above it, unless links prevail there.
        around = [0] * n
        for i in range(1, n):
            around[i] = i if self.tag[i] in ("article", "main") and 2 * link_chars[i] <= chars[i] else around[self.parent[i]]
        for i in range(1, n):
            if chosen[i] and around[i] and density[around[i]] >= threshold:
                chosen[around[i]] = True
        for i in range(1, n):
            chosen[i] = (chosen[i] or chosen[self.parent[i]]) and not self.noise[i]
        return chosen

    def main_text(self) -> str:
        chosen = self.selected()
        blocks, held = [], []
        for node, text in [*self.events, (0, None)]:
            if text is None:
                if block := " ".join("".join(held).split()):
                    blocks.append(block)
                held = []
            elif chosen[node]:
                held.append(text)
        return "\n\n".join(blocks)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, html, SLICE_BYTES):
            found = pa.array([Page(h).main_text() if h else "" for h in batch.column(html).to_pylist()], pa.string())
            keep = [n for n in batch.schema.names if n not in (html, text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), found], [*keep, text])

    pages = pages.withColumn(html, text_of(html))
    fields = [f for f in pages.schema.fields if f.name not in (html, text)] + [T.StructField(text, T.StringType())]
    return pages.mapInArrow(run, T.StructType(fields))
