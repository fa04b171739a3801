"""Main text of web pages by tree scoring.

A page is read once into a tree. Its runs of text (what stands between two block
borders) pass points for length and commas to the blocks that hold them, in full
to the nearest and less to those above. A block's points are discounted by the
share of its text that is in links. The best block is kept, raised to the article
around it, with those siblings that score well too. On a page without an article
all that stands beside the best block, at any level, is kept if it is not mostly links.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are known
by their tag, role or class words and take no part. Class words count on blocks
only; those that prose has too, and those of paragraphs and headings, rule a block
out only if it is mostly links or outside the best block.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary"
    " table tbody td tfoot th thead tr ul caption".split()
)
# Blocks that can hold an article.
HOLDER = frozenset("article body center div main section td blockquote".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag that ends an open element of the same group.
ENDS = {
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
FENCE = frozenset("ul ol dl table select div section article body".split())

NOISE_TAGS = RAW | frozenset("head nav footer aside form button select option input menu dialog svg canvas object template search fieldset label".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay"
    " pager pagination popup promo promoted promotion reactions recommended related replies respond share sharing sidebar"
    " signup skip social sponsor sponsored subscribe toolbar widget widgets gdpr paywall login".split()
)
# Of these, words that parts of an article have too.
SOFT_WORDS = frozenset(
    "banner header login masthead notice notices notification overlay recommended related share sharing signup skip social widget widgets".split()
)
# Blocks that any class word can rule out; other blocks are ruled out by evidence too, and inline elements never.
CONTAINER = frozenset("aside center details div dl figure ol section table ul".split())
HEADLINE_WORDS = frozenset("article entry post story".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
# Elements that a class word cannot rule out.
KEPT_TAGS = frozenset("html body article main".split())

# Blocks that are navigation if most of their text is in several short links, without a heading.
WRAPPER = frozenset("div section center".split())
SHORT_LINK = 25.0
SIBLING_SHARE = 0.2
SIBLING_LEAST = 10.0
# Share of links from which a block is furniture.
LINKED = 0.5


class Page:
    """The blocks of a page and its runs of text."""

    def __init__(self, source: str):
        self.tags, self.parents, self.noise, self.good, self.doubt = ["html"], [-1], [False], [False], [0]
        self.texts: list[tuple[int, int, str, bool]] = []  # run, node, text, in a link
        self.run = 0
        self._read(source)

    def _read(self, source: str) -> None:
        stack, links, at = [0], 0, 0
        find = TOKEN.search
        while True:
            token = find(source, at)
            end = token.start() if token else len(source)
            if end > at:
                self.texts.append((self.run, stack[-1], source[at:end], links > 0))
            if token is None:
                return
            at = token.end()
            name = (token[2] or token[5] or "").lower()
            if not name:
                continue
            closing = token[1] or token[4]
            if closing:
                if name in BLOCK:
                    self.run += 1
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[depth]] == name:
                        links -= sum(self.tags[n] == "a" for n in stack[depth:])
                        del stack[depth:]
                        break
                continue
            if name == "br":
                self.texts.append((self.run, stack[-1], " ", False))
            if name in BLOCK:
                self.run += 1
                links = self._end_open(stack, name, links)
            if name in VOID:
                continue
            if name in RAW:
                close = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            if (token[3] or token[6] or "").endswith("/") and name in ("svg", "path", "a"):
                continue
            if name == "a" and links:
                links = self._drop(stack, "a", links)
            stack.append(self._node(name, stack[-1], token[3] or token[6] or ""))
            links += name == "a"

    def _drop(self, stack: list[int], name: str, links: int) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag == name:
                links -= sum(self.tags[n] == "a" for n in stack[depth:])
                del stack[depth:]
                break
            if tag in FENCE:
                break
        return links

    def _end_open(self, stack: list[int], name: str, links: int) -> int:
        """A block ends an open paragraph; items end the item before."""
        links = self._drop(stack, "p", links)
        for other in ENDS.get(name, ()):
            links = self._drop(stack, other, links)
        return links

    def _node(self, name: str, parent: int, attributes: str) -> int:
        noise, good = self.noise[parent] or name in NOISE_TAGS, False
        doubtful = False
        inside_article = name == "header" and self._within(parent, "article")
        if name == "header" and not inside_article:
            noise = True
        if attributes and not noise:
            for key, *values in ATTRIBUTE.findall(attributes):
                value, key = "".join(values), key.lower()
                if key == "role":
                    noise = noise or value.lower() in NOISE_ROLES
                elif key == "hidden" or key == "aria-hidden":
                    noise = noise or (key == "hidden" or value.lower() == "true")
                else:
                    words = {w.lower() for w in WORD.findall(value)}
                    good = good or bool(words & GOOD_WORDS)
                    if name in BLOCK and name not in KEPT_TAGS and not inside_article and words & NOISE_WORDS:
                        if name in CONTAINER and not words & NOISE_WORDS <= SOFT_WORDS:
                            noise = True
                        elif not words & HEADLINE_WORDS:
                            doubtful = True
        self.tags.append(name)
        self.parents.append(parent)
        self.noise.append(noise)
        self.good.append(good)
        # The outermost block around a node that a class word speaks against, 0 if none.
        self.doubt.append(0 if name in KEPT_TAGS else self.doubt[parent] or (len(self.tags) - 1 if doubtful else 0))
        return len(self.tags) - 1

    def _within(self, node: int, name: str) -> bool:
        while node > 0:
            if self.tags[node] == name:
                return True
            node = self.parents[node]
        return False

    def anchor(self, node: int) -> int:
        """The link around a node."""
        while node > 0 and self.tags[node] != "a":
            node = self.parents[node]
        return node

    def holders(self, node: int) -> list[int]:
        """The blocks around a node that can hold an article, from the nearest."""
        found = []
        while node >= 0:
            if self.tags[node] in HOLDER or node == 0:
                found.append(node)
            node = self.parents[node]
        return found


def main_text(source: str | None) -> str:
    """The blocks of a page's article, one per line; empty if the page has none."""
    if not source:
        return ""
    page = Page(source)
    runs: dict[int, list] = {}
    for run, node, text, linked in page.texts:
        if page.noise[node]:
            continue
        kept = runs.setdefault(run, [node, [], 0, set()])
        text = html.unescape(text)
        kept[1].append(text)
        if linked:
            kept[2] += len(" ".join(text.split()))
            kept[3].add(page.anchor(node))
    blocks = []  # node, text, length in links, links, blocks around it
    around_node: dict[int, list[int]] = {}
    for node, parts, linked, anchors in runs.values():
        text = " ".join("".join(parts).split())
        if text:
            if node not in around_node:
                around_node[node] = page.holders(node)
            blocks.append((node, text, linked, anchors, around_node[node]))
    if not blocks:
        return ""

    # Where all text is doubtful, no class word counts.
    doubts = any(not page.doubt[node] for node, *_ in blocks)
    doubt = {node: page.doubt[node] if doubts else 0 for node, *_ in blocks}
    doubt_length: dict[int, int] = defaultdict(int)
    doubt_links: dict[int, int] = defaultdict(int)
    points: dict[int, float] = defaultdict(float)
    length: dict[int, int] = defaultdict(int)
    in_links: dict[int, int] = defaultdict(int)
    links: dict[int, set[int]] = defaultdict(set)
    headed: set[int] = set()
    for node, text, linked, anchors, around in blocks:
        if doubt[node]:
            doubt_length[doubt[node]] += len(text)
            doubt_links[doubt[node]] += linked
            continue
        heading = any(page.tags[n] in HEADING for n in _up(page, node, around[0]))
        worth = 0.0 if heading else (len(text) >= 25) + text.count(",") + min(len(text) / 100, 3.0)
        for level, holder in enumerate(around):
            points[holder] += worth / (1 if level == 0 else 2 * level)
            length[holder] += len(text)
            in_links[holder] += linked
            links[holder] |= anchors
            if heading:
                headed.add(holder)

    def density(holder: int) -> float:
        return min(1.0, in_links[holder] / max(1, length[holder]))

    def navigation(around: list[int], kept: set[int]) -> bool:
        """Whether a block below the kept ones that holds this text is navigation; cells and quotes belong to the text around."""
        for holder in around:
            if holder in kept or page.tags[holder] not in WRAPPER:
                return False
            n = len(links[holder])
            if n > 1 and density(holder) > LINKED and in_links[holder] < SHORT_LINK * n and holder not in headed:
                return True
        return False

    def score(holder: int) -> float:
        bonus = 25.0 * (page.tags[holder] in ("article", "main")) + 5.0 * page.good[holder]
        return (points[holder] + bonus) * (1 - density(holder))

    best = max(points, key=lambda n: (score(n), -n))
    for above in page.holders(best)[1:]:
        if page.tags[above] in ("article", "main") and length[above]:
            best = above
    level = page.parents[best]
    least = max(SIBLING_LEAST, SIBLING_SHARE * score(best))
    siblings = {n for n in points if n != best and page.parents[n] == level and score(n) >= least} if best else set()
    kept = {best} | siblings
    whole = page.tags[best] in ("article", "main")
    above_best = set(page.holders(best))

    lines = []
    for node, text, linked, _, around in blocks:
        inside = any(holder in kept for holder in around)
        if doubt[node] and (not inside or doubt_links[doubt[node]] > LINKED * doubt_length[doubt[node]]):
            continue
        menu = navigation(around, kept)
        if inside:
            if not menu:
                lines.append(text)
        elif not whole:
            beside = [holder for holder in around if holder not in above_best]
            if not menu and (density(beside[-1]) if beside else linked / len(text)) <= LINKED:
                lines.append(text)
    return "\n".join(lines)


def _up(page: Page, node: int, stop: int) -> Iterator[int]:
    while node != stop and node >= 0:
        yield node
        node = page.parents[node]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: ``key``, ``url``, ``text``, ``n_chars`` (code points).

    Character references are decoded, white space inside a block is one space,
    blocks are joined by one line break. A NULL or empty page, and one without
    text, has the empty text. Repeated and NULL keys keep their rows; other columns
    are not read; an empty table gives no rows. Pages of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "u", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(source).cast("string").alias("h"))
    kind = rows.schema["k"].dataType.simpleString()
    found = rows.mapInArrow(run, f"k {kind}, u string, text string, n_chars bigint")
    return found.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
