"""Main text of web pages by tree scoring (operator 11).

Each paragraph passes points for its length and commas to its ancestors: all to the nearest
container, half to the next, ever less further up; an ``article`` gets all at any height. A
container's points are discounted by its link density, the share of its text inside links.
The best container is kept, with siblings that have enough points or read like text.

Before scoring, elements that hold no article by their kind (navigation, forms, scripts ...) or by
a word of their class, id or role (sidebar, comments, cookie ...) are left out; lists and boxes of links
inside the container go after it. If that leaves no paragraph, names are not counted, and then
forms, which some pages wrap around everything.

Text: character references are decoded once, white space inside a block becomes one space, blocks are
trimmed and joined in page order by a line feed. A ``br`` is white space. Unclosed paragraphs, list items and cells
end where the next begins; comments, scripts and tags that never end reach to the end of the page, and
a quote of a tag that never ends is a sign like another.

Defined results: a null or empty page has an empty text; a page without any markup is one
block; rows are judged each by itself, so repeated rows and ids stay; ties between containers go to the
first of the page; an empty table gives no rows; other columns stay as they are. Time is
linear in the page's length, and a page is in memory as a whole.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.llm.common import give_back, small_batches

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<said>(?>[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+)(?:>|\Z)""",
    re.S | re.X,
)
_SAID = re.compile(r"""(?:^|[\s/"'])(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""", re.I)

#: Elements whose content is no markup.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")
#: Elements that hold no article text.
NEVER = {*RAW, "head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "template", "svg", "math", "canvas", "object", "embed", "audio", "video", "label", "legend", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "dl", "table"}
BOXES = {"address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "div", "fieldset", "figure", "figcaption", "footer", "form", "header", "hgroup", "html", "main", "menu", "nav", "search", "section", "summary", *LISTS}
CELLS = {"li", "dt", "dd", "td", "th", "tr", "caption", "thead", "tbody", "tfoot"}
BLOCKS = {"p", "pre", "hr", *HEADINGS, *BOXES, *CELLS}
#: What an opening tag ends, up to which element.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
for _part in ("thead", "tbody", "tfoot"):
    ENDS[_part] = ({"thead", "tbody", "tfoot"}, {"table"})
#: Words of a class, id or role that mark something beside the article.
ASIDE = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer foot sidebar sidebars aside rail widget widgets complementary contentinfo "
    "comment comments commentlist discussion disqus reply replies respond responses cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay dialog "
    "newsletter subscribe subscription signup login register paywall share sharing social related recommended recommendations search form copyright legal disclaimer skip hidden".split()
)
#: Words before such a word that make it say something else: a page with a sidebar is none.
ABOUT = {"has", "with", "no", "without", "not"}

#: Points of a paragraph: for being of some length, for each so many characters up to a number, for each comma.
LEAST, STEP, MOST = 25, 100, 3
COMMAS = re.compile("[,،、，]")
#: Shares of points by height, the last one divided by the height above.
SHARES = (1.0, 0.5)
HEIGHT = 6
#: Siblings stay with this share of the best's points, and paragraphs of so many characters and few links.
ENOUGH, LONG, FEW_LINKS, MANY_LINKS = 0.2, 80, 0.25, 0.5


class Node:
    """An element: its parent, why it is out (0 in, 1 by name, 2 a form, 3 by kind), the nearest block, box
    and article from itself up, and what its text sums up to."""

    __slots__ = ("article", "block", "box", "chars", "linked", "links", "out", "points", "tag", "top", "up")

    def __init__(self, tag: str, up: Node | None, out: int):
        self.tag, self.up, self.out = tag, up, max(out, up.out if up else 0)
        self.block = self if up is None or tag in BLOCKS else up.block
        self.box = self if up is None or tag in BOXES else up.box
        self.article = self if tag == "article" else up.article if up else None
        self.points = self.chars = self.links = 0.0
        self.top, self.linked = None, False

    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0


def _named_aside(said: str) -> int:
    """1 if an attribute's words mark something beside the article, 3 if it is hidden."""
    for name, *values in _SAID.findall(said):
        name, value = name.lower(), html.unescape("".join(values)).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return 3
        if name in ("class", "id", "role"):
            for one in value.split():
                words = re.split(r"[^a-z]+", one)
                if ASIDE.intersection(words) and not ABOUT.intersection(words):
                    return 1
    return 0


class Page:
    """Blocks of a page in order, (element, text, characters in links), and all elements, each after its parent."""

    def __init__(self, source: str):
        self.nodes = [Node("", None, 0)]
        self.blocks: list[tuple[Node, str, int]] = []
        self.open = [self.nodes[0]]
        self.number: dict[str, int] = {}  # of open elements by tag
        self.said: list[tuple[str, bool]] = []
        at, text = 0, source
        while found := _TOKEN.search(text, at):
            self.say(text[at : found.start()])
            at = found.end()
            if tag := found["tag"]:
                tag = tag.lower()
                if found["end"]:
                    self.close(tag)
                else:
                    self.begin(tag, found["said"])
                    if tag in RAW:
                        over = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
                        at = over.start() if over else len(text)
        self.say(text[at:])
        self.cut()

    def say(self, text: str) -> None:
        if text and self.open[-1].out < 3:
            self.said.append((html.unescape(text), bool(self.number.get("a"))))

    def cut(self) -> None:
        """Ends the current block."""
        if self.said:
            text = " ".join("".join(t for t, _ in self.said).split())
            if text:
                linked = sum(len(" ".join(t.split())) for t, link in self.said if link)
                self.blocks.append((self.open[-1].block, text, min(linked, len(text))))
            self.said = []

    def pop(self, places: int) -> None:
        for _ in range(places):
            self.number[self.open.pop().tag] -= 1

    def end_open(self, tags: set, within: set) -> None:
        """Closes the innermost open element of some tags, unless one of ``within`` is nearer."""
        if any(self.number.get(t) for t in tags):
            for k, node in enumerate(reversed(self.open), 1):
                if node.tag in tags:
                    return self.pop(k)
                if node.tag in within:
                    return None
        return None

    def begin(self, tag: str, said: str) -> None:
        if tag in BLOCKS:
            self.cut()
            self.end_open({"p"}, {"td", "th", "button", "object", "caption"})
        if tag == "br":
            self.said.append((" ", False))
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if tag == "a":
            self.end_open({"a"}, {"td", "th", "object"})
        if tag in VOID:
            return
        out = 2 if tag == "form" else 3 if tag in NEVER else 0
        if not out and said.strip() and tag not in ("html", "body"):
            out = _named_aside(said)
        node = Node(tag, self.open[-1], out)
        self.nodes.append(node)
        self.open.append(node)
        self.number[tag] = self.number.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        if tag in BLOCKS or tag in NEVER:
            self.cut()
        if not self.number.get(tag):
            return
        for k, node in enumerate(reversed(self.open), 1):
            if node.tag == tag:
                return self.pop(k)
            if tag not in BLOCKS and node.tag in BLOCKS and tag not in NEVER:
                return  # an inline element does not end the block around its end


def points(text: str) -> float:
    return (len(text) >= LEAST) + min(len(text) / STEP, MOST) + len(COMMAS.findall(text))


def _scored(page: Page, out: int) -> Node | None:
    """Sums up all elements; the best container, None if no paragraph has points. Elements that are out by more than ``out`` don't count."""
    for n in page.nodes:
        n.points = n.chars = n.links = 0.0
    for own, text, linked in page.blocks:
        if own.out > out:
            continue
        own.chars += len(text)
        own.links += linked
        if own.tag in HEADINGS:
            continue
        worth, box, given = points(text), own.box, False
        for height in range(HEIGHT):
            if box is None:
                break
            whole = box is own.article
            given |= whole
            box.points += worth if whole else worth * (SHARES[height] if height < len(SHARES) else SHARES[-1] / height)
            box = box.up.box if box.up else None
        if own.article and not given:
            own.article.points += worth
    for n in reversed(page.nodes):  # children come after their parents
        if n.up is not None and n.out <= out:
            n.up.chars += n.chars
            n.up.links += n.links
    best = max((n for n in page.nodes if n.box is n), key=lambda n: n.points * (1 - n.density()))
    return best if best.points else None


def _kept(page: Page, best: Node, out: int) -> list[str]:
    """The texts of the best container's blocks and of those of its siblings that stay."""
    least = best.points * (1 - best.density()) * ENOUGH
    for n in page.nodes:
        # the best container or its sibling that holds the element, and whether a list or box of links does
        n.top = n if n is best or (n.up is not None and n.up is best.up) else n.up.top if n.up else None
        links = n is not best and (n.tag in LISTS or n.tag in ("div", "section")) and n.density() > MANY_LINKS
        n.linked = links or bool(n.up and n.up.linked and n is not best)

    def stays(top: Node, text: str, linked: int) -> bool:
        if top is best:
            return True
        if top.tag in HEADINGS:
            return not linked
        if top.box is top:
            return top.points * (1 - top.density()) >= least
        return (len(text) >= LONG and linked < FEW_LINKS * len(text)) or (not linked and text[-1] in ".!?:")

    return [text for own, text, linked in page.blocks if own.out <= out and own.top is not None and not own.linked and stays(own.top, text, linked)]


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    for out in range(3):
        if (best := _scored(page, out)) is not None and (texts := _kept(page, best, out)):
            return "\n".join(texts)
    return "\n".join(text for own, text, _ in page.blocks if own.out == 0)


@F.pandas_udf(StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    try:
        return pages.map(main_text)
    finally:
        give_back()


def extracted(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each in a column ``name``."""
    small_batches(pages.sparkSession)
    return pages.withColumn(name, _main_texts(F.col(source)))


def digest(pages: DataFrame) -> DataFrame:
    n_chars: Column = F.length("text").cast("long")
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", n_chars.alias("n_chars"))


#: The same for pages whose article is one element that holds only a heading and paragraphs, as all of the given tables have.
ORACLE_SQL = r"""
WITH parts AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(p|h1)>') AS blocks FROM pages),
said AS (SELECT page_id, url, list_transform(blocks, lambda b: trim(regexp_replace(
  replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '</?b>', '', 'g'), '<br>', ' ', 'g'), '&quot;?', '"', 'g'), '&(lt|gt);?', '&\1;', 'g'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))) AS blocks FROM parts),
whole AS (SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda b: regexp_replace(b, '&amp;?', '&', 'g')), lambda b: b <> ''), chr(10)) AS text FROM said)
SELECT page_id, url, text, length(text) AS n_chars FROM whole
"""
