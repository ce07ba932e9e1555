"""Main text of web pages by composite text density.

A page is parsed into a tree that forgives unclosed and misplaced tags.  Boilerplate by markup (scripts, menus, footers,
what is hidden or has such a role) is left out.  Blocks whose class or id names an advert, a menu, comments and so on, and
forms, are left out too, but not one that holds most of the page's text outside links: names only weigh against a block,
and where they would leave nothing they do not count.  Every other node gets its link-adjusted characters per tag, and
the sum of these densities over its children.  The node with the largest sum is the main text; where it holds several
articles, the one with the largest sum, if most of the text is in it.  An article or main element around it widens it if that
is denser than the body.  Otherwise it is widened to a block that adds the title and little else, and other subtrees count
too whose density reaches the lowest density on the path from the body to that node.  An article, or a division or section
with many of these, beside that path in which nothing is so dense, such as a list of short comments, is left out.

Defined cases: null and empty pages, and pages whose text is all boilerplate by markup, give an empty text; a page that
breaks off counts up to its end; markup without a body is its own body; repeated rows give equal texts.  ``extract`` takes
the name of the column that it adds, in place of a caller's column of that name.
"""

from __future__ import annotations

import html
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, own, table

TOKEN = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z))""", re.S)
#: One attribute, consumed whole: its name, then a quoted or bare value.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*)?))?""")
#: Words of a class or id, not those after has-, with- or no-.
WORDS = re.compile(r"(?:(?:has|with|without|no)(?:[-_][A-Za-z]+|[A-Z][a-z]*))|([A-Z]?[a-z]+|[A-Z]+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the text.
DROPPED = frozenset("head script style noscript template textarea title iframe object embed svg math canvas audio video nav footer aside button select input dialog menu".split())
#: Roles, and words of classes and ids, that name a block beside the article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer topbar cookie cookies consent gdpr newsletter "
    "topnav subnav sidenav mainnav sitenav navmenu menubar sidemenu topmenu rail adbox adslot adunit adsbygoogle advertorial gdprbanner cookiebar comment comments commentlist disqus".split()
)
WEAK = frozenset(
    "sponsored sponsors promo promotion promoted banner banners masthead toolbar notice notices alert popup modal overlay subscribe subscription signup login disclaimer discussion respond "
    "responses feedback reply replies share sharing social related recommended recommendations widget widgets pagination pager".split()
)
#: Words of which a class or id of the article itself is made; beside one, other names are weak.
ARTICLE = frozenset("article entry post story content text main body page single hentry prose".split())
#: A named block stays if it holds more than this share of the page's text outside links; by how strongly it is named.
MOST = (1.0, 0.5, 0.9)
#: Words beside which "header" names that of the page, not of the article.
PAGE_HEADERS = frozenset("site page top global main header head".split())
#: An open element that the key's start tag ends, looked for up to one of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements that hold others and are no text of their own.
CONTAINERS = frozenset("div section article".split())
#: Containers within one that make it a list of such.
MANY = 5
SCOPES = frozenset("article aside body div footer form header main nav section table td th blockquote li html".split())


def named(attributes: str) -> dict[str, str]:
    """Values by names; of attributes that repeat a name the first counts."""
    out: dict[str, str] = {}
    for found in ATTRIBUTE.finditer(attributes):
        out.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")
    return out


class Tree:
    """Nodes in page order: parent, tag, whether left out by markup, how strongly named as beside the article (0 to 2);
    and the pieces of text with their node and block."""

    def __init__(self, page: str):
        self.parent, self.tag, self.out, self.named, self.texts = [-1], [""], [False], [0], []
        self.open, self.block = [0], 0
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag, and of those in SCOPES
        self.scopes = [0]
        at = 0
        while found := TOKEN.search(page, at):
            self.text(page[at:found.start()])
            at = found.end()
            name = (found[2] or "").lower()
            if found[1]:
                self.close(name)
            elif name:
                self.start(name, found[3] or "")
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                    at = end.start() if end else len(page)
        self.text(page[at:])

    def text(self, data: str) -> None:
        if data and not self.out[self.open[-1]]:
            self.texts.append((self.open[-1], self.block, html.unescape(data)))

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.block += 1
            self.end_open({"p"}, SCOPES)
        if name in ENDS:
            self.end_open(*ENDS[name])
        above = self.open[-1]
        self.parent.append(above)
        self.tag.append(name)
        out, names = (True, 0) if self.out[above] else self.beside(name, attributes)
        self.out.append(out)
        self.named.append(names)
        if name not in VOID:
            self.places.setdefault(name, []).append(len(self.open))
            if name in SCOPES:
                self.scopes.append(len(self.open))
            self.open.append(len(self.tag) - 1)
        elif name == "br":
            self.text(" ")

    def nearest(self, tags) -> int:
        """Place among the open elements of the innermost with one of the tags; 0 if none has."""
        return max((self.places[x][-1] for x in tags if self.places.get(x)), default=0)

    def cut(self, place: int) -> None:
        """End the open elements from this place on."""
        for node in self.open[place:]:
            self.places[self.tag[node]].pop()
            if self.tag[node] in SCOPES:
                self.scopes.pop()
        del self.open[place:]

    def end_open(self, ended: set[str], scope) -> None:
        found = self.nearest(ended)
        if found and found > (self.scopes[-1] if scope is SCOPES else self.nearest(scope - ended)):
            self.cut(found)

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.block += 1
        found = self.nearest((name,))
        if found and (name in SCOPES or found > self.scopes[-1]):
            self.cut(found)

    def within(self, node: int, names) -> int | None:
        while node > 0 and self.tag[node] not in names:
            node = self.parent[node]
        return node if node > 0 else None

    def beside(self, name: str, attributes: str) -> tuple[bool, int]:
        """Whether markup says that the element is not part of the article, and how strongly names say so."""
        if name in DROPPED or (name == "header" and not self.nearest(("article", "main"))):
            return True, 0
        strength, article = int(name == "form"), False
        for key, value in named(attributes).items() if attributes else ():
            if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)) or (key == "role" and value.lower() in ROLES):
                return True, 0
            if key in ("class", "id") and name not in ("html", "body", "article", "main"):
                for token in value.split():
                    words = {w.lower() for w in WORDS.findall(token)} - {""}
                    article |= bool(words) and words <= ARTICLE
                    if not STRONG.isdisjoint(words):
                        strength = 2
                    elif not WEAK.isdisjoint(words):
                        strength = max(strength, 1)
                words = {w.lower() for w in WORDS.findall(value)}
                if "header" in words and words <= PAGE_HEADERS and not self.nearest(("article", "main")):
                    strength = 2
        return False, min(strength, 1) if article else strength


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_links: int) -> float:
    """Characters per tag; on pages with links in their text, less for nodes with many and long links."""
    plain = chars / max(1, tags)
    if not body_links or not chars:
        return plain
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_links / max(1, body_chars) * chars + math.e)
    return plain * max(0.0, math.log(chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)) / math.log(max(base, 1.01)))


def counts(tree: Tree, out: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters and tags of each subtree, and those of links in it, without what is left out."""
    chars, tags, link_chars, link_tags = ([0] * len(out) for _ in range(4))
    for node, _, text in tree.texts:
        if not out[node]:
            chars[node] += len("".join(text.split()))
    for i in range(len(out) - 1, 0, -1):
        if not out[i]:
            if tree.tag[i] == "a":
                link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
            up = tree.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i]
    return chars, tags, link_chars, link_tags


def left_out(tree: Tree, last: list[int]) -> list[bool]:
    """Whether each node is left out, by markup or by names; last: of each subtree."""
    chars, _, link_chars, _ = counts(tree, tree.out)
    plain = [a - b for a, b in zip(chars, link_chars)]
    articles = [int(tag in ("article", "main") and chars[i] > 0) for i, tag in enumerate(tree.tag)]
    before, around, out = list(itertools.accumulate(articles, initial=0)), [0] * len(articles), list(tree.out)
    for i in range(1, len(out)):
        around[i] = around[tree.parent[i]] + articles[i]
        if out[tree.parent[i]]:
            out[i] = True
        elif tree.named[i] and not out[i]:
            elsewhere = before[-1] > before[last[i] + 1] - before[i] + around[i]
            out[i] = elsewhere or plain[i] <= MOST[tree.named[i]] * plain[0]
    return out if any(not out[node] and text.strip() for node, _, text in tree.texts) else tree.out


def main_text(page: str | None) -> str:
    tree = Tree(page or "")
    n = len(tree.tag)
    last = list(range(n))  # nodes are in page order, so a subtree is a range
    for i in range(n - 1, 0, -1):
        last[tree.parent[i]] = max(last[tree.parent[i]], last[i])
    out = left_out(tree, last) if any(tree.named) else tree.out
    chars, tags, link_chars, link_tags = counts(tree, out)
    body = next((i for i in range(n) if tree.tag[i] == "body" and chars[i] == chars[0]), 0)
    dense = [density(chars[i], tags[i], link_chars[i], link_tags[i], chars[body], link_chars[body]) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        if not out[i]:
            sums[tree.parent[i]] += dense[i]
    best = max(range(n), key=lambda i: (sums[i] if chars[i] else -1.0, chars[i], i))
    best = rival(tree, best, chars, sums, out, last)
    node, lowest = best, dense[best]
    while node not in (body, 0):
        node = tree.parent[node]
        lowest = min(lowest, dense[node])
    whole = tree.within(best, ("article",)) or tree.within(best, ("main",))
    if whole is not None and (whole == best or dense[whole] > dense[body] or chars[whole] == chars[body]):
        chosen = {whole}
    else:
        best = titled(tree, best, chars, link_chars, last)
        chosen = {best} | {i for i in range(1, n) if chars[i] and dense[i] >= lowest and sums[i] > 0 and not out[i] and i not in (body, 0) and tree.tag[i] != "html" and not i <= best <= last[i]}
        chosen |= {i for i in range(1, n) if tree.tag[i] in ("p", "pre", "blockquote", "h1") and chars[i] and dense[i] >= lowest and not out[i]}
    # a container beside the path to the node in which nothing is as dense as that path is none of the text
    most = [d if c else 0.0 for d, c in zip(dense, chars)]
    for i in range(n - 1, 0, -1):
        if not out[i]:
            most[tree.parent[i]] = max(most[tree.parent[i]], most[i])
    held = [0] * n
    for i in range(1, n):
        held[tree.parent[i]] += tree.tag[i] in CONTAINERS
    thin = [tree.tag[i] in CONTAINERS and not i <= best <= last[i] and most[i] < lowest and (held[i] >= MANY or tree.tag[i] == "article") for i in range(n)]
    inside = [False] * n
    for i in range(n):
        inside[i] = not out[i] and not thin[i] and (i in chosen or (i > 0 and inside[tree.parent[i]]))
    blocks: dict[int, list[str]] = {}
    for node, block, text in tree.texts:
        if inside[node]:
            blocks.setdefault(block, []).append(text)
    return "\n".join(filter(None, (" ".join("".join(x).split()) for x in blocks.values())))


def rival(tree: Tree, best: int, chars: list[int], sums: list[float], out: list[bool], last: list[int]) -> int:
    """best, or the article within it that has the largest sum of several and most of the text; the others are teasers."""
    found = [i for i in range(best + 1, last[best] + 1) if tree.tag[i] == "article" and chars[i] and not out[i]]
    if len(found) > 1:
        first = max(found, key=lambda i: (sums[i], -i))
        if 2 * chars[first] >= chars[best]:
            return first
    return best


def titled(tree: Tree, best: int, chars: list[int], link_chars: list[int], last: list[int]) -> int:
    """best, or the nearest node around it that has the page's title and little else besides; last: of each subtree."""
    titles = [i for i, tag in enumerate(tree.tag) if tag == "h1" and not best <= i <= last[best]]
    node = best
    while titles and (node := tree.parent[node]) > 0 and tree.tag[node] not in ("body", "html"):
        more, links = chars[node] - chars[best], link_chars[node] - link_chars[best]
        if more > 0.3 * chars[best] or links > 0.3 * more:
            break
        if more and any(node < i <= last[node] for i in titles):
            return node
    return best


def extract(pages: DataFrame, into: str = "_text") -> DataFrame:
    """pages with the main text of their html in the column ``into``."""
    bound_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in rows.to_pylist()], pa.string())

    return pages.select(*own(pages, into), texts("html").alias(into))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
