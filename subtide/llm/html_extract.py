"""Main text of web pages, with site templates removed.

A template is what a site repeats: every container element's subtree is hashed, hashes are counted per
host over pages that differ, and subtrees that recur on many pages of their host are deleted. Elements
that say by their name, class, id or role that they are no part of the article go as well, unless they
hold most of the page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from subtide.session import held

#: A subtree is template if it is on at least so many different pages of its host, and on at least this share of them.
MIN_PAGES = 3
MIN_SHARE = 0.3
#: On so many different pages it is template whatever its share, so that parts of a large site have their own templates.
MANY_PAGES = 10
#: Pages with templates are broadcast up to so many rows; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "caption tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form script style noscript template iframe object embed button select textarea svg canvas dialog menu head title audio video noembed noframes xmp datalist".split())
HINTS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert sidebar comment comments commentlist respond reply replies disqus newsletter subscribe subscription signup "
    "share sharing social related recommended breadcrumb breadcrumbs pagination pager menu nav navbar navigation footer "
    "popup modal overlay widget masthead topbar toolbar login search skip hidden".split()
)
#: Readers' words and hidden elements are no article however much text they hold.
READERS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: One of these is enough in a class or id, whatever it is joined with, on an element that comes after paragraphs; before them it is weighed.
READERS_ANYWHERE = READERS | frozenset("responses discussion".split())
#: But not beside these, which say what an article has.
ABOUT = frozenset("no has have with without open opened close closed enabled disabled on off count number total link".split())
#: Names of elements that go unless they hold most of the page, as a form around all of it does.
WRAPPERS = frozenset("form aside nav footer dialog menu".split())
#: What a hint may be joined with by - or _ in a class or id; other words (has-sidebar, menu-open) make it another name.
JOINED = frozenset(
    "site page main post entry article content body inner outer top bottom left right upper lower first last primary secondary global mobile desktop "
    "box bar area block section panel container wrapper wrap holder region zone unit slot module group list item items row col column columns "
    "link links button buttons icon icons form field title heading label text image posts articles stories news story products by for to in "
    "div gpt google dfp tag header bottombar dialog window menu input results media".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Containers whose subtrees are hashed; text blocks of an article (paragraphs, headings, quotes) are not.
CONTAINERS = frozenset("nav ul ol dl div section aside footer header table form menu details figure fieldset center".split())
#: A start tag of the key's kind ends an open element of these names.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tr", "td", "th"), "body": ("head",),
}
#: Implied ends look no further up than these.
SCOPES = frozenset("table ul ol dl select html body article section div aside nav main form td th".split())

TEXT_OR_COMMENT = re.compile(r"[^<]+|<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*>?|<(?![a-zA-Z/])", re.S)
TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE_VALUE = re.compile(r"[^\s>]*")
#: Headings are the article's own whatever they are called.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Hints that count inside an article too, where the element holds a small part of the page's text.
SMALL_INSIDE = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar".split())
#: Hints that count inside an article however much it is.
STRONG = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription".split())


class Node:
    """An element: its name, the hints it gives, its children (nodes and strings)."""

    __slots__ = ("name", "hinted", "children")

    def __init__(self, name: str, hinted: int):
        self.name, self.hinted, self.children = name, hinted, []


def _hinted(name: str, attributes: list[tuple[str, str]], after: bool) -> int:
    """How much the element says that it is no part of the article: 4 for readers' words and hidden elements, 3 for STRONG hints, 2 for SMALL_INSIDE, 1 for others, else 0; ``after`` paragraphs readers' words needn't stand alone."""
    hint = 0
    for key, value in attributes:
        value = value.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return 4
        if key == "role" and value in ROLES:
            hint = max(hint, 1)
        if key in ("class", "id") and name not in HEADINGS:
            for word in value.split():
                parts = [x for x in re.split(r"[_-]+", word) if x and not x.isdigit()]
                if not READERS_ANYWHERE.isdisjoint(parts) and ABOUT.isdisjoint(parts):
                    if after:
                        return 4
                    hint = max(hint, 1)
                if not HINTS.isdisjoint(parts) and all(x in HINTS or x in JOINED for x in parts):
                    if not READERS.isdisjoint(parts):
                        return 4
                    hint = max(hint, 3 if not STRONG.isdisjoint(parts) else 2 if not SMALL_INSIDE.isdisjoint(parts) else 1)
    return hint


def _goes(node: Node, inside: bool) -> bool:
    """The element is no main text by its name or hints; ``inside`` an article weak hints don't count."""
    return node.name in DROPPED or node.hinted > int(inside) and node.name != "body" or node.name == "header" and not inside


def _unhint(root: Node) -> None:
    """Takes the hint, or the name of a wrapper, from elements that hold most of the page's text and of its paragraphs, unless its articles are elsewhere.

    A SMALL_INSIDE hint is weak on an element with more than a quarter of the text.
    """
    nodes, up, within = [root], [0], [0]
    text, paragraphs, articles = [0], [0], [0]
    i, hints = 0, []
    while i < len(nodes):
        for child in nodes[i].children:
            if isinstance(child, str):
                n = len(child.strip())
                text[i] += n
                if within[i]:
                    paragraphs[i] += n
                    if within[i] == 2:
                        articles[i] += n
            elif (child.name not in DROPPED or child.name in WRAPPERS) and child.hinted != 4:
                if child.hinted or child.name in WRAPPERS:
                    hints.append(len(nodes))
                nodes.append(child)
                up.append(i)
                within.append(2 if child.name in ("article", "main") else max(within[i], int(child.name == "p")))
                for sums in (text, paragraphs, articles):
                    sums.append(0)
        i += 1
    if not hints:
        return
    for i in range(len(nodes) - 1, 0, -1):
        for sums in (text, paragraphs, articles):
            sums[up[i]] += sums[i]
    for i in hints:
        if 2 * text[i] > text[0] and 2 * paragraphs[i] > paragraphs[0] and (articles[i] or not articles[0]):
            nodes[i].hinted = 0
            if nodes[i].name in WRAPPERS:
                nodes[i].name = "div"
        elif nodes[i].hinted == 2 and 4 * text[i] > text[0]:
            nodes[i].hinted = 1


class _Open:
    """The open elements, and where those of each name, and scopes, are among them; every question takes constant time."""

    def __init__(self, root: Node):
        self.stack, self.places, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack.pop().name
            self.places[name].pop()
            if name in SCOPES:
                self.scopes.pop()

    def close(self, name: str) -> None:
        """An end tag: ends the innermost open element of the name, if there is one."""
        if self.places.get(name):
            self.cut(self.places[name][-1])

    def end(self, names: tuple[str, ...]) -> None:
        """Ends open elements of ``names`` from the innermost on, unless a scope lies between."""
        while True:
            depth = max((self.places[n][-1] for n in names if self.places.get(n)), default=0)
            if not depth or self.scopes and self.scopes[-1] > depth:
                return
            self.cut(depth)


def _attributes(text: str, at: int, last: dict[str, int]) -> tuple[int, list[tuple[str, str]], bool]:
    """Where the tag whose name ends at ``at`` ends, its attributes, and whether it closes itself. ``last``: the last place of either quote.

    A quote opens a value only after an equals sign, and only if the page has another one to close it. A
    tag without an end reaches to the page's end.
    """
    out = []
    while True:
        at = GAP.match(text, at).end()
        if at >= len(text):
            return at, out, False
        if text[at] == ">":
            return at + 1, out, text[at - 1] == "/"
        name = ATTRIBUTE_NAME.match(text, at)
        at, value = name.end(), ""
        equals = EQUALS.match(text, at)
        if equals:
            at = equals.end()
            quote = text[at : at + 1]
            if at < last.get(quote, -1):
                end = text.find(quote, at + 1)
                value, at = text[at + 1 : end], end + 1
            else:
                bare = BARE_VALUE.match(text, at)
                value, at = bare[0], bare.end()
        out.append((name[0].lower(), html.unescape(value)))


def parse(text: str) -> Node:
    """The page as a tree, with the usual repairs: void and raw elements, implied ends, stray end tags left out. Takes time in proportion to the page."""
    root = Node("#root", 0)
    opened, at, n = _Open(root), 0, len(text)
    after = False  # paragraphs have been seen
    last = {quote: text.rfind(quote) for quote in "\"'"}
    while at < n:
        m = TEXT_OR_COMMENT.match(text, at)
        if m:
            at = m.end()
            if text[m.start()] != "<" or m[0] == "<":
                opened.stack[-1].children.append(m[0])
                after = after or bool(opened.places.get("p")) and not m[0].isspace()
            continue
        m = TAG_NAME.match(text, at)
        if m is None:  # "</" at the page's end
            break
        is_end, name = text[at + 1] == "/", m[1].lower()
        at, attributes, closed = _attributes(text, m.end(), last)
        if is_end:
            opened.close(name)
            continue
        if name in BLOCK:
            opened.end(("p",))
        if name in CLOSES:
            opened.end(CLOSES[name])
        node = Node(name, _hinted(name, attributes, after))
        opened.stack[-1].children.append(node)
        if name in VOID or closed and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(text, at)
            if close is None:
                at = n
            else:
                at = text.find(">", close.end()) + 1 or n
            continue
        opened.push(node)
    _unhint(root)
    return root


def subtree_hashes(root: Node) -> dict[int, int]:
    """A 63-bit hash of the names and text below each container (by ``id`` of the node) that has text and no article in it."""
    out: dict[int, int] = {}
    # Each open node gathers a digest of its parts; done without recursion since pages may nest deeply.
    work: list[tuple[Node, int, list[bytes], list[bool]]] = [(root, 0, [], [False, False])]
    while work:
        node, at, parts, seen = work.pop()
        if at < len(node.children):
            work.append((node, at + 1, parts, seen))
            child = node.children[at]
            if isinstance(child, str):
                words = " ".join(child.split())
                if words:
                    parts.append(b"t" + words.encode("utf-8", "surrogatepass"))
                    seen[0] = True
            else:
                work.append((child, 0, [], [False, child.name in ("article", "main")]))
            continue
        digest = hashlib.blake2b(b"\0".join([node.name.encode("utf-8", "surrogatepass"), *parts]), digest_size=8).digest()
        if node.name in CONTAINERS and seen[0] and not seen[1]:
            out[id(node)] = int.from_bytes(digest, "big") >> 1
        if work:
            work[-1][2].append(b"e" + digest)
            work[-1][3][0] |= seen[0]
            work[-1][3][1] |= seen[1]
    return out


def _mains(root: Node, hashes: dict[int, int], template: frozenset[int] | set[int]) -> list[Node]:
    """The outermost articles, or main elements, if they hold most of the text that is left; or the page itself."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    held_by = {"article": 0, "main": 0}
    total = 0
    work: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while work:
        node, article, main = work.pop()
        if _goes(node, article or main) or hashes.get(id(node)) in template:
            continue
        if node.name == "article" and not article:
            found["article"].append(node)
            article = True
        if node.name == "main" and not main:
            found["main"].append(node)
            main = True
        own = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        total += own
        held_by["article"] += own * article
        held_by["main"] += own * main
        work.extend((x, article, main) for x in reversed(node.children) if not isinstance(x, str))
    for name, nodes in found.items():
        if 2 * held_by[name] > total:
            return nodes
    return [root]


def _walk(root: Node, template: frozenset[int] | set[int] = frozenset()) -> tuple[list[str], dict[int, tuple[int, int]]]:
    """The main text's blocks in page order, and by ``id`` of each container among them the range of its blocks."""
    hashes = subtree_hashes(root) if template else {}
    blocks: list[str] = []
    spans: dict[int, tuple[int, int]] = {}
    line: list[str] = []

    def end_block() -> None:
        words = " ".join("".join(line).split())
        if words:
            blocks.append(words)
        line.clear()

    for top in _mains(root, hashes, template):
        work: list[tuple[Node, int, int, bool]] = [(top, 0, len(blocks), top.name in ("article", "main"))]
        while work:
            node, at, first, whole = work.pop()
            if at == len(node.children):
                if node.name in BLOCK:
                    end_block()
                if node.name in CONTAINERS:
                    spans[id(node)] = (first, len(blocks))
                continue
            work.append((node, at + 1, first, whole))
            child = node.children[at]
            if isinstance(child, str):
                line.append(html.unescape(child))  # a reference ends where its text does
            elif _goes(child, whole) or hashes.get(id(child)) in template:
                if child.name in BLOCK:
                    end_block()
            elif child.name in VOID:
                if child.name == "hr":
                    end_block()
                else:
                    line.append(" " if child.name == "br" else "")
            else:
                if child.name in BLOCK:
                    end_block()
                work.append((child, 0, len(blocks), whole or child.name in ("article", "main")))
        end_block()
    return blocks, spans


def main_text(root: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text's blocks in page order, joined by a newline, without subtrees whose hash is in ``template``."""
    return "\n".join(_walk(root, template)[0])


def _kept(root: Node) -> set[int]:
    """The ``id`` of each container that neither goes by its name or hints nor lies in one that does."""
    kept, work = set(), [(root, False)]
    while work:
        node, inside = work.pop()
        if node.name != "header" and _goes(node, inside):
            continue
        if node.name in CONTAINERS:
            kept.add(id(node))
        inside = inside or node.name in ("article", "main")
        work.extend((x, inside) for x in node.children if not isinstance(x, str))
    return kept


def outside_keys(root: Node) -> dict[int, int]:
    """By hash of each subtree a 63-bit key of the main text's blocks outside it; subtree 0 is none, so its key is that of all blocks.

    Subtrees that are dropped by name are left out. Scripts, menus and adverts are no main text, so copies of an article have one key whatever stands around it.
    """
    blocks, spans = _walk(root)
    sums = [0]
    for block in blocks:
        sums.append(sums[-1] + int.from_bytes(hashlib.blake2b(block.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"))
    inside = {0: 0}
    kept = _kept(root)
    for node, subtree in subtree_hashes(root).items():
        if node not in kept:
            continue
        first, end = spans.get(node, (0, 0))
        inside[subtree] = inside.get(subtree, 0) + sums[end] - sums[first]
    return {subtree: (sums[-1] - own) & (2**63 - 1) for subtree, own in inside.items()}


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def page_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(page, template array<bigint>): the hashes of a page's subtrees that recur on its host, for pages that have any; page as in _with_page.

    Counts pages that differ in their main text outside the subtree, so copies of an article count once.
    A page gets none but its own hashes, however many its host has.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            hosts, pages_, subtrees, keys = [], [], [], []
            for host, page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = outside_keys(parse(text.as_py()))
                hosts.extend([host] * len(own))
                pages_.extend([page] * len(own))
                subtrees.extend(own)
                keys.extend(own.values())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (pages_, subtrees, keys))], names=["host", "page", "subtree", "key"])

    rows = _with_page(pages.where("html IS NOT NULL")).select("_host", "_page", "html")
    found = held(rows.mapInArrow(batches, "host string, page bigint, subtree bigint, key bigint"))
    # Subtree 0 stands for the page itself, so one count gives both numbers.
    counted = found.select("host", "subtree", "key").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    often = counted.where(F.col("n") >= min_pages)
    per_host = often.where("subtree = 0").select("host", F.col("n").alias("pages"))
    templates = often.where("subtree != 0").join(per_host, "host", "left").where((F.col("n") >= many_pages) | (F.col("n") >= F.col("pages") * min_share)).select("host", "subtree")
    return found.where("subtree != 0").join(templates, ["host", "subtree"]).groupBy("page").agg(F.collect_set("subtree").alias("template"))


def _with_page(pages: DataFrame) -> DataFrame:
    """``pages`` with _host and _page, a hash of host and html (null if there is no html)."""
    host = host_of(F.col("url"))
    return pages.select("*", host.alias("_host"), F.when(F.col("html").isNotNull(), F.xxhash64(host, "html")).alias("_page"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without main text, give an empty text. Pages of a null url share the
    empty host. Repeated rows stay repeated; other columns are not read; an empty table gives an
    empty table. Whole pages are parsed whatever their length.
    """
    pages = pages.select("page_id", "url", "html")
    templates = held(page_templates(pages, min_pages, min_share, many_pages))  # narrow: a page's hashes
    small = templates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = _with_page(pages).join(F.broadcast(templates) if small else templates, F.col("_page") == F.col("page"), "left").select("page_id", "url", "html", "template")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = [main_text(parse(h.as_py() or ""), frozenset(t.as_py() or ())) for h, t in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(batches, "page_id bigint, url string, text string, n_chars bigint")
