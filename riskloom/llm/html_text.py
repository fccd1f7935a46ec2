"""Main text of web pages by composite text density.

Every page is read into a small tree. What is never article text goes first: scripts, styles, forms and
the like, and elements whose tag, role, class or id names them as menu, header, footer, sidebar, notice,
advert or comments. A name or a form may also stand around the whole page: such an element stays if the
densest subtree is in it and what is outside does not look like the article. Of the rest each node gets its density: characters for each tag, lowered by the share
of them that stands in links. The densities of a node's children add up to its density sum; the subtree
with the largest sum is the article. The threshold is the smallest density on the path from it up to the
body. On pages without an article or main element every node below the body is held against it, and of each
that reaches it the descendant of the largest density sum belongs to the article as well; an article or main
element is taken whole, with neighbours of its tag that reach the threshold.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {k: frozenset(v.split()) for k, v in {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr", "td": "td th", "th": "td th"}.items()}
BLOCKS = CLOSES_P | frozenset("body html td th tr li dd dt".split())
P, LISTS = frozenset(("p",)), frozenset("ul ol dl table select".split())
SCOPES = frozenset("html body table ul ol dl div section article main aside nav td th blockquote form".split())

DROPPED_TAGS = frozenset(
    "head script style noscript template iframe object embed svg math canvas nav footer aside button select option input "
    "textarea label menu dialog audio video map noembed noframes xmp".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?<!with[_-])(?<!has[_-])(?<!no[_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|breadcrumb|breadcrumbs|comment|comments|"
    r"commentlist|consent|cookie|cookies|disqus|foot|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|"
    r"notification|overlay|pager|pagination|popup|promo|promoted|promotion|related|replies|reply|respond|share|sharing|sidebar|"
    r"sitenav|skip|social|sponsor|sponsored|subscribe|subscription|toolbar|topbar|widget|widgets)(?=$|[\s_-])(?![_-](?:open|closed|free))",
    re.IGNORECASE,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:site|page|top|main|global)?[_-]?header(?=$|\s)", re.IGNORECASE)
#: Names of what may be longer than the article, which a whole page is rarely wrapped in.
ASIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|advertising|adsense|comments?|commentlist|consent|cookies?|disqus|gdpr|modal|newsletter|notice|notification|"
    r"overlay|popup|promo\w*|related|replies|reply|respond|sponsor\w*|subscribe|subscription)(?=$|[\s_-])", re.IGNORECASE)
ARTICLE_NAMES = frozenset("comment comment-body comments reply ad advert promo related".split())
KEPT_TAGS = frozenset("html body article main".split())
NAMED = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|(?<==)\s*\"[^\"]*+\"|(?<==)\s*'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
READ = frozenset("class id role hidden aria-hidden".split())
STANDS, ASIDE, WRAPS = "stands", "aside", "wraps"
SCRAP_CHARS, SCRAP_SHARE = 100, 0.2
BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "children", "dropped", "doubt", "parent", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped, self.children = tag, parent, dropped, []
        self.doubt = ""
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def drop(tag: str, attributes: str, inside: Node) -> str:
    """STANDS for what always goes, ASIDE or WRAPS for what goes by name or as a form unless it holds the article, else empty."""
    if tag in DROPPED_TAGS:
        return STANDS
    found = {}
    if attributes:
        for k, a, b, c in ATTRIBUTE.findall(attributes):
            if (k := k.lower()) in READ:
                found.setdefault(k, a or b or c)
    if tag in KEPT_TAGS:
        return STANDS if tag == "article" and not ARTICLE_NAMES.isdisjoint(found.get("class", "").lower().split()) else ""
    if tag == "header":  # the header of an article holds its title
        while inside is not None:
            if inside.tag in ("article", "main"):
                return ""
            inside = inside.parent
        return STANDS
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in DROPPED_ROLES:
        return STANDS
    names = [found[k] for k in ("class", "id") if found.get(k)]
    if any(DROPPED_NAMES.search(x) or HEADER_NAMES.search(x) for x in names):
        return ASIDE if any(map(ASIDE_NAMES.search, names)) else WRAPS
    return WRAPS if tag == "form" else ""


def parse(page: str) -> Node:
    """A tree of elements and texts. Unclosed and stray tags are mended the way browsers mostly do."""
    top = at = Node("", None, False)
    opened: Counter[str] = Counter()
    place, end = 0, len(page)

    def leave(upto: Node) -> Node:
        """Close everything from the current element up to and with `upto`."""
        node = at
        while True:
            opened[node.tag] -= 1
            if node is upto:
                return node.parent
            node = node.parent

    def nearest(tags: frozenset[str], stops: frozenset[str]) -> Node | None:
        if not any(opened[t] for t in tags):
            return None
        node = at
        while node is not None and node.tag not in tags:
            if node.tag in stops:
                return None
            node = node.parent
        return node

    while place < end:
        token = TOKEN.search(page, place)
        if token is None:
            at.children.append(page[place:])
            break
        if token.start() > place:
            at.children.append(page[place : token.start()])
        place = token.end()
        if token[2] is None:
            continue
        tag, attributes = token[2].lower(), token[3]
        if token[1]:
            # an inline end tag closes nothing around its block
            node = nearest(frozenset((tag,)), BLOCKS if tag in INLINE else frozenset())
            at = leave(node) if node else at
            continue
        if tag in CLOSES_P and (node := nearest(P, SCOPES)):
            at = leave(node)
        if tag in SIBLINGS and (node := nearest(SIBLINGS[tag], LISTS)):
            at = leave(node)
        why = STANDS if at.dropped else drop(tag, attributes, at)
        node = Node(tag, at, why == STANDS)
        node.doubt = why if why != STANDS else ""
        at.children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in CLOSES_P:
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(page, place)
            node.dropped = True
            place = page.find(">", close.start()) + 1 if close else end
            place = place or end
            continue
        opened[tag] += 1
        at = node
    return top


def measure(top: Node) -> list[Node]:
    """Nodes in page order, with characters, link characters, tags, density and density sum; dropped ones left out."""
    order, stack = [], [(top, False)]
    while stack:
        node, linked = stack.pop()
        order.append((node, linked))
        node.chars = node.links = node.tags = node.link_tags = 0
        node.density = 0.0
        stack += [(c, linked or c.tag == "a") for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    for node, linked in reversed(order):
        own = sum(len(BLANK.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        node.chars += own
        node.links += own if linked else 0
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.tags += node.tags + (node.tag not in INLINE or node.tag == "a")
            node.parent.link_tags += node.link_tags + (node.tag == "a")
    share = top.links / top.chars if top.chars else 0.0
    for node, _ in order:
        if node.chars:
            tags, link_tags = max(1, node.tags), max(1, node.link_tags)
            base = 1 + math.log(node.chars / max(1, node.chars - node.links) * node.links + share * node.chars + math.e)
            node.density = node.chars / tags * math.log(1 + node.chars / max(1, node.links) * tags / link_tags, base)
    for node, _ in order:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped and c.tag not in INLINE)
    return [n for n, _ in order]


def settled(top: Node) -> list[Node]:
    """measure(top) after every drop by name or form is decided: lifted around the article, else done."""
    nodes = measure(top)
    if not any(n.doubt for n in nodes):
        return nodes
    while True:
        best = max(reversed(nodes), key=lambda n: n.total)
        node, around = best, None
        while node is not None:
            around = node if node.doubt else around
            node = node.parent
        if around is None:  # plain text in an element counts for its parent
            around = next((c for c in best.children if isinstance(c, Node) and c.doubt and not c.dropped and c.density > best.total / 2), None)
        if best.total <= 0 or around is None:
            break
        if wraps(around, nodes):
            around.doubt = ""
        else:
            around.dropped, around.doubt = True, ""
            nodes = measure(top)
    left = [n for n in nodes if n.doubt]
    for n in left:
        n.dropped = True
    return measure(top) if left else nodes


def wraps(around: Node, nodes: list[Node]) -> bool:
    """Whether the page's article is in this element: by its title or element, else as nothing like one is outside."""
    if around.links >= around.chars / 2:
        return False
    inside, gone, marked, text = set(), set(), [False, False], 0
    for n in nodes:  # parents first
        if n is around or n.parent in inside:
            inside.add(n)
        if n is not around and (n.doubt == ASIDE or n.parent in gone):
            gone.add(n)
        elif n.chars and (n.tag in NAMED or n.tag == "h1"):
            marked[n in inside] = True
    if marked[True] != marked[False]:
        return marked[True]
    out = {None}
    for n in nodes:
        if n.parent in out and not n.doubt:
            out.add(n)
            text += sum(len(BLANK.sub(" ", c).strip()) for c in n.children if isinstance(c, str)) if n.tag != "a" else 0
    scraps = SCRAP_CHARS if around.doubt == ASIDE else max(SCRAP_CHARS, SCRAP_SHARE * around.chars)
    return text < scraps


def article(top: Node) -> list[Node]:
    """The subtree of the largest density sum, with what else reaches the threshold of its path."""
    nodes = settled(top)
    best = max(nodes, key=lambda n: n.total)
    if best.total <= 0:
        return [top]
    # an article element around the best subtree is the whole of it; inside it, the densest one
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    outer = next((n for n in path if n.tag in NAMED), None)
    inner = [n for n in nodes if n.tag in NAMED and n.chars and within(n, best)] if outer is None else []
    if outer is not None:
        best = outer
    elif inner:
        best = max(inner, key=lambda n: n.chars)
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    threshold, node = best.density, best
    while node is not None and node.tag not in ("body", "html", ""):
        threshold = min(threshold, node.density)
        node = node.parent
    if best.tag not in NAMED:
        return spread(nodes, best, threshold)
    out, before = [], True
    for c in best.parent.children:
        if c is best:
            before = False
            out.append(c)
        elif isinstance(c, Node) and not c.dropped and c.chars and c.links < c.chars / 2:
            title = before and c.tag in HEADINGS
            if title or c.tag == best.tag and c.density >= threshold:
                out.append(c)
    return out


def spread(nodes: list[Node], best: Node, threshold: float) -> list[Node]:
    """The densest subtrees of all nodes below the body that reach the threshold, and titles before `best`; in page order, none inside another."""
    densest: dict[Node, Node] = {}
    for n in reversed(nodes):  # children first
        own = densest.setdefault(n, n)
        if n.parent is not None and n.tag not in INLINE:
            held = densest.get(n.parent, n.parent)
            densest[n.parent] = own if own.total >= held.total and own.total > 0 and own.total > n.parent.total else held
    kept, path, body = {best}, set(), best
    while body is not None:
        path.add(body)
        body = body.parent
    for n in nodes:
        if n in path or n.tag in INLINE or n.tag in ("html", "body", "") or not n.chars or n.links >= n.chars / 2:
            continue
        if n.density >= threshold and (d := densest[n]).links < d.chars / 2:
            kept.add(d)
    place = {n: i for i, n in enumerate(nodes)}
    for c in best.parent.children:
        if c is best:
            break
        if isinstance(c, Node) and c in place and c.tag in HEADINGS and c.links < c.chars / 2:
            kept.add(c)
    inside: set[Node] = set()
    out = []
    for n in nodes:
        if n.parent in inside or n in kept:
            inside.add(n)
            if n.parent not in inside:
                out.append(n)
    return out


def within(node: Node, top: Node) -> bool:
    while node is not None:
        if node is top:
            return True
        node = node.parent
    return False


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks in page order; white space inside a block becomes one space."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = BLANK.sub(" ", html.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    for root in roots:
        stack: list = [root]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            elif item.tag == "br":
                run.append(" ")
            elif not item.dropped:
                inner = list(reversed(item.children))
                if item.tag in INLINE:
                    stack += inner
                else:
                    flush()
                    stack += [None, *inner]
        flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(article(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    A null or empty page, and one without any text outside what is dropped, has an empty text. Broken
    markup never fails: an unclosed tag, comment or attribute runs to the end of the page. Repeated rows
    and rows with null ids stay. An empty table gives no rows; extra columns are ignored.
    """

    def read(batch: pa.RecordBatch):
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema[:2])
    return arrow_map(source, read, f"{kinds}, text string, n_chars long")
