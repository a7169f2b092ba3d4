"""Main text of web pages by tree scoring.

A page becomes a tree of its containers. Each paragraph passes points for its length and its commas to
its ancestors, fewer the further up, but in full to the nearest `article` or `main` element; a container's
points are discounted by its link density, and tags and names that speak of an article are a bonus. The
container with the most points is kept, and with it those of its siblings that score well. If it stands
in no article or main element, all that stands beside it and beside its ancestors is kept, whatever its
length, unless it consists of links.

Parts that are menus, headers, footers, sidebars, notices, adverts, forms, scripts or reader comments
go. A name tells such a part if it says nothing else (ad, share-buttons, comment-12); one that says more
(side-by-side, alert-levels) does so only outside of the best container. Names of states (has-sidebar,
comments-open beside entry) mark no such part, nor is a container one that holds an article, or nearly
all of the page's text.

Defined cases: a null or empty page, or one without text, gives the empty text; broken markup is read
leniently (unclosed and stray tags, tags in scripts and comments; once a tag runs to the page's end for a
quote that isn't closed, quotes don't count any more); of containers with equal points the first is the best;
pages of any length are read whole, in time that grows with their length; rows that repeat are kept as often
as they occur. Only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.scratch import small_batches

# HTML's element kinds, and names by which pages mark what isn't their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav aside footer form button select fieldset dialog menu object canvas audio video map datalist optgroup option head".split())
PARAGRAPH = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dt dd td th figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NEGATIVE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars side aside menu menus nav navbar navigation topnav breadcrumb breadcrumbs "
    "footer footers foot header masthead comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pager pagination hidden copyright".split()
)
POSITIVE = frozenset("article articles body content contents entry hentry main page post posts story text blog".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: Words that say nothing of a part beside where or how large it is.
GENERIC = frozenset(
    "area bar bars block body bottom box button buttons card center col column columns container content count cta desktop element form group grid holder icon icons id inline inner item items js "
    "label large left link links list mobile module news outer page panel panels placement post posts right row section single site slot small sticky sub tag text title top unit view wp wrap wrapper zone".split()
)

TAG = re.compile(r"</?[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Behind these words a name says what a container has or lacks, before those how it is.
HAVING = frozenset("has have no not with without".split())
STATES = frozenset("open opened closed enabled disabled on off active inactive visible".split())
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())

#: Siblings of an article are kept from this part of its score, and from this many points.
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
#: Others are kept up to this part of links.
MOST_LINKS = 0.25
#: A container isn't a side part if all that stands outside of such parts is shorter than this part of it.
OUTSIDE = 0.1


class Node:
    """A container: its children in order are nodes and strings; `links` counts characters in links."""

    __slots__ = ("tag", "parent", "children", "negative", "loose", "positive", "points", "chars", "links", "whole")

    def __init__(self, tag: str, parent: Node | None, negative: bool = False, positive: bool = False, loose: bool = False):
        self.tag, self.parent, self.children, self.negative, self.positive, self.loose = tag, parent, [], negative, positive, loose
        self.points, self.chars, self.links, self.whole = 0.0, 0, 0, False

    def is_article(self) -> bool:
        return self.tag in ("article", "main")


def named(value: str) -> set[str]:
    """The words of class and id names that say what a container is."""
    names = [WORD.findall(CAMEL.sub(" ", x).lower()) for x in value.split()]
    names = [w[: next((i for i, x in enumerate(w) if x in HAVING), len(w))] for w in names]
    plain = {x for w in names if w and w[-1] not in STATES for x in w}
    return plain if plain & POSITIVE else {x for w in names for x in w}


def says_no_more(value: str) -> bool:
    """Whether one of the class and id names is that of a side part and of nothing else."""
    for x in value.split():
        words = set(WORD.findall(CAMEL.sub(" ", x).lower()))
        if words & NEGATIVE and all(w in NEGATIVE or w in GENERIC or w in STATES or w.isdigit() for w in words):
            return True
    return False


def wraps(tag: str, attributes: str) -> bool:
    """Whether a container marked negative is so by its name or as a form, so that it may wrap the article all the same."""
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    words = named(given.get("class", "") + " " + given.get("id", ""))
    return not hidden and (tag == "form" or tag not in DROPPED and tag != "header" and given.get("role", "").lower() not in SIDE_ROLES - {"form"}) and not words & READERS


def marks(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """Whether a container is named as something else than the article, or as the article, and whether the former is by a name that says more."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return True, False, False
    if not attributes.strip():
        return False, tag in ("article", "main"), False
    names, words = "", set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names += " " + value
        elif name == "role" and value.lower() in SIDE_ROLES:
            return True, False, False
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, False, False
        elif name == "role" and value.lower() in ("main", "article"):
            words.add("article")
    words |= named(names)
    good = bool(words & POSITIVE) or tag in ("article", "main")
    bad = bool(words & NEGATIVE) and tag not in ("article", "main", "body", "html")
    if bad and inside_article and words & {"header", "body", "content"} and not words & (NEGATIVE - {"header"}):
        bad = False  # an article's own heading
    return bad, good, bad and not says_no_more(names)


def tag_end(page: str, i: int, quotes: bool) -> int:
    """The place of the > that closes a tag whose name ends at i, or -1; in quoted values it closes nothing."""
    while quotes:
        m = TAG_STOP.search(page, i)
        if not m or m[0] == ">":
            return m.start() if m else -1
        i = page.find(m[0][-1], m.end()) + 1
        if not i:
            return -1
    return page.find(">", i)


def tokens(page: str):
    """Texts as (text, None, None) and tags as (name, whether it closes, attributes), without comments and raw elements.

    No character is looked at more than a fixed number of times: what isn't found once isn't looked for again."""
    i, n, quotes = 0, len(page), True
    text = i
    while (i := page.find("<", i)) >= 0:
        m = TAG.match(page, i)
        if not m:
            if page.startswith("<!--", i):
                stop, size = "-->", 3
            elif page.startswith("<![CDATA[", i):
                stop, size = "]]>", 3
            elif page.startswith(("<!", "<?"), i):
                stop, size = ">", 1
            else:
                i += 1
                continue
            yield page[text:i], None, None
            end = page.find(stop, i + 2)
            i = text = end + size if end >= 0 else n
            continue
        end = tag_end(page, m.end(), quotes)
        if end < 0 and quotes:
            quotes, end = False, page.find(">", m.end())
        if end < 0:
            break  # no tag is closed any more: what is left is text
        yield page[text:i], None, None
        closing = page[i + 1] == "/"
        name, attributes = m[0][2 if closing else 1 :].lower(), page[m.end() : end]
        i = text = end + 1
        if name in RAW:
            if not closing and not (attributes.rstrip().endswith("/") and name in ("svg", "math")):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, i)
                end = page.find(">", stop.end()) if stop else -1
                i = text = end + 1 if end >= 0 else n
            continue
        yield name, closing, attributes
    yield page[text:], None, None


SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def parse(page: str) -> Node:
    """The tree of a page; inline elements leave their text where it stands."""
    root = Node("body", None)
    stack, opened, articles = [root], Counter(), 0
    link = 0  # the stack's depth where a link was opened; it ends with its container at the latest

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        opened[node.tag] += 1

    def cut(depth: int) -> None:
        nonlocal articles, link
        for x in stack[depth:]:
            opened[x.tag] -= 1
            articles -= x.is_article()
        del stack[depth:]
        if link > depth:
            link = 0

    for tag, closing, attributes in tokens(page):
        at = stack[-1]
        if closing is None:
            if tag:
                at.children.append(tag)
                if link:
                    at.links += len(tag.strip())
            continue
        if tag == "a":
            link = 0 if closing else len(stack)
        if tag in VOID:
            if not closing:
                at.children.append(" ")
                if tag == "hr" and at.tag == "p":
                    cut(len(stack) - 1)
            continue
        if tag in INLINE or tag in ("html", "body"):
            # a named inline element can still be an advert or a hidden part
            if closing or tag in ("html", "body", "a") or not attributes.strip():
                if closing and tag not in ("html", "body") and at.tag == f"~{tag}":
                    cut(len(stack) - 1)
                continue
            bad, _, loose = marks(tag, attributes, articles > 0)
            if bad:
                push(Node(f"~{tag}", at, True, loose=loose))
            continue
        if closing:
            if opened[tag]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in CLOSES_P:
            depth = len(stack) - 1
            while stack[depth].tag.startswith("~"):
                depth -= 1
            if depth and stack[depth].tag == "p":
                cut(depth)
        elif tag in SAME:
            while len(stack) > 1 and (stack[-1].tag in SAME[tag] or stack[-1].tag == "p" and any(opened[x] for x in SAME[tag])):
                cut(len(stack) - 1)
        at = stack[-1]
        bad, good, loose = marks(tag, attributes, articles > 0)
        node = Node(tag, at, bad, good, loose)
        node.whole = bad and wraps(tag, attributes)
        push(node)
        articles += node.is_article()
    return root


def own_text(node: Node) -> str:
    """Text that stands in the node itself, outside of its containers."""
    return " ".join("".join(x if isinstance(x, str) else " " for x in node.children).split())


def order_of(root: Node) -> list[Node]:
    """Kept containers, parents first, without recursion: pages may nest deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.negative:
            continue
        out.append(node)
        todo.extend(x for x in reversed(node.children) if not isinstance(x, str))
    return out


def unwrap(root: Node) -> None:
    """Containers that hold an article, or nearly all of the page's text, are no side parts whatever their name."""
    nodes, todo = [], [(root, False)]
    while todo:
        node, fixed = todo.pop()
        fixed = fixed or node.negative and not node.whole
        if not fixed:
            nodes.append(node)
            todo.extend((x, fixed) for x in reversed(node.children) if not isinstance(x, str))
    if not any(x.negative for x in nodes):
        return
    inner, held = dict.fromkeys(map(id, nodes), 0), set()
    for node in reversed(nodes):
        inner[id(node)] += max(0, len(own_text(node)) - node.links)
        if node.parent is not None:
            inner[id(node.parent)] += inner[id(node)]
            if node.tag in ("article", "main") or id(node) in held:
                held.add(id(node.parent))
    outside = sum(max(0, len(own_text(x)) - x.links) for x in order_of(root))
    for node in nodes:
        if node.negative and (id(node) in held or outside < OUTSIDE * inner[id(node)] and 2 * inner[id(node)] > inner[id(root)]):
            node.negative = False


def score(root: Node) -> list[Node]:
    """Give points; returns the kept containers."""
    unwrap(root)
    nodes = order_of(root)
    article_of: dict[int, Node | None] = {}
    for node in nodes:  # parents first
        article_of[id(node)] = node if node.is_article() else article_of.get(id(node.parent))
    for node in nodes:
        text = own_text(node)
        node.chars = len(text)
        if not text or node.tag in HEADINGS:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        points *= 1 - min(1.0, node.links / max(1, len(text)))
        # a paragraph's points go to its ancestors; text that stands in a container counts there too
        up, level = (node.parent if node.tag in PARAGRAPH and node.parent else node), 0
        nearest = article_of.get(id(up))
        if nearest is not None:
            nearest.points += points
        while up is not None and level < 6:
            if up is not nearest:
                up.points += points * (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12, 1 / 15)[level]
            level += 1
            up = up.parent
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
    for node in nodes:
        node.points *= 1 - min(1.0, node.links / max(1, node.chars))
        if node.positive:
            node.points = node.points * 1.25 + 5
    return nodes


def blocks(node: Node) -> list[str]:
    """The texts of a container's blocks in page order; a run of text between two containers is a block."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.negative and x is not node:
            if x.tag.startswith("~"):
                run.append(" ")
            else:
                flush()
        elif x.tag.startswith("~"):
            todo.extend(reversed(x.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def restore(best: Node) -> None:
    """Parts of the best container that are side parts only by a name that says more are parts of it."""
    todo = [best]
    while todo:
        node = todo.pop()
        if node is best or not node.negative or node.loose:
            node.negative = False
            todo.extend(x for x in node.children if not isinstance(x, str))


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends; empty if the page has none."""
    if not page:
        return ""
    nodes = score(parse(page))
    best = max((x for x in nodes if x.tag not in PARAGRAPH), key=lambda x: x.points, default=None)
    if best is None or nodes[0].chars == 0:
        return ""
    up = best.parent
    while up is not None and not up.is_article():
        up = up.parent
    if up is None and not best.is_article():
        restore(best)
        return "\n".join(beside(best))
    if up is not None and not best.is_article():
        # a part that scores higher than the article around it: its siblings are those within the article
        best = up
    restore(best)
    least = max(SIBLING_LEAST, SIBLING_SHARE * best.points)
    kept: list[str] = []
    for x in best.parent.children if best.parent is not None else [best]:
        if x is best:
            kept += blocks(best)
        elif isinstance(x, Node) and not x.negative and x.tag != "header":
            density = x.links / max(1, x.chars)
            if density < MOST_LINKS and (x.points >= least or x.tag == "p" and x.chars > 80):
                kept += blocks(x)
    return "\n".join(kept)


def beside(best: Node) -> list[str]:
    """The blocks of the page without side parts and without what consists of links beside a container and its ancestors."""
    at = best
    while at.parent is not None:
        up = at.parent
        inner = [x for x in up.children if not isinstance(x, str) and not x.negative]
        own, links = up.chars - sum(x.chars for x in inner), up.links - sum(x.links for x in inner)
        if links >= MOST_LINKS * max(1, own):
            up.children = [x if not isinstance(x, str) else " " for x in up.children]
        for x in inner:
            if x is not at and x.links >= MOST_LINKS * max(1, x.chars):
                x.negative = True
        at = up
    return blocks(at)


def extract(pages: DataFrame, page: str, out: str = "text") -> DataFrame:
    """Add `out`, the main text of each row's page; other columns pass through."""
    small_batches(pages.sparkSession)
    names = [c for c in pages.columns if c != page and c != out]

    def read(batches):
        for b in batches:
            texts = pa.array([main_text(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*names, out])

    df = pages.select(*names, page)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(read, f"{kinds}, `{out}` string" if kinds else f"`{out}` string")


def digest(extracted: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points."""
    return extracted.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
