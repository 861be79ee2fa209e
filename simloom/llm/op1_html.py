"""HTML extraction by tree scoring.

A page is parsed into a tree. Elements that never hold article text (scripts,
navigation, forms and the like) go, as do elements whose tag, role, class or
id names them as menus, adverts, notices, sidebars or comments. Every paragraph
gives points for its length and its commas to its ancestors, divided by 1, 2, 6,
9 and 12 from level to level; an ancestor's points are discounted by its link
density. The best container is kept, with those of its siblings that score near
it, have its class, or read like running text, and with what stands between these
or is a list, table or figure next to one, unless it is mostly links. Of a header
inside the article, headings and what reads like running text stay. Inside the
article, lists and boxes of nothing but several links go, and names that are also
words of articles (share, popular, legal and the like) decide only over what is
short or full of links.

Malformed pages: a quote opens a value only after ``=`` and closes it only
before white space or the tag's end, so a stray quote costs no text; closing
tags that close nothing are passed over in constant time. White space is what
Unicode calls so.

Defined results: null or empty html, and a page without article text, give an
empty text. Nothing is cut at any length; nesting may be of any depth. Repeated
rows give repeated results. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option optgroup input label fieldset menu dialog svg math object embed applet canvas audio video map".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption option optgroup legend".split())
IMPLIED = {  # an opening tag ends an open element of these, unless one of the second set stands between
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
SCORED = frozenset("p pre td blockquote li dd figcaption".split())

# Words in class and id that name what isn't the article, and what is.
JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|adbox|banner|promo\w*|sponsor\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|topbar|toolbar|"
    r"header|masthead|site-?header|footer|site-?footer|sidebar|side|rail|widget\w*|aside|related|recommend\w*|popular|trending|"
    r"comments?|comment-?list|respond|disqus|replies|reply|discussion|notices?|cookies?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|tags?|pagination|pager|skip|legal|copyright|disclaimer|paywall|form|search)(?=$|[\s_-])",
    re.I,
)
#: Of these, words that articles use themselves.
WEAK = re.compile(r"(?:^|[\s_-])(?:share|sharing|social|popular|trending|legal|tags?|side|rail|skip|pager|search|form)(?=$|[\s_-])", re.I)
KEEP = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|page|intro|introduction|lead|lede|standfirst|summary|abstract)(?=$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"(?=\s|/?>)|=\s*'[^']*'(?=\s|/?>)|[^>])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WS = re.compile(r"\s+")


class _Node:
    __slots__ = ("doubt", "kids", "links", "name", "points", "size", "tag", "up", "weight")

    def __init__(self, tag: str, up: "_Node | None", weight: int = 0, name: str = ""):
        self.tag, self.up, self.kids, self.name = tag, up, [], name
        self.points, self.size, self.links, self.weight, self.doubt = 0.0, 0, 0, weight, False


def _unwanted(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an opening tag names something that isn't the article."""
    if tag in DROPPED:
        return True
    if tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES or name == "style" and HIDDEN.search(value):
            return True
        if name in ("class", "id") and JUNK.search(value) and not KEEP.search(JUNK.sub(" ", value)):
            return True
    return False


def _doubtful(attrs: str) -> bool:
    """Whether a junk name is one only by words that articles use themselves."""
    named = [next((v for v in values if v), "") for name, *values in ATTR.findall(attrs) if name.lower() in ("class", "id")]
    return any(WEAK.search(v) for v in named) and not any(JUNK.search(WEAK.sub(" ", v)) for v in named) and not any(name.lower() in ("hidden", "role", "style", "aria-hidden") for name, *_ in ATTR.findall(attrs))


def _class(attrs: str) -> str:
    """The class of an opening tag, empty if it has none."""
    return next((" ".join(next((v for v in values if v), "").split()) for name, *values in ATTR.findall(attrs) if name.lower() == "class"), "") if attrs else ""


def _tree(page: str) -> _Node:
    """The tree of what may be article; text stands in it as plain strings."""
    root = _Node("#root", None)
    at, end, node, skip, depth = 0, len(page), root, "", 0
    lowered, open_tags = None, Counter()

    def closed_to(top: _Node) -> _Node:
        """Where the page goes on once ``top`` and all open elements in it are closed."""
        up = node
        while up is not top.up:
            open_tags[up.tag] -= 1
            up = up.up
        return up

    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not skip:
            node.kids.append(_html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if skip:
                if tag == skip:
                    depth -= 1
                    if not depth:
                        skip = ""
                continue
            if open_tags[tag]:
                up = node
                while up.tag != tag:
                    up = up.up
                node = closed_to(up)
            continue
        if at >= end and page[-1:] != ">":
            break  # a tag cut off by the end of the page
        closed = tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW
        if skip:
            if tag in RAW and tag != skip and not closed:
                lowered = page.lower() if lowered is None else lowered
                stop = lowered.find("</" + tag, at)
                at = end if stop < 0 else stop
            elif tag == skip and not closed:
                depth += 1
            continue
        if tag in RAW:
            lowered = page.lower() if lowered is None else lowered
            stop = lowered.find("</" + tag, at)
            at = end if stop < 0 else (lowered.find(">", stop) + 1 or end)
            continue
        if tag in CLOSES_P and open_tags["p"]:
            up = node
            while up is not root and up.tag != "p" and (up.tag not in BLOCKS):
                up = up.up
            if up.tag == "p":
                node = closed_to(up)
        if tag in IMPLIED and any(open_tags[x] for x in IMPLIED[tag][0]):
            ends, walls = IMPLIED[tag]
            up, found = node, None
            while up is not root and up.tag not in walls:
                if up.tag in ends:
                    found = up
                up = up.up
            if found:
                node = closed_to(found)
        inside = bool(open_tags["article"] or open_tags["main"])
        unwanted = _unwanted(tag, m[3], inside)
        doubt = unwanted and inside and tag not in DROPPED and tag != "header" and _doubtful(m[3])
        if unwanted and not doubt:
            if not closed:
                skip, depth = tag, 1
            continue
        if tag == "br":
            node.kids.append(" ")
            continue
        kid = _Node(tag, node, 25 if tag in ("article", "main") else 25 if m[3] and KEEP.search(m[3]) else 0, _class(m[3]))
        kid.doubt = doubt
        node.kids.append(kid)
        if not closed:
            node = kid
            open_tags[tag] += 1
    return root


def _own(node: _Node) -> str:
    """The text of a node without that of blocks inside it."""
    out, stack = [], [iter(node.kids)]
    while stack:
        for kid in stack[-1]:
            if isinstance(kid, str):
                out.append(kid)
            elif kid.tag not in BLOCKS:
                stack.append(iter(kid.kids))
                break
        else:
            stack.pop()
    return WS.sub(" ", "".join(out)).strip()


def _measure(root: _Node) -> list[_Node]:
    """Text and link sizes of all nodes, and the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    for node in reversed(order):
        node.size = node.links = 0
        for kid in node.kids:
            if isinstance(kid, str):
                node.size += len(kid.strip())
            else:
                node.size += kid.size
                node.links += kid.size if kid.tag == "a" else kid.links
    return order


def _cleared(root: _Node) -> None:
    """Take out what a doubtful name and its text call junk, and boxes of nothing but several links inside an article."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        stay = []
        for kid in node.kids:
            if not isinstance(kid, str):
                if kid.doubt and (kid.size < 140 or _density(kid) >= 0.25):
                    continue
                if inside and kid.tag in ("ul", "ol", "dl", "div", "section", "table") and kid.size and kid.links == kid.size and _several_links(kid):
                    continue
                stack.append((kid, inside))
            stay.append(kid)
        node.kids = stay


def _several_links(node: _Node) -> bool:
    found, stack = 0, [node]
    while stack and found < 2:
        for kid in stack.pop().kids:
            if not isinstance(kid, str):
                found += kid.tag == "a"
                stack.append(kid)
    return found > 1


def _density(node: _Node) -> float:
    return node.links / node.size if node.size else 0.0


def _reads(node: _Node, text: str) -> bool:
    """Whether ``text``, the own text of a node, is running text: long with few links, or a sentence without any."""
    return bool(text) and (len(text) > 80 and _density(node) < 0.25 or not node.links and text[-1] in ".!?")


def _blocks(nodes: list[_Node]) -> list[str]:
    """The texts of the blocks under some nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = WS.sub(" ", "".join(run)).strip()
            run.clear()
            if text:
                out.append(text)

    for top in nodes:
        flush()
        stack: list[tuple[_Node, Iterator]] = [(top, iter(top.kids))]
        while stack:
            node, kids = stack[-1]
            for kid in kids:
                if isinstance(kid, str):
                    run.append(kid)
                else:
                    if kid.tag in BLOCKS:
                        flush()
                    stack.append((kid, iter(kid.kids)))
                    break
            else:
                stack.pop()
                if node.tag in BLOCKS:
                    flush()
        flush()
    return out


def main_text(page: str | None) -> str:
    """The article of one page: its blocks, one a line."""
    if not page:
        return ""
    root = _tree(page)
    _measure(root)
    _cleared(root)
    order = _measure(root)
    for node in order:
        if node.tag == "header":  # inside an article: its headings and running text belong to it, the rest doesn't
            node.kids = [n for n in _measure(node) if re.fullmatch("h[1-6]", n.tag) or n.tag == "p" and _reads(n, _own(n))]
    candidates: dict[int, _Node] = {}
    for node in order:
        plain = node.tag in ("div", "section", "article", "main", "body", "#root")
        if node.tag not in SCORED and not plain:
            continue
        text = _own(node)
        if not text or plain and len(text) < 25:
            continue
        if node.size and _density(node) > 0.5:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        up, level = (node if plain else node.up), 0
        while up is not None and level < 5:
            up.points += points / (1, 2, 6, 9, 12)[level]
            candidates[id(up)] = up
            up, level = up.up, level + 1
    if not candidates:  # headings or a few words only
        top = next((n for n in order if n.tag == "article"), next((n for n in order if n.tag == "main"), root))
        return "" if _density(top) > 0.5 else "\n".join(_blocks([top]))
    scored = {k: (n.points + n.weight) * (1 - _density(n)) for k, n in candidates.items()}
    best = max((n for n in order if id(n) in candidates), key=lambda n: scored[id(n)])
    while best.up is not None and best.up.tag not in ("body", "html", "#root") and sum(not isinstance(k, str) for k in best.up.kids) == 1:
        best = best.up
    up = best
    while up is not None and up.tag != "article":
        up = up.up
    best = up or best
    top, kept = scored.get(id(best), 0.0), [best]
    if best.up is not None and best.tag not in ("article", "main", "body", "html"):
        kids, kept = [k for k in best.up.kids if not isinstance(k, str)], []
        for kid in kids:
            text = _own(kid) if kid is not best else ""
            if (
                kid is best
                or scored.get(id(kid), 0.0) >= max(10.0, 0.2 * top)
                or kid.tag == "header"
                or re.fullmatch("h[1-6]", kid.tag) and text and _density(kid) < 0.5
                or best.name and kid.name == best.name and kid.tag == best.tag and kid.size and _density(kid) < 0.5
                or kid.tag in ("p", "pre", "blockquote") and _reads(kid, text)
            ):
                kept.append(kid)
        at = [i for i, kid in enumerate(kids) if any(kid is k for k in kept)]
        near = lambda i: i > 0 and i - 1 in at or i + 1 in at
        held = ("ul", "ol", "dl", "table", "figure", "figcaption")
        kept = [kid for i, kid in enumerate(kids) if i in at or kid.size and (at[0] < i < at[-1] and _density(kid) <= 0.5 or kid.tag in held and near(i) and _density(kid) < 0.25)]
    return "\n".join(_blocks(kept))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in column ``text``."""
    keep = [f for f in pages.schema.fields if f.name not in (html, text)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([main_text(x.as_py()) for x in batch.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), out], [*(f.name for f in keep), text])

    return pages.select(*(f"`{f.name}`" for f in keep), html).mapInArrow(run, schema)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
