"""Main text of web pages by site style trees (operator 7).

The pages of one host are merged into a style tree: a style node is the way of tags and classes
from the root. A node's content importance is one minus the mean entropy of its texts over the
host's pages, in units of the entropy of a text that all pages share: what every page repeats has
none, what one page says has all. Its presentation importance is the entropy of the sequences
of children it has on different pages. Both together, weighed by what tags and classes say
about the node, are its importance; branches of low importance leave each page, and the
blocks that stay are its text. The fewer pages show a node, the more its tags and classes count: what
is beside the main part needs several pages to be kept, what is in it several to be removed.

A page is parsed once, in the task that reads it, into blocks of text and a few hashes for the
tree. Trees are built by aggregates with a map-side part, so that a host with a third of
all pages sends few rows. Pages of one host with the same nodes are decided alike, so that decisions are
a small table, and texts stay where they are if Spark can broadcast it.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.llm.common import slices, strings
from pagetrawl.session import settle

#: Branches of a lower importance are removed.
LEAST_IMPORTANCE = 0.3
#: Share of the content importance; the rest is the presentation's.
CONTENT_SHARE = 0.9
CHROME, OUTSIDE, NAMED, OPEN, MAIN = range(5)
#: Weight of a node by its role, and the importance that it has for its role alone, before several pages show it.
WEIGHTS = {CHROME: (0.25, 0.0), OUTSIDE: (0.5, 0.0), NAMED: (0.5, 0.0), OPEN: (1.0, None), MAIN: (1.0, 1.0)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "video", "audio", "canvas"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: Elements that are no content by their meaning, and those that weigh like a name.
_CHROME_TAGS = {"nav", "footer", "aside", "menu", "head", "button", "select", "dialog"}
_NAMED_TAGS = {"header", "form"}
_NAMES = (
    r"(?:ad|ads|adv|advert|advertisement|adsense|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"header|masthead|footer|sidebar|side|cookie|cookies|consent|gdpr|notice|alert|comment|comments|reply|replies|disqus|respond|share|"
    r"sharing|social|related|recommended|newsletter|subscribe|signup|login|search|popup|modal|widget|pagination|pager|toolbar|skip|"
    r"contentinfo|complementary)s?"
)
_CHROME_NAMES, _WHOLE_NAMES = re.compile(rf"(?:^|[\s_-]){_NAMES}(?:$|[\s_-])"), re.compile(rf"(?:^|\s){_NAMES}(?:$|\s)")
#: Names that tell what an element has or allows, not what it is.
_STATES = re.compile(r"(?:^|(?<=\s))(?:(?:has|have|with|without|no|is|not)[_-]\S*|\S*[_-](?:open|opened|closed|enabled|disabled|on|off))(?=\s|$)")
#: Elements that no name marks.
_UNMARKED = {"html", "body", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Tags whose start closes an open one of the second set.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPES = {"ul", "ol", "dl", "table", "html", "body", "article", "main", "section", "div", "td", "th"}


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


class Node:
    """An element: its tag, its way from the root as a hash, the element around it, its mark, and its children so far.

    ``mark`` is CHROME or NAMED for what its tag or names say, MAIN for a main part, or OPEN. The role follows once the
    page is read, since an element that turns out to hold the main part loses its mark.
    """

    __slots__ = ("tag", "way", "above", "mark", "in_main", "role", "children")

    def __init__(self, tag, way, above, mark):
        self.tag, self.way, self.above, self.mark, self.role, self.children = tag, way, above, mark, OPEN, 0
        self.in_main = above is not None and (above.in_main or above.mark == MAIN)


def _mark(tag: str, names: str, in_main: bool) -> int:
    if tag in _CHROME_TAGS:
        return CHROME
    is_main = tag in ("article", "main") or "main" in names.split() and tag not in _UNMARKED
    if names and tag not in _UNMARKED and (_WHOLE_NAMES if is_main else _CHROME_NAMES).search(_STATES.sub(" ", names)):
        return NAMED
    return MAIN if is_main else NAMED if tag in _NAMED_TAGS and not (tag == "header" and in_main) else OPEN


def _roles(made: list[Node]) -> None:
    """Settles the roles of all elements, each after the one around it."""
    for node in made:
        above = node.above.role if node.above else OPEN
        if above == CHROME or node.mark == CHROME:
            node.role = CHROME
        elif above == NAMED or node.mark == NAMED:
            node.role = NAMED
        else:
            node.role = MAIN if node.mark == MAIN else above
    if any(node.role == MAIN for node in made):  # what is beside the main part, and what is marked there as well
        for node in made:
            if not node.in_main and node.mark != MAIN:
                node.role = {OPEN: OUTSIDE, NAMED: CHROME}.get(node.role, node.role)


def parse(page: str) -> tuple[list, list]:
    """Blocks ``(way, role, text)`` in page order, and hashes ``(way, role, kind, feature)`` for the style tree.

    Kind 0 is a text of the node, kind 1 its sequence of children, kind 2 tells that it has a text. Inline tags belong to their
    block, ``br`` is white space in it. Elements that were left open end with the one around them.
    """
    stack, blocks, parts = [Node("", 0, None, OPEN)], [], []
    made, at, end = [stack[0]], 0, len(page)

    def close_block():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append((stack[-1], text))

    def pop_to(depth):
        close_block()
        del stack[depth:]

    while at < end:
        start = page.find("<", at)
        if start < 0:
            parts.append(entities.unescape(page[at:]))
            break
        if start > at:
            parts.append(entities.unescape(page[at:start]))
        token = _TOKEN.match(page, start)
        if token is None:
            parts.append("<")
            at = start + 1
            continue
        at = token.end()
        tag = token[2] or token[5]
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), token[1] or token[4], token[3] or token[6] or ""
        if closing:
            if tag in _INLINE:
                tag = "/" + tag
            elif tag == "p" or tag == "br":
                close_block()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
            continue
        if tag in _VOID:
            if tag == "hr":
                close_block()
            parts.append(" ")
            continue
        if tag in _RAW:
            if not rest.rstrip().endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = (page.find(">", shut.end()) + 1 or end) if shut else end if tag in ("script", "style", "textarea", "title") else at
            continue
        names = ""
        if "=" in rest:
            found = [(k.lower(), a or b or c) for k, a, b, c in _NAMED.findall(rest)]
            names = re.sub(r"\d+", "", " ".join(v for _, v in found).lower())
        if tag in _INLINE:
            if not names or _mark("", names, False) != NAMED:
                continue
            tag = "/" + tag  # an inline element that its class marks as no content
        elif "/" + tag not in _VOID:
            if stack[-1].tag == "p" or any(n.tag == "p" for n in stack[-3:]):
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"), 0)
                if depth:
                    pop_to(depth)
            if tag in _CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in _CLOSES[tag]:
                        pop_to(depth)
                        break
                    if stack[depth].tag in _SCOPES - _CLOSES[tag]:
                        break
        close_block()
        above = stack[-1]
        label = f"{tag} {names}"
        above.children = (above.children * 31 + _hash(label)) & 0x7FFFFFFF
        mark = _mark(tag, names, above.in_main or above.mark == MAIN)
        node = Node(tag, (above.way * 1_000_003 + _hash(label)) & 0x7FFFFFFFFFFFFFFF, above, mark)
        if mark == MAIN and not node.in_main:
            # what holds the main part is not marked by its names
            while above is not None:
                if above.mark == NAMED:
                    above.mark = OPEN
                above = above.above
        made.append(node)
        stack.append(node)
    close_block()
    _roles(made)
    nodes = {(node.way, node.role, 1, node.children) for node in made[1:]}
    blocks = [(node.way, node.role, text) for node, text in blocks]
    nodes |= {(way, role, 0, _hash(text)) for way, role, text in blocks} | {(way, role, 2, 0) for way, role, _ in blocks}
    return blocks, sorted(nodes)


#: Roles whose nodes can stay.
POSSIBLE = tuple(role for role, (weight, alone) in WEIGHTS.items() if max(weight, alone or 0) >= LEAST_IMPORTANCE)
_BLOCK = pa.struct([("way", pa.int64()), ("role", pa.int32()), ("text", pa.string())])
_NODE = pa.struct([("way", pa.int64()), ("role", pa.int32()), ("kind", pa.int32()), ("feature", pa.int64())])


def _parsed(batches):
    for batch in slices(batches, 64):
        found = [parse(h) for h in strings(batch.column(2))]
        blocks = pa.array([[dict(zip(("way", "role", "text"), b)) for b in bs if b[1] in POSSIBLE] for bs, _ in found], pa.list_(_BLOCK))
        nodes = pa.array([[dict(zip(("way", "role", "kind", "feature"), n)) for n in ns if n[1] in POSSIBLE] for _, ns in found], pa.list_(_NODE))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blocks, nodes], ["page_id", "url", "blocks", "nodes"])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Pages as blocks and nodes that can stay, each with its host and a hash of the nodes of its blocks (``shape``); settled."""
    schema = (
        "page_id long, url string, blocks array<struct<way:long,role:int,text:string>>, "
        "nodes array<struct<way:long,role:int,kind:int,feature:long>>"
    )
    found = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(_parsed, schema)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    shape = F.xxhash64(F.transform(F.filter("nodes", lambda n: n["kind"] == 2), lambda n: F.struct(n["way"], n["role"])))
    return settle(found.withColumns({"host": host, "shape": shape}), "parsed-pages")


def importance(parsed: DataFrame) -> DataFrame:
    """Of each style node of each host: host, way, role, pages, importance. Pages of equal nodes are copies and count once."""
    once = parsed.select("host", "nodes", F.xxhash64("nodes").alias("copy")).dropDuplicates(["host", "copy"])
    node = once.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    shared = node.groupBy("host", "way", "role", "kind", "feature").agg(F.count("*").alias("n"))
    # n pages share a feature: its entropy over m pages is log n in units of log m, at first summed as n * log n
    pages = parsed.select("host", F.xxhash64("nodes").alias("copy")).distinct().groupBy("host").agg(F.count("*").alias("m"))
    sums = shared.groupBy("host", "way", "role").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("repeated"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("alike"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("shown"),
        F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(1)).alias("told"),
    )
    unit = F.log(F.greatest("m", F.lit(2)))
    content = 1 - F.col("repeated") / F.col("texts") / unit
    shape = F.coalesce((F.log("shown") - F.col("alike") / F.col("shown")) / unit, F.lit(0.0))
    both = F.coalesce(CONTENT_SHARE * content + (1 - CONTENT_SHARE) * shape, shape)
    weight, alone = (F.element_at(F.create_map(*[F.lit(x).cast("double") if i % 2 else F.lit(x) for i, x in enumerate(e)]), F.col("role"))
                     for e in ([x for k, w in WEIGHTS.items() for x in (k, w[j])] for j in (0, 1)))
    weighed = F.coalesce(alone / F.col("told") + (1 - 1 / F.col("told")) * weight * both, weight * both)
    return sums.join(pages, "host").select("host", "way", "role", F.col("m").alias("pages"), weighed.alias("importance"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Pages without a host form one tree; a host with one page loses only what tags and classes mark. Null and
    empty pages, and pages of which nothing stays, have an empty text. Repeated rows are all kept, and
    count as one page of the tree; where the host repeats all of a page's main part, the page is a copy and keeps it. Elements
    may be nested and left open to any depth. Other columns are ignored.
    """
    parsed = parsed_pages(pages)
    low = importance(parsed).where(F.col("importance") < LEAST_IMPORTANCE).select("host", "way", "role", F.lit(True).alias("low"))
    shapes = parsed.select("host", "shape", "nodes").dropDuplicates(["host", "shape"])
    own = shapes.select("host", "shape", F.explode(F.filter("nodes", lambda n: n["kind"] == 2)).alias("n")).select("host", "shape", "n.way", "n.role")
    is_main = F.col("role") == MAIN
    cut = own.join(low, ["host", "way", "role"], "left").groupBy("host", "shape").agg(
        F.collect_set(F.when(F.col("low"), F.struct("way", "role"))).alias("cut"),
        F.coalesce(F.bool_or(is_main & F.col("low").isNull()), F.lit(False)).alias("keeps_main"),
    ).where(F.size("cut") > 0)
    cut = cut.select("host", "shape", F.filter("cut", lambda c: F.col("keeps_main") | (c["role"] != MAIN)).alias("cut"))
    cut = settle(cut.where(F.size("cut") > 0), "cut-nodes")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("cut", F.struct(b["way"].alias("way"), b["role"].alias("role"))), F.lit(False)))
    found = parsed.select("page_id", "url", "host", "shape", "blocks").join(cut, ["host", "shape"], "left").select("page_id", "url", kept.alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
