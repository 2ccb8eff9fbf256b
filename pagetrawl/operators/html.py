"""Pages to node trees: the one step whose body is Python.

Each page becomes one row holding its elements as an array in document order.
An element's subtree is a contiguous slice of that array and a parent is an
index into it, so every selector (see ``select.py``) is a narrow expression on
the row: no element is shuffled, and no join looks for parents.
"""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrawl.session import page_batches

# the parser travels with the plan: workers need no copy of this package
register_pickle_by_value(sys.modules[__name__])

NODE = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("parent", T.IntegerType(), False),  # -1 at the root
        T.StructField("last", T.IntegerType(), False),  # id of the last descendant, or own id
        T.StructField("tag", T.StringType(), False),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("text", T.StringType()),  # text before the first child, null if none
    ]
)

# Fixed values of the HTML syntax: elements without content, ...
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# ... elements whose start ends an open paragraph, ...
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
# ... and, per element, the open siblings its start ends and where that search stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
# An open paragraph is not looked for beyond these.
BARRIER = frozenset({"table", "td", "th"})
# Fixed values, the end-tag priorities of libxml2's public HTML parser (others: 100). An end tag is
# ignored when it would close an element of higher rank on the way.
RANK = {
    "div": 150,
    "td": 160,
    "th": 160,
    "tr": 170,
    "thead": 180,
    "tbody": 180,
    "tfoot": 180,
    "table": 190,
    "head": 200,
    "body": 200,
    "html": 220,
}
# Parsed pages are handed back to Spark once their HTML adds up to this many characters, or their elements to this many.
FLUSH_CHARS = 250_000
FLUSH_NODES = 10_000


class _Tree(HTMLParser):
    """Collects the elements of one page after another as flat columns."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.clear()

    def clear(self):
        self.page_ends = [0]
        self.parent, self.last, self.tag, self.text, self.attrs = [], [], [], [], []

    def add_page(self, source):
        self.reset()
        self.base = len(self.tag)
        self.open = []  # ids of the open elements, outermost first
        self.fresh = False  # whether text still is leading text of the innermost one
        self.feed(source)
        self.close()
        self._close_from(0)
        self.page_ends.append(len(self.tag))

    def _close_from(self, depth):
        last = len(self.tag) - self.base - 1
        for i in self.open[depth:]:
            self.last[self.base + i] = last
        del self.open[depth:]
        self.fresh = False

    def _depth_of(self, tags, stops):
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.tag[self.base + self.open[depth]]
            if tag in tags:
                return depth
            if tag in stops:
                break
        return None

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            depth = self._depth_of(*ENDS[tag])
            if depth is not None:
                self._close_from(depth)
        elif tag in ENDS_P:
            depth = self._depth_of(("p",), BARRIER)
            if depth is not None:
                self._close_from(depth)
        i = len(self.tag) - self.base
        self.parent.append(self.open[-1] if self.open else -1)
        self.last.append(i)
        self.tag.append(tag)
        self.text.append(None)
        # the first of two equal attributes counts
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.fresh = False
        if tag not in VOID:
            self.open.append(i)
            self.fresh = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        rank = RANK.get(tag, 100)
        for depth in range(len(self.open) - 1, -1, -1):
            open_tag = self.tag[self.base + self.open[depth]]
            if open_tag == tag:
                self._close_from(depth)
                return
            if RANK.get(open_tag, 100) > rank:
                return

    def handle_data(self, data):
        if self.fresh and self.open:
            i = self.base + self.open[-1]
            self.text[i] = data if self.text[i] is None else self.text[i] + data

    def handle_comment(self, data):
        self.fresh = False

    handle_pi = handle_comment

    def nodes(self, valid) -> pa.Array:
        """The collected pages as ``array<struct>``; null where ``valid`` is false."""
        ids = [i for lo, hi in zip(self.page_ends, self.page_ends[1:]) for i in range(hi - lo)]
        struct = pa.StructArray.from_arrays(
            [
                pa.array(ids, pa.int32()),
                pa.array(self.parent, pa.int32()),
                pa.array(self.last, pa.int32()),
                pa.array(self.tag, pa.string()),
                pa.array([list(a.items()) for a in self.attrs], pa.map_(pa.string(), pa.string())),
                pa.array(self.text, pa.string()),
            ],
            names=NODE.names,
        )
        ends = pa.array(self.page_ends, pa.int32())
        return pa.ListArray.from_arrays(ends, struct, mask=pa.array([not v for v in valid]))


def _parse(batches):
    """Replace column ``html`` (the last one) by the page's nodes."""
    tree = _Tree()
    for batch in batches:
        rest = pa.Table.from_batches([batch.select(batch.schema.names[:-1])])
        html = batch.column(batch.num_columns - 1)
        start, size, valid = 0, 0, []
        for row in range(batch.num_rows):
            source = html[row].as_py()
            tree.add_page(source or "")
            valid.append(source is not None)
            size += len(source or "")
            if size >= FLUSH_CHARS or len(tree.tag) >= FLUSH_NODES or row == batch.num_rows - 1:
                part = rest.slice(start, len(valid)).append_column("nodes", tree.nodes(valid))
                yield from part.combine_chunks().to_batches()
                tree.clear()
                start, size, valid = row + 1, 0, []


def html_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Parse every page once: column ``html`` becomes ``nodes``, the rest stays.

    Select what is needed beforehand; all other columns travel along.
    """
    page_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c != html]
    fields = [pages.schema[c] for c in rest]
    schema = T.StructType([*fields, T.StructField("nodes", T.ArrayType(NODE, False))])
    return pages.select(*rest, html).mapInArrow(_parse, schema)


#: Element rows handed back to Spark at a time.
ROWS_OUT = 2_048


def _element_rows(batches):
    """Each element of each page as a row; its ancestors come from a stack of open elements.

    Elements are in document order and ``last`` is an element's last descendant, so an element's
    ancestors are the stacked ones whose ``last`` reaches it: one push and at most one pop per
    element, and the work is the size of what is written, not the square of a page.
    """
    names = ("key", "node_id", "parent_id", "last", "depth", "tag", "attrs", "text", "path", "anc")
    out = {n: [] for n in names}

    def flush(schema):
        batch = pa.RecordBatch.from_arrays([pa.array(out[n], f.type) for n, f in zip(names, schema)], schema=schema)
        for n in names:
            out[n] = []
        return batch

    schema = None
    for batch in batches:
        if schema is None:
            schema = pa.schema([batch.schema.field(0), *[f for f in _ROW_SCHEMA]])
        keys, pages = batch.column(0).to_pylist(), batch.column(1)
        for key, nodes in zip(keys, pages):
            if not nodes.is_valid:
                continue
            stack = []  # (id, last, tag, path), outermost first
            for n in nodes.values.to_pylist():
                while stack and stack[-1][1] < n["id"]:
                    stack.pop()
                path = f"{stack[-1][3]}/{n['tag']}" if stack else n["tag"]
                for name, value in (
                    ("key", key), ("node_id", n["id"]), ("parent_id", n["parent"]), ("last", n["last"]), ("depth", len(stack)),
                    ("tag", n["tag"]), ("attrs", n["attrs"]), ("text", n["text"]), ("path", path), ("anc", [a[0] for a in stack]),
                ):
                    out[name].append(value)
                stack.append((n["id"], n["last"], n["tag"], path))
                if len(out["key"]) >= ROWS_OUT:
                    yield flush(schema)
    if schema is not None:
        yield flush(schema)


def _row_schema() -> list:
    return [
        pa.field("node_id", pa.int32()), pa.field("parent_id", pa.int32()), pa.field("last", pa.int32()),
        pa.field("depth", pa.int32()), pa.field("tag", pa.string()), pa.field("attrs", pa.map_(pa.string(), pa.string())),
        pa.field("text", pa.string()), pa.field("path", pa.string()), pa.field("anc", pa.list_(pa.int32())),
    ]


_ROW_SCHEMA = _row_schema()


def node_rows(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per element: the tree of :func:`html_nodes` as a plain table.

    Adds ``depth``, ``path`` (tags from the root, ``/``-joined) and ``anc`` (ancestor ids,
    outermost first), found in one pass over each page with a stack of open elements.
    Pages without nodes (null HTML) give no rows.
    """
    page_batches(parsed.sparkSession)
    field = parsed.schema[key]
    plain = [("node_id", T.IntegerType()), ("parent_id", T.IntegerType()), ("last", T.IntegerType()), ("depth", T.IntegerType()), ("tag", T.StringType())]
    schema = T.StructType(
        [T.StructField(key, field.dataType, field.nullable), *[T.StructField(n, t) for n, t in plain]]
        + [
            T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
            T.StructField("text", T.StringType()),
            T.StructField("path", T.StringType()),
            T.StructField("anc", T.ArrayType(T.IntegerType())),
        ]
    )
    found = parsed.select(key, "nodes").mapInArrow(_element_rows, schema)
    return found.select(key, "node_id", "parent_id", "last", "depth", "tag", "attrs", "text", "path", "anc")
