"""Extraction on hand-made pages, one per selector group."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from pagetrawl.operators.extract import (
    cards,
    cover,
    extract_all,
    facet_lists,
    facets,
    gallery_images,
    gallery_link,
    pagination,
    tracklist,
)
from pagetrawl.operators.html import _Tree, html_nodes, node_rows
from pagetrawl.operators.select import anywhere, child, node_texts, select_nodes

FACET_PAGE = """
<div id="facets_style_exact"><ul>
  <li><a href="/s/1"><small>1,234</small><span class="facet_name">
 Euro House
 </span></a></li>
  <li><a href="/s/2"><small>7</small><span class="facet_name">Ambient</span></a></li>
  <li><a><small>7</small><span class="facet_name">Hard Trance</span></a></li>
  <li><a href="/s/4"><span class="facet_name">Italodance</span></a></li>
</ul></div>
<div id="facets_format_exact"><ul><li><a href="/f"><small>9</small><span class="facet_name">CD</span></a></li></ul></div>
<div id="facets_country_exact"><ul><li><a href="/c"><small>3</small><span class="facet_name">Trinidad &amp; Tobago</span></a></li></ul></div>
"""

LISTING_PAGE = """
<strong class="pagination_total">1 – 100 of 1,234</strong>
<div class="cards cards_layout_text-only">
 <div data-object-id="98792"><div class="card_body">
  <h4><span><a>Artist A</a></span><a class="search_result_title " href="/A-Moment/master/98792">Moment</a></h4>
  <p class="card_info"><a>Label L</a><span class="card_release_year">2000</span><span class="card_release_country"><b>x</b></span></p>
 </div></div>
 <div data-object-id="2"><div class="card_body"><h4><a class="search_result_title" href="/x">no artist, class without trailing space</a></h4></div></div>
 <div data-object-id="3"><div class="card_body"><h4><span><a>B</a></span><a class="search_result_title" href="/x">other class</a></h4></div></div>
 <div><div class="card_body"><h4><span><a>C</a></span><a class="search_result_title " href="/y">no id</a></h4></div></div>
</div>
"""

DETAIL_PAGE = """
<meta property="og:image" content="https://img.example/R-1.jpeg">
<div id="page_content"><table>
 <tr><td class="tracklist_track_pos">A1</td><td><span class="tracklist_track_title">One</span></td></tr>
 <tr><td><span class="tracklist_track_title">Two</span></td></tr>
 <tr><td>heading</td></tr>
 <tr><td class="tracklist_track_pos">B1</td><td><span class="tracklist_track_title">Three</span></td></tr>
</table></div>
<a class="thumbnail_link x" href="/release/1/images"></a>
<div id="view_images"><p><img src="https://img.example/a.jpeg"></p></div>
"""


@pytest.fixture
def parse(spark):
    def run(*sources):
        pages = spark.createDataFrame(list(enumerate(sources)), "page_id bigint, html string")
        return html_nodes(pages)

    return run


def test_facets(parse):
    items = facets(parse(FACET_PAGE))
    good = items.where("reject is null").select("facet", "pos", "name", "url_name", "count", "count_n")
    assert rows(good) == [
        ("country", 0, "Trinidad & Tobago", "Trinidad+&+Tobago", "3", 3),
        ("format", 0, "CD", "CD", "9", 9),
        ("style", 0, "Euro House", "Euro+House", "1234", 1234),
    ]
    bad = items.where("reject is not null").select("name", "reject")
    assert rows(bad) == [("Hard Trance", "href"), ("Italodance", "count")]
    assert rows(facet_lists(items))[2] == ("style", ["Euro House"], ["Euro+House"], ["1234"])


def test_empty_facet_block_is_no_error(parse):
    items = facets(parse(FACET_PAGE.replace("facets_style_exact", "other")))
    assert {r.facet for r in items.collect()} == {"format", "country"}


def test_cards(parse):
    parsed = parse(LISTING_PAGE).withColumn("url", F.lit("u")).withColumn("page_index", F.lit(1))
    found = cards(parsed, ("url", "page_index"), base="https://b.example")
    good = found.where("reject is null").drop("pos", "reject", "href")
    assert [r.asDict() for r in good.collect()] == [
        {
            "url": "u",
            "page_index": 1,
            "obj_id": "98792",
            "artist": "Artist A",
            "title": "Moment",
            "detail_url": "https://b.example/A-Moment/master/98792",
            "label": "Label L",
            "catalog_number": "Unknown",
            "format": "Unknown",
            "year": "2000",
            "country": None,  # the node is there, its leading text is not
        }
    ]
    assert rows(found.where("reject is not null").select("pos", "reject")) == [
        (1, "artist"),
        (2, "title"),
        (3, "obj_id"),
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1 – 100 of 1,234", (1234, 13)),
        ("100", (100, 1)),
        ("1", (1, 1)),
        ("1 - 25 of  101 \n", (101, 2)),
        ("none of these", (None, None)),
    ],
)
def test_pagination(parse, text, expected):
    found = pagination(parse(f'<p><strong class="pagination_total">{text}</strong>')).drop("page_id")
    assert rows(found) == [expected]


def test_pagination_absent(parse):
    assert rows(pagination(parse("<p>x</p>"))) == [(0, None, None)]


def test_cover_and_tracklist(parse):
    parsed = parse(DETAIL_PAGE, "<p>nothing</p>", '<meta property="og:image">')
    assert rows(cover(parsed)) == [(0, "https://img.example/R-1.jpeg", None), (1, None, "no cover"), (2, None, None)]
    assert rows(tracklist(parsed)) == [(0, ["1.A1-One", "2.Two"]), (1, []), (2, [])]
    passed_over = tracklist(parsed, stop_at_gap=False)
    assert rows(passed_over)[0] == (0, ["1.A1-One", "2.Two", "4.B1-Three"])


def test_tracklist_null_texts(parse):
    html = (
        '<div id="page_content"><table><tr><td class="tracklist_track_pos"></td>'
        '<td><span class="tracklist_track_title">One</span></td>'
        '<tr><td><span class="tracklist_track_title"><b>x</b></span></td></table></div>'
    )
    assert rows(tracklist(parse(html))) == [(0, ["1.One", "2.None"])]
    assert rows(tracklist(parse(html), null_position="None")) == [(0, ["1.None-One", "2.None"])]


def test_nested_tables_list_each_row_once(parse):
    row = '<tr><td><span class="tracklist_track_title">{}</span>'
    html = f'<div id="page_content"><table>{row.format("a")}<table>{row.format("b")}</table></td></tr></table></div>'
    # the outer row holds both titles and shows its first
    assert rows(tracklist(parse(html))) == [(0, ["1.a", "2.b"])]


def test_gallery(parse):
    parsed = parse(DETAIL_PAGE, '<a class="thumbnail_link" href="/none">x</a>')
    assert rows(gallery_link(parsed, base="https://b.example")) == [
        (0, "https://b.example/release/1/images"),
        (1, None),
    ]
    assert rows(gallery_images(parsed)) == [(0, 0, "https://img.example/a.jpeg")]


def test_leading_text_entities_and_implied_ends(parse):
    html = (
        "<html><head><script>var t='</p><p>';</script></head><body><p>one &amp; two<b>bold</b> tail"
        "<p>next<!-- c -->more<ul><li>a<li>b<!-- c --></ul><br>x<td>y</body>"
    )
    table = node_rows(parse(html)).select("tag", "text", "path")
    assert [tuple(r) for r in table.collect()] == [
        ("html", None, "html"),
        ("head", None, "html/head"),
        ("script", "var t='</p><p>';", "html/head/script"),
        ("body", None, "html/body"),
        ("p", "one & two", "html/body/p"),
        ("b", "bold", "html/body/p/b"),
        ("p", "next", "html/body/p"),
        ("ul", None, "html/body/ul"),
        ("li", "a", "html/body/ul/li"),
        ("li", "b", "html/body/ul/li"),
        ("br", None, "html/body/br"),
        ("td", "y", "html/body/td"),
    ]


def test_null_empty_and_deep_pages(spark, parse):
    deep = "<b>" * 5000 + "<i>x</i>" + "</b>" * 5000 + "<u>y</u>"
    assert rows(parse(None, "", deep).select("page_id", F.size("nodes"))) == [
        (0, None),
        (1, 0),
        (2, 5002),
    ]
    found = node_rows(parse(deep))
    last = found.orderBy(F.desc("node_id")).first()
    assert (last.tag, last.text, last.parent_id) == ("u", "y", -1)
    inner = found.where("tag = 'i'").first()
    assert (inner.parent_id, inner.node_id, inner.last) == (4999, 5000, 5000)


def test_selectors_on_deep_and_nested_pages(spark, parse):
    wrapped = "<div>" * 1500 + "<ul><li><a>x</a></li></ul>" + "</div>" * 1500
    links = node_texts(select_nodes("nodes", anywhere("ul"), child("li"), child("a")))
    assert parse(wrapped).select(links).first()[0] == ["x"]
    nested = "<div><p><a>1</a></p><div><p><a>2</a></p></div><p><a>3</a></p></div><a>4</a>"
    for steps in ((anywhere("div"), child("p"), child("a")), (anywhere("div"), anywhere("a"))):
        assert parse(nested).select(node_texts(select_nodes("nodes", *steps))).first()[0] == ["1", "2", "3"]


def test_flat_pattern_equals_tree(spark, parse):
    source = "<nav><ul><li><a href='/a'>1</a></li><li><a href='/b'>2</a></li></ul></nav>"
    flat = extract_all(spark.createDataFrame([(0, source)], "page_id int, html string"), "<a href='([^']*)'>")
    assert rows(flat) == [(0, 0, "/a"), (0, 1, "/b")]


PIECES = ["<p>", "</p>", "<b class=x>", "</b>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<br>", "<i/>", "text &amp; ",
          "<!-- c -->", "<li>", "<ul>", "</ul>", "<script>", "</script>", "<a href='", "<", ">", "&lt", "<div>", "</div>", "<?x>", "<!x>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=1, max_size=3))
def test_any_soup_makes_a_consistent_tree(sources):
    tree = _Tree()
    for source in sources:
        tree.add_page(source)
    for nodes in tree.nodes([True] * len(sources)).to_pylist():
        for i, n in enumerate(nodes):
            assert n["id"] == i and n["parent"] < i <= n["last"] < len(nodes)
            # the slice up to last is exactly the subtree
            assert all(i <= m["parent"] for m in nodes[i + 1 : n["last"] + 1])
            assert all(not i <= m["parent"] <= n["last"] for m in nodes[n["last"] + 1 :])


def test_ancestors_are_the_enclosing_elements_and_linear(spark, parse):
    """Ancestors from the stack walk equal the elements whose interval holds the element; time grows with the rows."""
    import random
    import time

    rng = random.Random(4)

    def page(n):
        parts, open_ = [], []
        for _ in range(n):
            if open_ and rng.random() < 0.45:
                parts.append(f"</{open_.pop()}>")
            tag = rng.choice(["div", "section", "span", "br", "p"])
            parts.append(f"<{tag}>t")
            if tag != "br":
                open_.append(tag)
        return "".join(parts) + "".join(f"</{t}>" for t in reversed(open_))

    found = node_rows(parse(page(1_500)))
    nodes = {r.node_id: r for r in found.collect()}
    for r in nodes.values():
        around = sorted(m.node_id for m in nodes.values() if m.node_id < r.node_id and m.last >= r.node_id)
        assert r.anc == around and r.depth == len(around)
        assert r.path == "/".join([nodes[a].tag for a in around] + [r.tag])

    def seconds(n):
        parsed = parse(*[page(n)] * 4).cache()
        parsed.count()
        start = time.time()
        node_rows(parsed).agg(F.sum("depth")).collect()
        return time.time() - start

    seconds(1_000)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.05)


def test_parsed_pages_leave_in_small_pieces():
    """Pages go back to Spark piece by piece, however many come in one batch: all of them, in order."""
    import pyarrow as pa

    from pagetrawl.operators import html

    pages = [None if i == 5 else "<p>x</p>" * 3_000 for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(40), pa.int64()), "html": pa.array(pages)})
    out = list(html._parse(iter([batch])))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(40))
    sizes = [len(b.column(1).flatten()) for b in out]
    assert sum(sizes) == 39 * 3_000 and max(sizes) <= html.FLUSH_NODES + 3_000
