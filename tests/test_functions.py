"""Scalar functions against literal values and the standard library."""

from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from pagetrawl import functions as fn
from pagetrawl.functions.text import WHITESPACE


def test_whitespace_is_what_a_strip_removes():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_text_functions(spark):
    df = spark.createDataFrame([("\n Trip  Hop\t\n", "1,234,567"), (None, None), ("", "x")], "name string, n string")
    got = df.select(
        fn.facet_url_name(F.col("name")), fn.clean_count(F.col("n")), fn.count_value(F.col("n"))
    ).collect()
    assert [tuple(r) for r in got] == [("Trip++Hop", "1234567", 1234567), (None, None, None), ("", "x", None)]


def test_keyword_default_and_own_words(spark):
    df = spark.createDataFrame([("Italodance",), ("Hardcore",), ("Ambient",), ("house",), (None,)], "s string")
    got = [r[0] for r in df.select(fn.has_keyword(F.col("s"))).collect()]
    assert got == [True, True, False, True, None]
    assert df.where(fn.has_keyword(F.col("s"), ("AMB",))).count() == 1


def test_first_or_default_keeps_null_apart_from_absent(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), ([None],)], "m array<string>")
    assert [r[0] for r in df.select(fn.first_or_default(F.col("m"))).collect()] == ["a", "Unknown", None]


@pytest.mark.parametrize("text, n", [("1 – 100 of 1,234", 13), ("100", 1), ("0", 0), ("of", None), ("9,999,999,999,999", None)])
def test_page_count(spark, text, n):
    assert spark.range(1).select(fn.page_count(F.lit(text))).first()[0] == n


def test_stamp(spark):
    assert spark.range(1).select(fn.stamp("2020-03-13 19:54:07.9")).first()[0] == "2020-03-13 19:54:07"
    assert len(spark.range(1).select(fn.stamp()).first()[0]) == 19


def test_image_data_uri_has_no_line_breaks(spark):
    import base64

    content = bytes(range(256)) * 3
    df = spark.createDataFrame([(bytearray(content),)], "c binary")
    expected = "data:image/jpg;base64," + base64.b64encode(content).decode()
    assert df.select(fn.image_data_uri(F.col("c"))).first()[0] == expected


def test_fingerprint(spark):
    df = spark.createDataFrame(
        [("a", "2000", 2000), ("a|", "", 0), ("a", "|", 0), (None, "a", 0), ("a", None, 0)], "x string, y string, n int"
    )
    prints = [r[0] for r in df.select(fn.fingerprint("x", "y")).collect()]
    assert len(set(prints)) == 5 and all(len(p) == 32 for p in prints)
    same = df.limit(1).select(fn.fingerprint("x", "n") == fn.fingerprint("x", "y"))
    assert same.first()[0]  # an integer year and its text are one task


def test_search_url(spark):
    task = spark.createDataFrame(
        [("Trinidad+&+Tobago", "7\"", 2000, "Euro+House", 3)],
        "country string, format string, year int, style string, page int",
    )
    assert task.select(fn.search_url(base="https://b.example")).first()[0] == (
        "https://b.example/search/?layout=sm&country_exact=Trinidad+%26+Tobago&format_exact=7%22&limit=100"
        "&year=2000&style_exact=Euro+House&page=3&decade=2000"
    )


def test_url_params(spark):
    df = spark.createDataFrame(
        [("http://h/?a=1&page=2&c=3",), ("http://h/?page=#f",), ("http://h/?mypage=4",)], "url string"
    )
    got = df.select(
        fn.set_url_param(F.col("url"), "page", 17), fn.get_url_param(F.col("url"), "page"), fn.get_url_param(F.col("url"), "a")
    ).collect()
    assert [tuple(r) for r in got] == [
        ("http://h/?a=1&page=17&c=3", "2", "1"),
        ("http://h/?page=17#f", "", None),
        ("http://h/?mypage=4", None, None),
    ]


def test_url_tails(spark):
    df = spark.createDataFrame([("http://h/a/R-1.jpeg?x=1",), ("http://h/",), ("name.jpeg",)], "url string")
    got = rows(df.select(fn.last_path_segment(F.col("url")), fn.image_name(F.col("url")), fn.url_key(F.col("url"))))
    assert got == [("", "", "http://h/"), ("R-1.jpeg?x=1", "R-1?x=1", "http://h/a/R-1.jpeg?x=1"), ("name.jpeg", "name", "name.jpeg")]


HREFS = ["", "/", "a", "/a", "//o.example/x", "?q=1", "#f", "a/b?c#d", "..", "../", "../../x", "./y", "/./z", "/../w",
         "a/../b", "a//b", "mailto:x@y", "https://z.example/p", "a/.", "a/..", "...", ".b", "?", "#", "/a/b/", "x:y"]
BASES = ["https://h.example", "https://h.example/", "http://h.example/a/b/c?x=1#y", "https://h.example/a/b/", "http://h.example/d//e/f"]


def joined(spark, pairs):
    df = spark.createDataFrame(pairs, "b string, h string")
    return [r[0] for r in df.select(fn.url_join(F.col("b"), F.col("h"))).collect()]


def test_url_join_equals_the_standard_join(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    got = dict(zip(pairs, joined(spark, pairs)))
    wrong = {p: (g, urljoin(*p)) for p, g in got.items() if g != urljoin(*p)}
    assert not wrong
    assert joined(spark, [("https://h.example/a", None)]) == ["https://h.example/a"]


segments = st.lists(st.sampled_from(["a", "b.c", ".", "..", "x y", ""]), max_size=6).map("/".join)
tails = st.sampled_from(["", "?q=1", "#f", "?a=b&c=../d#../e"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(segments, segments, tails), min_size=50, max_size=100))
def test_url_join_property(spark, cases):
    pairs = [("https://h.example/" + b, h + t) for b, h, t in cases if not h.startswith("//")]
    assert joined(spark, pairs) == [urljoin(*p) for p in pairs]
