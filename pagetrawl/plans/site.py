"""A site rendered from the documents table, to run the stages on.

Documents are the releases and their lines the tracks. Spark renders the facet
page of each year, the search pages of each (country, format, year, style) and
a page per release, whole texts included, and the stages must read back what
the table says. Some cards lack the artist or an optional field, some releases
have no cover, and some rows of a track table have no title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.functions import search_url
from pagetrawl.functions.urls import BASE_URL
from pagetrawl.operators.extract import CARDS_CLASS, FACET_IDS, TITLE_CLASS
from pagetrawl.operators.frontier import start_url
from pagetrawl.operators.ordered import enumerate_rows

PER_PAGE = 10  # cards of a rendered search page
SEARCH = ("country", "format", "year", "style")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def markup(pattern: str, *values) -> Column:
    """``pattern`` with each ``{}`` replaced by a column; null if one is null."""
    pieces = pattern.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def optional(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: what its card and its page show."""
    n = F.col("n_chars")
    lines = F.split("text", "\n")
    format_ = F.when(n < 1000, "short").when(n < 2000, "medium").otherwise("long")
    style = F.when(n % 3 == 0, "Euro House").when(n % 3 == 1, "Ambient").otherwise("Hard & Core")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        F.col("lang").alias("country"),
        format_.alias("format"),
        (2000 + n % 2).cast("int").alias("year"),
        style.alias("style"),
        F.when(n % 10 != 0, F.col("source")).alias("artist"),
        F.get(lines, F.lit(0)).alias("title"),
        markup("{} & {}", F.col("source"), F.col("lang")).alias("label"),
        F.when(n % 4 != 0, n).alias("catalog_number"),
        (n % 5 == 0).alias("blank_country"),
        F.when(n % 7 != 0, F.col("doc_id")).alias("cover"),
        lines.alias("lines"),
    )


def facet_pages(spark: SparkSession, sf_dir: str, base: str = BASE_URL) -> DataFrame:
    """One search start page per year of the orders, with its three facet blocks."""
    counts = releases(spark, sf_dir).groupBy(*SEARCH).agg(F.count("*").alias("n"))
    # the counts of one year: as many rows as it has values per facet
    per_item = counts.select("year", "n", F.explode(F.create_map(*[x for f in FACET_IDS for x in (F.lit(f), F.col(f))])).alias("facet", "name"))
    item = markup(
        '<li><a href="/search/{}"><small>{}</small><span class="facet_name">\n {} \n</span></a></li>',
        F.col("name"),
        F.format_number("n", 0),
        escape(F.col("name")),
    )
    items = per_item.groupBy("year", "facet", "name").agg(F.sum("n").alias("n")).withColumn("item", item)
    block = F.array_join(F.array_sort(F.collect_list("item")), "")
    blocks = items.groupBy("year", "facet").agg(block.alias("items"))
    ids = F.create_map(*[F.lit(x) for pair in FACET_IDS.items() for x in pair])
    html = markup('<div id="{}"><ul>{}</ul></div>', ids[F.col("facet")], F.col("items"))
    page = F.array_join(F.array_sort(F.collect_list(html)), "\n")
    pages = blocks.groupBy("year").agg(page.alias("html"))
    return pages.select(F.col("year").cast("bigint").alias("page_id"), start_url(F.col("year"), base).alias("url"), "html")


def listing_pages(spark: SparkSession, sf_dir: str, base: str = BASE_URL) -> DataFrame:
    """Search pages with at most ``PER_PAGE`` cards, of every search that has releases."""
    rows = releases(spark, sf_dir)
    totals = rows.groupBy(*SEARCH).agg(F.count("*").alias("total"))
    numbered = enumerate_rows(rows, SEARCH, "key").withColumn("page", F.ceil(F.col("n") / PER_PAGE).cast("int"))
    country = F.when(F.col("blank_country"), F.lit('<span class="card_release_country"><b>x</b></span>')).otherwise(
        markup('<span class="card_release_country">{}</span>', F.col("country"))
    )
    card = F.concat(
        markup('<div data-object-id="{}"><div class="card_body"><h4>', F.col("key")),
        optional(markup("<span><a>{}</a></span>", escape(F.col("artist")))),
        markup(f'<a class="{TITLE_CLASS}" href="/release/{{}}">{{}}</a></h4>', F.col("key"), escape(F.col("title"))),
        markup('<p class="card_info"><a>{}</a>', escape(F.col("label"))),
        optional(markup('<span class="card_release_catalog_number">{}</span>', F.col("catalog_number"))),
        markup('<span class="card_release_format">{}</span>', F.col("format")),
        markup('<span class="card_release_year">{}</span>', F.col("year")),
        country,
        F.lit("</div></div>"),
    )
    on_page = F.array_sort(F.collect_list(F.struct("n", "key", card.alias("card")))).alias("on_page")
    pages = numbered.groupBy(*SEARCH, "page").agg(on_page).join(totals, [*SEARCH])
    html = F.concat(
        markup(
            '<strong class="pagination_total">{} – {} of {}</strong>',
            (F.col("page") - 1) * PER_PAGE + 1,
            F.least(F.col("page") * PER_PAGE, F.col("total")),
            F.format_number("total", 0),
        ),
        F.lit(f'<div class="{CARDS_CLASS}">'),
        F.array_join(F.col("on_page.card"), "\n"),
        F.lit("</div>"),
    )
    first_key = F.get("on_page", F.lit(0))["key"]
    return pages.select(
        (first_key * 2).alias("page_id"), search_url(base=base, per_page=PER_PAGE).alias("url"), html.alias("html")
    )


def release_pages(spark: SparkSession, sf_dir: str, base: str = BASE_URL) -> DataFrame:
    """A page per document: its cover, and its lines as the rows of a track table."""

    def row(line, i):
        position = markup('<td class="tracklist_track_pos">A{}</td>', i + 1)
        title = markup('<td><span class="tracklist_track_title">{}</span>', escape(line))
        return F.concat(
            F.lit("<tr>"),
            F.when((i + 1) % 3 != 0, position).otherwise(F.lit("")),
            F.when(F.length(line) % 9 != 0, title).otherwise(F.lit("<td>heading")),
        )

    cover = markup('<meta property="og:image" content="https://img.example.com/R-{}.jpeg">', F.col("cover"))
    html = F.concat(
        optional(cover),
        F.lit('<div id="page_content"><table>'),
        F.array_join(F.transform("lines", row), "\n"),
        F.lit("</table></div>"),
        markup('<a class="thumbnail_link" href="/release/{}/images">more</a>', F.col("key")),
    )
    return releases(spark, sf_dir).select(
        (F.col("key") * 2 + 1).alias("page_id"),
        markup(base + "/release/{}", F.col("key")).alias("url"),
        html.alias("html"),
    )


def gallery_pages(spark: SparkSession, sf_dir: str, base: str = BASE_URL) -> DataFrame:
    """The image gallery of every release, which shows its cover twice."""
    image = markup('<p><img src="https://img.example.com/R-{}.jpeg"></p>', F.col("cover"))
    html = F.concat(F.lit('<div id="view_images">'), optional(image), optional(image), F.lit("</div>"))
    return releases(spark, sf_dir).select(
        (-F.col("key") - 1).alias("page_id"),
        markup(base + "/release/{}/images", F.col("key")).alias("url"),
        html.alias("html"),
    )
