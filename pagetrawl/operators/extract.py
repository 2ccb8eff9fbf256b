"""Facets, cards, pagination, cover, tracklist and gallery of a page.

All functions but :func:`html_nodes` are narrow: they take a parsed page (a row
with a ``nodes`` array) and never shuffle. Parse once, then apply several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrawl.functions import (
    STYLE_WORDS,
    clean_count,
    count_value,
    facet_url_name,
    first_or_default,
    has_keyword,
    page_count,
    strip,
    url_join,
)
from pagetrawl.functions.urls import BASE_URL
from pagetrawl.operators.select import (
    anywhere,
    child,
    first_match,
    node_attrs,
    node_texts,
    once,
    select_below,
    select_nodes,
    select_within,
    slice_below,
)

# Ids of the three facet blocks on a search page.
FACET_IDS = {"style": "facets_style_exact", "format": "facets_format_exact", "country": "facets_country_exact"}

# Classes of a result card and its parts; the space is part of the value.
CARDS_CLASS = "cards cards_layout_text-only"
TITLE_CLASS = "search_result_title "
OPTIONAL_CLASSES = {
    "catalog_number": "card_release_catalog_number",
    "format": "card_release_format",
    "year": "card_release_year",
    "country": "card_release_country",
}


def extract_all(pages: DataFrame, pattern: str, html: str = "html", group: int = 1) -> DataFrame:
    """All matches of a flat pattern: one row per match with its position.

    For regular one-tag patterns only; no tree is built and no Python runs.
    """
    rest = [c for c in pages.columns if c != html]
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(group))
    return pages.select(*rest, F.posexplode(found).alias("pos", "value"))


def facets(parsed: DataFrame, words=STYLE_WORDS, keep: tuple = ()) -> DataFrame:
    """Facet items of search pages, one row each; ``reject`` names what an item lacks.

    Only styles are filtered by keyword. ``pos`` orders the items of a facet.
    """
    blocks = []
    for facet, block_id in FACET_IDS.items():
        anchors = select_nodes("nodes", anywhere("div", id=block_id), child("ul"), child("li"), child("a"))
        items = F.transform(anchors, _facet_item)
        if facet == "style":
            items = F.filter(items, lambda i: i["reject"].isNotNull() | has_keyword(i["name"], words))
        blocks.append(F.struct(F.lit(facet).alias("facet"), items.alias("items")))
    per_block = parsed.select(*keep, F.inline(F.array(*blocks)))
    per_item = per_block.select(*keep, "facet", F.posexplode("items").alias("pos", "item"))
    return per_item.select(
        *keep,
        "facet",
        "pos",
        "item.name",
        facet_url_name(F.col("item.name")).alias("url_name"),
        "item.count",
        count_value(F.col("item.count")).alias("count_n"),
        "item.reject",
    )


def _facet_item(anchor: Column) -> Column:
    count = first_match(node_texts(select_below("nodes", anchor, anywhere("small"))))
    name = first_match(node_texts(select_below("nodes", anchor, anywhere("span", class_="facet_name"))))
    has_link = F.map_contains_key(anchor["attrs"], F.lit("href"))
    reject = F.when(count.isNull(), "count").when(name.isNull(), "name").when(~has_link, "href")
    return F.struct(
        strip(name).alias("name"),
        clean_count(count).alias("count"),
        reject.alias("reject"),
    )


def facet_lists(items: DataFrame, by: tuple = ()) -> DataFrame:
    """Per facet the parallel lists ``names``, ``url_names`` and ``counts``.

    A facet list is bounded by the page it stands on; pass the page's key in
    ``by`` when there are several.
    """
    good = items.where(F.col("reject").isNull())
    packed = F.array_sort(F.collect_list(F.struct("pos", "name", "url_name", "count")))
    lists = good.groupBy(*by, "facet").agg(packed.alias("l"))
    return lists.select(
        *by,
        "facet",
        F.col("l.name").alias("names"),
        F.col("l.url_name").alias("url_names"),
        F.col("l.count").alias("counts"),
    )


def card_items() -> Column:
    """Result cards of a parsed page as an array: per field the texts of its nodes."""
    roots = select_nodes("nodes", anywhere("div", class_=CARDS_CLASS), child("div"))
    body = anywhere("div", class_="card_body")
    info = (body, child("p", class_="card_info"))

    def card(cut):
        root = cut["root"]
        below = lambda *steps: select_within(cut["below"], root, *steps)
        title = F.transform(
            below(body, child("h4"), child("a", class_=TITLE_CLASS)),
            lambda n: F.struct(n["text"].alias("text"), n["attrs"]["href"].alias("href")),
        )
        return F.struct(
            root["attrs"]["data-object-id"].alias("obj_id"),
            node_texts(below(body, child("h4"), child("span"), child("a"))).alias("artist"),
            title.alias("title"),
            node_texts(below(*info, child("a"))).alias("label"),
            *[node_texts(below(*info, child("span", class_=c))).alias(n) for n, c in OPTIONAL_CLASSES.items()],
        )

    # a card's slice of the page is cut once and searched for all fields
    cuts = F.transform(roots, lambda r: F.struct(r.alias("root"), slice_below("nodes", r).alias("below")))
    return F.transform(cuts, card)


def card_rows(pages: DataFrame, items: str | Column, keep: tuple, base: str = BASE_URL) -> DataFrame:
    """One row per card of :func:`card_items`, in page order.

    ``reject`` names the required field a card lacks and is null for good
    cards; required are id, artist, title and link.
    """
    found = pages.select(*keep, F.posexplode(items).alias("pos", "card")).select(*keep, "pos", "card.*")
    reject = (
        F.when(F.col("obj_id").isNull(), "obj_id")
        .when(F.size("artist") == 0, "artist")
        .when(F.size("title") == 0, "title")
        .when(first_match(F.col("title"))["href"].isNull(), "href")
    )
    first_title = first_match(F.col("title"))
    return found.select(
        *keep,
        "pos",
        "obj_id",
        first_match(F.col("artist")).alias("artist"),
        first_title["text"].alias("title"),
        first_title["href"].alias("href"),
        F.when(first_title["href"].isNotNull(), url_join(base, first_title["href"])).alias("detail_url"),
        *[first_or_default(F.col(n)).alias(n) for n in ("label", *OPTIONAL_CLASSES)],
        reject.alias("reject"),
    )


def usable_card(card: Column) -> Column:
    """Whether a card of :func:`card_items` has all required fields."""
    linked = F.get(card["title"], F.lit(0))["href"].isNotNull()
    return card["obj_id"].isNotNull() & (F.size(card["artist"]) > 0) & (F.size(card["title"]) > 0) & F.coalesce(linked, F.lit(False))


def cards(parsed: DataFrame, keep: tuple = ("url",), base: str = BASE_URL) -> DataFrame:
    """Result cards of parsed pages, one row each (see :func:`card_rows`)."""
    return card_rows(parsed, card_items(), keep, base)


def pagination_text() -> Column:
    """Text of the first pagination element of a parsed page."""
    return first_match(node_texts(select_nodes("nodes", anywhere("strong", class_="pagination_total"))))


def pagination(parsed: DataFrame, keep: tuple = ("page_id",), per_page: int = 100) -> DataFrame:
    """Total number of results and of result pages; null where a page names none."""
    text = parsed.select(*keep, pagination_text().alias("text"))
    total = count_value(F.substring_index("text", "of", -1))
    return text.select(*keep, total.alias("total"), page_count(F.col("text"), per_page).alias("pages"))


def cover_links() -> Column:
    """Open Graph images of a parsed page, in document order."""
    return node_attrs(select_nodes("nodes", anywhere("meta", property="og:image")), "content")


def cover(parsed: DataFrame, keep: tuple = ("page_id",)) -> DataFrame:
    """Cover of each page; ``reject`` is set where no element names one."""
    covers = parsed.select(*keep, cover_links().alias("covers"))
    return covers.select(*keep, first_match(F.col("covers")).alias("cover_url"), no_cover(F.col("covers")).alias("reject"))


def no_cover(covers: Column) -> Column:
    """Reject reason of a page without a cover element; one without content is a null cover."""
    return F.when(F.size(covers) == 0, "no cover")


def track_titles(stop_at_gap: bool = True, null_position: str | None = None) -> Column:
    """Numbered titles of a parsed page: ``n.title`` or ``n.position-title``.

    Rows count from 1 in document order. The list ends at the first row
    without a title; with ``stop_at_gap=False`` such rows are passed over. An
    empty position element counts as none unless ``null_position`` gives the
    text to print for it.
    """
    rows = select_nodes("nodes", anywhere("div", id="page_content"), anywhere("table"), anywhere("tr"))
    read = F.transform(rows, lambda r, i: _track(r, i, null_position))
    if stop_at_gap:

        def until_gap(found):
            gap = F.array_position(F.transform(found, lambda t: t.isNull()), F.lit(True)).cast("int")
            return F.when(gap > 0, F.slice(found, F.lit(1), gap - 1)).otherwise(found)

        return once(read, until_gap)
    return F.filter(read, lambda t: t.isNotNull())


def _track(row: Column, index: Column, null_position: str | None) -> Column:
    position = select_below("nodes", row, anywhere("td", class_="tracklist_track_pos"))
    title = select_below("nodes", row, anywhere("td"), anywhere("span", class_="tracklist_track_title"))
    lead = first_match(node_texts(position))
    if null_position is not None:
        lead = F.when(F.size(position) > 0, F.coalesce(lead, F.lit(null_position)))
    # Fixed value: a title element without text prints as None
    text = F.coalesce(first_match(node_texts(title)), F.lit("None"))
    text = F.concat(F.coalesce(F.concat(lead, F.lit("-")), F.lit("")), text)
    numbered = F.concat((index + 1).cast("string"), F.lit("."), text)
    return F.when(F.size(title) > 0, numbered)


def tracklist(parsed: DataFrame, keep: tuple = ("page_id",), **options) -> DataFrame:
    return parsed.select(*keep, track_titles(**options).alias("title_list"))


def gallery_href() -> Column:
    """Link of a parsed page to its image gallery, as written; null if none."""
    link = anywhere("a", contains={"class": "thumbnail_link", "href": "images"})
    return first_match(node_attrs(select_nodes("nodes", link), "href"))


def gallery_link(parsed: DataFrame, keep: tuple = ("page_id",), base: str = BASE_URL) -> DataFrame:
    """Absolute link to a release's image gallery, null when the page has none."""
    found = parsed.select(*keep, gallery_href().alias("href"))
    url = F.when(F.col("href").isNotNull(), url_join(base, F.col("href")))
    return found.select(*keep, url.alias("gallery_url"))


def image_links() -> Column:
    """Image links of a gallery page, in document order."""
    images = select_nodes("nodes", anywhere("div", id="view_images"), child("p"), anywhere("img"))
    return node_attrs(images, "src")


def gallery_images(parsed: DataFrame, keep: tuple = ("page_id",)) -> DataFrame:
    """Image links of gallery pages, one row each."""
    return parsed.select(*keep, F.posexplode(image_links()).alias("pos", "img_url"))
