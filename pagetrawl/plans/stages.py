"""The three stages as DataFrame plans.

A page is parsed where it is read and shrinks to the few fields a stage wants
(``page_facts``); only those rows meet the tasks, so HTML is never shuffled. No
stage collects anything or stops for a bad page: what cannot be used leaves as
a reject or as the outcome of an attempt, with the reason.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrawl.functions import (
    STYLE_WORDS,
    fingerprint,
    image_data_uri,
    image_name,
    last_path_segment,
    page_count,
    search_url,
    stamp,
    url_join,
)
from pagetrawl.functions.urls import BASE_URL
from pagetrawl.operators.dedup import dedup_first, split_valid, unseen
from pagetrawl.operators.extract import (
    card_items,
    card_rows,
    cover_links,
    facet_lists,
    facets,
    gallery_href,
    image_links,
    no_cover,
    pagination_text,
    track_titles,
    usable_card,
)
from pagetrawl.operators.frontier import (
    fetch_join,
    follow_up_pages,
    frontier_product,
    newest_captures,
    task_fingerprint,
    task_project,
    with_content,
)
from pagetrawl.operators.html import html_nodes
from pagetrawl.operators.retry import ok_pages
from pagetrawl.operators.select import first_match
from pagetrawl.operators.upsert import Upsert
from pagetrawl.schemas import DETAIL_FIELDS, INDEX_FIELDS, SEED_TASK_COLUMNS
from pagetrawl.session import scratch_path, settle, spread
from pagetrawl.sources.catalogue import read_catalogue, write_catalogue
from pagetrawl.sources.images import write_missing_images
from pagetrawl.sources.tasks import append_batch, read_tasks

CATALOGUE = Upsert(
    key="obj_id",
    # the later write wins; within one page the later card
    order="crawler_time string, page_index int, pos int",
    types=(
        "obj_id string, artist string, title string, detail_url string, label string, catalog_number string, "
        "format string, year string, country string, url string, page_index int, cover_url string, "
        "title_list array<string>, base64url string, crawler_time string, index_time string, detail_time string"
    ),
    carried={
        "index": (*INDEX_FIELDS, "index_time"),
        "detail": (*DETAIL_FIELDS, "detail_time"),
        # details stored together with the cover image
        "cover": (*DETAIL_FIELDS, "detail_time", "base64url"),
    },
)


class Fetched(NamedTuple):
    """What a stage makes of its tasks."""

    rows: DataFrame  # for the catalogue
    rejects: DataFrame  # what could not be used, with ``reject``
    outcomes: DataFrame  # one attempt per task: fp, ok, error
    tasks: DataFrame | None = None  # follow-up tasks of the same stage
    details: DataFrame | None = None  # tasks of the detail stage
    read: DataFrame | None = None  # page_id of the pages whose content was read


def seed_stage(pages: DataFrame, years: list[int], words=STYLE_WORDS, by: tuple = ("page_id",)) -> DataFrame:
    """Search tasks from facet pages: every year, style, format and country of a page.

    Pages with a ``status`` count only where it is 200.
    """
    good = ok_pages(pages) if "status" in pages.columns else pages
    parsed = html_nodes(good.select(*by, "html"))
    lists = facet_lists(facets(parsed, words, keep=by), by)
    return frontier_product(lists, years, by).withColumn("fp", task_fingerprint())


FACTS = {
    "pagination": pagination_text,
    "cards": card_items,
    "covers": cover_links,
    "title_list": track_titles,
    "gallery_href": gallery_href,
    "image_links": image_links,
}
INDEX_FACTS = ("pagination", "cards")
DETAIL_FACTS = ("covers", "title_list")
GALLERY_FACTS = ("gallery_href", "image_links")


def page_facts(pages: DataFrame, fields: tuple = tuple(FACTS)) -> DataFrame:
    """What the stages read from a page, one row per page, in one parse.

    A narrow step from archive to facts: settle it once and let all stages
    and rounds read from it. ``fields`` names what the stages ahead want; a page
    without HTML has nulls.
    """
    parsed = html_nodes(spread(pages.select("page_id", "html"), "page_id"))
    return parsed.select("page_id", *[FACTS[f]().alias(f) for f in fields])


def _outcomes(fetched: DataFrame, read: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """One attempt per task: good only if its content was ``read``, and not ``refused`` then."""
    had = read.select("fp").distinct().withColumn("had", F.lit(True))
    told = fetched.join(had, "fp", "left")
    if refused is not None:
        told = told.join(refused, "fp", "left")
    why = [_fetch_error(), F.when(F.col("had").isNull(), "no content"), *([F.col("refused")] if refused is not None else [])]
    told = told.withColumn("error", F.coalesce(*why))
    return told.select("fp", F.col("error").isNull().alias("ok"), "error")


def _fetch_error() -> Column:
    told = F.concat(F.lit("status "), F.col("status").cast("string"))
    return F.when(F.col("result") != "ok", F.coalesce(told, F.lit("no page")))


def index_stage(
    tasks: DataFrame, captures: DataFrame, facts: DataFrame, at=None, base: str = BASE_URL, per_page: int = 100
) -> Fetched:
    """Search tasks to index rows, detail tasks and follow-up pages.

    ``captures`` is :func:`newest_captures` of the archive, ``facts`` its
    :func:`page_facts`.
    """
    fetched = settle(fetch_join(tasks.withColumn("url", search_url(base=base, per_page=per_page)), captures), "fetched")
    content = facts.select("page_id", *INDEX_FACTS).where("cards is not null")
    pages = settle(with_content(fetched, content), "read")
    valid, rejects = split_valid(card_rows(pages, "cards", ("url", "page"), base))

    time = stamp(at)
    rows = valid.withColumns({"page_index": F.col("page"), "crawler_time": time, "index_time": time})
    rows = rows.select("obj_id", *INDEX_FIELDS, "index_time", "pos")
    details = valid.select(F.col("href").alias("url"), fingerprint("href").alias("fp")).distinct()

    # any page of a search names the total; each search announces its pages once
    search = [c for c in SEED_TASK_COLUMNS if c != "page"]
    named = pages.where(F.exists("cards", usable_card)).withColumn("pages", page_count(F.col("pagination"), per_page))
    counted = named.groupBy(*search).agg(F.max("pages").alias("pages"))
    follow_ups = task_project(follow_up_pages(counted)).withColumn("fp", task_fingerprint())
    told = rejects.select("url", "pos", "obj_id", "reject")
    return Fetched(rows, told, _outcomes(fetched, pages), follow_ups, details)


def detail_stage(
    tasks: DataFrame,
    captures: DataFrame,
    facts: DataFrame,
    at=None,
    base: str = BASE_URL,
    images: DataFrame | None = None,
) -> Fetched:
    """Detail tasks to catalogue rows; a page without a cover is rejected whole.

    With ``images`` (``url, content``, one per URL) the rows also carry the
    cover as ``base64url``, and a page whose cover is not among them is
    rejected. Store such rows as source ``cover``, others as ``detail``.
    """
    located = tasks.withColumn("url", url_join(base, F.col("url")))
    fetched = settle(fetch_join(located, captures), "fetched")
    covers = F.col("covers")
    content = facts.where("covers is not null")
    read = content.select("page_id", first_match(covers).alias("cover_url"), no_cover(covers).alias("reject"), "title_list")
    told = with_content(fetched, read)
    extra = []
    if images is not None:
        # reduced to the covers asked for: image bytes move only for these
        told = settle(told, "hits")
        asked = told.select("cover_url").distinct()
        found = images.withColumnRenamed("url", "cover_url").join(asked, "cover_url", "left_semi")
        told = told.join(found.select("cover_url", F.col("content").alias("_image")), "cover_url", "left")
        told = told.withColumn("reject", F.coalesce("reject", F.when(F.col("_image").isNull(), "no image")))
        # coded when the rows are made: base64 is longer than the bytes and does not compress
        extra = [image_data_uri(F.col("_image")).alias("base64url")]
    told = settle(told, "told")  # rows, rejects and outcomes read it
    valid, rejects = split_valid(told)

    time = stamp(at)
    rows = valid.select(
        last_path_segment(F.col("url")).alias("obj_id"),
        "cover_url",
        "title_list",
        *extra,
        time.alias("crawler_time"),
        time.alias("detail_time"),
        F.lit(None).cast("int").alias("page_index"),
        F.lit(0).alias("pos"),
    )
    refused = rejects.select("fp", F.col("reject").alias("refused"))
    outcomes = _outcomes(fetched, told, refused)
    return Fetched(rows, rejects.select("url", "reject"), outcomes, read=told.select("page_id").distinct())


def gallery_stage(
    captures: DataFrame, facts: DataFrame, images: DataFrame, base: str = BASE_URL, of: DataFrame | None = None
) -> DataFrame:
    """Images of the galleries that pages link to (those of ``of (page_id)``, or all), for the image store.

    Page to gallery page to image (``images`` has ``url, content``), each step
    a join on distinct keys; rows ``name, content, img_url``.
    """
    linking = facts if of is None else facts.join(of, "page_id", "left_semi")
    links = linking.where("gallery_href is not null").select(url_join(base, F.col("gallery_href")).alias("url"))
    shown = with_content(fetch_join(links.distinct(), captures), facts.select("page_id", "image_links"))
    # settled, so that the size a broadcast is decided by is the real one
    wanted = settle(shown.select(F.explode("image_links").alias("img_url")).distinct(), "wanted")
    found = images.join(wanted, images.url == wanted.img_url)
    return found.select(image_name(F.col("img_url")).alias("name"), "content", "img_url")


def fetch_seeds(starts: DataFrame, captures: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that start URLs (``url``) lead to, by their newest good captures; the HTML of these alone moves."""
    fetched = fetch_join(starts.select("url").distinct(), captures)
    return with_content(fetched, pages.select("page_id", "html")).where("html is not null")


def crawl(
    seed_pages: DataFrame | None,
    pages: DataFrame,
    years: list[int],
    path: str | None = None,
    words=STYLE_WORDS,
    base: str = BASE_URL,
    per_page: int = 100,
    at=None,
    starts: DataFrame | None = None,
    images: DataFrame | None = None,
) -> DataFrame:
    """All stages over an archive; returns the catalogue.

    Seed pages are given, or fetched from the archive by their URLs (``starts``). With ``images``
    (``url, content``) covers go into the catalogue, and the galleries of the details that
    were read into the image store ``<path>/images``.

    The archive's facts are settled once. Index rounds run until no task is
    new; each round writes its rows as one catalogue batch and its detail
    tasks and outcomes as one batch of their queues. ``path`` is a new folder:
    all that a run writes stays below it.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "crawl")
    index_store, detail_store, queues = f"{path}/index", f"{path}/detail", f"{path}/queues"
    captures = settle(newest_captures(pages), "captures", f"{path}/captures")
    fields = INDEX_FACTS + DETAIL_FACTS + (GALLERY_FACTS if images is not None else ())
    facts = settle(page_facts(pages, fields), "facts", f"{path}/facts")
    if seed_pages is None:
        seed_pages = settle(fetch_seeds(starts, captures, pages), "seed-pages", f"{path}/seed-pages")

    seeds = seed_stage(seed_pages, years, words)
    frontier = settle(dedup_first(seeds, ("page",)), "round", f"{path}/round-0")
    n = 0
    while not frontier.isEmpty():
        done = index_stage(frontier, captures, facts, at, base, per_page)
        write_catalogue(CATALOGUE, CATALOGUE.state(done.rows, "index"), index_store, n)
        append_batch(done.details, queues, "detail", n)
        append_batch(done.outcomes, queues, "outcomes", n)
        seen = spark.read.schema(frontier.schema).parquet(*[f"{path}/round-{i}" for i in range(n + 1)])
        named = settle(dedup_first(done.tasks, ("page",)), "named", f"{path}/named-{n + 1}")
        fresh = unseen(named, seen)
        n += 1
        frontier = settle(fresh, "round", f"{path}/round-{n}")

    queued = read_tasks(spark, queues, "detail", "url string, fp string")
    done = detail_stage(dedup_first(queued, ("url",)), captures, facts, at, base, images)
    source = "detail" if images is None else "cover"
    write_catalogue(CATALOGUE, CATALOGUE.state(done.rows, source), detail_store, 0, wide=True)
    if images is not None:
        found = gallery_stage(captures, facts, images, base, done.read)
        write_missing_images(found, f"{path}/images", "img_url")
    append_batch(done.outcomes, queues, "outcomes", 0, "detail")
    return read_catalogue(CATALOGUE, spark, index_store, detail_store)
