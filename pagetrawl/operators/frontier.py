"""The task frontier: seeds, follow-up pages, fetching, rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.functions import fingerprint, url_key
from pagetrawl.functions.urls import BASE_URL
from pagetrawl.operators.dedup import dedup_first, unseen
from pagetrawl.operators.retry import fetch_result
from pagetrawl.schemas import SEED_TASK_COLUMNS
from pagetrawl.session import scratch_path, settle

# Pages of one explode step; a result list of any length is expanded in two.
PAGE_BLOCK = 10_000


def start_url(year: Column, base: str = BASE_URL, decade: int = 2000, per_page: int = 25) -> Column:
    """Search page a crawl starts from, one per year."""
    return F.format_string(f"{base}/search/?limit={per_page}&layout=sm&decade={decade}&year=%d&page=1", year.cast("int"))


def start_requests(spark: SparkSession, first: int, last: int, **options) -> DataFrame:
    years = spark.range(first, last + 1).withColumnRenamed("id", "year")
    return years.select(start_url(F.col("year"), **options).alias("url"))


def task_project(rows: DataFrame) -> DataFrame:
    """Shape rows into search tasks; text years and pages become numbers."""
    numbers = ("year", "page")
    return rows.select(*[F.col(c).cast("int" if c in numbers else "string").alias(c) for c in SEED_TASK_COLUMNS])


def task_fingerprint() -> Column:
    return fingerprint(*SEED_TASK_COLUMNS)


def frontier_product(lists: DataFrame, years: list[int], by: tuple = ()) -> DataFrame:
    """Every combination of year, style, format and country, at page 1.

    Takes :func:`facet_lists`. The lists of a page meet in one row and are
    exploded one after the other, so nothing is joined; the rows in between
    are spread over the cluster before they multiply. An empty list makes an
    empty product.
    """
    list_of = lambda facet: F.max(F.when(F.col("facet") == facet, F.col("url_names"))).alias(facet)
    pages = lists.groupBy(*by).agg(*[list_of(f) for f in ("style", "format", "country")])
    years_styles = pages.select(*by, F.explode(F.lit(years)).alias("year"), "style", "format", "country").select(
        *by, "year", F.explode("style").alias("style"), "format", "country"
    )
    # a style that many pages list is spread by page as well
    spread = years_styles.repartition(*by, "year", "style")
    formats = spread.select("year", "style", F.explode("format").alias("format"), "country")
    tasks = formats.select(F.explode("country").alias("country"), "format", "year", "style", F.lit(1).alias("page"))
    return task_project(tasks)


def follow_up_pages(tasks: DataFrame, pages: str = "pages") -> DataFrame:
    """Tasks for result pages 2 to N; none where N is missing or at most 1."""
    n = F.col(pages)
    blocks = F.sequence(F.lit(0), F.floor((n - 2) / F.lit(PAGE_BLOCK)).cast("int"))
    per_block = tasks.where(n > 1).withColumn("_block", F.explode(blocks))
    low = F.col("_block") * PAGE_BLOCK + 2
    high = F.least(low + (PAGE_BLOCK - 1), n)
    return per_block.withColumn("page", F.explode(F.sequence(low, high))).drop("_block")


def union_tasks(*tasks: DataFrame) -> DataFrame:
    """Seed and follow-up tasks in one frame, in one schema, with fingerprints."""
    first, *others = [task_project(t) for t in tasks]
    for other in others:
        first = first.unionByName(other)
    return first.withColumn("fp", task_fingerprint())


def newest_captures(pages: DataFrame, latest: tuple = ("page_id",)) -> DataFrame:
    """Per URL the page a fetch finds: its newest capture, by ``latest``.

    Reads the key columns only. URLs captured over and over collapse before
    the shuffle.
    """
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    captures = pages.select(
        url_key(F.col("url")).alias("url_key"), F.struct(F.struct(*latest), "page_id", status.alias("status")).alias("c")
    )
    newest = captures.groupBy("url_key").agg(F.max("c").alias("c"))
    return newest.select("url_key", "c.page_id", "c.status")


def fetch_join(tasks: DataFrame, captures: DataFrame) -> DataFrame:
    """Each task with the page its ``url`` leads to, by key only.

    Adds ``page_id``, ``status`` and ``result`` (``ok``, ``unhandled``,
    ``failed``; no page is a failed fetch). Captures are reduced to the wanted
    ones first: a small frontier is broadcast to them, by its size at run time,
    and the archive's keys stay where they are. Content is joined afterwards
    with :func:`with_content`.
    """
    wanted = tasks.withColumn("url_key", url_key(F.col("url")))
    there = captures.join(wanted.select("url_key").distinct(), "url_key", "left_semi")
    fetched = wanted.join(there, "url_key", "left").drop("url_key")
    return fetched.withColumn("result", fetch_result(F.col("status")))


def with_content(fetched: DataFrame, pages: DataFrame) -> DataFrame:
    """The content columns of ``pages`` for the tasks that were fetched.

    Give it extracted rows rather than raw HTML when most pages are wanted:
    then the HTML is parsed where it is read and never shuffled.
    """
    known = [c for c in pages.columns if c == "page_id" or c not in fetched.columns]
    return fetched.where("result = 'ok'").join(pages.select(*known), "page_id")


def frontier_rounds(
    seeds: DataFrame,
    expand: Callable[[DataFrame], DataFrame],
    order: tuple,
    path: str | None = None,
) -> DataFrame:
    """Follow tasks to new tasks until none is left; adds the ``round`` each was first seen.

    Rounds end with the first that finds nothing new, however long the chain to it.

    ``seeds`` has a fingerprint ``fp``; ``expand`` maps tasks to follow-up
    tasks of the same columns. Each round is written as a table and read
    back, so plans do not grow and the loss of an executor costs no round.
    """
    spark = seeds.sparkSession
    path = path or scratch_path(spark, "rounds")
    n = 0
    frontier = settle(dedup_first(seeds, order).withColumn("round", F.lit(0)), "round", f"{path}/round-0")
    so_far = lambda n: spark.read.schema(frontier.schema).parquet(*[f"{path}/round-{i}" for i in range(n)])
    while not frontier.isEmpty():
        n += 1
        named = dedup_first(expand(frontier.drop("round")).select(*seeds.columns), order)
        fresh = unseen(settle(named, "named", f"{path}/named-{n}"), so_far(n)).withColumn("round", F.lit(n))
        frontier = settle(fresh, "round", f"{path}/round-{n}")
    return so_far(n + 1)
