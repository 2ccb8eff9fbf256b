"""The registered queries: every operator over whole tables.

Each takes ``(spark, sf_dir)`` and returns a frame; ``oracle.py`` holds the
same results as SQL. Stage queries run on the site that ``site.py`` renders
from the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl import functions as fn
from pagetrawl.operators import dedup, extract, frontier, ordered, retry, upsert
from pagetrawl.operators.html import html_nodes, node_rows
from pagetrawl.operators.select import anywhere, child, node_attrs, node_texts, select_nodes
from pagetrawl.plans import site, stages
from pagetrawl.schemas import SEED_TASK
from pagetrawl.session import bucketed, scratch_path, settle, spread
from pagetrawl.sources import catalogue, images, pages as page_source, tasks as task_source
from pagetrawl.streaming import stage_streams as stage_stream, streams

LINK = '<li><a href="([^"]*)">'
AT = "2020-01-02 03:04:05"
YEARS = [2000, 2001]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return page_source.read_pages(spark, f"{d}/pages.parquet")


_table = site.table


# --- flat extraction and URLs


def page_links(spark, d):
    found = extract.extract_all(_pages(spark, d).select("page_id", "html"), LINK)
    return found.select("page_id", "pos", F.col("value").alias("href"))


def page_links_joined(spark, d):
    found = extract.extract_all(_pages(spark, d), LINK)
    return found.select("page_id", "pos", fn.url_join(F.col("url"), F.col("value")).alias("target"))


def link_tasks(spark, d):
    """Links as detail tasks, each once, with the page that names it first."""
    links = page_links_joined(spark, d).select(fn.fingerprint("target").alias("fp"), "page_id", "pos", "target")
    return dedup.dedup_first(links, ("page_id", "pos"))


def page_title(spark, d):
    heads = F.regexp_extract_all("html", F.lit("<h1>([^<]*)"), F.lit(1))
    return _pages(spark, d).select("page_id", F.get(heads, F.lit(0)).alias("title"))


def page_fingerprint(spark, d):
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    return _pages(spark, d).select("page_id", fn.fingerprint("html").alias("fp"), lang.alias("lang"))


def url_param_get_set(spark, d):
    url = F.col("url")
    page = fn.get_url_param(url, "page")
    return _pages(spark, d).select("page_id", page.alias("page"), fn.set_url_param(url, "page", 7).alias("page_7"))


def url_tail(spark, d):
    url = F.col("url")
    return _pages(spark, d).select(
        "page_id", fn.last_path_segment(url).alias("tail"), fn.image_name(F.concat(url, F.lit(".jpeg"))).alias("name")
    )


def clean_facets(spark, d):
    """Facet names and counts as a page shows them, cleaned again."""
    parts = _table(spark, d, "part").groupBy("p_name").agg(F.sum("p_partkey").alias("n"))
    shown = parts.select(F.concat(F.lit("\n "), "p_name", F.lit("\t\n")).alias("name"), F.format_number("n", 0).alias("n"))
    return shown.select(
        fn.strip(F.col("name")).alias("name"),
        fn.facet_url_name(F.col("name")).alias("url_name"),
        fn.clean_count(F.col("n")).alias("count"),
        fn.count_value(F.col("n")).alias("count_n"),
    )


def search_urls(spark, d):
    rows = site.releases(spark, d).select(*[F.replace(c, F.lit(" "), F.lit("+")).alias(c) if c != "year" else c for c in site.SEARCH])
    tasks = rows.distinct().withColumn("page", F.lit(1))
    return tasks.select(fn.search_url().alias("url"), fn.stamp(AT).alias("crawler_time"))


def image_uri(spark, d):
    return _pages(spark, d).select("page_id", fn.image_data_uri(F.encode("html", "utf-8")).alias("uri"))


# --- node trees and selectors


def _tree(pages, key="page_id"):
    return html_nodes(spread(pages.select(key, "html"), key))


def _parsed(spark, d):
    return _tree(_pages(spark, d))


def node_table(spark, d):
    """The node table, counted by page and tag."""
    return node_rows(_parsed(spark, d)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def node_links(spark, d):
    links = select_nodes("nodes", anywhere("nav"), child("ul"), child("li"), child("a"))
    return _parsed(spark, d).select("page_id", F.posexplode(node_attrs(links, "href")).alias("pos", "href"))


def node_path_links(spark, d):
    """The same links from the plain node table, by path."""
    links = node_rows(_parsed(spark, d)).where("path like '%/nav/ul/li/a'")
    return links.select("page_id", F.col("attrs")["href"].alias("href"))


def deep_headings(spark, d):
    """Headings of pages that 300 further elements are wrapped around."""
    wrapped = F.concat(F.repeat(F.lit("<div>"), 300), "html", F.repeat(F.lit("</div>"), 300))
    parsed = _tree(_pages(spark, d).select("page_id", wrapped.alias("html")))
    heads = node_texts(select_nodes("nodes", *[child("div")] * 3, anywhere("article"), child("h1")))
    return parsed.select("page_id", F.explode(heads).alias("heading"))


def node_heading(spark, d):
    heads = node_texts(select_nodes("nodes", anywhere("article"), child("h1")))
    return _parsed(spark, d).select("page_id", F.explode(heads).alias("heading"))


def ad_blocks(spark, d):
    texts = node_texts(select_nodes("nodes", anywhere("div", class_="ad")))
    return _parsed(spark, d).select("page_id", F.explode(texts).alias("ad"))


def facet_counts(spark, d):
    links = select_nodes("nodes", anywhere("nav"), child("ul"), child("li"), child("a"))
    names = node_texts(links)
    return _parsed(spark, d).select("page_id", F.size(names).alias("n"), F.array_join(names, "|").alias("names"))


def cards_with_reject(spark, d):
    """A card per page: the page number is required, the campaign optional."""
    param = lambda name: fn.get_url_param(F.col("url"), name)
    found = F.array_compact(F.array(param("utm_source")))
    rows = _pages(spark, d).select("page_id", param("page").alias("page"), fn.first_or_default(found).alias("campaign"))
    valid, rejects = dedup.split_valid(rows, dedup.missing_field(("page",)))
    return valid.unionByName(rejects, allowMissingColumns=True)


def _gallery_pages(spark, d):
    hrefs = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    shown = F.transform(hrefs, lambda h: site.markup('<img src="https://img.example.com{}.jpeg">', h))
    more = F.concat(
        site.markup('<a class="x thumbnail_link" href="/release/{}/images"></a>', F.col("page_id")),
        F.lit('<div id="view_images"><p>'),
        F.array_join(shown, "<br>"),
        F.lit("</p></div>"),
    )
    return _tree(_pages(spark, d).select("page_id", F.concat("html", more).alias("html")))


def gallery_link(spark, d):
    return extract.gallery_link(_gallery_pages(spark, d))


def gallery_images(spark, d):
    return extract.gallery_images(_gallery_pages(spark, d))


# --- ordered scans


def take_while(spark, d):
    """Turns of a conversation before its first long text."""
    turns = _table(spark, d, "conversations")
    return ordered.take_while(turns, ("conv_id",), "turn", F.length("text") <= 1500).select("conv_id", "turn", "n")


def take_while_list(spark, d):
    turns = _table(spark, d, "conversations")
    kept = ordered.take_while(turns, ("conv_id",), "turn", F.length("text") <= 1500)
    lists = ordered.assemble_list(kept, ("conv_id",), F.concat(F.col("n").cast("string"), F.lit("."), "role", F.lit("-"), "text"))
    return lists.select("conv_id", "list_no", F.array_join("items", "|").alias("items"))


def enumerate_rows(spark, d):
    orders = _table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return ordered.enumerate_rows(orders, ("o_custkey",), "o_orderkey")


def enumerate_sparse(spark, d):
    """The same by a column of far-apart numbers, a part of them missing."""
    orders = _table(spark, d, "orders").select("o_custkey", "o_orderkey")
    mixed = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") * 7919003 % (1 << 40)).alias("place")
    return ordered.enumerate_rows(orders.select("*", mixed), ("o_custkey",), "place")


def assemble_list(spark, d):
    """Order lists of each customer, five orders to a row."""
    lists = ordered.assemble_list(enumerate_rows(spark, d), ("o_custkey",), F.col("o_orderkey").cast("string"), chunk=5)
    return lists.select("o_custkey", "list_no", F.array_join("items", ",").alias("items"))


# --- deduplication and sets


def _event_tasks(spark, d):
    return _table(spark, d, "events").select("event_id", "user_id", "event_type")


def first_seen(spark, d):
    tasks = _event_tasks(spark, d).withColumn("fp", fn.fingerprint("user_id", "event_type"))
    return dedup.dedup_first(tasks, ("event_id",))


def dup_report(spark, d):
    return dedup.dup_report(_event_tasks(spark, d), ("user_id", "event_type"))


def _user_items(spark, d, event_type):
    events = _table(spark, d, "events").where(F.col("event_type") == event_type)
    return events.select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k")).withColumn(
        "fp", fn.fingerprint("user_id", "k")
    )


def unseen(spark, d):
    """Clicked items their user never bought, each once."""
    clicks = dedup.dedup_first(_user_items(spark, d, "click"), ("event_id",))
    return dedup.unseen(clicks, _user_items(spark, d, "purchase"))


def add_to_set(spark, d):
    return dedup.add_to_set(_user_items(spark, d, "click"), _user_items(spark, d, "purchase"), "fp")


def claim(spark, d):
    keys = _event_tasks(spark, d).select(fn.fingerprint("user_id", "event_type").alias("fp")).distinct()
    return dedup.claim(keys, 20)[0]


def claim_rest(spark, d):
    keys = _event_tasks(spark, d).select(fn.fingerprint("user_id", "event_type").alias("fp")).distinct()
    return dedup.claim(keys, 20)[1]


# --- upserts

EVENT_DOCS = upsert.Upsert(
    key="user_id",
    order="event_id bigint",
    types="user_id bigint, event_id bigint, value double, props string",
    carried={
        "click": ("event_id", "value"),
        "view": ("event_id", "props"),
        "purchase": ("event_id", "value", "props"),
        "signup": ("event_id",),
        "error": ("event_id",),
    },
)

ORDER_DOCS = upsert.Upsert(
    key="order_key",
    order="l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double",
    types="order_key bigint, status string, total double, part bigint, quantity double",
    carried={"order": ("status", "total"), "line": ("part", "quantity")},
)


def latest_fields(spark, d):
    return EVENT_DOCS.latest_fields(_table(spark, d, "events"), F.col("event_type"))


def upsert_catalogue(spark, d):
    """Events stored in three batches and a snapshot, the later events first."""
    events = _table(spark, d, "events")
    bought = F.col("event_type") == "purchase"
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    path = scratch_path(spark, "events")
    for n, part in enumerate((events.where(late & ~bought), events.where(bought), events.where(~late & ~bought))):
        catalogue.write_catalogue(EVENT_DOCS, EVENT_DOCS.state(part, F.col("event_type")), path, n)
        catalogue.compact(EVENT_DOCS, spark, path)
    return catalogue.read_catalogue(EVENT_DOCS, spark, path)


def merge_metrics(spark, d):
    """What the purchases change in the documents of all other events."""
    events = _table(spark, d, "events")
    before = EVENT_DOCS.latest_fields(events.where("event_type != 'purchase'"), F.col("event_type"))
    return upsert.merge_metrics(before, latest_fields(spark, d), "user_id")


def merge_sources(spark, d):
    """Orders and their last lines in one document each."""
    orders = _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
        F.lit(0).alias("l_linenumber"),
        *[F.lit(0).alias(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")],
    )
    lines = _table(spark, d, "lineitem").withColumns(
        {"order_key": F.col("l_orderkey"), "part": F.col("l_partkey"), "quantity": F.col("l_quantity")}
    )
    merged = ORDER_DOCS.merge(ORDER_DOCS.state(orders, "order"), ORDER_DOCS.state(lines, "line"))
    return ORDER_DOCS.documents(merged)


def _labelled(spark, d):
    docs, labels = _table(spark, d, "documents").select("doc_id", "lang"), _table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left")


def delete_where(spark, d):
    """Documents left when those labelled harmless go; unlabelled ones stay."""
    return upsert.delete_where(_labelled(spark, d), F.col("toxic") == 0)


def pending_scan(spark, d):
    docs = _labelled(spark, d).withColumns({"_id": F.col("doc_id"), "status": F.col("quality")})
    return dedup.pending_scan(docs).select("doc_id", "lang", "status")


# --- frontier


def start_requests(spark, d):
    """Start pages of the years the orders span."""
    first, last = _table(spark, d, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return frontier.start_requests(spark, first, last)


def _facet_items(spark, d):
    """Distinct part types, order priorities and nations as facet items."""
    columns = (("style", "part", "p_type"), ("format", "orders", "o_orderpriority"), ("country", "nation", "n_name"))
    items = None
    for facet, name, column in columns:
        counted = _table(spark, d, name).groupBy(F.col(column).alias("name")).agg(F.count("*").cast("string").alias("count"))
        one = counted.select(
            F.lit(facet).alias("facet"),
            F.lit(0).alias("pos"),
            "name",
            fn.facet_url_name(F.col("name")).alias("url_name"),
            "count",
            F.lit(None).cast("string").alias("reject"),
        )
        if facet == "style":
            one = one.where(fn.has_keyword(F.col("name"), ("ECO", "STAND")))
        items = one if items is None else items.unionByName(one)
    return items


def facet_lists(spark, d):
    lists = extract.facet_lists(_facet_items(spark, d))
    return lists.select("facet", *[F.array_join(c, "|").alias(c) for c in ("names", "url_names", "counts")])


def frontier_product(spark, d):
    return frontier.frontier_product(extract.facet_lists(_facet_items(spark, d)), YEARS)


def page_expansion(spark, d):
    """Result pages 2 to N of the customers of each nation, ten to a page."""
    counts = _table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    texts = counts.select("c_nationkey", F.concat(F.lit("1 – 10 of "), F.format_number("n", 0)).alias("text"))
    tasks = texts.select("c_nationkey", fn.page_count(F.col("text"), 10).alias("pages"))
    return frontier.follow_up_pages(tasks).select("c_nationkey", "page")


def union_tasks(spark, d):
    """First pages and follow-up pages of all searches as one set of tasks."""
    searches = site.releases(spark, d).groupBy(*site.SEARCH).agg(F.count("*").alias("n"))
    first = searches.withColumn("page", F.lit(1))
    pages = F.ceil(F.col("n") / site.PER_PAGE).cast("int")
    more = frontier.follow_up_pages(searches.withColumn("pages", pages))
    texts = frontier.task_project(more).withColumn("page", F.col("page").cast("string"))
    return dedup.dedup_first(frontier.union_tasks(first, texts, first), ("page",))


def _with_status(spark, d):
    """Pages cut off before their end count as status 201."""
    status = F.when(F.col("html").contains("</html>"), 200).otherwise(201)
    return _pages(spark, d).select("page_id", "url", status.alias("status"))


def ok_pages(spark, d):
    return retry.ok_pages(_with_status(spark, d)).select("page_id", "url")


def fetch_join(spark, d):
    """Fetch every URL with another fragment, and every URL at its page 3."""
    url = F.col("url")
    wanted = F.array(F.concat(fn.url_key(url), F.lit("#x")), fn.set_url_param(url, "page", 3))
    tasks = _pages(spark, d).select(F.col("page_id").alias("task_id"), F.posexplode(wanted).alias("kind", "url"))
    captures = frontier.newest_captures(_with_status(spark, d))
    return frontier.fetch_join(tasks, captures).select("task_id", "kind", "url", "page_id", "result")


def _edges(spark, d):
    """Links of the order tables: region, nation, customer, order, part, supplier, nation."""
    node = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    t = lambda name: _table(spark, d, name)
    pairs = (
        (t("nation"), node("r", "n_regionkey"), node("n", "n_nationkey")),
        (t("customer"), node("n", "c_nationkey"), node("c", "c_custkey")),
        (t("orders"), node("c", "o_custkey"), node("o", "o_orderkey")),
        (t("lineitem"), node("o", "l_orderkey"), node("p", "l_partkey")),
        (t("lineitem"), node("p", "l_partkey"), node("s", "l_suppkey")),
        (t("supplier"), node("s", "s_suppkey"), node("n", "s_nationkey")),
    )
    edges = None
    for rows, src, dst in pairs:
        one = rows.select(src.alias("src"), dst.alias("dst"))
        edges = one if edges is None else edges.unionByName(one)
    return edges


def frontier_rounds(spark, d):
    """Every node reached from one region, with the round that finds it."""
    region = _table(spark, d, "region").where("r_name = 'ASIA'")
    key = fn.fingerprint("node").alias("fp")
    seeds = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node")).select(key, "node")

    with bucketed(_edges(spark, d), "src") as edges:

        def expand(tasks):
            # only the tasks move, to the buckets; the edges are neither shuffled nor sorted
            asked = tasks.hint("shuffle_hash")
            return asked.join(edges, asked.node == edges.src).select(F.col("dst").alias("node")).select(key, "node")

        return frontier.frontier_rounds(seeds, expand, ("node",)).select("node", "round")


def retry_ledger(spark, d):
    """Errors as failed attempts, purchases as good ones, per user and item."""
    events = _table(spark, d, "events").where("event_type in ('error', 'purchase')")
    outcomes = events.select(
        fn.fingerprint("user_id", F.get_json_object("props", "$.k")).alias("fp"),
        F.col("event_id").alias("attempt"),
        (F.col("event_type") == "purchase").alias("ok"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("error"),
    )
    return retry.retry_ledger(outcomes)


# --- queues, images, streams


def task_roundtrip(spark, d):
    """Search tasks appended in two goes and read back."""
    path = scratch_path(spark, "queues")
    tasks = frontier_product(spark, d)
    for year in YEARS:
        task_source.append_tasks(tasks.where(F.col("year") == year), path, "search")
    return task_source.read_tasks(spark, path, "search", SEED_TASK)


def _page_images(spark, d):
    return _pages(spark, d).select(
        "page_id", fn.image_name(fn.url_key(F.col("url"))).alias("name"), F.encode("html", "utf-8").alias("content")
    )


def write_missing(spark, d):
    """Pages that were cut off, then all pages, stored as images by name."""
    path = scratch_path(spark, "images")
    rows = _page_images(spark, d)
    cut_off = ~F.decode("content", "utf-8").contains("</html>")
    images.write_missing_images(rows.where(cut_off), path, "page_id")
    images.write_missing_images(rows, path, "page_id")
    stored = spark.read.schema(images.IMAGE).parquet(path)
    return stored.select("name", F.md5("content").alias("digest"))


def image_files(spark, d):
    """A file per supplier, read back as images by name."""
    path = scratch_path(spark, "image-files")
    rows = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lower(F.hex(F.encode("s_name", "utf-8"))).alias("value"))
    images.write_files(rows, path, "key", "value", ".txt")
    files = page_source.read_images(spark, path, "*.txt")
    key = F.regexp_extract("path", r"key=([0-9]+)\.txt", 1).cast("long").alias("s_suppkey")
    return files.select(key, F.md5("content").alias("digest"))


EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(spark, d, max_files=2):
    path = scratch_path(spark, "event-files")
    settle(_table(spark, d, "events").repartition(6, "event_id"), "event-files", path)
    return page_source.read_pages_stream(spark, path, max_files, EVENT)


def stream_dedup(spark, d):
    keyed = _event_stream(spark, d).select("user_id", "event_type", fn.fingerprint("user_id", "event_type").alias("fp"))
    path, checkpoint = scratch_path(spark, "once"), scratch_path(spark, "once-checkpoint")
    streams.stream_dedup(keyed, path, checkpoint).awaitTermination()
    return spark.read.schema("user_id bigint, event_type string, fp string").parquet(path)


def stream_upsert(spark, d):
    path, checkpoint = scratch_path(spark, "upserts"), scratch_path(spark, "upserts-checkpoint")
    query = streams.stream_upsert(EVENT_DOCS, _event_stream(spark, d), F.col("event_type"), path, checkpoint)
    query.awaitTermination()
    return catalogue.read_catalogue(EVENT_DOCS, spark, path)


#: Drops of events that ``stream_metrics`` upserts one after another: those with ``event_id % DROPS == k``.
DROPS = 4


def stream_metrics(spark, d):
    """Events upserted in drops, one streamed batch each: per batch its inserted, modified and unchanged documents."""
    events = _table(spark, d, "events")
    source, path = scratch_path(spark, "metric-events"), scratch_path(spark, "metric-docs")
    checkpoint, metrics = scratch_path(spark, "metric-checkpoint"), scratch_path(spark, "metrics")
    for k in range(DROPS):
        events.where(F.col("event_id") % DROPS == k).coalesce(1).write.mode("append").parquet(source)
        stream = page_source.read_pages_stream(spark, source, 1, EVENT)
        streams.stream_upsert(EVENT_DOCS, stream, F.col("event_type"), path, checkpoint, metrics).awaitTermination()
    return spark.read.schema(streams.METRICS).parquet(metrics)


def stream_commit(spark, d):
    """Items tried by error and purchase events: seen once a purchase was among a batch."""
    events = _event_stream(spark, d, 2).where("event_type in ('error', 'purchase')")
    tasks = events.select(fn.fingerprint("user_id", "event_type").alias("fp"), "event_id", "event_type")
    seen, checkpoint = scratch_path(spark, "seen"), scratch_path(spark, "seen-checkpoint")

    def work(fresh, batch):
        return fresh.select("fp", (F.col("event_type") == "purchase").alias("ok"))

    streams.commit_after_success(tasks, work, ("event_id",), seen, checkpoint).awaitTermination()
    return streams.seen_tasks(spark, seen)


#: Event time of the streamed fetches: a task every 10 s from this instant; its page some 0 to 15 minutes later.
EPOCH, EVERY_S, WAIT_S, FILE_S = 1_704_067_200, 10, 600, 3_600
#: Files a stream is written in at most: each is a batch, whose cost is mostly fixed, so a longer span has longer files.
TIME_FILES = 4


def _time_files(rows: DataFrame, at: str, path: str, close: dict) -> None:
    """``rows`` as Parquet files of one or more whole hours of event time each, written in time order, then two closing marks.

    The rows are dealt to their files in one pass; a file is then written from its own rows alone.
    A closing mark is a row a day (two days) after all others: the watermarks of a stream pass
    every waiting row, as the next hours of a running crawl would.
    """
    spark = rows.sparkSession
    timed = settle(rows.where(F.col(at).isNotNull()).withColumn("_hour", F.floor(F.unix_timestamp(at) / FILE_S)), "timed")
    low, high, last = timed.agg(F.min("_hour"), F.max("_hour"), F.max(F.unix_timestamp(at))).first()
    if last is not None:
        hours = -(-(high - low + 1) // TIME_FILES)
        dealt = scratch_path(spark, "dealt")
        by_file = timed.withColumn("_file", F.floor((F.col("_hour") - low) / hours)).drop("_hour")
        by_file.repartition("_file").write.partitionBy("_file").parquet(dealt)
        for k in [r[0] for r in by_file.select("_file").distinct().sort("_file").collect()]:
            spark.read.schema(rows.schema).parquet(f"{dealt}/_file={k}").coalesce(1).write.mode("append").parquet(path)
    for days in (1, 2):
        when = F.timestamp_seconds(F.lit((EPOCH if last is None else last) + days * 86_400))
        cols = [
            when.alias(c) if c == at else F.lit(close.get(c)).cast(rows.schema[c].dataType).alias(c)
            for c in rows.columns
        ]
        spark.range(1).select(*cols).coalesce(1).write.mode("append").parquet(path)


def await_pages(spark, d):
    """Tasks of every page's URL and of its page 3; pages arrive after their tasks, a part of them too late.

    Tasks and captures stream in by hour of event time and meet in a stream-stream join: a capture
    within ``WAIT_S`` after issue fetches the task, a task that met none is released as failed.
    """
    pages = _pages(spark, d)
    url = F.col("url")
    issued = F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id") * EVERY_S)
    tasks = pages.select(
        F.col("page_id").alias("task_id"), F.posexplode(F.array(url, fn.set_url_param(url, "page", 3))).alias("kind", "url"), issued.alias("issued_at")
    )
    status = F.when(F.col("html").contains("</html>"), 200).otherwise(201)
    fetched = F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id") * EVERY_S + F.col("page_id") * 37 % 900)
    captures = pages.select("page_id", "url", status.alias("status"), fetched.alias("fetched_at"))
    task_path, page_path = scratch_path(spark, "task-stream"), scratch_path(spark, "page-stream")
    _time_files(tasks, "issued_at", task_path, {"task_id": -1, "kind": -1, "url": "close:"})
    _time_files(captures, "fetched_at", page_path, {"page_id": -1, "url": "close:", "status": 0})
    task_stream = spark.readStream.schema(tasks.schema).option("maxFilesPerTrigger", 1).parquet(task_path)
    page_stream = spark.readStream.schema(captures.schema).option("maxFilesPerTrigger", 1).parquet(page_path)
    met = streams.await_pages(task_stream, page_stream, f"{WAIT_S} seconds", f"{WAIT_S} seconds")
    out, checkpoint = scratch_path(spark, "awaited"), scratch_path(spark, "awaited-checkpoint")
    # the closing marks are dropped only from what was written: a filter in the stream would reach below the watermark
    streams.stream_to(met.select("task_id", "kind", "url", "page_id", "result"), out, checkpoint).awaitTermination()
    return spark.read.schema("task_id bigint, kind int, url string, page_id bigint, result string").parquet(out).where("task_id >= 0")


# --- the stages on the rendered site


def site_facets(spark, d):
    parsed = _tree(site.facet_pages(spark, d))
    found = extract.facets(parsed, keep=("page_id",)).where("reject is null")
    return found.select("page_id", "facet", "name", "url_name", "count", "count_n")


def seed_tasks(spark, d):
    return stages.seed_stage(site.facet_pages(spark, d), YEARS).drop("fp").distinct()


def pagination(spark, d):
    parsed = _tree(site.listing_pages(spark, d), "url")
    return extract.pagination(parsed, ("url",), site.PER_PAGE)


def pages_with_more(spark, d):
    """Search pages that hold at least one usable card."""
    facts = extract.cards(_tree(site.listing_pages(spark, d), "url"), keep=("url",))
    return facts.where("reject is null").select("url").distinct()


def site_cards(spark, d):
    parsed = _tree(site.listing_pages(spark, d), "url")
    return extract.cards(parsed, keep=("url",))


def site_covers(spark, d):
    return extract.cover(_tree(site.release_pages(spark, d), "url"), ("url",))


def tracklist(spark, d):
    parsed = _tree(site.release_pages(spark, d), "url")
    return extract.tracklist(parsed, ("url",)).select("url", F.array_join("title_list", "\n").alias("titles"))


def tracklist_past_gaps(spark, d):
    parsed = _tree(site.release_pages(spark, d), "url")
    found = extract.tracklist(parsed, ("url",), stop_at_gap=False)
    return found.select("url", F.array_join("title_list", "\n").alias("titles"))


def _index(spark, d):
    """The index stage on all result pages of the searches that the seeds name."""
    pages = settle(site.listing_pages(spark, d), "pages")
    captures = settle(frontier.newest_captures(pages), "captures")
    facts = settle(stages.page_facts(pages, stages.INDEX_FACTS), "facts")
    seeds = settle(dedup.dedup_first(stages.seed_stage(site.facet_pages(spark, d), YEARS), ("page",)), "seeds")
    more = stages.index_stage(seeds, captures, facts, AT, per_page=site.PER_PAGE).tasks
    every = settle(dedup.dedup_first(seeds.unionByName(more), ("page",)), "every-page")
    return stages.index_stage(every, captures, facts, AT, per_page=site.PER_PAGE)


def index_rows(spark, d):
    return _index(spark, d).rows.drop("pos", "index_time")


def index_rejects(spark, d):
    return _index(spark, d).rejects


def index_outcomes(spark, d):
    return _index(spark, d).outcomes.groupBy("ok", "error").agg(F.count("*").alias("n"))


def follow_up_tasks(spark, d):
    return _index(spark, d).tasks.drop("fp")


def detail_rows(spark, d):
    pages = settle(site.release_pages(spark, d), "pages")
    tasks = site.releases(spark, d).select(site.markup("/release/{}", F.col("key")).alias("url"))
    tasks = tasks.withColumn("fp", fn.fingerprint("url"))
    facts = settle(stages.page_facts(pages, stages.DETAIL_FACTS), "facts")
    done = stages.detail_stage(tasks, frontier.newest_captures(pages), facts, AT)
    return done.rows.select("obj_id", "cover_url", F.array_join("title_list", "\n").alias("titles"), "crawler_time")


def stage_outcomes(spark, d):
    """Outcomes of detail tasks where facts are missing for some pages and others have no HTML."""
    key = F.shiftright("page_id", 1)
    html = F.when(key % 5 != 0, F.col("html"))
    pages = settle(site.release_pages(spark, d).withColumn("html", html), "pages")
    tasks = site.releases(spark, d).select(site.markup("/release/{}", F.col("key")).alias("url"))
    tasks = tasks.withColumn("fp", fn.fingerprint("url"))
    facts = settle(stages.page_facts(pages.where(key % 11 != 0), stages.DETAIL_FACTS), "facts")
    done = stages.detail_stage(tasks, frontier.newest_captures(pages), facts, AT)
    return done.outcomes.groupBy("ok", "error").agg(F.count("*").alias("n"))


def linkless_cards(spark, d):
    """Cards of a page per supplier, whose link is missing, padded or plain."""
    key = F.col("s_suppkey")
    link = F.when(key % 3 == 0, F.lit("")).otherwise(
        site.markup(' href="{}"', F.when(key % 3 == 1, F.concat(F.lit(" /release/"), key.cast("string"), F.lit("\t\n"))).otherwise(F.concat(F.lit("/release/"), key.cast("string"))))
    )
    html = F.concat(
        F.lit(f'<div class="{extract.CARDS_CLASS}">'), site.markup('<div data-object-id="{}"><div class="card_body"><h4><span><a>x</a></span>', key),
        F.lit(f'<a class="{extract.TITLE_CLASS}"'), link, F.lit(">t</a></h4></div></div></div>"),
    )
    parsed = _tree(_table(spark, d, "supplier").select(key.alias("page_id"), html.alias("html")))
    return extract.cards(parsed, keep=("page_id",)).select("page_id", "obj_id", "detail_url", "reject")


def seed_tasks_ok(spark, d):
    """Search tasks of facet pages, of which every second year answers with status 500."""
    pages = site.facet_pages(spark, d)
    status = F.when(F.col("page_id") % 2 == 0, 200).otherwise(500)
    return stages.seed_stage(pages.withColumn("status", status), YEARS).drop("fp").distinct()


def _covers(spark, d):
    """Cover images of the releases: their texts as bytes, at the cover's URL."""
    docs = _table(spark, d, "documents")
    return docs.select(
        site.markup("https://img.example.com/R-{}.jpeg", F.col("doc_id")).alias("url"), F.encode("text", "utf-8").alias("content")
    )


def cover_rows(spark, d):
    """Detail rows together with the cover image as a data URI."""
    pages = settle(site.release_pages(spark, d), "pages")
    tasks = site.releases(spark, d).select(site.markup("/release/{}", F.col("key")).alias("url"))
    tasks = tasks.withColumn("fp", fn.fingerprint("url"))
    facts = settle(stages.page_facts(pages, stages.DETAIL_FACTS), "facts")
    done = stages.detail_stage(tasks, frontier.newest_captures(pages), facts, AT, images=_covers(spark, d))
    docs = stages.CATALOGUE.latest_fields(done.rows, "cover")
    return docs.select("obj_id", "cover_url", F.md5("base64url").alias("digest"), "detail_time")


def gallery_store(spark, d):
    """Image store filled from the galleries of all releases."""
    galleries, releases = site.gallery_pages(spark, d), site.release_pages(spark, d)
    pages = settle(releases.unionByName(galleries), "pages")
    facts = settle(stages.page_facts(pages, stages.GALLERY_FACTS), "facts")
    found = stages.gallery_stage(frontier.newest_captures(pages), facts, _covers(spark, d))
    path = scratch_path(spark, "gallery")
    images.write_missing_images(found, path, "img_url")
    stored = spark.read.schema(images.IMAGE).parquet(path)
    return stored.select("name", F.md5("content").alias("digest"))


def crawl_catalogue(spark, d):
    """All stages: seed, index rounds, detail, upsert."""
    pages = settle(site.listing_pages(spark, d).unionByName(site.release_pages(spark, d)), "pages")
    docs = stages.crawl(
        site.facet_pages(spark, d), pages, YEARS, per_page=site.PER_PAGE, at=AT
    )
    return docs.drop("base64url").withColumn("title_list", F.array_join("title_list", "\n"))


def _crawl_from_starts(spark, d, path):
    """All stages from start URLs to images; seed pages are part of the archive."""
    facets = site.facet_pages(spark, d).withColumn("page_id", -F.col("page_id") - (1 << 40))
    archive = facets.unionByName(site.listing_pages(spark, d)).unionByName(site.release_pages(spark, d))
    pages = settle(archive.unionByName(site.gallery_pages(spark, d)), "pages")
    starts = frontier.start_requests(spark, YEARS[0], YEARS[-1])
    return stages.crawl(None, pages, YEARS, path, per_page=site.PER_PAGE, at=AT, starts=starts, images=_covers(spark, d))


def crawl_covers(spark, d):
    """Covers of the catalogue that a crawl from start URLs makes."""
    docs = _crawl_from_starts(spark, d, scratch_path(spark, "crawl"))
    return docs.where("base64url is not null").select("obj_id", "artist", "cover_url", F.md5("base64url").alias("digest"))


def crawl_gallery(spark, d):
    """Image store of the same crawl: galleries of the details that were read."""
    path = scratch_path(spark, "crawl")
    _crawl_from_starts(spark, d, path)
    stored = spark.read.schema(images.IMAGE).parquet(f"{path}/images")
    return stored.select("name", F.md5("content").alias("digest"))


def stage_streams(spark, d):
    """The catalogue of both streamed stages, whose follow-up pages go back into the queue until none is new."""
    path = scratch_path(spark, "streamed")
    pages = settle(site.listing_pages(spark, d).unionByName(site.release_pages(spark, d)), "pages")
    captures = settle(frontier.newest_captures(pages), "captures")
    facts = settle(stages.page_facts(pages, stages.INDEX_FACTS + stages.DETAIL_FACTS), "facts")
    task_source.append_tasks(stages.seed_stage(site.facet_pages(spark, d), YEARS).drop("fp"), path, "search")
    stage_stream.index_until_empty(spark, path, captures, facts, at=AT, per_page=site.PER_PAGE)
    stage_stream.detail_stream(spark, path, captures, facts, at=AT).awaitTermination()
    docs = stage_stream.streamed_catalogue(spark, path)
    return docs.drop("base64url").withColumn("title_list", F.array_join("title_list", "\n"))


def requeue_failed(spark, d):
    """Detail tasks that are dead after three attempts: their page has no cover."""
    path = scratch_path(spark, "requeued")
    pages = settle(site.release_pages(spark, d), "pages")
    captures = settle(frontier.newest_captures(pages), "captures")
    facts = settle(stages.page_facts(pages, stages.DETAIL_FACTS), "facts")
    task_source.append_tasks(site.releases(spark, d).select(site.markup("/release/{}", F.col("key")).alias("url")), path, "detail")
    for _ in range(3):
        stage_stream.detail_stream(spark, path, captures, facts, at=AT).awaitTermination()
        dead = stage_stream.requeue_failed(spark, path, "detail")
    return dead


QUERIES = {
    f.__name__: f
    for f in (
        page_links, page_links_joined, link_tasks, page_title, page_fingerprint, url_param_get_set, url_tail,
        clean_facets, search_urls, image_uri, node_table, node_links, node_path_links, deep_headings, node_heading, ad_blocks,
        facet_counts, cards_with_reject, gallery_link, gallery_images, take_while, take_while_list, enumerate_rows,
        enumerate_sparse, assemble_list, first_seen, dup_report, unseen, add_to_set, claim, claim_rest, latest_fields,
        upsert_catalogue, merge_metrics, merge_sources, delete_where, pending_scan, start_requests, facet_lists,
        frontier_product, page_expansion, union_tasks, ok_pages, fetch_join, frontier_rounds, retry_ledger,
        task_roundtrip, write_missing, image_files, stream_dedup, stream_upsert, stream_metrics, stream_commit, await_pages, site_facets, seed_tasks,
        pagination, pages_with_more, site_cards, site_covers, tracklist, tracklist_past_gaps, index_rows,
        index_rejects, index_outcomes, follow_up_tasks, stage_outcomes, linkless_cards, seed_tasks_ok, detail_rows, cover_rows, gallery_store, crawl_catalogue,
        crawl_covers, crawl_gallery, stage_streams, requeue_failed,
    )
}
