"""Streams against batch: drops, restarts, redelivery, the stages on queues."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pagetrawl.functions import fingerprint
from pagetrawl.operators.extract import card_rows
from pagetrawl.operators.frontier import newest_captures
from pagetrawl.plans import site, stages
from pagetrawl.session import settle
from pagetrawl.sources.catalogue import complete_parts, read_catalogue
from pagetrawl.sources.pages import read_pages_stream
from pagetrawl.sources.tasks import append_tasks
from pagetrawl.streaming import streams
from pagetrawl.streaming.stage_streams import (
    detail_stream,
    index_stream,
    requeue_failed,
    stage_outcomes,
    streamed_catalogue,
)
from pagetrawl.streaming.streams import commit_after_success, stream_dedup, stream_upsert
from test_operators import SPEC, UPDATE

SF = "/root/testdata/sf0.001"
TASK = "n int, name string"


def drop(spark, data, path, schema=TASK):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_dedup_over_drops_and_a_restart(spark, tmp_path):
    source, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    first = [(i, f"t{i % 7}") for i in range(30)]
    second = [(i, f"t{i % 11}") for i in range(30)]
    for data in (first, second):  # each run is a new query on the same checkpoint
        drop(spark, data, source)
        tasks = read_pages_stream(spark, source, 1, TASK).withColumn("fp", fingerprint("name"))
        stream_dedup(tasks, out, cp).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 11 and {r.name for r in got.collect()} == {f"t{i}" for i in range(11)}


def test_dedup_within_a_watermark(spark, tmp_path):
    source, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    drop(spark, [("a", 0), ("a", 1), ("b", 2)], source, "name string, s int")
    tasks = read_pages_stream(spark, source, 1, "name string, s int").withColumn("fp", fingerprint("name"))
    timed = tasks.withColumn("at", F.timestamp_seconds("s"))
    stream_dedup(timed, out, cp, within=("at", "10 minutes")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_upsert_equals_batch(spark, tmp_path):
    source, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    data = [(f"k{i % 5}", "index" if i % 3 else "detail", f"v{i}", f"v{i}", f"{i:03}", i * 7 % 20, i) for i in range(20)]
    for part in (data[:8], data[8:]):
        drop(spark, part, source, UPDATE)
        updates = read_pages_stream(spark, source, 1, UPDATE)
        stream_upsert(SPEC, updates, F.col("source"), out, cp).awaitTermination()
    batch = SPEC.latest_fields(spark.createDataFrame(data, UPDATE), F.col("source"))
    assert rows(read_catalogue(SPEC, spark, out)) == rows(batch)
    assert complete_parts(spark, out, "batch=") == [0, 1]


def test_pages_stream_through_extraction(spark, tmp_path):
    source, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    pages = site.listing_pages(spark, SF)
    pages.repartition(4).write.parquet(source)
    stream = stages.page_facts(read_pages_stream(spark, source, 1))
    found = card_rows(stream, "cards", ("page_id",)).where("reject is null")
    query = found.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", cp).start(out)
    query.awaitTermination()
    batch = card_rows(stages.page_facts(pages), "cards", ("page_id",)).where("reject is null")
    assert rows(spark.read.parquet(out)) == rows(batch) and batch.count() > 50


def test_failed_tasks_stay_unseen(spark, tmp_path):
    source, seen, cp = (str(tmp_path / p) for p in ("in", "seen", "cp"))
    worked = []

    def run(fails):
        def work(fresh, number):
            worked.append(sorted(r.name for r in fresh.collect()))
            return fresh.select("fp", (~F.col("name").isin(fails)).alias("ok"))

        tasks = read_pages_stream(spark, source, 10, TASK).withColumn("fp", fingerprint("name"))
        commit_after_success(tasks, work, ("n",), seen, cp).awaitTermination()

    drop(spark, [(1, "a"), (2, "b"), (3, "a")], source)
    run(["b"])
    drop(spark, [(4, "a"), (5, "b"), (6, "c")], source)  # both are delivered again
    run(["none"])
    drop(spark, [(7, "a"), (8, "b"), (9, "c")], source)
    run(["none"])
    assert worked == [["a", "b"], ["b", "c"], []]


def test_a_batch_that_fails_is_repeated(spark, tmp_path):
    source, seen, cp = (str(tmp_path / p) for p in ("in", "seen", "cp"))
    runs = []

    def work(fresh, number):
        runs.append((number, sorted(r.name for r in fresh.collect())))
        if len(runs) == 1:
            raise RuntimeError("lost")
        return fresh.select("fp", F.lit(True).alias("ok"))

    drop(spark, [(1, "a"), (2, "b")], source)
    for attempt in range(2):
        tasks = read_pages_stream(spark, source, 10, TASK).withColumn("fp", fingerprint("name"))
        query = commit_after_success(tasks, work, ("n",), seen, cp)
        if attempt == 0:
            with pytest.raises(Exception):
                query.awaitTermination()
        else:
            query.awaitTermination()
    assert runs == [(0, ["a", "b"])] * 2
    assert spark.read.parquet(f"{seen}/batch=0").count() == 2


def test_stage_streams_equal_the_batch_crawl(spark, tmp_path):
    path = str(tmp_path / "run")
    pages = settle(site.listing_pages(spark, SF).unionByName(site.release_pages(spark, SF)), "pages")
    seed_pages = settle(site.facet_pages(spark, SF), "seeds")
    at = "2020-01-02 03:04:05"
    batch = stages.crawl(seed_pages, pages, [2000, 2001], per_page=site.PER_PAGE, at=at)

    captures, facts = settle(newest_captures(pages), "captures"), settle(stages.page_facts(pages), "facts")
    append_tasks(stages.seed_stage(seed_pages, [2000, 2001]).drop("fp"), path, "search")
    for _ in range(3):  # the seeds, the pages they lead to, nothing new
        index_stream(spark, path, captures, facts, at=at, per_page=site.PER_PAGE).awaitTermination()
    detail_stream(spark, path, captures, facts, at=at).awaitTermination()

    assert batch.count() > 50
    assert rows(streamed_catalogue(spark, path)) == rows(batch)
    for stage in ("index", "detail"):
        outcomes = stage_outcomes(spark, path, stage)
        assert {r.error for r in outcomes.where("not ok").collect()} <= {"no page", "no cover"}
        assert outcomes.where("ok").groupBy("fp").count().where("count > 1").isEmpty()


def test_failed_tasks_are_tried_three_times(spark, tmp_path):
    path = str(tmp_path / "run")
    html = '<meta property="og:image" content="c"><div id="page_content"></div>'
    page = lambda i, status: (i, f"{stages.BASE_URL}/release/{i}", status, html)
    archive = lambda data: spark.createDataFrame(data, "page_id bigint, url string, status int, html string")
    append_tasks(spark.createDataFrame([("/release/1",), ("/release/2",), ("/release/3",)], "url string"), path, "detail")

    def run(data):
        pages = archive(data)
        captures, facts = newest_captures(pages), settle(stages.page_facts(pages), "facts")
        detail_stream(spark, path, captures, facts, at="2020-01-02 03:04:05").awaitTermination()
        return rows(requeue_failed(spark, path, "detail").select("attempts", "last_error"))

    assert run([page(1, 200), page(2, 404)]) == []
    assert run([page(1, 200), page(2, 200), page(3, 500)]) == []  # the second is there now
    assert run([page(3, 503)]) == [(3, "status 503")]
    assert run([page(3, 200)]) == [(3, "status 503")]  # dead: not tried again
    assert {r.obj_id for r in streamed_catalogue(spark, path).collect()} == {"1", "2"}
    attempts = stage_outcomes(spark, path, "detail").groupBy("fp").agg(F.count("*").alias("n"))
    assert sorted(r.n for r in attempts.collect()) == [1, 2, 3]


def test_the_seen_set_is_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FOLD_AFTER", 3)
    source, seen, cp = (str(tmp_path / p) for p in ("in", "seen", "cp"))
    for n in range(8):
        drop(spark, [(n, f"t{n}"), (n + 100, "again")], source)
        tasks = read_pages_stream(spark, source, 10, TASK).withColumn("fp", fingerprint("name"))
        work = lambda fresh, number: fresh.select("fp", F.lit(True).alias("ok"))
        commit_after_success(tasks, work, ("n",), seen, cp).awaitTermination()
    assert complete_parts(spark, seen, "v=") == [2, 5]
    found = [r.fp for r in streams.seen_tasks(spark, seen).collect()]
    assert len(found) == len(set(found)) == 9


def test_tasks_wait_for_pages_that_arrive_later(spark, tmp_path):
    """Pages come in later batches than their tasks; one within the wait, one past it, one never."""
    task_schema = "task_id bigint, url string, issued_at timestamp"
    page_schema = "page_id bigint, url string, status int, fetched_at timestamp"

    def file(folder, schema, rows):
        at = schema.split(", ")[-1].split()[0]
        df = spark.createDataFrame(rows, schema.replace("timestamp", "long"))
        df.withColumn(at, F.timestamp_seconds(F.lit(1_704_067_200) + F.col(at))).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))

    file("tasks", task_schema, [(1, "http://a.example/x#frag", 0), (2, "http://a.example/y", 0), (3, "http://a.example/z", 10)])
    file("pages", page_schema, [(10, "http://a.example/x", 200, 100)])
    file("pages", page_schema, [(11, "http://a.example/y", 200, 900), (12, "http://a.example/x", 201, 500)])
    for days in (1, 2):  # closing marks
        file("tasks", task_schema, [(-1, "close:", 86_400 * days)])
        file("pages", page_schema, [(-1, "close:", 0, 86_400 * days)])
    read = lambda folder, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
    met = streams.await_pages(read("tasks", task_schema), read("pages", page_schema), "600 seconds", "60 seconds")
    streams.stream_to(met.select("task_id", "page_id", "result"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("task_id >= 0")
    assert rows(got) == [(1, 10, "ok"), (1, 12, "unhandled"), (2, None, "failed"), (3, None, "failed")]


def test_small_batches_ask_the_seen_set_by_list(spark, tmp_path, monkeypatch):
    """After a fold, a batch of few fingerprints reads only their buckets, by a list pushed to the scan."""
    monkeypatch.setattr(streams, "FOLD_AFTER", 3)
    path = str(tmp_path / "seen")
    for n in range(4):
        spark.range(n * 500, n * 500 + 500).select(F.sha2(F.col("id").cast("string"), 256).alias("fp")).write.parquet(f"{path}/batch={n}")
    fresh = spark.range(0, 3000, 250).select(F.sha2(F.col("id").cast("string"), 256).alias("fp"))
    known = streams.seen_among(spark, path, 10, fresh)
    assert known.count() == 8  # ids 0 to 1750 were seen
    assert streams.seen_tasks(spark, path).count() == 2000
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[b#\d+ INSET", plan) and "PushedFilters: [In(fp" in plan


def test_upsert_counts_each_batch_in_its_write(spark, tmp_path):
    """Inserted, modified and unchanged per batch, observed while writing, equal the full join of before and after."""
    from pagetrawl.operators.upsert import merge_metrics

    source, out, cp, metrics = (str(tmp_path / p) for p in ("in", "out", "cp", "metrics"))
    data = [(f"k{i % 5}", "index" if i % 3 else "detail", f"v{i}", f"v{i}", f"{i:03}", i * 7 % 20, i) for i in range(20)]
    data += [data[0], data[3]]  # writes that change nothing
    parts = (data[:8], data[8:14], data[14:] + [(f"k{9}", "index", "x", "x", "000", 1, 99)])
    expected = []
    for number, part in enumerate(parts):
        before = read_catalogue(SPEC, spark, out) if number else None
        drop(spark, part, source, UPDATE)
        stream_upsert(SPEC, read_pages_stream(spark, source, 1, UPDATE), F.col("source"), out, cp, metrics).awaitTermination()
        after = read_catalogue(SPEC, spark, out)
        keys = spark.createDataFrame(part, UPDATE).select(SPEC.key).distinct()
        old = before.join(keys, SPEC.key, "left_semi") if before is not None else after.limit(0)
        counts = merge_metrics(old, after.join(keys, SPEC.key, "left_semi"), SPEC.key).first()
        expected.append((number, *counts))
    got = spark.read.parquet(metrics).select("batch", "inserted", "modified", "unchanged")
    assert rows(got) == sorted(expected, key=str)
    assert rows(read_catalogue(SPEC, spark, out)) == rows(SPEC.latest_fields(spark.createDataFrame(data + list(parts[2][-1:]), UPDATE), F.col("source")))


def test_time_files_are_few_and_in_order(spark, tmp_path):
    """Forty hours of event time: a few files of whole hours, earlier hours in earlier files, every row once."""
    from pagetrawl.plans import queries

    path = str(tmp_path / "timed")
    at = F.timestamp_seconds(F.lit(queries.EPOCH) + F.col("id") * 1800).alias("at")
    queries._time_files(spark.range(80).select("id", at).union(spark.sql("select 99L, cast(null as timestamp)")), "at", path, {"id": -1})
    files = sorted((tmp_path / "timed").glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    ids = [[r.id for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(files) <= queries.TIME_FILES + 2 and ids[-2:] == [[-1], [-1]]
    assert [i for part in ids[:-2] for i in sorted(part)] == list(range(80))
