"""Queues, catalogue, images, on folders of their own."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import rows
from pagetrawl.functions import image_data_uri, image_name
from pagetrawl.operators.dedup import absent_only
from pagetrawl.schemas import IMAGE, PAGE, SEED_TASK
from pagetrawl.session import scratch_path, settle
from pagetrawl.sources.catalogue import compact, complete_parts, read_catalogue, write_catalogue
from pagetrawl.sources import images
from pagetrawl.sources.images import write_missing_images
from pagetrawl.sources.pages import read_images, read_pages, read_pages_stream
from pagetrawl.sources.tasks import append_batch, append_tasks, queue_path, read_tasks
from test_operators import TASK, SPEC, UPDATE


def test_scratch_is_below_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    path = scratch_path(spark, "x")
    assert path.startswith(f"{named.rstrip('/')}/x-") and path != scratch_path(spark, "x")
    kept = settle(spark.range(3), "kept")
    assert kept.count() == 3 and f"{named.rstrip('/')}/kept-" in kept.inputFiles()[0]


def test_pages_batch_and_stream(spark, tmp_path):
    path = str(tmp_path / "pages")
    data = [(f"http://h/{i}", 200 if i % 2 else 404, f"<p>{i}", None) for i in range(6)]
    spark.createDataFrame(data, PAGE).repartition(3).write.parquet(path)
    assert read_pages(spark, path, PAGE).count() == 6
    stream = read_pages_stream(spark, path, 1, PAGE)
    assert stream.isStreaming and stream.columns == ["url", "status", "html", "fetched_at"]
    sizes = []
    query = stream.writeStream.foreachBatch(lambda b, n: sizes.append(b.count())).trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert len(sizes) == 3 and sum(sizes) == 6  # one file a batch


def test_queue(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(AnalysisException):
        read_tasks(spark, path, "search", SEED_TASK)
    with pytest.raises(AnalysisException):
        read_tasks(spark, path, "search", SEED_TASK, streaming=True)
    one = spark.createDataFrame([TASK], SEED_TASK)
    append_tasks(one, path, "search")
    append_tasks(one, path, "search")
    append_batch(one, path, "search", 3)
    append_batch(one, path, "search", 3)  # a repeated batch counts once
    assert read_tasks(spark, path, "search", SEED_TASK).count() == 3
    stream = read_tasks(spark, path, "search", SEED_TASK, streaming=True)
    append_tasks(stream, path, "copy", str(tmp_path / "cp")).awaitTermination()
    assert rows(read_tasks(spark, path, "copy", SEED_TASK)) == [TASK] * 3
    assert queue_path("a/", "q") == "a/queue=q"


def test_catalogue_log_and_snapshot(spark, tmp_path):
    path = str(tmp_path / "cat")
    assert read_catalogue(SPEC, spark, path).count() == 0
    steps = [("1", "index", "Moment", None, "t1", 1, 0), ("1", "detail", None, "c1", "t2", 2, 0), ("1", "index", None, None, "t3", 3, 0)]
    expected = [("1", "Moment", None, "t1"), ("1", "Moment", "c1", "t2"), ("1", None, "c1", "t3")]
    for n, step in enumerate(steps):
        state = SPEC.state(spark.createDataFrame([step], UPDATE), F.col("source"))
        write_catalogue(SPEC, state, path, n)
        write_catalogue(SPEC, state, path, n)
        assert rows(read_catalogue(SPEC, spark, path)) == [expected[n]]
        compact(SPEC, spark, path)
        compact(SPEC, spark, path)
        # the last batch may have to be repeated and stays in the log
        assert complete_parts(spark, path, "v=") == list(range(n))
        assert rows(read_catalogue(SPEC, spark, path)) == [expected[n]]
    # a batch whose write never finished is not read
    (tmp_path / "cat" / "batch=2" / "_SUCCESS").unlink()
    assert rows(read_catalogue(SPEC, spark, path)) == [expected[1]]


def test_catalogue_of_two_writers(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for path, step in ((a, ("1", "index", "T", None, "t1", 1, 0)), (b, ("1", "detail", None, "c", "t2", 2, 0))):
        write_catalogue(SPEC, SPEC.state(spark.createDataFrame([step], UPDATE), F.col("source")), path, 0)
    assert rows(read_catalogue(SPEC, spark, a, b)) == [("1", "T", "c", "t2")]


def test_images(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "R-1.jpeg").write_bytes(b"\x00\xffone")
    (folder / "R-2.jpeg").write_bytes(b"two")
    (folder / "note.txt").write_text("no image")
    found = read_images(spark, str(folder), "*.jpeg")
    assert found.columns == ["path", "content"] and found.count() == 2
    uris = rows(found.select(image_name(F.col("path")), image_data_uri(F.col("content"))))
    assert uris == [("R-1", "data:image/jpg;base64,AP9vbmU="), ("R-2", "data:image/jpg;base64,dHdv")]

    store = str(tmp_path / "store")
    new = found.select(image_name(F.col("path")).alias("name"), "content", F.col("path").alias("seq"))
    write_missing_images(new.where("name = 'R-1'"), store, "seq")
    changed = new.withColumn("content", F.lit(b"other").cast("binary"))
    twice = changed.union(changed.withColumn("seq", F.concat("seq", F.lit("x"))).withColumn("content", F.lit(b"later").cast("binary")))
    write_missing_images(twice, store, "seq")
    stored = spark.read.schema(IMAGE).parquet(store)
    assert [(r.name, bytes(r.content)) for r in stored.orderBy("name").collect()] == [("R-1", b"\x00\xffone"), ("R-2", b"other")]
    assert absent_only(new, stored, "name").count() == 0


def test_data_without_commit_marks_is_an_error(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=0")
    with pytest.raises(ValueError, match="_SUCCESS"):
        complete_parts(spark, path, "batch=")
    assert complete_parts(spark, str(tmp_path / "none"), "batch=") == []


def test_files_of_many_keys_in_few_folders(spark, tmp_path):
    """A file a key, its lines together, but no folder a key; listing leaves the session's setting as it was."""
    data = [(i, f"t{i}") for i in range(600)] + [(7, "t7"), (8, None), (None, "n")]
    path = str(tmp_path / "files")
    images.write_files(spark.createDataFrame(data, "key long, value string"), path, "key", "value", ".txt")
    assert len(list((tmp_path / "files").iterdir())) <= images.FOLDERS
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    found = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in read_images(spark, path, "*.txt").collect()}
    assert spark.conf.get(listing) == before
    assert len(found) == 601 and found["key=599.txt"] == b"t599\n" and found["key=7.txt"] == b"t7\nt7\n"
    assert sorted(found["key=8.txt"]) == sorted(b"t8\n\n") and found[f"key={images.NULL_KEY}.txt"] == b"n\n"


def test_wide_batches_merge_repeated_keys_only(spark, tmp_path, monkeypatch):
    from pagetrawl.operators.upsert import Upsert
    from pagetrawl.sources.catalogue import read_catalogue, write_catalogue

    spec = Upsert("k", "at int", "k string, v string", {"one": ("v",)})
    data = [(f"k{i}", 1, "x") for i in range(50)] + [("k7", 3, "y"), ("k7", 2, "z"), (None, 1, "n"), (None, 2, None)]
    state = spec.state(spark.createDataFrame(data, "k string, at int, v string"), "one")
    expected, moved, merge = rows(spec.documents(spec.merge(state))), [], Upsert.merge

    def counted(self, *states):
        moved.append(states[0].count())
        return merge(self, *states)

    with monkeypatch.context() as patch:
        patch.setattr(Upsert, "merge", counted)
        write_catalogue(spec, state, str(tmp_path / "c"), 0, wide=True)
    assert moved == [5]  # three rows of k7, two without a key
    assert rows(read_catalogue(spec, spark, str(tmp_path / "c"))) == expected


def test_images_are_coded_after_the_last_write_of_a_stage(spark, monkeypatch):
    from pagetrawl.plans import queries, stages

    written, settle = [], stages.settle

    def noted(df, label, path=None):
        written.append(df.columns)
        return settle(df, label, path)

    with monkeypatch.context() as patch:
        patch.setattr(stages, "settle", noted)
        assert queries.cover_rows(spark, "/root/testdata/sf0.001").count() > 0
    assert written and not any("base64url" in c for c in written)
