"""Batches of texts between Spark and Python have bounded bytes."""

import gc

import pyarrow as pa
from pyspark.sql import functions as F

from pagetrawl.llm import common, learn, near_dedup, packing
from pagetrawl.llm.queries import vocabulary
from pagetrawl.session import TEXT_BATCH, text_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_texts_are_bounded(spark):
    named = KEY in spark.conf.getAll
    if named:
        spark.conf.unset(KEY)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    try:
        docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("some words "), 300).alias("text"))
        assert learn.only(docs, lambda texts: [True] * len(texts)).count() == 4000
        told = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        assert told.agg(F.max("n")).first()[0] < 3 << 20
        spark.conf.set(KEY, "5m")
        text_batches(spark)
        assert spark.conf.get(KEY) == "5m" != TEXT_BATCH
    finally:
        spark.conf.unset(KEY)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _alive(kind) -> int:
    gc.collect()
    return sum(isinstance(x, kind) and (not isinstance(x, dict) or len(x) > 0) for x in gc.get_objects())


def test_a_worker_keeps_the_caches_of_one_operator():
    path = vocabulary("byte_bpe_50k.json")
    assert common.encoder(path, True) is common.encoder(path, True)
    near_dedup.shingle_sets(["one two three four five six"])
    assert _alive(common.TextEncoder) == 0 and _alive(near_dedup.WordHashes) == 1
    near_dedup.shingle_sets(["seven eight"])
    assert _alive(near_dedup.WordHashes) == 1
    assert len(common.encoder(path, True)("seven eight")) > 0
    assert _alive(near_dedup.WordHashes) == 0


def test_classifiers_begin_without_caches(spark):
    """After packing, in the workers that packed."""
    docs = spark.range(0, 40, 1, 4).selectExpr("id as doc_id", "'some words' as text")
    assert packing.pack(docs, vocabulary("byte_bpe_50k.json")).count() >= 40

    def empty(texts):
        import gc

        gc.collect()
        found = [x for x in gc.get_objects() if type(x).__name__ == "TextEncoder"]
        return [not found] * len(texts)

    assert learn.only(docs, empty).count() == 40
    found = learn.score_texts(docs, lambda texts: [float(x) for x in empty(texts)])
    assert found.agg(F.min("score")).first()[0] == 1.0


def test_the_reader_holds_few_texts(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    named = key in spark.conf.getAll
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        text_batches(spark)
        assert int(spark.conf.get(key)) <= 512
        spark.conf.set(key, "1000")
        text_batches(spark)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before) if named else spark.conf.unset(key)
