"""Page archives and images, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetrawl.schemas import ARCHIVE_PAGE

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def read_pages(spark: SparkSession, path: str, schema: str = ARCHIVE_PAGE) -> DataFrame:
    """An archived page table."""
    return spark.read.schema(schema).parquet(path)


def read_pages_stream(spark: SparkSession, path: str, max_files: int = 1000, schema: str = ARCHIVE_PAGE) -> DataFrame:
    """Pages as they arrive in a folder, at most ``max_files`` files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


#: Tasks that list folders at most, per core: Spark's own choice is a task for each folder up to 10,000.
LIST_TASKS = 4
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Image files as rows ``path, content``, subfolders included.

    The files are listed once, here: by a few tasks of many folders each rather than a task a folder.
    """
    reader = spark.read.format("binaryFile").schema(BINARY_FILE)
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, LIST_TASKS * spark.sparkContext.defaultParallelism)
    try:
        return reader.options(**options).load(path).select("path", "content")
    finally:
        spark.conf.set(_LISTING, before)
