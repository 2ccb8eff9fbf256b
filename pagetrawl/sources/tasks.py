"""Named task queues as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def queue_path(path: str, queue: str) -> str:
    return f"{path.rstrip('/')}/queue={queue}"


def append_tasks(tasks: DataFrame, path: str, queue: str, checkpoint: str | None = None, writer: str = "stream"):
    """Append tasks to a queue, which is made when absent.

    A streaming frame needs a ``checkpoint``; the started query is returned
    and ends when all input that was there has been appended.
    """
    if not tasks.isStreaming:
        tasks.write.mode("append").parquet(queue_path(path, queue))
        return None
    step = lambda batch, number: append_batch(batch, path, queue, number, writer)
    start = tasks.writeStream.foreachBatch(step).trigger(availableNow=True)
    return start.option("checkpointLocation", checkpoint).start()


def append_batch(tasks: DataFrame, path: str, queue: str, batch: int, writer: str = "batch") -> None:
    """Append the tasks of one micro-batch; a repeated batch replaces itself."""
    tasks.write.mode("overwrite").parquet(f"{queue_path(path, queue)}/{writer}={batch}")


def read_tasks(spark: SparkSession, path: str, queue: str, schema: str, streaming: bool = False, max_files: int = 1000):
    """Tasks of a queue; reading one that nobody has made is an error."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if streaming else spark.read
    return reader.schema(schema).option("recursiveFileLookup", "true").parquet(queue_path(path, queue))
