"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Job settings the operators count on; the cluster's own values may override.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # pages are wide rows: few per Arrow batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # call-site capture doubles the time to build the long selector expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores="*", **conf) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pagetrawl")
    settings = {
        **DEFAULTS,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor reach: ``spark.checkpoint.dir`` as the cluster names it.

    A session without one fails on a cluster. Only a local session (tests, benchmarks) gets a
    folder of this machine, set once as the session's checkpoint folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagetrawl-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below :func:`shared_folder`."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends at the written table.

    Used where a frame feeds several outputs, or a loop; what it holds
    survives the loss of executors.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """The distinct rows of ``df``, written once in buckets of ``key``: joins on it do not shuffle them again.

    For a frame that a loop joins over and over. The table is known to the session's catalogue
    inside the block only; its files are scratch files.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    # dealt by the key first: the rows to compare are together then, one shuffle does for both
    rows = df.repartition(n, key).distinct()
    rows.write.bucketBy(n, key).option("path", scratch_path(spark, name)).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table {name}")


def page_batches(spark: SparkSession) -> None:
    """Few wide rows per Arrow batch, as in ``DEFAULTS``, in a session that names no number itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, DEFAULTS[key])


#: Bytes of an Arrow batch of texts: both ends of the pipe to Python hold a batch, and buffers of about twice its size.
TEXT_BATCH = "2m"
#: Rows that the Parquet reader holds at once: with Spark's 4096, a column of texts is an array of 8 to 16 MB in each task.
TEXT_ROWS = "512"


def text_batches(spark: SparkSession) -> None:
    """Few whole texts at once, in a session that names no sizes itself: Arrow batches of bounded bytes (narrow rows are
    batched as before), and short batches of the Parquet reader."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH), ("spark.sql.parquet.columnarReaderBatchSize", TEXT_ROWS)):
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` on all cores, for work that costs far more than moving its rows.

    An input of fewer splits than there are cores is repartitioned by
    ``key``, which should be unique; at most one split per core is moved.
    Larger inputs have enough splits and stay where they are.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * split else df


def _bytes(setting: str) -> int:
    units = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    text = setting.lower().removesuffix("b") or "0"
    return int(text[:-1]) << units[text[-1]] if text[-1] in units else int(text)
