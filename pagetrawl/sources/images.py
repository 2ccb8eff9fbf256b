"""The image store: rows ``name, content``, one per name; and plain files, one per key."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.operators.dedup import absent_only
from pagetrawl.schemas import IMAGE

# the file writer travels with the plan: workers need no copy of this package
register_pickle_by_value(sys.modules[__name__])

#: Folders that the files of :func:`write_files` are dealt over: few to list, none too large.
FOLDERS = 256
NULL_KEY = "__HIVE_DEFAULT_PARTITION__"


def missing_images(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """The images to write: absent names, each once, the first by ``order``.

    ``order`` is unique. Which rows win is settled on names alone; image bytes
    are read only for those.
    """
    winners = absent_only(new.groupBy("name").agg(F.min(order).alias(order)), existing, "name")
    return new.join(winners, ["name", order], "left_semi").select("name", "content")


def write_missing_images(new: DataFrame, path: str, order: str) -> None:
    """Add the images whose names are not stored yet; stored ones stay as they are."""
    spark = new.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    existing = spark.read.schema(IMAGE).parquet(path) if there else spark.createDataFrame([], IMAGE)
    missing_images(new, existing, order).write.mode("append").parquet(path)


def write_files(rows: DataFrame, path: str, key: str, text: str, suffix: str = "") -> None:
    """The lines ``text`` of each ``key`` as a file ``key=<key><suffix>`` below ``path``, in one of ``FOLDERS`` folders.

    The files are written in place by the tasks, over Arrow's file systems: no folder a key to make,
    list and move. A task that is repeated writes the same files again. A null line is an empty one.
    """
    spark = rows.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toUri()
    # Hadoop names a local path file:/x, Arrow file:///x
    base = f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()
    folder = F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int").alias("folder")
    lines = rows.select(folder, F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY)).alias("key"), F.col(text).alias("line"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def write(batches):
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(base)
        made, held, out, files = set(), None, None, 0
        for batch in batches:
            for number, name, line in zip(*[c.to_pylist() for c in batch.columns]):
                if name != held:
                    if out is not None:
                        out.close()
                    if number not in made:
                        store.create_dir(f"{root}/{number}", recursive=True)
                        made.add(number)
                    out, held, files = store.open_output_stream(f"{root}/{number}/key={name}{suffix}"), name, files + 1
                out.write(f"{line or ''}\n".encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    lines.repartition(n, "folder").sortWithinPartitions("key").mapInArrow(write, "files long").agg(F.sum("files")).collect()
