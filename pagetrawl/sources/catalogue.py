"""The catalogue on storage: a log of merged batches and, now and then, a snapshot.

A batch adds only its own rows (``batch=N``), so the cost of an upsert does not
grow with the catalogue; a batch that is written again replaces itself.
``compact`` folds the log into a snapshot (``v=N`` covers batches up to N).
Readers take the newest complete snapshot and the complete batches after it.
Each writer has a path of its own and a reader may merge several. Keep the path
together with the checkpoint of the stream that writes it: batch numbers start
over with a fresh checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.operators.upsert import Upsert
from pagetrawl.session import settle

#: Up to so many keys that come several times in a wide batch are broadcast; with more, all rows are shuffled.
BROADCAST_KEYS = 1_000_000


def complete_parts(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers N of the folders ``<prefix>N`` below ``path`` whose write has committed.

    A commit shows by its ``_SUCCESS`` file. Folders of data of which none has one come from a
    writer that makes no such files, and are an error rather than an empty store.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path

    def found(name: str):
        pattern = path_of(f"{path}/{prefix}*/{name}")
        return pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)

    files = found("_SUCCESS")
    if not files and found("*.parquet"):
        raise ValueError(f"{path} holds data without _SUCCESS files: set mapreduce.fileoutputcommitter.marksuccessfuljobs")
    return sorted(int(f.getPath().getParent().getName()[len(prefix) :]) for f in files or [])


def write_catalogue(spec: Upsert, state: DataFrame, path: str, batch: int, wide: bool = False) -> None:
    """Upsert one batch of updates (``spec.state`` rows, any number per key).

    With ``wide`` (texts, images) keys are counted first, and rows whose key comes once are written where
    they are: only the others are shuffled and merged. ``state`` is then read twice; settle it first when it is costly.
    """
    merged = _merged_repeats(spec, state) if wide else spec.merge(state)
    merged.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _merged_repeats(spec: Upsert, state: DataFrame) -> DataFrame:
    """``spec.merge(state)`` that moves only the rows of keys that come several times."""
    counts = state.groupBy(F.col(spec.key).alias("_key")).agg(F.count("*").alias("_n"))
    repeated = settle(counts.where("_n > 1").select("_key"), "repeated-keys")
    if repeated.count() > BROADCAST_KEYS:
        return spec.merge(state)
    again, same = F.broadcast(repeated), F.col(spec.key).eqNullSafe(F.col("_key"))
    return state.join(again, same, "left_anti").unionByName(spec.merge(state.join(again, same, "left_semi")))


def _parts(spark: SparkSession, path: str, below: int | None = None) -> list[str]:
    """The folders that make up what one writer has stored (before batch ``below``)."""
    base = complete_parts(spark, path, "v=")[-1:]
    batches = [n for n in complete_parts(spark, path, "batch=") if not base or n > base[0]]
    kept = [n for n in batches if below is None or n < below]
    return [f"{path}/v={n}" for n in base] + [f"{path}/batch={n}" for n in kept]


def _merged(spec: Upsert, spark: SparkSession, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], spec.schema)
    state = spark.read.schema(spec.schema).parquet(*parts)
    return state if len(parts) == 1 else spec.merge(state)


def catalogue_state(spec: Upsert, spark: SparkSession, *paths: str) -> DataFrame:
    """The merged rows of everything written so far, by one writer or several."""
    return _merged(spec, spark, [part for path in paths for part in _parts(spark, path)])


def state_before(spec: Upsert, spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The merged rows of what one writer stored before batch ``batch``."""
    return _merged(spec, spark, _parts(spark, path, batch))


def read_catalogue(spec: Upsert, spark: SparkSession, *paths: str) -> DataFrame:
    """The catalogue: one row per key, every field as last written."""
    return spec.documents(catalogue_state(spec, spark, *paths))


def compact(spec: Upsert, spark: SparkSession, path: str) -> None:
    """Fold the log into a snapshot, but for its last batch.

    That one a stream may still have to repeat; all before it are final.
    """
    *final, last = complete_parts(spark, path, "batch=") or [0]
    parts = _parts(spark, path, last)
    if final and parts[-1] == f"{path}/batch={final[-1]}":
        _merged(spec, spark, parts).write.mode("overwrite").parquet(f"{path}/v={final[-1]}")
