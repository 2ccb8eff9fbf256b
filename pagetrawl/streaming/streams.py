"""Streaming forms: deduplication, upsert, and work that commits after success.

All queries use ``availableNow``: they take what is there in bounded batches
and end. How much one batch takes is set where the stream is read
(``max_files``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.functions.urls import url_key
from pagetrawl.operators.dedup import dedup_first
from pagetrawl.operators.retry import fetch_result
from pagetrawl.operators.upsert import Upsert
from pagetrawl.session import settle
from pagetrawl.sources.catalogue import complete_parts, state_before, write_catalogue


def stream_dedup(tasks: DataFrame, path: str, checkpoint: str, within: tuple[str, str] | None = None):
    """Append each task once, by fingerprint ``fp``.

    Fingerprints are remembered for ever, as a seen set is; the state grows
    with the number of distinct tasks and belongs in RocksDB. ``within``
    (event-time column, delay) bounds it, which is another contract: a copy
    that comes later than the delay is let through.
    """
    if within:
        first = tasks.withWatermark(*within).dropDuplicatesWithinWatermark(["fp"])
    else:
        first = tasks.dropDuplicates(["fp"])
    writer = first.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start(path)


def stream_upsert(spec: Upsert, updates: DataFrame, source, path: str, checkpoint: str, metrics: str | None = None):
    """Upsert every micro-batch into the catalogue at ``path``.

    Offsets are committed after the batch is stored, and a batch that is
    repeated replaces itself: each update counts once. With ``metrics``, each
    batch also stores how many documents it inserted, modified and left as they
    were (see :func:`observed_upsert`).
    """

    def store(batch: DataFrame, number: int) -> None:
        if metrics is None:
            write_catalogue(spec, spec.state(batch, source), path, number)
        else:
            observed_upsert(spec, spec.state(batch, source), path, number, metrics)

    return _start(updates, store, checkpoint)


METRICS = "batch long, inserted long, modified long, unchanged long"


def observed_upsert(spec: Upsert, state: DataFrame, path: str, number: int, metrics: str) -> dict:
    """Store one batch and count its effect in the same pass, by ``observe``.

    Only the batch's keys are read from what was stored before; their merged rows are written as the
    batch (merging is idempotent, so this is the same catalogue) and, on the way, compared with the
    documents they replace: inserted (a new key), modified, unchanged. The counts go to
    ``metrics/batch=N``; a repeated batch replaces both.
    """
    from pyspark.sql import Observation

    spark = state.sparkSession
    batch = spec.merge(state)
    old = state_before(spec, spark, path, number).join(batch.select(spec.key), spec.key, "left_semi")
    after = spec.merge(old.unionByName(batch))
    previous = old.select(spec.key, spec.document().alias("_old"))
    flagged = after.join(previous, spec.key, "left").withColumn("_new", spec.document())
    seen = Observation(f"upsert-{number}")
    counted = flagged.observe(
        seen,
        F.count_if(F.col("_old").isNull()).alias("inserted"),
        F.count_if(F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("modified"),
        F.count_if(F.col("_old").eqNullSafe(F.col("_new"))).alias("unchanged"),
    )
    counted.select(*spec.schema.names).write.mode("overwrite").parquet(f"{path}/batch={number}")
    found = seen.get
    row = (number, found["inserted"], found["modified"], found["unchanged"])
    spark.createDataFrame([row], METRICS).coalesce(1).write.mode("overwrite").parquet(f"{metrics}/batch={number}")
    return found


#: Batches of the seen set after which it is folded into a snapshot.
FOLD_AFTER = 32
SEEN = "fp string"


#: Leading characters of a fingerprint that name its bucket folder in a snapshot.
BUCKET_CHARS = 2
#: A batch of at most this many fingerprints asks the seen set by a list: only its buckets and row groups are read.
IN_LIST = 10_000


def _bucket(fp: str = "fp"):
    return F.substring(F.col(fp), 1, BUCKET_CHARS)


def _seen_parts(spark: SparkSession, path: str, below: int | None) -> tuple[str | None, list[str]]:
    """The snapshot (or None) and the log batches of the seen set before batch ``below``; folds a long log first.

    A snapshot is written in bucket folders ``b=`` of the fingerprint's first characters, sorted by
    fingerprint within, with a Parquet Bloom filter on it: a lookup of a few fingerprints reads the
    footers of its buckets and the row groups that may hold them, not the history.
    """
    before = lambda prefix: [n for n in complete_parts(spark, path, prefix) if below is None or n < below]
    base = before("v=")[-1:]
    log = [n for n in before("batch=") if not base or n > base[0]]
    snapshot = f"{path}/v={base[0]}" if base else None
    logs = [f"{path}/batch={n}" for n in log]
    if below is not None and len(log) >= FOLD_AFTER:
        folded = f"{path}/v={log[-1]}"
        everything = _read_seen(spark, snapshot, logs).distinct()
        everything.withColumn("b", _bucket()).repartitionByRange("fp").sortWithinPartitions("fp").write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#fp", "true"
        ).partitionBy("b").parquet(folded)
        return folded, []
    return snapshot, logs


def _read_seen(spark: SparkSession, snapshot: str | None, logs: list[str], asked: list[str] | None = None) -> DataFrame | None:
    parts = []
    if snapshot:
        seen = spark.read.schema(SEEN + ", b string").parquet(snapshot)
        if asked is not None:
            seen = seen.where(F.col("b").isin(sorted({a[:BUCKET_CHARS] for a in asked})) & F.col("fp").isin(asked))
        parts.append(seen.select("fp"))
    if logs:
        seen = spark.read.schema(SEEN).parquet(*logs)
        parts.append(seen.where(F.col("fp").isin(asked)) if asked is not None else seen)
    if not parts:
        return None
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def seen_tasks(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """Fingerprints seen so far (before batch ``below``), None if there are none yet.

    The set is a log of batches (``batch=N``) over a snapshot (``v=N``, batches up to N) in bucket
    folders of the fingerprint. A log of many batches is folded into the next snapshot first:
    batches before ``below`` are final.
    """
    return _read_seen(spark, *_seen_parts(spark, path, below))


def seen_among(spark: SparkSession, path: str, below: int, fresh: DataFrame) -> DataFrame | None:
    """The fingerprints of ``fresh`` that were seen before batch ``below``.

    A batch of at most ``IN_LIST`` distinct fingerprints asks for them by list (pushed to the scan:
    bucket folders, row group statistics, Bloom filters), so what it reads does not grow with the
    history; a larger batch is semi-joined with the whole set.
    """
    snapshot, logs = _seen_parts(spark, path, below)
    if snapshot is None and not logs:
        return None
    asked = fresh.select("fp").distinct()
    few = asked.limit(IN_LIST + 1).collect()
    if len(few) <= IN_LIST:
        found = _read_seen(spark, snapshot, logs, [r.fp for r in few if r.fp is not None])
        return found.distinct()
    return _read_seen(spark, snapshot, logs).join(asked, "fp", "left_semi").distinct()


def commit_after_success(
    tasks: DataFrame,
    work: Callable[[DataFrame, int], DataFrame],
    order: tuple,
    seen_path: str,
    checkpoint: str,
):
    """Work on each unseen task once it succeeds; failed ones stay unseen.

    ``work`` gets the fresh tasks of a micro-batch and its number, stores its
    results under that number, and returns rows ``fp, ok``. Only fingerprints
    that are ``ok`` enter the seen table, so a failed task that is delivered
    again is worked on again.
    """

    def step(batch: DataFrame, number: int) -> None:
        fresh = settle(dedup_first(batch, order), "batch")
        known = seen_among(batch.sparkSession, seen_path, number, fresh)
        if known is not None:
            fresh = settle(fresh.join(known, "fp", "left_anti"), "fresh")
        outcome = work(fresh, number)
        done = outcome.where("ok").select("fp").distinct()
        done.write.mode("overwrite").parquet(f"{seen_path}/batch={number}")

    return _start(tasks, step, checkpoint)


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    writer = stream.writeStream.foreachBatch(step).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()


def await_pages(tasks: DataFrame, captures: DataFrame, wait: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Tasks joined with the captures of their URL that arrive within ``wait`` after issue, as a stream.

    A stream-stream left outer join on the URL's fetch key and event time: ``tasks`` has ``url`` and
    ``issued_at``, ``captures`` has ``page_id``, ``url``, ``status`` and ``fetched_at``. A task waits in
    state for its pages; each capture within the wait gives a row with ``result`` from its status.
    Once the watermark passes ``issued_at + wait``, a task that met none is released with a null page
    and ``result`` ``failed`` (no page). Tasks leave the state ``wait`` plus ``late`` after issue and
    captures ``late`` after their fetch, so the state holds a window, not the history.
    """
    t = tasks.withColumn("_task_key", url_key(F.col("url"))).withWatermark("issued_at", late)
    c = captures.select(
        url_key(F.col("url")).alias("_page_key"), "page_id", "status", "fetched_at"
    ).withWatermark("fetched_at", late)
    within = (
        (F.col("_task_key") == F.col("_page_key"))
        & (F.col("fetched_at") >= F.col("issued_at"))
        & (F.col("fetched_at") <= F.col("issued_at") + F.expr(f"interval {wait}"))
    )
    joined = t.join(c, within, "leftOuter")
    return joined.withColumn("result", fetch_result(F.col("status"))).drop("_task_key", "_page_key")


def stream_to(rows: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows to Parquet at ``path``, taking what is there and ending."""
    writer = rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start(path)
