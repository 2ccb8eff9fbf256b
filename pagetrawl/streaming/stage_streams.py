"""The index and detail stages as streams over their queues.

Each takes the tasks its queue holds, in bounded batches, and ends. A
micro-batch writes its catalogue rows, the tasks it found and its outcomes
under its own number, and only then are its good tasks marked as seen, so a
batch that is repeated after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.functions import fingerprint
from pagetrawl.functions.urls import BASE_URL
from pagetrawl.operators.frontier import task_fingerprint
from pagetrawl.operators.retry import ATTEMPTS, retry_ledger
from pagetrawl.plans.stages import CATALOGUE, Fetched, detail_stage, index_stage
from pagetrawl.schemas import DETAIL_TASK, OUTCOME, SEED_TASK
from pagetrawl.session import settle
from pagetrawl.sources.catalogue import read_catalogue, write_catalogue
from pagetrawl.sources.tasks import append_batch, append_tasks, read_tasks
from pagetrawl.streaming.streams import commit_after_success

# queue and fingerprint of each stage's tasks
STAGES = {
    "index": ("search", SEED_TASK, task_fingerprint),
    "detail": ("detail", DETAIL_TASK, lambda: fingerprint("url")),
}


def queued_tasks(spark: SparkSession, path: str, stage: str, streaming: bool = False, max_files: int = 1000) -> DataFrame:
    """The tasks of a stage's queue below ``path``, with their fingerprints."""
    queue, schema, fp = STAGES[stage]
    return read_tasks(spark, path, queue, schema, streaming, max_files).withColumn("fp", fp())


def stage_outcomes(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """Every attempt of a stage so far; an attempt is numbered by its batch."""
    return read_tasks(spark, path, f"outcomes-{stage}", OUTCOME)


def index_stream(
    spark: SparkSession,
    path: str,
    captures: DataFrame,
    facts: DataFrame,
    max_files: int = 1000,
    at=None,
    base: str = BASE_URL,
    per_page: int = 100,
):
    """Work off the search queue below ``path``; follow-up pages go back into it."""

    def work(fresh: DataFrame, number: int) -> DataFrame:
        done = index_stage(fresh, captures, facts, at, base, per_page)
        append_batch(done.details.select("url"), path, "detail", number, "index")
        append_batch(done.tasks.drop("fp"), path, "search", number, "index")
        return _store(done, "index", path, number)

    tasks = queued_tasks(spark, path, "index", True, max_files)
    return commit_after_success(tasks, work, ("page",), f"{path}/seen-index", f"{path}/checkpoint-index")


def until_empty(start) -> int:
    """Runs ``start()``, an ``availableNow`` query over a queue, again while a run still takes rows.

    Work that a run appends to its own queue (follow-up pages) is taken by the next run; the loop
    ends with the first run that finds no new task. Returns the number of runs.
    """
    runs = 0
    while True:
        query = start()
        query.awaitTermination()
        runs += 1
        if not sum(p["numInputRows"] for p in query.recentProgress):
            return runs


def index_until_empty(spark: SparkSession, path: str, captures: DataFrame, facts: DataFrame, **options) -> int:
    """:func:`index_stream` until the search queue holds no task that was not taken."""
    return until_empty(lambda: index_stream(spark, path, captures, facts, **options))


def detail_stream(
    spark: SparkSession,
    path: str,
    captures: DataFrame,
    facts: DataFrame,
    max_files: int = 1000,
    at=None,
    base: str = BASE_URL,
    images: DataFrame | None = None,
):
    """Work off the detail queue below ``path``."""
    source = "detail" if images is None else "cover"

    def work(fresh: DataFrame, number: int) -> DataFrame:
        return _store(detail_stage(fresh, captures, facts, at, base, images), source, path, number)

    tasks = queued_tasks(spark, path, "detail", True, max_files)
    return commit_after_success(tasks, work, ("url",), f"{path}/seen-detail", f"{path}/checkpoint-detail")


def _store(done: Fetched, source: str, path: str, number: int) -> DataFrame:
    stage = "index" if source == "index" else "detail"
    write_catalogue(CATALOGUE, CATALOGUE.state(done.rows, source), f"{path}/catalogue-{stage}", number, wide=stage == "detail")
    outcomes = done.outcomes.withColumn("attempt", F.lit(number)).select("fp", "attempt", "ok", "error")
    append_batch(outcomes, path, f"outcomes-{stage}", number)
    return outcomes


def requeue_failed(spark: SparkSession, path: str, stage: str, attempts: int = ATTEMPTS) -> DataFrame:
    """Put the failed tasks of a stage back into its queue; returns the dead ones.

    A task is dead after ``attempts`` failed attempts; rows ``fp, attempts,
    verdict, last_error``. Run it between runs of the stage's stream.
    """
    ledger = settle(retry_ledger(stage_outcomes(spark, path, stage), attempts).where("verdict != 'done'"), "ledger")
    queue, schema, _ = STAGES[stage]
    tasks = queued_tasks(spark, path, stage)
    again = tasks.join(ledger.where("verdict = 'requeue'"), "fp", "left_semi").drop("fp").distinct()
    # settled first: a queue is not read and appended to in one go
    append_tasks(settle(again, "again"), path, queue)
    return ledger.where("verdict = 'dead'")


def streamed_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue both streams write."""
    return read_catalogue(CATALOGUE, spark, f"{path}/catalogue-index", f"{path}/catalogue-detail")
