"""Page status and the ledger of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS = 3


def fetch_result(status: Column) -> Column:
    """``ok`` for 200, ``unhandled`` for 201 (fetched, but no stage reads it), else ``failed``."""
    return F.when(status == 200, "ok").when(status == 201, "unhandled").otherwise("failed")


def ok_pages(pages: DataFrame) -> DataFrame:
    return pages.where("status = 200")


def retry_ledger(outcomes: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Per task what its attempts come to: ``done``, ``requeue`` or ``dead``.

    ``outcomes`` has columns ``fp, attempt, ok, error``; ``last_error`` is the
    error of the latest failed attempt.
    """
    failed = ~F.col("ok")
    told = outcomes.groupBy("fp").agg(
        F.count("*").alias("attempts"),
        F.bool_or("ok").alias("ok"),
        F.max(F.when(failed, F.struct("attempt", "error"))).alias("last"),
    )
    verdict = F.when(F.col("ok"), "done").when(F.col("attempts") < attempts, "requeue").otherwise("dead")
    return told.select("fp", "attempts", verdict.alias("verdict"), F.col("last.error").alias("last_error"))
