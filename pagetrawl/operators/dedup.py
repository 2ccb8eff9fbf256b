"""Fingerprint deduplication. Every grouping pre-aggregates before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_first(tasks: DataFrame, order: tuple, fp: str = "fp") -> DataFrame:
    """One row per fingerprint: the first by ``order``, ties broken by content.

    All columns must be orderable, which a map is not.
    Copies collapse in the map-side aggregate, so a fingerprint that a third
    of all rows share sends one row per map task through the shuffle.
    """
    rest = [c for c in tasks.columns if c != fp and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return tasks.groupBy(fp).agg(first).select(*[c if c == fp else f"first.{c}" for c in tasks.columns])


def dup_report(tasks: DataFrame, by: tuple) -> DataFrame:
    """Per distinct message how often it came (``n``) and how often again (``dups``)."""
    return tasks.groupBy(*by).agg(F.count("*").alias("n"), (F.count("*") - 1).alias("dups"))


def absent_only(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose ``key`` does not exist yet.

    ``existing`` is first reduced to the keys asked for: when ``new`` is small
    it is broadcast, by its size, and the large set is read but not shuffled,
    which an anti join alone cannot do. ``new`` is read twice; settle it first
    when it is costly.
    """
    # distinct keys: an anti join can't split the copies of a hot one
    known = existing.select(key).join(new.select(key), key, "left_semi").distinct()
    return new.join(known, key, "left_anti")


def unseen(tasks: DataFrame, seen: DataFrame, fp: str = "fp") -> DataFrame:
    """Tasks whose fingerprint is not in ``seen``. Deduplicate ``tasks`` first."""
    return absent_only(tasks, seen, fp)


def add_to_set(values: DataFrame, seen: DataFrame, value: str) -> DataFrame:
    """Set insert: ``added`` is 1 for new members and 0 for present ones.

    One row per distinct value; ``repeats`` counts its further inserts, each
    of which would report 0.
    """
    adds = values.groupBy(value).agg(F.count("*").alias("n"))
    asked = seen.select(value).join(adds.select(value), value, "left_semi")
    known = asked.distinct().withColumn("known", F.lit(True))
    new = F.coalesce(~F.col("known"), F.lit(True))
    return adds.join(known, value, "left").select(value, new.cast("int").alias("added"), (F.col("n") - 1).alias("repeats"))


#: Characters of ``by`` whose counts place the cut of :func:`claim`: at most 16 ** 4 rows for hex fingerprints.
CLAIM_PREFIX = 4


def claim(tasks: DataFrame, n: int, by: str = "fp") -> tuple[DataFrame, DataFrame]:
    """Take ``n`` tasks out, in the order of ``by`` (nulls first); also what is left.

    No global sort: a histogram of the first ``CLAIM_PREFIX`` characters of ``by`` (one row a prefix
    reaches the driver) finds the prefix where the ``n``-th task lies. Tasks of earlier prefixes are
    taken by a filter; only that prefix is ranked (by range partitions) for the rest of the ``n``.
    Ties in ``by``, nulls among them, are cut between rows, each row on one side.
    """
    key = F.substring(F.col(by).cast("string"), 1, CLAIM_PREFIX)
    counts = tasks.groupBy(key.alias("k")).agg(F.count("*").alias("c")).collect()
    before, last, found = 0, None, False
    for row in sorted(counts, key=lambda r: (r.k is not None, r.k or "")):
        if before + row.c >= n:
            last, found = row.k, True
            break
        before += row.c
    if not found:
        return tasks, tasks.limit(0)
    if last is None:
        earlier, at, later = F.lit(False), key.isNull(), key.isNotNull()
    else:
        earlier, at, later = key.isNull() | (key < F.lit(last)), key == F.lit(last), key > F.lit(last)
    from pagetrawl.operators.ordered import ranked

    # the prefix of the cut, ranked once by range partitions: taken and left are two sides of one written table
    edge = ranked(tasks.where(at).withColumn("_all", F.lit(0)).withColumn("_o", F.struct(by)), ("_all",), "_o")
    cut = F.col("_n") <= F.lit(n - before)
    taken = tasks.where(earlier).unionByName(edge.where(cut).select(*tasks.columns))
    return taken, tasks.where(later).unionByName(edge.where(~cut).select(*tasks.columns))


def split_valid(rows: DataFrame, reject: Column | str = "reject") -> tuple[DataFrame, DataFrame]:
    """Rows without and with a reject reason.

    Both filter the same input: settle it first when it is costly to compute.
    """
    reason = F.col(reject) if isinstance(reject, str) else reject
    named = rows.withColumn("reject", reason)
    return named.where("reject is null").drop("reject"), named.where("reject is not null")


def missing_field(required: tuple) -> Column:
    """Name of the first required column that is null, as a reject reason."""
    first, *others = required
    reason = F.when(F.col(first).isNull(), F.lit(first))
    for name in others:
        reason = reason.when(F.col(name).isNull(), F.lit(name))
    return reason


def pending_scan(docs: DataFrame) -> DataFrame:
    """Documents not worked on yet (``status`` 0), without their storage id."""
    return docs.where("status = 0").drop("_id")
