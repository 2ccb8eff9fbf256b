"""Ordered scans of a group: numbering, stopping, list building.

Rows are range-partitioned on (group, order) by sampled bounds and sorted within
their partition, so a group that holds a third of all rows, or one whose order
values lie far apart, still spreads over many tasks. A row's position is its
place inside its partition plus the rows of its group in earlier partitions,
taken from a small table of per-partition group counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrawl.session import settle

#: Offsets of at most this many (partition, group) pairs are broadcast; more are joined by a shuffle.
BROADCAST_OFFSETS = 1_000_000


def ranked(rows: DataFrame, part: tuple, order: str, holds: Column | None = None, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``_n``, the position from 1 of each row in its group by ``order``, ``_size`` and ``_stop``.

    ``_size`` is the number of rows of the group; ``_stop`` is the least ``order`` of the group where ``holds`` is not true (null: none, or no ``holds``).
    Rows without ``order`` have no place and are left out; null groups are groups. The sorted rows
    are written once, so the sampled bounds are fixed for every pass that follows and a lost
    executor recomputes nothing before them.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    gap = F.when(~F.coalesce(holds, F.lit(False)), F.col(order)) if holds is not None else F.lit(None).cast(rows.schema[order].dataType)
    keyed = rows.where(F.col(order).isNotNull()).withColumn("_g", F.struct(*part)).withColumn("_gap", gap)
    spread = keyed.repartitionByRange(n, "_g", order).sortWithinPartitions("_g", order)
    placed = settle(spread.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranked")
    counts = placed.groupBy("_p", "_g").agg(F.count("*").alias("_c"), F.min("_i").alias("_first"), F.min("_gap").alias("_gp"))
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(
        counts.select(
            "_p", "_g", "_first",
            F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
            F.min("_gp").over(Window.partitionBy("_g")).alias("_stop"),
            F.sum("_c").over(Window.partitionBy("_g")).alias("_size"),
        ),
        "offsets",
    )
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    joined = placed.join(offsets, ["_p", "_g"])
    return joined.withColumn("_n", F.col("_i") - F.col("_first") + F.col("_before") + 1).drop("_p", "_g", "_i", "_first", "_before", "_gap")


def enumerate_rows(rows: DataFrame, part: tuple, order: str, start: int = 1) -> DataFrame:
    """Position ``n`` of each row in its group, from ``start``.

    ``order`` is a column unique within a group; rows without it have no place and are left out.
    Dense and far-apart values alike are spread by sampled range bounds.
    """
    return take_while(rows, part, order, F.lit(True), start)


def take_while(rows: DataFrame, part: tuple, order: str, holds: Column, start: int = 1) -> DataFrame:
    """Rows of each group before the first one where ``holds`` is not true (null counts as not true).

    ``n`` is a row's position in the group; ``order`` is that of :func:`enumerate_rows`.
    """
    found = ranked(rows, part, order, holds)
    kept = found.where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    return kept.withColumn("n", F.col("_n") + F.lit(start - 1)).drop("_n", "_stop", "_size")


def assemble_list(rows: DataFrame, part: tuple, text: Column, n: str = "n", chunk: int = 1_000) -> DataFrame:
    """The texts of a group as lists, in the order of ``n`` (from 1).

    A list longer than ``chunk`` goes on in the next row (``list_no``), so no
    row outgrows a task whatever the size of the group.
    """
    pairs = rows.select(*part, F.floor((F.col(n) - 1) / F.lit(chunk)).alias("list_no"), F.struct(n, text.alias("t")).alias("p"))
    lists = pairs.groupBy(*part, "list_no").agg(F.array_sort(F.collect_list("p")).alias("l"))
    return lists.select(*part, "list_no", F.col("l.t").alias("items"))
