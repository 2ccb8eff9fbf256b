"""Connected components of links between ids, as rounds of aggregates and joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.session import settle


#: Links that one task takes at most before it hands on what it has joined.
BLOCK = 1_000_000
MAPPING = "a long, b long"


def _forest(batches):
    """Union-find over the links of one partition, in blocks: each id with the smallest id of its tree."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def flush():
        nodes = list(parent)
        rows = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])
        parent.clear()
        return rows

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen > BLOCK:
            yield flush()
            seen = 0
    yield flush()


def _forests(links: DataFrame) -> DataFrame:
    return links.mapInArrow(_forest, MAPPING).where("a <> b")


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether each id has one link, to an id that has none."""
    several = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    return several.isEmpty() and links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of all ids in ``links (a, b)``: the smallest id reachable. Ids without links are left out.

    Trees of each partition first; links that fit one task's block are done with that. Then rounds of
    large and small stars: a node hands its neighbours the smallest id it knows, until all links lead to a
    component's smallest id. A round is settled as a table, so lost executors repeat one round only;
    links of a hub are split by the skew join, minima have a map-side part.
    """
    links = links.select("a", "b").where("a <> b")
    if links.count() <= BLOCK // 2:
        return settle(links.coalesce(1).mapInArrow(_forest, MAPPING).toDF("id", "component"), "components")
    now = settle(_forests(links), "links")
    while not _is_forest_of_stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        lower = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(_forests(small.union(lower.select("a", F.col("m").alias("b")))).distinct(), "links")
    lowest = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = lowest.select("component").distinct().select(F.col("component").alias("id"), "component")
    return lowest.join(roots, "id", "left_anti").union(roots)
