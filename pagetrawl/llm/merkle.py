"""A Merkle manifest of a table: leaves per group, a tree per group, a tree of the groups' subroots.

Method: a content-addressed DAG. Every inner node is stored as a record ``digest -> children``
(distinct by digest, so equal subtrees are stored once). Proofs are not built leaf by leaf:
requests descend from the root, level by level, by the digits of their rank in base ``fanout``;
at each record the selected child goes on and the unselected ones are collected as the
segment of that level (those left of it, those right of it). The segments of a path are then
reversed, so a proof reads from the leaf's own run up to the root.

Requests that share a node descend together (a join of one node row with its record), so a
level costs its number of nodes, a sixteenth of the level below; leaves meet their path once,
in a join on the position of their run. Ranks come from sampled range bounds, so a group that
holds a third of all rows is ranked, grouped and joined by many tasks.

Hash: ``H`` is the lowercase hex SHA-256 of its inputs concatenated, digests as their hex text.
A field of a leaf is ``-`` if null, else its UTF-8 byte count, ``:``, and its value (integers
in decimal). Leaves of a group ascend by their order column (nulls first), ties by leaf digest.
While more than one node remains, every ``fanout`` consecutive nodes (the last run fewer, even
one) become their ``H``; a lone leaf is its group's subroot itself. Subroots ascend by group
(null first, UTF-8 bytewise) and give the root the same way.

Cases: an empty table has no rows and no root. Repeated rows are separate leaves of equal
digest. Null keys, groups and fields are ordinary values as above. Only the named columns are
read, so other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrawl.operators.ordered import ranked
from pagetrawl.session import settle, text_batches

FANOUT = 16
SEGMENT = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else ``<UTF-8 bytes>:<value>``."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _level(n: Column, fanout: int, most: int) -> Column:
    """Height of a tree of ``n`` leaves: the least ``h`` with ``fanout ** h >= n``."""
    height = F.lit(most)
    for h in range(most - 1, -1, -1):
        height = F.when(n <= F.lit(fanout**h), F.lit(h)).otherwise(height)
    return height


def _records(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Inner nodes of the trees of ``nodes (tree, idx, size, digest)``, level by level, and each tree's top.

    Returns the tables of levels 1, 2, ... as ``(tree, idx, size, digest, children)`` and the tops
    as ``(tree, size, digest)``.
    """
    most = nodes.agg(F.max("size")).first()[0] or 1
    height = 0
    while fanout**height < most:
        height += 1
    levels, tops, level = [], [], nodes
    for k in range(height + 1):
        count = F.expr(f"(size + {fanout**k - 1}) div {fanout**k}")
        tops.append(level.where(count == 1).select("tree", "size", "digest"))
        if k == height:
            break
        kids = level.where(count > 1).groupBy("tree", F.expr(f"idx div {fanout}").alias("idx"), "size").agg(
            F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids")
        )
        up = kids.select(
            "tree", "idx", "size",
            F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"),
            F.col("kids.digest").alias("children"),
        )
        up = settle(up, f"merkle-level-{k + 1}")
        levels.append(up)
        level = up.drop("children")
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return levels, top


def _segment(children: Column, at: Column) -> Column:
    """The unselected children of a record: those left of position ``at`` (from 0), those right of it."""
    n = F.size(children)
    left = F.array_join(F.slice(children, F.lit(1), at), "")
    right = F.when(at + 1 < n, F.array_join(F.slice(children, at + 2, n), "")).otherwise(F.lit(""))
    return F.struct(left.alias("l"), right.alias("r"))


@dataclass
class Manifest:
    """``proofs``: per row its key, group, leaf, subroot, root, proof digest and folded root; ``records``: digest -> children; ``root``."""

    proofs: DataFrame
    records: DataFrame
    root: str | None


def manifest(
    rows: DataFrame, key: str, group: str, fields: tuple, tamper: Column | None = None, fanout: int = FANOUT
) -> Manifest:
    """The Merkle manifest of ``rows``: leaves of ``fields`` per ``group``, ascending by ``key``.

    ``tamper``, if given, is a column of the same row's fields after a change (null: unchanged);
    its leaf is folded with the original siblings into ``folded_root``, and ``verified`` tells
    whether that equals the root.
    """
    spark = rows.sparkSession
    text_batches(spark)
    leaf = leaf_digest(*[F.col(c) for c in fields])
    changed = F.coalesce(tamper, leaf) if tamper is not None else leaf
    leaves = rows.select(
        F.col(key).alias("key"), F.struct(F.col(group).alias("g")).alias("tree"), leaf.alias("leaf"), changed.alias("changed")
    ).withColumn("ord", F.struct("key", "leaf"))
    placed = settle(
        ranked(leaves, ("tree",), "ord").select(
            "key", "tree", "leaf", "changed", (F.col("_n") - 1).alias("idx"), F.col("_size").alias("size")
        ),
        "merkle-leaves",
    )
    levels, tops = _records(placed.select("tree", "idx", "size", F.col("leaf").alias("digest")), fanout)
    subroots = settle(tops.select("tree", F.col("digest").alias("subroot"), "size"), "merkle-subroots")

    # the tree of subroots, ascending by group: one more tree of its own
    ordered = ranked(subroots.withColumn("_all", F.lit(0)), ("_all",), "tree")
    nodes = ordered.select(F.lit(0).alias("tree_of"), "tree", (F.col("_n") - 1).alias("idx"), F.col("_size").alias("size"), F.col("subroot").alias("digest"))
    nodes = settle(nodes, "merkle-groups")
    top_levels, top = _records(nodes.select(F.struct("tree_of").alias("tree"), "idx", "size", "digest"), fanout)
    found = top.select("digest").first()
    root = found[0] if found else None

    records = None
    for level in levels + top_levels:
        part = level.select("digest", "children")
        records = part if records is None else records.unionByName(part)
    if records is None:
        records = spark.createDataFrame([], "digest string, children array<string>")
    records = settle(records.dropDuplicates(["digest"]), "merkle-records")

    most = max(1, nodes.agg(F.max("size")).first()[0] or 1, placed.agg(F.max("size")).first()[0] or 1)
    height = 0
    while fanout**height < most:
        height += 1

    empty = F.array().cast(SEGMENT)
    # down the tree of groups to each subroot
    start = top.select(F.col("tree").alias("tree"), F.lit(0).cast("long").alias("idx"), _level(F.col("size"), fanout, height).alias("lvl"), "digest", empty.alias("segs"))
    at_subroots = _walk(start, records, fanout)
    named = at_subroots.join(nodes.select("idx", F.col("tree").alias("group_tree")), "idx").select(
        F.col("group_tree").alias("tree"), F.lit(0).cast("long").alias("idx"), "digest", "segs"
    )
    sized = named.join(subroots.select("tree", "size"), "tree")
    begin = sized.select("tree", "idx", _level(F.col("size"), fanout, height).alias("lvl"), "digest", F.col("digest").alias("subroot"), "segs")
    runs = _walk(begin, records, fanout, keep=("subroot",), stop=1)

    # leaves meet the record of their run: level 0's segment, then the path reversed
    bottom = runs.where("lvl = 1").join(records, "digest").select("tree", F.col("idx").alias("run"), "subroot", "segs", "children")
    lone = runs.where("lvl = 0").select("tree", F.col("idx").alias("idx"), "subroot", "segs")
    at = (F.col("idx") % fanout).cast("int")
    inner = placed.withColumn("run", F.expr(f"idx div {fanout}")).join(bottom, ["tree", "run"]).select(
        "key", "tree", "leaf", "changed", "subroot",
        F.reverse(F.concat("segs", F.array(_segment(F.col("children"), at)))).alias("path"),
    )
    single = placed.join(lone, ["tree", "idx"]).select("key", "tree", "leaf", "changed", "subroot", F.reverse("segs").alias("path"))
    joined = inner.unionByName(single)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = F.aggregate("path", F.col("changed"), lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))
    proofs = joined.select(
        "key", F.col("tree.g").alias("group"), "leaf", "subroot", F.lit(root).alias("root"),
        proof.alias("proof_sha256"), folded.alias("folded_root"), F.size("path").alias("depth"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
    return Manifest(proofs, records, root)


def _walk(frontier: DataFrame, records: DataFrame, fanout: int, keep: tuple = (), stop: int = 0) -> DataFrame:
    """Requests ``(tree, idx, lvl, digest, segs, *keep)`` taken down by their records to level ``stop`` (or 0).

    Each round joins the requests above ``stop`` with the records of their digests and goes on with
    every child: its rank is ``idx * fanout + position``, and the record's other children form the
    segment it appends. Requests at ``stop`` or below are done as they are.
    """
    done = []
    while True:
        done.append(frontier.where(F.col("lvl") <= stop))
        frontier = frontier.where(F.col("lvl") > stop)
        if frontier.isEmpty():
            break
        met = frontier.join(records, "digest")
        children = met.select(
            "tree", "idx", "lvl", "segs", *keep, "children", F.posexplode("children").alias("at", "child")
        )
        frontier = settle(
            children.select(
                "tree",
                (F.col("idx") * fanout + F.col("at")).alias("idx"),
                (F.col("lvl") - 1).alias("lvl"),
                F.col("child").alias("digest"),
                F.concat("segs", F.array(_segment(F.col("children"), F.col("at")))).alias("segs"),
                *keep,
            ),
            "merkle-descent",
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
