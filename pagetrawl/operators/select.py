"""Selectors as column expressions over a page's node array.

A selector is a tuple of steps built with :func:`child` and :func:`anywhere`, worked off from
the first on: each step filters the array for what lies below the elements found
so far. Below means inside the interval of ids from an element to its last
descendant, so that pages of any depth take the same room.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    tag: str
    deep: bool  # any descendant rather than a child
    equals: dict = field(default_factory=dict)  # attribute is exactly
    contains: dict = field(default_factory=dict)  # attribute contains

    def accepts(self, node: Column) -> Column:
        ok = node["tag"] == self.tag
        for name, value in self.equals.items():
            ok = ok & (node["attrs"][name] == value)
        for name, value in self.contains.items():
            ok = ok & node["attrs"][name].contains(value)
        return ok


def child(tag: str, contains: dict | None = None, **equals) -> Step:
    """Child elements ``tag``; keyword ``class_`` stands for ``class``."""
    return Step(tag, False, {k.rstrip("_"): v for k, v in equals.items()}, contains or {})


def anywhere(tag: str, contains: dict | None = None, **equals) -> Step:
    """Descendant elements ``tag``."""
    return Step(tag, True, {k.rstrip("_"): v for k, v in equals.items()}, contains or {})


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once rather than in every turn of a lambda in it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _follow(found: Column, nodes: Column, steps: tuple[Step, ...], first_id) -> Column:
    """What the further ``steps`` select among ``nodes`` (ids from ``first_id`` on), below the elements ``found``."""
    for step in steps:
        found = (_below if step.deep else _children)(found, nodes, step, first_id)
    return found


def _below(found: Column, nodes: Column, step: Step, first_id) -> Column:
    spans = F.transform(found, lambda n: F.struct(n["id"].alias("id"), n["last"].alias("last")))
    # intervals nest or are apart: the outermost hold all that lies below any, in document order
    outer = F.aggregate(
        spans,
        F.array().cast("array<struct<id:int,last:int>>"),
        lambda acc, n: F.when(F.coalesce(F.get(acc, F.size(acc) - 1)["last"] >= n["last"], F.lit(False)), acc).otherwise(
            F.concat(acc, F.array(n))
        ),
    )
    inside = F.transform(outer, lambda o: F.filter(F.slice(nodes, o["id"] + 2 - first_id, o["last"] - o["id"]), step.accepts))
    return F.flatten(inside)


def _children(found: Column, nodes: Column, step: Step, first_id) -> Column:
    ids = F.transform(found, lambda n: n["id"])
    return once(ids, lambda known: F.filter(nodes, lambda n: step.accepts(n) & F.array_contains(known, n["parent"])))


def select_nodes(nodes, *steps: Step) -> Column:
    """Elements of a whole page selected by ``steps``, in document order."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    first, *others = steps
    found = F.filter(nodes, lambda n: first.accepts(n) & (F.lit(True) if first.deep else n["parent"] == -1))
    return _follow(found, nodes, tuple(others), F.lit(0))


def slice_below(nodes, node: Column) -> Column:
    """All elements below ``node``, in document order."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    return F.slice(nodes, node["id"] + 2, node["last"] - node["id"])


def select_within(below: Column, node: Column, *steps: Step) -> Column:
    """Elements selected among those ``below`` a node (:func:`slice_below`): cut once, searched often."""
    first, *others = steps
    found = F.filter(below, lambda n: first.accepts(n) & (F.lit(True) if first.deep else n["parent"] == node["id"]))
    return _follow(found, below, tuple(others), node["id"] + 1)


def select_below(nodes, node: Column, *steps: Step) -> Column:
    """Elements below ``node``, one of the page's ``nodes``; only the slice below it is searched."""
    return once(slice_below(nodes, node), lambda below: select_within(below, node, *steps))


def node_texts(selected: Column) -> Column:
    """Leading text of each element: the text before its first child."""
    return F.transform(selected, lambda n: n["text"])


def node_attrs(selected: Column, name: str) -> Column:
    """An attribute of each element, null where it has none."""
    return F.transform(selected, lambda n: n["attrs"][name])


def first_match(matches: Column) -> Column:
    """First in document order; null when nothing matches."""
    return F.get(matches, F.lit(0))
