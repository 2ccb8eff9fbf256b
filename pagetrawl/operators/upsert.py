"""Field-level upsert as a mergeable aggregate.

Each source carries a fixed list of fields. Fields carried by the same sources
form a group, and an update turns into one struct ``(order, fields)`` per
group it carries. The larger struct is the later write, so merging is one
``max`` per group and key: it pre-aggregates, and it gives the same result in
any order, in any split into batches, and when a batch comes twice. A group an
update does not carry is a null struct; a carried field that is null is not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class Upsert:
    """What is merged: the key, the write order, and the fields of each source."""

    key: str
    order: str  # DDL of the columns that order two writes of one field
    types: str  # DDL of the key and all fields
    carried: dict  # source name -> names of the fields it writes

    @cached_property
    def groups(self) -> dict[str, tuple[frozenset, T.StructType]]:
        """Group name -> the sources that carry it and its struct type."""
        order, types = _fields(self.order), _fields(self.types)
        members: dict[frozenset, list] = {}
        for field in types:
            sources = frozenset(s for s, names in self.carried.items() if field.name in names)
            if sources:
                members.setdefault(sources, []).append(field)
        return {
            "by_" + "_".join(sorted(sources)): (
                sources,
                T.StructType([T.StructField("at", order), *fields]),
            )
            for sources, fields in members.items()
        }

    @cached_property
    def schema(self) -> T.StructType:
        key = _fields(self.types)[self.key]
        return T.StructType([key, *[T.StructField(n, t) for n, (_, t) in self.groups.items()]])

    def state(self, updates: DataFrame, source: str | Column) -> DataFrame:
        """Updates as mergeable rows. ``source`` is one name, or a column of names."""
        at = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _fields(self.order)])
        columns = [F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)]
        for name, (sources, kind) in self.groups.items():
            if isinstance(source, str) and source not in sources:
                columns.append(F.lit(None).cast(kind).alias(name))
                continue
            values = [F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields[1:]]
            packed = F.struct(at.alias("at"), *values)
            if isinstance(source, Column):
                packed = F.when(source.isin(*sources), packed)
            columns.append(packed.alias(name))
        return updates.select(*columns)

    def merge(self, *states: DataFrame) -> DataFrame:
        """One mergeable row per key, each group as last written."""
        every = reduce(DataFrame.unionByName, states)
        return every.groupBy(self.key).agg(*[F.max(n).alias(n) for n in self.groups])

    def documents(self, state: DataFrame) -> DataFrame:
        """The plain catalogue rows of a merged state."""
        where = {f.name: n for n, (_, kind) in self.groups.items() for f in kind.fields[1:]}
        names = [f.name for f in _fields(self.types)]
        return state.select(*[n if n == self.key else f"{where[n]}.{n}" for n in names])

    def document(self) -> Column:
        """A merged state row's catalogue fields (the key left out) as one struct."""
        where = {f.name: n for n, (_, kind) in self.groups.items() for f in kind.fields[1:]}
        names = [f.name for f in _fields(self.types) if f.name != self.key]
        return F.struct(*[F.col(f"{where[n]}.{n}").alias(n) for n in names])

    def latest_fields(self, updates: DataFrame, source: str | Column) -> DataFrame:
        """Catalogue rows from updates alone: per key and field the last write."""
        return self.documents(self.merge(self.state(updates, source)))


def merge_metrics(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How many documents a merge inserted, modified and left as they were."""
    fields = [c for c in after.columns if c != key]
    old = before.select(F.col(key), F.struct(*fields).alias("old"))
    new = after.select(F.col(key), F.struct(*fields).alias("new"))
    both = old.join(new, key, "full")
    return both.agg(
        F.count_if(F.col("old").isNull() & F.col("new").isNotNull()).alias("inserted"),
        F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).alias(
            "modified"
        ),
        F.count_if(F.col("old").eqNullSafe(F.col("new"))).alias("unchanged"),
    )


def delete_where(docs: DataFrame, condition: Column) -> DataFrame:
    """Documents left after a delete; where the condition is null nothing matches."""
    return docs.where(~F.coalesce(condition, F.lit(False)))
