"""Compare a Spark result with the SQL result on the same tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        db.execute(f"create view {name} as select * from '{path}'")
    return db


def kind(arrow_type) -> str:
    return str(arrow_type).replace("large_", "")


def compare(spark_df, db, sql: str) -> list[str]:
    """What differs, as text; empty when schema and rows agree."""
    ours, theirs = spark_df.toArrow(), db.sql(sql).to_arrow_table()
    names = sorted(ours.column_names)
    if names != sorted(theirs.column_names):
        return [f"columns {names} != {sorted(theirs.column_names)}"]
    problems = []
    types = [(n, kind(ours.schema.field(n).type), kind(theirs.schema.field(n).type)) for n in names]
    problems += [f"type of {n}: {a} != {b}" for n, a, b in types if a != b]
    a, b = (Counter(zip(*[t.column(n).to_pylist() for n in names])) for t in (ours, theirs))
    if a != b:
        problems.append(f"{ours.num_rows} rows, SQL {theirs.num_rows}; only ours {list((a - b).items())[:2]}, only SQL {list((b - a).items())[:2]}")
    return problems
