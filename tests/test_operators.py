"""Dedup, frontier, ordered scans, upsert, retry on small fixtures and by property."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from pagetrawl.functions import fingerprint
from pagetrawl.operators.dedup import absent_only, add_to_set, claim, dedup_first, dup_report, missing_field, pending_scan, split_valid, unseen
from pagetrawl.operators.frontier import (
    fetch_join,
    follow_up_pages,
    frontier_product,
    frontier_rounds,
    newest_captures,
    start_requests,
    task_fingerprint,
    task_project,
    union_tasks,
    with_content,
)
from pagetrawl.operators.ordered import assemble_list, enumerate_rows, ranked, take_while
from pagetrawl.operators.retry import fetch_result, ok_pages, retry_ledger
from pagetrawl.operators.upsert import Upsert, delete_where, merge_metrics
from pagetrawl.schemas import OUTCOME, SEED_TASK

TASK = ("chile", "cassette", 1979, "cumbia", 1)


def test_sixteen_equal_tasks_are_one(spark):
    tasks = spark.createDataFrame([TASK] * 16, SEED_TASK)
    keyed = tasks.withColumn("fp", task_fingerprint()).withColumn("seq", F.monotonically_increasing_id())
    first = dedup_first(keyed, ("seq",))
    assert first.count() == 1 and first.columns == keyed.columns
    assert rows(dup_report(tasks, tuple(tasks.columns))) == [(*TASK, 16, 15)]


def test_text_year_is_the_same_task(spark):
    texts = spark.createDataFrame([(TASK[0], TASK[1], str(TASK[2]), TASK[3], str(TASK[4]))], SEED_TASK.replace("int", "string"))
    both = union_tasks(spark.createDataFrame([TASK], SEED_TASK), texts)
    assert both.select("fp").distinct().count() == 1
    assert task_project(texts).schema.simpleString() == both.drop("fp").schema.simpleString()


def test_set_adds(spark):
    urls = spark.createDataFrame([(f"https://example.org/item/{i}",) for i in range(10)], "value string")
    empty = urls.limit(0)
    assert [r.added for r in add_to_set(urls, empty, "value").collect()] == [1] * 10
    assert [r.added for r in add_to_set(urls, urls.union(urls), "value").collect()] == [0] * 10
    twice = add_to_set(urls.union(urls), empty, "value")
    assert {(r.added, r.repeats) for r in twice.collect()} == {(1, 1)}
    taken, left = claim(urls, 10, "value")
    assert (taken.count(), left.count()) == (10, 0)
    taken, left = claim(urls, 3, "value")
    assert [r.value[-1] for r in taken.collect()] == ["0", "1", "2"] and left.count() == 7


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=40))
def test_dedup_first_property(spark, data):
    df = spark.createDataFrame([(str(k), s, v) for k, s, v in data], "fp string, seq int, v int")
    once = dedup_first(df, ("seq",))
    low = lambda v: (v is not None, v)
    expected = sorted({k: min(((s, v) for q, s, v in data if str(q) == k), key=lambda x: (x[0], low(x[1]))) for k in {str(d[0]) for d in data}}.items())
    got = sorted((r.fp, (r.seq, r.v)) for r in once.collect())
    assert got == expected
    assert sorted((r.fp, (r.seq, r.v)) for r in dedup_first(once, ("seq",)).collect()) == got


def test_unseen(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "fp string")
    assert rows(unseen(tasks, spark.createDataFrame([("a",), ("a",)], "fp string"))) == [("b",)]


def test_product_and_empty_side(spark):
    data = [(f, ["n"], u, ["1"]) for f, u in (("style", ["s1", "s2"]), ("format", ["CD"]), ("country", ["x", "y", "z"]))]
    lists = spark.createDataFrame(data, "facet string, names array<string>, url_names array<string>, counts array<string>")
    tasks = frontier_product(lists, [2000, 2001])
    assert tasks.count() == 2 * 2 * 1 * 3 and tasks.schema.simpleString().startswith("struct<country:string,format:string,year:int")
    assert {r.page for r in tasks.collect()} == {1}
    assert frontier_product(lists.where("facet != 'style'"), [2000, 2001]).count() == 0
    explained = tasks._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in explained


@pytest.mark.parametrize("n, expected", [(None, []), (0, []), (1, []), (2, [2]), (13, list(range(2, 14)))])
def test_follow_up_pages(spark, n, expected):
    df = spark.createDataFrame([(n,)], "pages int")
    assert [r.page for r in follow_up_pages(df).orderBy("page").collect()] == expected


def test_follow_up_pages_across_blocks(spark):
    got = follow_up_pages(spark.createDataFrame([(25_003,)], "pages int"))
    assert got.agg(F.min("page"), F.max("page"), F.count_distinct("page"), F.count("*")).first() == (2, 25_003, 25_002, 25_002)


def test_start_requests(spark):
    got = rows(start_requests(spark, 2000, 2001, base="https://b.example"))
    assert got == [(f"https://b.example/search/?limit=25&layout=sm&decade=2000&year={y}&page=1",) for y in (2000, 2001)]


def test_fetch_join(spark):
    tasks = spark.createDataFrame([("a", "http://h/1#x"), ("b", "http://h/2"), ("c", "http://h/3"), ("d", "http://h/4")], "fp string, url string")
    pages = spark.createDataFrame(
        [(1, "http://h/1", 404, "old", 1), (2, "http://h/1#y", 200, "new", 2), (3, "http://h/2", 201, "x", 1), (4, "http://h/3", 500, "x", 1), (5, "http://h/9", 200, "x", 1)],
        "page_id int, url string, status int, html string, fetched_at int",
    )
    fetched = fetch_join(tasks, newest_captures(pages, ("fetched_at",)))
    assert rows(fetched.select("fp", "page_id", "result")) == [("a", 2, "ok"), ("b", 3, "unhandled"), ("c", 4, "failed"), ("d", None, "failed")]
    assert rows(with_content(fetched, pages).select("fp", "html")) == [("a", "new")]
    assert ok_pages(pages).count() == 2
    assert {tuple(r) for r in pages.select("status", fetch_result(F.col("status"))).collect()} == {
        (404, "failed"), (200, "ok"), (201, "unhandled"), (500, "failed")
    }


@pytest.mark.parametrize("seed", [0, 2, 16])
def test_take_while_and_lists(spark, seed):
    rng = random.Random(seed)
    data = [(g, i * 2 - 9, rng.random() > 0.15) for g in ("hot", "b", None) for i in range(40 if g == "hot" else 7)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "g string, pos int, ok boolean")
    expected, every = [], []
    for g in ("hot", "b", None):
        going = True
        for n, (_, pos, ok) in enumerate([d for d in data if d[0] == g], 1):
            every.append((g, pos, ok, n))
            going = going and ok
            if going:
                expected.append((g, pos, ok, n))
    assert rows(take_while(df, ("g",), "pos", F.col("ok"))) == sorted(expected, key=str)
    numbered = enumerate_rows(df, ("g",), "pos")
    assert rows(numbered) == sorted(every, key=str)
    lists = assemble_list(numbered, ("g",), F.concat_ws(".", "n", "pos"), chunk=25)
    assert rows(lists.where("g = 'hot'")) == [
        ("hot", 0, [f"{n}.{2 * n - 11}" for n in range(1, 26)]),
        ("hot", 1, [f"{n}.{2 * n - 11}" for n in range(26, 41)]),
    ]


SPEC = Upsert(
    key="obj_id",
    order="t int, pos int",
    types="obj_id string, title string, cover_url string, crawler_time string",
    carried={"index": ("title", "crawler_time"), "detail": ("cover_url", "crawler_time")},
)
UPDATE = "obj_id string, source string, title string, cover_url string, crawler_time string, t int, pos int"


def test_upsert_steps(spark):
    steps = [("98792", "index", "Moment", None, "t1", 1, 0), ("98792", "detail", None, "c1", "t2", 2, 0), ("98792", "index", None, None, "t3", 3, 0)]
    after = [rows(SPEC.latest_fields(spark.createDataFrame(steps[:n], UPDATE), F.col("source")))[0] for n in (1, 2, 3)]
    assert after == [("98792", "Moment", None, "t1"), ("98792", "Moment", "c1", "t2"), ("98792", None, "c1", "t3")]


def test_upsert_one_source_by_name(spark):
    update = spark.createDataFrame([("1", "c", "t", 1, 0)], "obj_id string, cover_url string, crawler_time string, t int, pos int")
    state = SPEC.state(update, "detail")
    assert state.schema.simpleString() == SPEC.schema.simpleString()
    assert rows(SPEC.documents(SPEC.merge(state))) == [("1", None, "c", "t")]


updates = st.lists(
    st.tuples(st.sampled_from("ab"), st.sampled_from(["index", "detail"]), st.sampled_from([None, "x", "y"]), st.integers(0, 3), st.integers(0, 3)),
    min_size=1,
    max_size=20,
)


@settings(max_examples=5, deadline=None)
@given(updates, st.randoms())
def test_upsert_is_order_free_and_idempotent(spark, data, rng):
    full = [(k, s, v, v, f"{t}", t, p) for k, s, v, t, p in data]
    shuffled = rng.sample(full, len(full))
    cut = rng.randrange(len(full) + 1)
    state = lambda part: SPEC.state(spark.createDataFrame(part, UPDATE), F.col("source"))
    whole = rows(SPEC.documents(SPEC.merge(state(full))))
    first, second = state(shuffled[:cut]), state(shuffled[cut:])
    merged = SPEC.merge(SPEC.merge(first), second)
    assert rows(SPEC.documents(merged)) == whole
    assert rows(SPEC.documents(SPEC.merge(merged, state(full)))) == whole
    # against a plain loop over the writes in order
    docs = {}
    for k, s, v, _, c, t, p in sorted(full, key=lambda u: (u[5], u[6], u[2] is not None, u[2])):
        doc = docs.setdefault(k, {})
        doc.update({"title" if s == "index" else "cover_url": v, "crawler_time": c})
    assert whole == sorted(((k, d.get("title"), d.get("cover_url"), d["crawler_time"]) for k, d in docs.items()), key=str)


def test_merge_metrics(spark):
    before = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", None)], "k string, v int")
    assert rows(merge_metrics(before, after, "k")) == [(1, 2, 1)]


def test_delete_and_pending(spark):
    docs = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, None, None)], "_id int, flag int, status int")
    assert rows(delete_where(docs, F.col("flag") == 0)) == [(2, 1, 1), (3, None, None)]
    assert rows(pending_scan(docs)) == [(0, 0)]


def test_split_valid(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "id int, name string")
    valid, rejects = split_valid(df, missing_field(("id", "name")))
    assert rows(valid) == [(1, "a")] and rows(rejects) == [(2, None, "name"), (None, "b", "id")]


def test_retry_ledger(spark):
    data = [("ok", 1, True, None)]
    data += [("late", i, i == 3, None if i == 3 else f"e{i}") for i in (1, 2, 3)]
    data += [("dead", i, False, f"e{i}") for i in (1, 2, 3)] + [("again", i, False, f"e{i}") for i in (1, 2)]
    assert rows(retry_ledger(spark.createDataFrame(data, OUTCOME))) == [
        ("again", 2, "requeue", "e2"),
        ("dead", 3, "dead", "e3"),
        ("late", 3, "done", "e2"),
        ("ok", 1, "done", None),
    ]


def test_frontier_rounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string").withColumn("fp", fingerprint("node"))

    def expand(tasks):
        follow = tasks.join(edges, tasks.node == edges.src).select(F.col("dst").alias("node"))
        return follow.withColumn("fp", fingerprint("node"))

    got = frontier_rounds(seeds, expand, ("node",)).select("node", "round")
    assert rows(got) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_frontier_rounds_follow_long_chains(spark):
    seeds = spark.createDataFrame([(0,)], "node int").withColumn("fp", fingerprint("node"))
    expand = lambda tasks: tasks.where("node < 14").select((F.col("node") + 1).alias("node")).withColumn("fp", fingerprint("node"))
    assert rows(frontier_rounds(seeds, expand, ("node",)).select("node", "round")) == sorted([(n, n) for n in range(15)], key=str)


def test_hot_known_keys_are_asked_for_once(spark):
    existing = spark.range(20_000).select(F.lit("hot").alias("fp"))
    new = spark.createDataFrame([("hot", 1), ("new", 2)], "fp string, n int")
    assert rows(absent_only(new, existing, "fp")) == [("new", 2)]
    plan = absent_only(new, existing, "fp")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > plan.index("LeftAnti")


def test_rows_without_an_order_are_left_out(spark):
    data = spark.createDataFrame([("g", 1, True), ("g", None, False), ("g", 5, True), ("g", 9, False)], "g string, o bigint, ok boolean")
    assert rows(take_while(data, ("g",), "o", F.col("ok")).select("o", "n")) == [(1, 1), (5, 2)]


def test_far_order_values_spread_a_hot_group(spark):
    """One value of 2 ** 62 beside dense rows of the same group: the group still spans all partitions."""
    dense = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    far = spark.createDataFrame([("hot", 1 << 62), ("cold", 5)], "g string, o bigint")
    found = ranked(dense.unionByName(far), ("g",), "o", partitions=8)
    spans = found.where("g = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spans) >= 6 and max(r["count"] for r in spans) < 6_000
    numbered = enumerate_rows(dense.unionByName(far), ("g",), "o")
    assert numbered.where("g = 'hot'").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (1, 20_001, 20_001)
    assert rows(numbered.where("o = 4611686018427387904 or g = 'cold'").select("g", "n")) == [("cold", 1), ("hot", 20_001)]


@settings(max_examples=4, deadline=None)
@given(*[st.integers(0, 4)] * 3)
def test_product_counts(spark, styles, formats, countries):
    sides = {"style": styles, "format": formats, "country": countries}
    data = [(f, [], [f"{f}{i}" for i in range(n)], []) for f, n in sides.items() if n]
    lists = spark.createDataFrame(data, "facet string, names array<string>, url_names array<string>, counts array<string>")
    assert frontier_product(lists, [2000, 2001]).distinct().count() == 2 * styles * formats * countries


@pytest.mark.parametrize("n", [0, 1, 7, 500, 999, 1003, 5000])
def test_claim_by_prefix_counts(spark, n):
    keys = [f"{k * 2654435761 % 2**32:08x}" for k in range(1000)] + [None, None, "0000ab", "0000aa"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "fp string, i int")
    taken, left = claim(df, n)
    order = sorted(keys, key=lambda k: (k is not None, k or ""))
    got = [r.fp for r in taken.collect()]
    assert sorted(got, key=lambda k: (k is not None, k or "")) == order[:n]
    assert taken.count() + left.count() == len(keys) and taken.join(left, "i").count() == 0


def test_bucketed_edges_stay_where_they_are(spark):
    """A join on the buckets' key shuffles the tasks alone; rows are distinct and the catalogue is left as it was."""
    from pagetrawl.session import bucketed

    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), (None, "d")], "src string, dst string")
    with bucketed(edges, "src") as kept:
        tasks = spark.createDataFrame([("a",), ("x",)], "node string").hint("shuffle_hash")
        found = tasks.join(kept, tasks.node == kept.src)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange") < plan.index("FileScan")
        assert rows(found.select("node", "dst")) == [("a", "b"), ("a", "c")]
        assert kept.count() == 4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
