"""Every registered query against its SQL on the smallest tables, and its plan."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from pagetrawl.plans.oracle import ORACLE
from pagetrawl.plans.queries import QUERIES

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_works_without_the_subpackage():
    hide = (
        "import sys, importlib.abc\n"
        "class Hide(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('pagetrawl.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), len(e.oracle_sql()))"
    )
    root = os.path.dirname(os.path.abspath(entry.__file__))
    told = subprocess.run([sys.executable, "-c", hide], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert told == [str(len(QUERIES)), str(len(ORACLE))]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert compare(QUERIES[name](spark, SF), db, ORACLE[name]) == []


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["fp", "page_id", "pos", "target"] and found.count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["page_links", "cards_with_reject", "image_uri", "url_tail"])
def test_page_work_is_narrow(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["node_links", "gallery_images", "tracklist", "site_covers"])
def test_parsing_is_narrow_on_large_inputs(spark, name):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # then these tables are large
    try:
        assert "Exchange" not in plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "Exchange" in plan(QUERIES[name](spark, SF))  # small ones are spread over the cores


@pytest.mark.parametrize("name", ["frontier_product", "unseen", "fetch_join", "take_while", "latest_fields", "merge_sources"])
def test_no_products(spark, name):
    found = plan(QUERIES[name](spark, SF))
    assert "Cartesian" not in found and "NestedLoop" not in found


def test_scans_are_pruned(spark):
    tails = plan(QUERIES["url_tail"](spark, SF))
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", tails)
    bought = plan(QUERIES["unseen"](spark, SF))
    assert "EqualTo(event_type,click)" in bought


@pytest.mark.parametrize("name", ["link_tasks", "first_seen", "dup_report", "latest_fields", "retry_ledger"])
def test_groups_collapse_before_the_shuffle(spark, name):
    found = plan(QUERIES[name](spark, SF))
    assert found.count("partial_") >= 1 and found.index("Exchange") < found.index("partial_")
