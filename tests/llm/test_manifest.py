"""Merkle manifest against a plain tree built in Python, with the odd cases of its contract."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pagetrawl.llm import merkle, queries
from pagetrawl.session import TEXT_ROWS

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, _n int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fld(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([H(*cur[i : i + fanout]) for i in range(0, len(cur), fanout)])
    return levels


def path(levels, i, fanout):
    segs = []
    for level in levels[:-1]:
        s = i // fanout * fanout
        run = level[s : s + fanout]
        segs.append(("".join(run[: i - s]), "".join(run[i - s + 1 :])))
        i //= fanout
    return segs


def brute(rows, fanout, tampered):
    """doc_id -> (leaf, subroot, root, proof, folded root) by the contract, rows as (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        leaf = H(*map(fld, r))
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, leaf), r, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = []
    per_group = {}
    for g in names:
        members = sorted(groups[g], key=lambda x: x[0])
        levels = levels_of([m[2] for m in members], fanout)
        per_group[g] = (members, levels)
        tops.append(levels[-1][0])
    top_levels = levels_of(tops, fanout)
    root = top_levels[-1][0]
    out = []
    for k, g in enumerate(names):
        members, levels = per_group[g]
        above = path(top_levels, k, fanout)
        for i, (_, r, leaf) in enumerate(members):
            segs = path(levels, i, fanout) + above
            proof = H(*[a + b for a, b in segs])
            acc = tampered(r) or leaf
            for a, b in segs:
                acc = H(a, acc, b)
            out.append((r[0], leaf, levels[-1][0], root, proof, acc, acc == root))
    return sorted(out, key=str)


def lowered(r):
    if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5:
        return None
    text = None if r[4] is None else r[4].translate(str.maketrans(queries.UPPER, queries.LOWER))
    return H(*map(fld, (*r[:4], text)))


def fixture_rows():
    rows = [(i, f"s{i % 3}", "en", 5, f"Text Nr {i}") for i in range(300)]
    rows += [(1000, "alone", None, None, None), (None, None, "de", 0, ""), (None, None, "de", 0, ""), (7, "s1", "en", 5, "Text Nr 7")]
    rows += [(2000 + i, "é-bytes", "fr", 20_000, "Ä" * 20_000) for i in range(3)] + [(3000, "s0", "en", 2, "AB")]
    return rows


@pytest.mark.parametrize("fanout", [16, 4, 2])
def test_manifest_matches_a_plain_tree(spark, fanout):
    rows = fixture_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = [F.translate("text", queries.UPPER, queries.LOWER) if c == "text" else F.col(c) for c in queries.LEAF_FIELDS]
    found = merkle.manifest(df, "doc_id", "source", queries.LEAF_FIELDS, F.when(hit, merkle.leaf_digest(*low)), fanout=fanout)
    got = sorted((tuple(r) for r in found.proofs.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    expected = brute(rows, fanout, lowered)
    assert got == expected
    assert found.root == expected[0][3]
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_lone_row_and_empty_table(spark):
    one = spark.createDataFrame([(5, "a", "en", 1, "x")], SCHEMA.split(", leaf")[0])
    found = merkle.manifest(one, "doc_id", "source", queries.LEAF_FIELDS)
    (r,) = found.proofs.collect()
    assert r.leaf == r.subroot == r.root == found.root and r.proof_sha256 == H() and r.verified
    empty = merkle.manifest(one.limit(0), "doc_id", "source", queries.LEAF_FIELDS)
    assert empty.root is None and empty.proofs.count() == 0


def test_query_on_the_given_table(spark):
    got = queries.op11_merkle(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*queries.LEAF_FIELDS).collect()]
    assert sorted((tuple(r) for r in got.drop("source").collect()), key=str) == brute(rows, 16, lowered)


def test_texts_are_read_in_short_batches(spark, tmp_path):
    """The Parquet reader of the leaves holds few whole texts at once, unless the session names a number."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    rows = [(i, f"s{i % 2}", "en", 2000, f"Text {i} " * 200) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA.split(", leaf")[0]).write.parquet(str(tmp_path / "documents.parquet"))
    named = spark.conf.get(key) if key in spark.conf.getAll else None
    try:
        for before, after in ((None, TEXT_ROWS), ("1000", "1000")):
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
            got = queries.op11_merkle(spark, str(tmp_path))
            assert sorted((tuple(r) for r in got.drop("source").collect()), key=str) == brute(rows, 16, lowered)
            assert spark.conf.get(key) == after
    finally:
        spark.conf.unset(key) if named is None else spark.conf.set(key, named)
