"""Quality rules: base counts against plain Python, C-steps against numpy, and the odd cases."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrawl.llm import quality_rules as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dup = len(lines) - len(set(lines))
    tri = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for t in tri:
        counts[t] = counts.get(t, 0) + 1
    covered = {j for i, t in enumerate(tri) if counts[t] >= 2 for j in (i, i + 1, i + 2)}
    chars = sum(len(w) for w in words)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), chars, symbols, dup, len(covered), failed


ODD = [None, "", " ", "\t\n", "a b c a b c a b c", "x\ny\nx\n\nx \nx", "#*$%&|<> <>", "Ä𝔘 ß  z", "w " * 60, ("one two three " * 30).strip()]


def test_base_counts_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(10_000 + k, t, "xx", None) for k, t in enumerate(ODD)], docs.schema)
    both = docs.unionByName(odd)
    got = {r.doc_id: tuple(r)[1:] for r in q.with_base(both).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    for doc_id, text in both.select("doc_id", "text").collect():
        assert got[doc_id] == base(text), doc_id


def percentile(values, p):
    """Spark's percentile: the least value with at least ``p`` of all values at or below it."""
    v = np.sort(values)
    return v[max(0, math.ceil(p * len(v)) - 1)]


def estimate(x, mean, cov):
    z = np.linalg.solve(np.linalg.cholesky(cov + q.FLOOR * np.eye(q.DIMS)), (x - mean).T)
    return (z * z).sum(axis=0)


def brute_mcd(x):
    med = np.array([percentile(x[:, i], 0.5) for i in range(q.DIMS)])
    mad = np.array([percentile(np.abs(x[:, i] - med[i]), 0.5) for i in range(q.DIMS)])
    mean, cov = med, np.diag((mad * 1.4826) ** 2)
    for _ in range(q.C_STEPS):
        d2 = estimate(x, mean, cov)
        near = x[d2 <= percentile(d2, q.H_FRACTION)]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True)

    def consistent(mean, cov):
        return mean, cov * max(percentile(estimate(x, mean, cov), 0.5), 1e-12) / q.MEDIAN_CHI2

    mean, cov = consistent(mean, cov)
    near = x[estimate(x, mean, cov) <= q.REWEIGHT]
    mean, cov = consistent(near.mean(axis=0), np.cov(near.T, bias=True))
    return estimate(x, mean, cov)


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal([1.5, 0.05, 0.1, 0.2], [0.1, 0.03, 0.05, 0.08], (300, 4)), rng.normal([2.5, 0.6, 0.5, 0.5], 0.05, (12, 4))])
    frame = spark.createDataFrame([(i, "k", *map(float, v)) for i, v in enumerate(x)], "doc_id long, key string, x0 double, x1 double, x2 double, x3 double")
    est = q.mcd(frame)
    got = {r.doc_id: r.d for r in q.attach(frame, est, "key").select("doc_id", q.distance().alias("d")).collect()}
    expected = brute_mcd(x)
    assert np.allclose([got[i] for i in range(len(x))], expected, rtol=1e-6, atol=1e-6)
    assert (expected[300:] > q.CUTOFF).all() and (expected[:300] > q.CUTOFF).mean() < 0.02


def test_rules_on_the_given_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = "\n".join("<< ### %% $$ && || ** >> " + w for w in ("alpha beta gamma delta " * 20).split())
    odd = spark.createDataFrame(
        [(20_000 + k, t, "en", "src0", 0) for k, t in enumerate([*ODD, junk])] + [(None, None, None, None, None), (1, "x", "en", "src0", 1)],
        docs.schema,
    ).withColumn("key", F.lit("clash")).withColumn("x0", F.lit(1.0))
    both = docs.withColumn("key", F.lit("clash")).withColumn("x0", F.lit(1.0)).unionByName(odd)
    got = q.quality_rules(both)
    assert got.count() == both.count()
    by_id = {r.doc_id: r for r in got.where("doc_id >= 20000").collect()}
    assert not by_id[20_000 + len(ODD)].kept  # symbols: far from every group
    assert all(not r.kept for r in got.where("base_failed").collect())
    clean = got.where("not base_failed")
    assert clean.where("kept").count() >= 0.9 * clean.count()
    assert q.quality_rules(docs.limit(0)).count() == 0
