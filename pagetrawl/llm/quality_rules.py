"""Quality rules: base counts of every text, then robust multivariate outliers per language and source.

Everything here is a column expression or an aggregate: no Python runs on the rows.

Base (fixed by contract): words are runs of ``[^\\x20\\x09-\\x0D]``; ``word_chars`` counts their code
points, ``n_symbols`` the characters of ``[#*$%&|<>]``, ``n_dup_lines`` the ``\\n``-split lines with a word
that equal an earlier line, ``n_repeat_words`` the words that lie in a 3-word window found twice or
more in the text (first one included). ``base_failed``: fewer than 50 words, or over half of them in
repeated windows.

Method: each document that passes the base rules becomes a vector of four transformed statistics
(log mean word length and the arcsine square roots of the symbol share, the duplicate line share and
the repeated word share). Per (lang, source) a minimum-covariance-determinant estimate is found by
C-steps: from a coordinate-wise median and MAD start, keep the ``H_FRACTION`` of rows nearest by
Mahalanobis distance and re-estimate mean and covariance from them; each step lowers the determinant.
The last estimate is scaled for consistency (median distance to that of chi-square), re-estimated
from the rows within the chi-square 0.975 quantile (reweighting) and scaled again; documents
farther than the chi-square quantile ``CUTOFF`` are rejected. A (lang, source) with fewer than
``MIN_ROWS`` documents uses its language's estimate, and a language with fewer the estimate of all.
Distances are solved through a Cholesky factor written out as column expressions.

Scale: counts and windows are array functions within a row (a sort of the 3-word windows, no
quadratic search). Estimates are mergeable aggregates (means, co-moments, percentile sketches), so
a group with a third of all rows is pre-aggregated in every task; the per-group tables, one row per
group, are broadcast when their counted size allows it, else joined with a salt.

Cases: a null or empty text has no words and fails the base rules. Null lang or source is a value of
its own. Repeated rows are scored alike. Only ``doc_id``, ``text``, ``lang`` and ``source`` are read.
Quantiles come from Spark's percentile sketch at ``ACCURACY``: exact up to that many rows a group,
within a rank error of ``1 / ACCURACY`` beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: white space of words, symbol characters, base thresholds.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

# Parameters of the method.
H_FRACTION = 0.75  # rows kept by each C-step
C_STEPS = 4
FLOOR = 0.01  # added to each variance of the transformed statistics: a spread of 0.1 that no group goes below
MIN_ROWS = 40
ACCURACY = 10_000
DIMS = 4
MEDIAN_CHI2 = 3.356694  # chi-square median, 4 degrees of freedom
CUTOFF = 18.46683  # chi-square 0.999 quantile, 4 degrees of freedom
REWEIGHT = 11.14329  # chi-square 0.975 quantile, 4 degrees of freedom: rows of the reweighted estimate
BROADCAST_GROUPS = 200_000
SALTS = 32


def base_counts(text: Column) -> dict[str, Column]:
    """The base statistics of ``text`` as columns (null: no words)."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD + "+"), 0)
    n = F.size(words)
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD))
    return {
        "words": words,
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }


def windows(words: Column) -> Column:
    """The 3-word windows of ``words`` as ``(t, i)``, sorted by text: equal windows are neighbours."""
    made = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, F.lit(3))).alias("t"), i.alias("i")),
    )
    return F.when(F.size(words) >= 3, F.array_sort(made)).otherwise(F.array().cast("array<struct<t:string,i:int>>"))


def repeated_words(windows: str) -> Column:
    """Words in 3-word windows that occur twice or more (first occurrence included); a word counts once."""
    starts = F.expr(
        f"filter(transform({windows}, (x, k) -> if(coalesce(get({windows}, k - 1).t = x.t, false)"
        f" or coalesce(get({windows}, k + 1).t = x.t, false), x.i, -1)), s -> s >= 0)"
    )
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(s, s + 1, s + 2))))).cast("long")


def with_base(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the base counts and ``base_failed`` of every row of ``docs``."""
    counts = base_counts(F.col("text"))
    rows = docs.select("doc_id", "lang", "source", *[c.alias(k) for k, c in counts.items()])
    rows = rows.withColumn("w", windows(F.col("words")))
    rows = rows.withColumn("n_repeat_words", repeated_words("w")).drop("w", "words")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return rows.withColumn("base_failed", failed)


def _share(part: str, whole: str) -> Column:
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))


def statistics(rows: DataFrame) -> list[Column]:
    """The transformed statistics ``x0 .. x3`` of rows with base counts."""
    return [
        F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))).alias("x0"),
        _share("n_symbols", "word_chars").alias("x1"),
        _share("n_dup_lines", "n_lines").alias("x2"),
        _share("n_repeat_words", "n_words").alias("x3"),
    ]


def attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row per ``key``): broadcast if its rows are few, else salted."""
    if table.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(table), key)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(spread, [key, "_salt"]).drop("_salt")


def _estimate(frame: DataFrame) -> DataFrame:
    """Mean and Cholesky factor (as ``m*`` and ``l*`` columns) per ``key`` of the rows of ``frame``."""
    aggs = [F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMS)]
    aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    return _factored(frame.groupBy("key").agg(*aggs))


def _factored(stats: DataFrame, scale: Column | None = None) -> DataFrame:
    """Stats with the lower Cholesky factor ``l{i}{j}`` of ``c * scale + FLOOR * I``, entry by entry."""
    keep = ["key", *[f"m{i}" for i in range(DIMS)], *[f"c{i}{j}" for i in range(DIMS) for j in range(i + 1)]]
    out = stats.select(*keep, *([scale.alias("_scale")] if scale is not None else []))
    for i in range(DIMS):
        for j in range(i + 1):
            c = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0))
            if scale is not None:
                c = c * F.col("_scale")
            s = c + (F.lit(FLOOR) if i == j else F.lit(0.0))
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l{j}{j}"))
    return out.drop("_scale")


def distance(prefix_m: str = "m", prefix_l: str = "l") -> Column:
    """Squared Mahalanobis distance of ``x*`` by forward substitution through ``l*``."""
    y = []
    for i in range(DIMS):
        s = F.col(f"x{i}") - F.col(f"{prefix_m}{i}")
        for k in range(i):
            s = s - F.col(f"{prefix_l}{i}{k}") * y[k]
        y.append(s / F.col(f"{prefix_l}{i}{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _start(frame: DataFrame) -> DataFrame:
    """Coordinate-wise median and MAD per key: a diagonal start."""
    medians = frame.groupBy("key").agg(*[F.percentile_approx(f"x{i}", 0.5, ACCURACY).alias(f"m{i}") for i in range(DIMS)])
    spread = attach(frame, medians, "key").groupBy("key").agg(
        *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, ACCURACY).alias(f"s{i}") for i in range(DIMS)]
    )
    stats = medians.join(spread, "key")
    cols = {f"c{i}{j}": (F.pow(F.col(f"s{i}") * 1.4826, 2) if i == j else F.lit(0.0)) for i in range(DIMS) for j in range(i + 1)}
    return _factored(stats.select("key", *[f"m{i}" for i in range(DIMS)], *[v.alias(k) for k, v in cols.items()]))


def mcd(frame: DataFrame, steps: int = C_STEPS) -> DataFrame:
    """Per ``key`` of ``frame (doc_id, key, x0..x3, ...)``: the final mean and factor after C-steps and consistency scaling."""
    from pagetrawl.session import settle

    est = settle(_start(frame), "mcd-start")
    stat_cols = [f"m{i}" for i in range(DIMS)] + [f"c{i}{j}" for i in range(DIMS) for j in range(i + 1)] + [f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)]
    for step in range(steps):
        scored = attach(frame, est, "key").withColumn("d2", distance()).drop(*stat_cols)
        limit = scored.groupBy("key").agg(F.percentile_approx("d2", H_FRACTION, ACCURACY).alias("limit"))
        near = attach(scored, limit, "key").where(F.col("d2") <= F.col("limit"))
        est = settle(_estimate(near), f"mcd-step-{step}")
    raw = _consistent(frame, est, "mcd-raw")
    # reweighting: a classical estimate from the rows the raw one does not flag
    near = attach(frame, raw, "key").withColumn("d2", distance()).where(F.col("d2") <= F.lit(REWEIGHT)).drop(*stat_cols, "d2")
    return _consistent(frame, settle(_estimate(near), "mcd-reweighted"), "mcd-final")


def _consistent(frame: DataFrame, est: DataFrame, label: str) -> DataFrame:
    """``est`` scaled so that the median distance of all rows of a key is that of chi-square."""
    from pagetrawl.session import settle

    scored = attach(frame, est, "key").withColumn("d2", distance())
    middle = scored.groupBy("key").agg(F.percentile_approx("d2", 0.5, ACCURACY).alias("med"))
    factor = F.greatest(F.col("med"), F.lit(1e-12)) / F.lit(MEDIAN_CHI2)
    return settle(_factored(est.join(middle, "key"), factor), label)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, source, n_words, the four base counts, base_failed, distance, kept."""
    from pagetrawl.session import settle

    base = settle(with_base(docs.select("doc_id", "text", "lang", "source")), "rules-base")
    passing = base.where(~F.col("base_failed"))
    by_pair = F.concat(F.lit("1"), F.to_json(F.struct("lang", "source")))
    by_lang = F.concat(F.lit("2"), F.to_json(F.struct("lang")))
    pairs = passing.groupBy(by_pair.alias("pair"), by_lang.alias("lang_key")).agg(F.count("*").alias("n_pair"))
    langs = pairs.groupBy("lang_key").agg(F.sum("n_pair").alias("n_lang"))
    keys = pairs.join(langs, "lang_key").select(
        "pair",
        F.when(F.col("n_pair") >= MIN_ROWS, F.col("pair")).when(F.col("n_lang") >= MIN_ROWS, F.col("lang_key")).otherwise(F.lit("3")).alias("key"),
    )
    keyed = attach(passing.withColumn("pair", by_pair), keys, "pair").drop("pair")
    frame = settle(keyed.select("*", *statistics(keyed)), "rules-frame")
    est = mcd(frame)
    scored = attach(frame, est, "key").withColumn("distance", distance())
    judged = scored.withColumn("kept", F.col("distance") <= F.lit(CUTOFF))
    failed = base.where(F.col("base_failed")).withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    out = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    return judged.select(*out).unionByName(failed.select(*out))
